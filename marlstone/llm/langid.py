"""Language identification by words first, then ever shorter character n-grams.

Learning counts words by language over a bounded, seeded sample of labelled rows and keeps, for every language, its most frequent words
and the n-grams of all words. Runs of more than LONG letters, as of texts without blanks, are learned by their n-grams only. A known word scores by
its log frequency in each language. An unseen word or long run backs off to the longest n-grams (5 to 1 characters, with word borders) of its whole
length of which any is known. A text's score is the posterior of its best language.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, discard, give_back, kept_for, stage, text_batches

#: Runs of letters; learning and predicting leave out words of the few non-letters that this class also takes.
WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows of each language that a model learns from, at most.
ROWS_PER_LANGUAGE = 4000
#: Words of each language, and n-grams in all, that a model keeps at most.
WORDS_PER_LANGUAGE = 50_000
GRAMS = 200_000
#: Numbers in a model's table of words, about: with many languages each has fewer words, but never less than LEAST_WORDS.
CELLS, LEAST_WORDS = 1 << 26, 100
LONGEST = 5
#: Letters of a run that is a word, at most.
LONG = 40
#: n-grams of a long run, and words of a model that is being built, that are held at once.
PIECE, SOME = 1 << 16, 1 << 14
#: Words of a text that count as independent evidence in the posterior, at most.
EVIDENCE = 40


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def pieces(word: str, n: int) -> Iterator[list[str]]:
    """The n-grams of a whole run, PIECE at a time."""
    w = f"^{word}$"
    last = len(w) - n + 1
    for at in range(0, last, PIECE):
        yield [w[i : i + n] for i in range(at, min(at + PIECE, last))]


def _counted(found: Counter, most: int) -> Iterator[pa.RecordBatch]:
    if len(found) > most:
        langs, sizes, words = zip(*found, strict=True)
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], ["lang", "size", "word", "n"])
        found.clear()


#: Texts that are taken out of an Arrow batch at once.
TEXTS = 200


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_for("langid")
    found: Counter = Counter()
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            langs, texts = (batch.column(k).slice(at, TEXTS).to_pylist() for k in (0, 1))
            for lang, text in zip(langs, texts, strict=True):
                words = tokens(text)
                found.update((lang, 0, w) for w in words if len(w) <= LONG and any(map(str.isalpha, w)))
                yield from _counted(found, 200_000)
                for w in words:
                    if len(w) > LONG and any(map(str.isalpha, w)):
                        for size in range(1, LONGEST + 1):
                            for own in pieces(w, size):
                                found.update((lang, size, g) for g in own)
                                yield from _counted(found, 200_000)
    yield from _counted(found, 0)
    give_back()


class Model:
    """Centred log frequencies: ``words`` and ``grams`` (by size) map to rows of ``table``, one column a language. Row 0 is all zeros."""

    def __init__(self, counts: pa.Table, langs: list[str]):
        self.langs = langs
        sizes, cols, times = (x.to_numpy() for x in (counts["size"], pc.index_in(counts["lang"], pa.array(langs, counts["lang"].type)), counts["n"]))
        of = [np.flatnonzero(sizes == size) for size in range(LONGEST + 1)]  # 0: words; others: n-grams of long runs
        words = counts["word"].take(pa.array(of[0])).to_pylist()
        tables, first, kept = [np.zeros((1, len(langs)), np.float32)], 1, []
        for size in range(LONGEST + 1):  # words themselves are of size 0 here; one size is held at a time
            own: dict[str, int] = {}
            table = np.zeros((0, len(langs)))
            runs = counts["word"].take(pa.array(of[size])).to_pylist() if size else []
            for names, at, cut in ((words, of[0], size), (runs, of[size], 0)):
                for k in range(0, len(names), SOME):
                    rows, widths = array("q"), array("q")
                    for word in names[k : k + SOME]:
                        found = grams(word, cut) if cut else (word,)
                        rows.extend(own.setdefault(g, len(own)) for g in found)
                        widths.append(len(found))
                    if len(own) > len(table):
                        grown = np.zeros((max(len(own), 2 * len(table)), len(langs)))
                        grown[: len(table)] = table
                        table = grown
                    cells = np.frombuffer(rows, np.int64) * len(langs) + np.repeat(cols[at[k : k + SOME]], widths)
                    np.add.at(table.reshape(-1), cells, np.repeat(times[at[k : k + SOME]].astype(np.float64), widths))
            names, total = list(own), table[: len(own)].sum(1)
            most = min(len(own), len(own) if not size else GRAMS // LONGEST)
            some = np.flatnonzero(total >= np.partition(total, -most)[-most]).tolist() if most else []
            some = np.array(sorted(some, key=names.__getitem__), np.int64)
            order = some[np.argsort(-total[some], kind="stable")][:most]  # by total, then by name
            table = table[order]
            logs = np.log((table + 0.1) / (table.sum(0) + 0.1 * max(1, len(table))))
            tables.append((logs - logs.mean(1, keepdims=True)).astype(np.float32) if len(langs) else logs.astype(np.float32))
            kept.append({names[i]: first + k for k, i in enumerate(order.tolist())})
            first += len(order)
        self.words, self.grams, self.table = kept[0], kept, np.concatenate(tables)

    def parts(self) -> tuple:
        """The model as plain values: a broadcast of these can be read where this package isn't installed."""
        return self.langs, self.words, self.grams, self.table

    @staticmethod
    def of(parts: tuple) -> Model:
        out = Model.__new__(Model)
        out.langs, out.words, out.grams, out.table = parts
        return out

    def backoff(self, word: str) -> list[int]:
        """Rows of the longest n-grams of which any is known; row 0 if not even a single character is."""
        for size in range(min(LONGEST, len(word) + 2), 0, -1):
            known = self.grams[size]
            if found := [known[g] for g in grams(word, size) if g in known]:
                return found
        return [0]

    def mean(self, run: str) -> np.ndarray:
        """The mean of the rows of :meth:`backoff`, for a run of any length."""
        for size in range(min(LONGEST, len(run) + 2), 0, -1):
            known, n, total = self.grams[size], 0, np.zeros(self.table.shape[1])
            for own in pieces(run, size):
                if rows := [known[g] for g in own if g in known]:
                    total += self.table[rows].sum(0, dtype=np.float64)
                    n += len(rows)
            if n:
                return total / n
        return self.table[0]


class Predictor:
    """Scores texts; vectors of words that the model doesn't know are kept until they have CACHED letters in all, or a tenth as many words."""

    CACHED = 2_000_000

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index, self.table, self.used, self.letters = dict(self.model.words), self.model.table, len(self.model.table), 0

    def _add(self, words: list[str]) -> None:
        known = [w for w in words if any(map(str.isalpha, w))]
        self.letters += sum(map(len, words))
        self.index.update((w, -1) for w in words)
        if not known:
            return
        rows = [self.model.backoff(w) if len(w) <= LONG else [0] for w in known]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((r for own in rows for r in own), np.int64, int(sizes.sum()))
        new = np.add.reduceat(self.model.table[flat], np.concatenate(([0], np.cumsum(sizes)[:-1]))) / sizes[:, None]
        for i, w in enumerate(known):
            if len(w) > LONG:
                new[i] = self.model.mean(w)
        if self.used + len(new) > len(self.table):
            grown = np.empty((2 * len(self.table) + len(new), new.shape[1]), np.float32)
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        elif self.table is self.model.table:
            self.table = self.table.copy()
        self.table[self.used : self.used + len(new)] = new
        self.index.update(zip(known, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for at in range(0, len(texts), 200):
            found = [Counter(tokens(t)) if t and self.model.langs else None for t in texts[at : at + 200]]
            new: set[str] = set()
            for f in found:
                if f:
                    new.update(f)
            words = list(new)
            if self.letters > self.CACHED or len(self.index) > len(self.model.words) + self.CACHED // 10:
                self.forget()
            self._add([w for w in words if w not in self.index])
            for f in found:
                lang, score = "und", 0.0
                if f:
                    rows = np.fromiter(map(self.index.__getitem__, f), np.int64, len(f))
                    k = np.fromiter(f.values(), np.float32, len(f))
                    if rows.min() < 0:
                        rows, k = rows[rows >= 0], k[rows >= 0]
                    if n := float(k.sum()):
                        total = (k @ self.table[rows]).astype(np.float64) * min(1.0, EVIDENCE / n)
                        p = np.exp(total - total.max())
                        best = int(p.argmax())
                        lang, score = self.model.langs[best], float(p[best] / p.sum())
                langs.append(lang)
                scores.append(score)
        return langs, scores


def learn(docs: DataFrame, where: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """A model of the rows that ``where`` admits and whose language and text aren't null.

    The sample takes at most about ROWS_PER_LANGUAGE rows of each language by a seeded hash of the id. Only counts reach the driver: of each language its
    most frequent words, WORDS_PER_LANGUAGE of them or as many as CELLS allows, and, of each size, as many of the most frequent n-grams of long runs as a model keeps in all.
    Repeated rows count as often as they occur; extra columns are ignored. Without any labelled row, as of an empty table, the model knows no language and answers ``und``.
    """
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    scale = 1 << 30
    share = stage(rows.groupBy("lang").agg(F.expr(f"least({scale}, {scale * ROWS_PER_LANGUAGE} div count(*))").alias("share")), "languages")
    langs = max(1, share.count())
    most = max(LEAST_WORDS, min(WORDS_PER_LANGUAGE, CELLS // langs**2))
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(scale)) < F.col("share"))  # one row a language
    counts = picked.select("lang", "text").mapInArrow(_count, "lang string, size int, word string, n long").groupBy("lang", "size", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "word"))
    with text_batches(docs.sparkSession):
        kept = counts.withColumn("r", rank).where(f"r <= if(size = 0, {most}, {GRAMS // LONGEST})").drop("r").toArrow()
    discard(share)
    model = Model(kept, sorted(kept["lang"].unique().to_pylist()))
    del kept
    give_back()
    return model


VERDICT = "struct<lang_pred:string,score:double>"


def verdict(spark: SparkSession, model: Model, text: Column) -> Column:
    """lang_pred and score of a whole text, as one struct. Only the texts go to Python workers."""
    shipped = spark.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept_for("langid")
        own = Predictor(Model.of(shipped.value))
        for batch in batches:
            langs, scores = [], []
            for at in range(0, len(batch), TEXTS):
                found = own.predict(batch.slice(at, TEXTS).to_pylist())
                langs += found[0]
                scores += found[1]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])
        del own
        give_back()

    return F.arrow_udf(run, VERDICT)(text)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with lang_pred and score (0 to 1) of the whole text.

    ``und`` with score 0 if the text is null or has no letter, or if the model knows no language. Very long texts are read whole.
    Ties go to the alphabetically first language. Only the text enters a prediction. Repeated rows each get theirs; an empty table gives no rows. A column of
    ``docs`` that is named lang_pred or score is replaced; columns of any other name are kept as they are.
    """
    found = verdict(docs.sparkSession, model, column(text_col))
    own = [column(c) for c in keep or docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(*own, found["lang_pred"].alias("lang_pred"), found["score"].alias("score"))
