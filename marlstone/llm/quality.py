"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + <w, x> + sum over pairs i < j of <v_i, v_j> x_i x_j), the pair sum by the identity
``(|sum v_i x_i|**2 - sum |v_i|**2 x_i**2) / 2``: linear in the features that a text has.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, discard, give_back, stage

#: Buckets of hashed words, rank of the interactions.
BUCKETS, RANK = 2048, 8
#: Labelled rows that a model is fitted on, about, picked by a seeded hash of the id.
TRAINING_ROWS = 8000
#: Words of 64 letters at most whose buckets a task keeps.
KEPT_WORDS = 200_000
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.02, 1e-4

_KIND = np.zeros(256, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 new line, 5 beyond ASCII, 6 full stop or comma, 7 other marks
_KIND[[*range(0, 97), *range(123, 128)]] = 7
_KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:], _KIND[[44, 46]] = 1, 2, 3, 4, 5, 6
STATISTICS = 26
#: The last ones are metadata: the table's own character count, and whether it is there.
METADATA = 2
SIZE = BUCKETS + STATISTICS + METADATA


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, m = max(1, len(raw)), max(1, len(words))
    share = np.bincount(_KIND[raw], minlength=8) / n
    top = [c for _, c in counts.most_common(10)]
    lines = [x for x in text.split("\n") if x.strip()]
    q = max(1, len(lines))
    stops = text.count(".") + text.count("!") + text.count("?")
    freq = np.bincount(raw, minlength=256) / n
    freq = freq[freq > 0]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / m, *share,
        len(counts) / m, (top[0] if top else 0) / m, sum(top) / m, sum(c == 1 for c in counts.values()) / m,
        len(set(lines)) / q, np.log1p(len(lines)), np.log1p(len(text) / q), sum(x.rstrip()[-1] in ".!?" for x in lines) / q,
        sum(not any(map(str.isalnum, w)) for w in counts) / max(1, len(counts)), sum(w[-1:] in "!#%$&*" for w in counts) / max(1, len(counts)),
        np.log1p(max(map(len, counts), default=0)), m / (1 + stops), float(-(freq * np.log(freq)).sum()), text.count("|") / m, text.count("!") / m,
    ]


def features(text: str | None, n_chars: float | None, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their weights (length 1 in all), then statistics and metadata, not yet standardised."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    bag: dict[int, float] = {}
    for w, c in counts.items():
        k = cache.get(w)
        if k is None:
            k = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS
            if len(w) <= 64:
                if len(cache) >= KEPT_WORDS:
                    cache.clear()
                cache[w] = k
        bag[k] = bag.get(k, 0.0) + c
    at = np.fromiter(bag, np.int32, len(bag))
    x = np.log1p(np.fromiter(bag.values(), np.float32, len(bag)))
    x /= max(1e-9, float(np.sqrt((x * x).sum())))
    known = n_chars is not None and n_chars == n_chars
    meta = [float(np.log1p(max(0.0, n_chars))) if known else 0.0, float(known)]
    return at, x, np.array(statistics(text, words, counts) + meta, np.float32)


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache: dict[str, int] = {}
    for batch in batches:
        got = [features(t, n, cache) for t, n in zip(batch["text"], batch["n_chars"], strict=True)]
        yield pd.DataFrame({"at": [g[0] for g in got], "x": [g[1] for g in got], "s": [g[2] for g in got], "y": batch["y"], "place": batch["place"]})


class Machine:
    """The fitted parameters. ``mean`` and ``scale`` standardise statistics and metadata."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale
        self.square = (v * v).sum(1)

    def standard(self, s: np.ndarray) -> np.ndarray:
        return np.clip((s - self.mean) * self.scale, -4, 4) * 0.4

    def parts(self) -> tuple:
        """The machine as plain values: a broadcast of these can be read where this package isn't installed."""
        return self.w0, self.w, self.v, self.mean, self.scale

    def score_all(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of rows of :func:`features`, to nine places, so that they don't depend on which rows come together."""
        if not rows:
            return np.empty(0)
        at = np.concatenate([np.append(r[0], 0) for r in rows])  # an entry of weight 0 ends each bag, so none is empty
        x = np.concatenate([np.append(r[1], 0) for r in rows]).astype(np.float64)
        first = np.cumsum([0, *[len(r[0]) + 1 for r in rows[:-1]]])
        z = self.standard(np.stack([r[2] for r in rows])).astype(np.float64)
        total = np.add.reduceat(x[:, None] * self.v[at], first) + z @ self.v[BUCKETS:]
        own = np.add.reduceat(x * x * self.square[at], first) + (z * z) @ self.square[BUCKETS:]
        y = self.w0 + np.add.reduceat(x * self.w[at], first) + z @ self.w[BUCKETS:] + 0.5 * ((total * total).sum(1) - own)
        return np.round(1 / (1 + np.exp(-np.clip(y, -30, 30))), 9)

    def score(self, at: np.ndarray, x: np.ndarray, s: np.ndarray) -> float:
        return float(self.score_all([(at, x, s)])[0])


def fit(rows: pd.DataFrame, seed: int = 6) -> Machine:
    """Adam on the log loss. Without rows, or with one label only, all scores are that label's share (0.5 without rows)."""
    n = len(rows)
    rng = np.random.default_rng(seed)
    stats = np.array(rows["s"].tolist(), np.float32).reshape(n, STATISTICS + METADATA)
    mean, scale = (stats.mean(0), 1 / np.maximum(stats.std(0), 1e-3)) if n else (np.zeros(STATISTICS + METADATA, np.float32), np.ones(STATISTICS + METADATA, np.float32))
    y = rows["y"].to_numpy(np.float32)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.5
    params = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)]
    machine = Machine(float(params[0][0]), params[1], params[2] * 0, mean, scale)
    if n < 2 or y.min() == y.max():
        return machine
    x = np.zeros((n, SIZE), np.float32)
    for i, (at, val) in enumerate(zip(rows["at"], rows["x"], strict=True)):
        x[i, np.asarray(at, np.int64)] = val
    x[:, BUCKETS:] = machine.standard(stats)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            b, t = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
            w0, w, v = params
            s, sq = b @ v, b * b
            out = w0 + b @ w + 0.5 * ((s * s).sum(1) - sq @ (v * v).sum(1))
            d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - t) / len(t)
            grads = [np.array([d.sum()], np.float32), b.T @ d + DECAY * w, b.T @ (d[:, None] * s) - v * (sq.T @ d)[:, None] + DECAY * v]
            step += 1
            rate = RATE * min(1.0, step / 50) / (1 + 3 * step * BATCH / (EPOCHS * n))
            for p, g, m1, m2 in zip(params, grads, first, second, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    return Machine(float(params[0][0]), params[1], params[2], mean, scale)


def learn(docs: DataFrame, labels: DataFrame, where: Column, label_col: str = "quality") -> Machine:
    """A machine fitted on about TRAINING_ROWS labelled rows that ``where`` (over doc_id) admits.

    Rows without a label, or whose id is null or not in ``docs``, teach nothing. Of repeated labels of an id the largest counts; rows that repeat an id each teach. Rows
    are put in the order of their texts' hashes, so the machine doesn't depend on how the tables lie in files. Without rows all scores are 0.5. Extra columns are ignored.
    """
    own = stage(labels.where(where & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("float").alias("y")), "labels")
    n = own.count()
    scale = 1 << 30
    picked = own.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(scale)) < min(scale, scale * TRAINING_ROWS // max(1, n)))
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).join(F.broadcast(picked), "doc_id")  # about TRAINING_ROWS rows of 12 bytes
    rows = rows.select("text", "n_chars", "y", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("place"))
    got = rows.mapInPandas(_featurise, "at array<int>, x array<float>, s array<float>, y float, place string").toPandas()
    discard(own)
    got["meta"] = [float(s[-2]) for s in got["s"]]
    return fit(got.sort_values(["place", "y", "meta"], kind="stable").reset_index(drop=True))


def scored(spark: SparkSession, machine: Machine, text: Column, n_chars: Column) -> Column:
    """The score of a whole text. Only texts and character counts go to Python workers."""
    shipped = spark.sparkContext.broadcast(machine.parts())

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own, cache = Machine(*shipped.value), {}
        for texts, counts in batches:
            out = []
            for at in range(0, len(texts), 500):
                rows = zip(texts.slice(at, 500).to_pylist(), counts.slice(at, 500).to_pylist(), strict=True)
                out.append(own.score_all([features(t, n, cache) for t, n in rows]))
            yield pa.array(np.concatenate(out) if out else [], pa.float64())
        give_back()

    return F.arrow_udf(run, "double")(text, n_chars.cast("double"))


def score(docs: DataFrame, machine: Machine, text_col: str = "text", n_chars_col: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5).

    A null text counts as empty and gets a score too; a null character count is a feature of its own. Whole texts are read, whatever their length. Repeated rows each get
    their score; an empty table gives no rows. A column of ``docs`` that is named score or predicted is replaced; columns of any other name are kept as they are.
    """
    own = [column(c) for c in keep or docs.columns if c.lower() not in ("score", "predicted")]
    found = docs.select(*own, scored(docs.sparkSession, machine, column(text_col), column(n_chars_col)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
