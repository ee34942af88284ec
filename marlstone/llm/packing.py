"""Packing of tokenised documents into sequences of a fixed size.

Only longer documents are cut. The histogram of piece lengths (at most one entry a length) goes to the driver. There, patterns of few pieces
that fill a sequence are enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded down, and the
residual is packed best-fit, longest first, on the histogram again. The plan's size depends on the sequence size alone. Pieces
of a length are numbered by salted ranks and take the plan's places in that order.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, kept_for, stage, text_batches

SEQUENCE = 2048
#: Closes every document.
END_ID = 0
#: Patterns that the fit considers, and its rounds.
PATTERNS, ROUNDS = 24_000, 400
#: Rows of a salt of a length, about.
SALT_ROWS = 1 << 19
#: Bytes of parts and their ids that a worker keeps, about, and the characters of the longest part.
_CACHED_BYTES, _CACHED_CHARS = 112 << 20, 64
#: Bytes of a kept part besides its own characters: two objects and an entry.
_ENTRY_BYTES = 190


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks that end a part without being part of a contraction or of a special token's opening.
MARKS = ".,;:!?#$%&*()[]{}+-=_/|>\"~^@`\\"
#: A part of Latin letters (all letters below U+0100) and trailing marks.
LATIN = r"\A(?P<core>[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[" + "".join("\\" + m for m in MARKS) + r"]*)\z"
#: Texts whose parts are looked up at once, and the words of a line.
_TEXTS, _LINE = 1000, 2000


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its parts between ASCII blanks, in order. Arrow splits texts, finds
    the distinct parts and strings their ids together; Python sees words only. Of a part, Latin letters and trailing marks are separate words to the
    tokenizer, and letters are lower-cased, so "Word," costs no entry besides "word" and ",". All other parts are words as they are.
    Words recur and are cached. The cache has two halves: once the younger one is full it becomes the older one, and what is used of the older one
    moves over. So it is bounded, and keeps what recurs. New words of Latin letters are encoded as one line; each ends at a token with the
    end-of-word suffix. All others are encoded by themselves.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        self.final = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
        self.final[[i for w, i in tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.aged: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of ``new`` words, which hold no blanks."""
        latin = [w for w in new if len(w) <= _CACHED_CHARS and w.isalpha() and (w.isascii() or max(w) < "\u0100")]
        other = list(set(new).difference(latin))
        out = dict(zip(other, self._ids(other), strict=True))
        for at in range(0, len(latin), _LINE):
            own = latin[at : at + _LINE]
            ids = np.array(self.encode([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.final[ids]) + 1)).tolist()
            if len(ends) != len(own):  # a tokenizer of another make
                out.update(zip(own, self._ids(own), strict=True))
                continue
            raw = ids.tobytes()
            out.update((w, raw[a:b]) for w, a, b in zip(own, [0, *ends], ends, strict=False))
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) * _ENTRY_BYTES > _CACHED_BYTES // 2:
            self.known, self.aged = {"": b""}, self.known
        out = list(map(self.known.get, words))
        new = [w for w, x in zip(words, out, strict=True) if x is None]
        if not new:
            return out
        found = {w: self.aged[w] for w in new if w in self.aged} if self.aged else {}
        found.update(self._learn([w for w in new if w not in found] if found else new))
        self.known.update((w, x) for w, x in found.items() if len(w) <= _CACHED_CHARS)
        return [found[w] if x is None else x for w, x in zip(words, out, strict=True)]

    def _parts(self, parts: pa.Array) -> pa.Array:
        """Ids of distinct parts."""
        latin = pc.extract_regex(parts, LATIN)
        words = pc.coalesce(pc.utf8_lower(pc.struct_field(latin, "core")), parts).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(latin, "tail"), "").dictionary_encode()
        ids = [pa.array(self._words(x.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(x.indices) for x in (words, tails)]
        return pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary()))

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each of ``texts`` (strings; null: empty)."""
        for at in range(0, len(texts), _TEXTS):
            split = pc.ascii_split_whitespace(pc.fill_null(texts.slice(at, _TEXTS).cast(pa.large_string()), ""))
            parts = split.flatten().dictionary_encode()
            own = self._parts(parts.dictionary).take(parts.indices)
            ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset :]
            raw = memoryview(own.buffers()[2] or b"")
            places = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
            del split, parts, own
            for a, b in zip(places, places[1:], strict=False):
                yield raw[a:b].tobytes()


def _cut(path: str, size: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = kept_for("packing")
        encoder = kept.get(path) or kept.setdefault(path, Encoder(path))
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                doc, piece, start, length, crc, ids = ([] for _ in range(6))
                for i, raw in enumerate(encoder.ids(part.column(1))):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * size)):
                        own = raw[a : a + 4 * size]
                        doc.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                columns = [part.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.record_batch([*columns, pa.array(ids, pa.binary())], [*names, "ids"]) if with_ids else pa.record_batch(columns, names)
        give_back()

    return run


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of up to four lengths (0: none) that exist and fill ``size`` exactly or as nearly as the last one can."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    below = np.maximum.accumulate(np.where(have, np.arange(size + 1), 0))  # the longest existing length up to each
    out = [(int(a), int(below[size - a]), 0, 0) for a in lengths]
    wide = lengths[np.unique(np.linspace(0, len(lengths) - 1, max(1, PATTERNS // max(1, 2 * len(lengths)))).astype(int))]
    for b in wide:
        a = lengths[lengths + b <= size]
        c = below[size - a - b]
        out += zip(a.tolist(), [int(b)] * len(a), c.tolist(), [0] * len(a), strict=True)
        d = below[(size - a - b) // 2]
        e = below[size - a - b - d]
        out += zip(a.tolist(), [int(b)] * len(a), d.tolist(), e.tolist(), strict=True)
    rows = np.unique(-np.sort(-np.array(out, np.int64), 1), axis=0)
    full = rows.sum(1)
    return rows[(full <= size) & (full >= size - size // 64)]


def fit(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """x >= 0 that makes the lengths used by x repeats of each pattern close to the histogram, in least squares, by multiplicative updates."""
    mark = (rows > 0).astype(float)

    def down(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (mark * x[:, None]).ravel(), minlength=len(histogram))

    def up(r: np.ndarray) -> np.ndarray:
        return (r[rows] * mark).sum(1)

    goal = up(histogram.astype(float))
    x = np.full(len(rows), histogram.sum() / max(1, 3 * len(rows)))
    for _ in range(ROUNDS):
        x *= goal / np.maximum(up(down(x)), 1e-9)
    return x


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, copies)]) for the sequences that hold every piece of ``histogram`` (length -> count) exactly once."""
    left = np.zeros(size + 1, np.int64)
    for k, n in histogram.items():
        left[k] = n
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if left[size]:
        out.append((int(left[size]), [(size, 1)]))
        left[size] = 0
    lengths = np.flatnonzero(left)
    rows = patterns(lengths, size) if len(lengths) else np.empty((0, 4), np.int64)
    if len(rows):
        x = fit(rows, left)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 1:
                break
            used, copies = np.unique(rows[i][rows[i] > 0], return_counts=True)
            times = int(min(np.floor(x[i]), (left[used] // copies).min()))
            if times > 0:
                left[used] -= times * copies
                out.append((times, [(int(u), int(c)) for u, c in zip(used[::-1], copies[::-1], strict=True)]))
    present = [int(k) for k in np.flatnonzero(left)]  # ascending
    from bisect import bisect_right

    while present:
        room, own = size, []
        at = len(present)
        while room and (at := bisect_right(present, room, 0, at)):
            k = present[at - 1]
            copies = int(min(room // k, left[k]))
            if own:
                own.append((k, copies))
            else:
                copies = 1 if 2 * k > size else copies
                own.append((k, copies))
            room -= copies * k
            at -= 1
        times = int(min(left[k] // c for k, c in own))
        for k, c in own:
            left[k] -= times * c
        out.append((times, own))
        present = [k for k in present if left[k]]
    return out


def places(found: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset, copies a sequence), by length and rank."""
    rows, used, sequence = [], {}, 0
    for times, own in found:
        offset = 0
        for k, copies in own:
            rows.append((k, used.get(k, 0), times * copies, sequence, offset, copies))
            used[k] = used.get(k, 0) + times * copies
            offset += k * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _place(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("places")  # all texts are encoded by now
        table = shipped.value
        keys = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(k)).to_numpy() for k in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 48) | rank, "right") - 1] if len(batch) else np.empty((0, 6), np.int64)
            t = rank - row[:, 1]
            keep = [k for k in names if k != "rank"]
            yield pa.record_batch([*(batch.column(names.index(k)) for k in keep), pa.array(row[:, 3] + t // row[:, 5]), pa.array(row[:, 4] + t % row[:, 5] * length)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = SEQUENCE, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``ids`` (binary, little-endian) too if asked for.

    Null and empty texts are one piece of the closing id. A document of more than ``size`` ids is cut into pieces of ``size``, the last
    may be shorter; no other is cut. Offsets of a sequence are gapless from 0. Rows that repeat an id, or have a null id, are packed as
    documents of their own. Extra columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    with text_batches(docs.sparkSession):
        pieces = stage(rows.mapInArrow(_cut(tokenizer or default_tokenizer(), size, end_id, with_ids), schema), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    table = places(plan(histogram, size))
    shipped = docs.sparkSession.sparkContext.broadcast(table)
    salts = max(64, sum(histogram.values()) // SALT_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).select("length", "salt", "before")
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("rn", number).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rn") - 1).select(*pieces.columns, "rank")
    return ranked.mapInArrow(_place(shipped), f"{schema}, sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and its ids (binary) from the result of :func:`pack` with ids: at most one sequence's ids a group."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.aggregate(own, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
