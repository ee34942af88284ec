"""Exact de-duplication as a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt into runs by a seeded hash of their id: 64, or eight times as many for each 2**23 rows a run. Within a run, a sort aggregate by digest leaves one
entry per distinct text: the best row and a count. In each following round eight neighbouring runs merge into one (64, 8, 1), again
by digest, and each level keeps the smallest verified entry. A digest only merges with entries that agree on SHA-256, on a second
64-bit hash and on the normalised length. The verdicts then travel down: the root's entry of a digest to its
run entries, and those to the rows. No task ever gathers the rows of a group: a group with a third of all
rows reaches a round as at most one entry a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage, without, without_blanks

#: Bits of the seeded hash that deals rows into runs; RUN_BITS of them are used, and ROUND_BITS more for each RUN_ROWS-fold of rows.
DEALT_BITS = 30
RUN_BITS, ROUND_BITS = 6, 3
RUN_ROWS = 1 << 23
_TEXT = ["text_sha256", "check", "norm_len"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, digest of the normalised text, code points of the original text, run."""
    norm = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"), without_blanks(F.col(text_col)).alias("norm"))
    return norm.select(
        "doc_id",
        "n_points",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").alias("norm_len"),
        F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << DEALT_BITS)).cast("int").alias("run"),
    )


def _verdicts(rows: DataFrame) -> DataFrame:
    """The staged result of :func:`digests` with keep_id and group_size."""
    n, bits = rows.count(), RUN_BITS
    while bits + ROUND_BITS <= DEALT_BITS and n >> bits > RUN_ROWS:
        bits += ROUND_BITS
    dealt = rows.withColumn("run", F.shiftright("run", DEALT_BITS - bits))
    best = F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    level = dealt.groupBy(*_TEXT, "run").agg(F.min(best).alias("best"), F.count("*").alias("n"))
    first = level
    for left in range(bits - ROUND_BITS, -1, -ROUND_BITS):
        keys = [*_TEXT, "run"] if left else _TEXT
        merged = level.withColumn("run", F.shiftright("run", ROUND_BITS)) if left else level
        level = merged.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    root = level.select(*_TEXT, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))
    return dealt.join(first.select(*_TEXT, "run").join(root, _TEXT), [*_TEXT, "run"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Two texts are equal when identical after deletion of ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the most code
    points in the original text, then the smallest doc_id, stays.

    Null text counts as empty, so null, empty and blank texts form one group. A null doc_id loses every tie; if all ids of a
    group are null, keep_id is null and those rows stay. Repeated rows: each counts in group_size, and rows that repeat the keeper's id
    stay with it. Extra columns are ignored whatever their names. An empty table gives no rows.
    """
    found = _verdicts(stage(digests(docs, id_col, text_col), "digests"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its own columns: one row of each group of :func:`exact_groups`.

    Of a group the row that :func:`exact_groups` keeps stays; of several rows with that id, null included, the one whose columns come first as JSON.
    Columns of any name are kept as they are; an empty table stays empty.
    """
    rows = stage(digests(docs, id_col, text_col), "digests")
    groups = stage(_verdicts(rows).where("group_size > 1").select("doc_id", "check", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")), "groups")
    keys = groups.groupBy("doc_id", "check", "kept").agg(F.count("*").alias("n"))
    lost, repeated = stage(keys.where("not kept").select("doc_id", "check"), "lost"), stage(keys.where("kept and n > 1").select("doc_id", "check"), "repeated")
    discard(rows, groups)
    return without(docs, docs[id_col], F.xxhash64(without_blanks(docs[text_col])), lost, repeated)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS points, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS h FROM d),
k AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY points DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, h AS text_sha256 FROM k
"""
