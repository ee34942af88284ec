"""Perspective rotation of dialogues, in DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the assistant, the others as named users and system messages as they are.
The mask marks the assistant's words and their end mark. A dialogue is rendered in parts of at most PART messages, so a task holds one part at
a time however long a dialogue is; its parts in order are the whole text. Rows out are participants times parts: that is the operator's result. Positions come from
counts of turn blocks, so a dialogue with a third of all rows is numbered in many tasks; a block with more than HOT messages, as where turns repeat or are null, is
counted by message and numbered by ranges. Parts meet their participants in a join by dialogue, whose partitions adaptive execution splits if they are skewed.

Marks can't be forged: in texts and roles a backslash is put between ``<`` and ``|``, in roles between ``|`` and ``>``, before any backslashes that are there already, so
it can be taken out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, stage

PART = 64
TURN_BLOCK = 1024
#: Messages of a block above which it is numbered by ranges of RANGE messages, about.
HOT, RANGE = 1 << 14, 1 << 15
#: Repeats of one message that are numbered at once.
REPEATS = 1 << 12
END = "<|end|>\n"
SYSTEM, NOBODY = "system", "unknown"
LAST = (1 << 63) - 1


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(role: Column) -> Column:
    return F.regexp_replace(escaped(role), r"\|(\\*)>", r"|\\$1>")


def _by_ranges(messages: DataFrame, hot: DataFrame, n: int) -> DataFrame:
    """conv_id, role, text, pos of the messages in the blocks ``hot`` (c, b, before), of ``n`` messages in all."""
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    key = ["turn", "role", "text"]
    counted = messages.join(sized(hot), same).groupBy("conv_id", "block", "before", *key).agg(F.count("*").alias("n"))
    ranged = stage(counted.repartitionByRange(max(1, n // RANGE), "conv_id", *key).withColumn("p", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("conv_id", "block", "p").agg(F.sum("n").alias("s"))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("p").alias("q"), (F.sum("s").over(Window.partitionBy("conv_id", "block").orderBy("p")) - F.col("s")).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy("conv_id", "block", "p").orderBy(*key)) - F.col("n")
    first = ranged.withColumn("inside", inside).join(sums, same & (F.col("p") == F.col("q"))).withColumn("first", F.col("before") + F.col("earlier") + F.col("inside"))
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {REPEATS}"))))
    last = F.least(F.lit(REPEATS).cast("long"), F.col("n") - F.col("run") * REPEATS) - 1
    return runs.select("conv_id", "role", "text", (F.col("first") + F.col("run") * REPEATS).alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k")).select("conv_id", "role", "text", (F.col("at") + F.col("k")).alias("pos"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, part, n_messages, text, mask (array of start, end in code points of the part's text, end exclusive).

    Messages are ordered by turn (null: last), role, text. A null role is the participant ``unknown``, a null text is empty. Rows that repeat
    a message are messages of their own. A null conv_id is one dialogue. A dialogue of system messages alone has no participant and no rows.
    Texts and roles are escaped as the module says. Extra columns are ignored whatever their names; an empty table gives no rows.
    """
    messages = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(LAST)).alias("turn"),
        F.coalesce("role", F.lit(NOBODY)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("block", F.shiftright("turn", TURN_BLOCK.bit_length() - 1))
    blocks = messages.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("n")
    blocks = stage(blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), before.alias("before"), "n"), "blocks")
    hot = stage(blocks.where(F.col("n") > HOT), "hot-blocks")
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text"))
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    crowded = hot.agg(F.sum("n")).first()[0] or 0
    calm = messages.join(sized(hot.select("c", "b")), here, "left_anti") if crowded else messages
    placed = calm.withColumn("rn", within).join(blocks.where(F.col("n") <= HOT).drop("n"), here)
    placed = placed.select("conv_id", "role", "text", (F.col("before") + F.col("rn") - 1).alias("pos"))
    if crowded:
        placed = placed.union(_by_ranges(messages, hot.select("c", "b", "before"), crowded))
    parts = placed.groupBy("conv_id", F.floor(F.col("pos") / PART).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("m"))
    people = messages.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    shown = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    head = lambda x: (
        F.when(x["role"] == F.col("perspective"), F.lit("<|assistant|>\n"))
        .when(x["role"] == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), escaped_name(x["role"]), F.lit("|>\n")))
    )
    lines = F.transform("m", lambda x: F.struct(head(x).alias("head"), F.concat(escaped(x["text"]), F.lit(END)).alias("body"), (x["role"] == F.col("perspective")).alias("own")))
    shown = shown.select("conv_id", "perspective", "part", F.size("m").alias("n_messages"), lines.alias("lines"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(acc, x):
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        return F.struct(b.alias("at"), F.when(x["own"], F.concat(acc["spans"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    mask = F.aggregate("lines", start, step, lambda acc: acc["spans"])
    return shown.select("conv_id", "perspective", "part", "n_messages", F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"])), "").alias("text"), mask.alias("mask"))


def written_masks(rotated: DataFrame) -> DataFrame:
    """The result of :func:`rotate` with its mask as ``start:end`` pairs, comma-joined."""
    pairs = F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return rotated.withColumn("mask", F.concat_ws(",", pairs))


ORACLE_SQL = rf"""
WITH m AS (SELECT conv_id, coalesce(turn, {LAST}) AS turn, coalesce(role, '{NOBODY}') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM m),
w AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> '{SYSTEM}'),
r AS (SELECT p.conv_id, perspective, pos, pos // {PART} AS part, role = perspective AS own, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS body,
  CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = '{SYSTEM}' THEN '<|system|>' ELSE '<|user name=' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' END || chr(10) AS head
  FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos) AS upto FROM r)
SELECT conv_id, perspective, part::INTEGER AS part, count(*)::INTEGER AS n_messages, string_agg(head || body, '' ORDER BY pos) AS text,
  coalesce(string_agg((upto - length(body))::VARCHAR || ':' || upto::VARCHAR, ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
