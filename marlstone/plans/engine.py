"""Queries of the engine's own operators over the driver's tables: SQL by the engine's names, lineage, ranking, schedules, partitions, timelines, metrics and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import names
from marlstone.model import Lineage
from marlstone.operators import metrics, partitions, schedule, search, sections, timeline
from marlstone.sources import derived
from marlstone.streaming import refresh


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by the names of other engines, in SQL text."""
    names.register(spark, "strpos", "starts_with", "ends_with", "to_hex", "sha256", "gcd", "lcm", "array_has", "array_to_string", "string_to_array", "array_length")
    return spark.sql(
        "SELECT c_custkey, strpos(c_name, '#') AS p, starts_with(c_name, 'Customer') AS s, ends_with(c_name, '7') AS e, to_hex(c_custkey) AS h, sha256(c_mktsegment) AS d, gcd(c_custkey, 360) AS g, lcm(c_custkey, 6) AS l, "
        "array_has(string_to_array(c_name, '#'), 'Customer') AS a, array_to_string(string_to_array(c_name, '#'), '+') AS j, array_length(string_to_array(c_name, '#')) AS n FROM {customer}",
        customer=_table(spark, sf_dir, "customer"),
    )


def sql_date_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    names.register(spark, "date_bin")
    return spark.sql("SELECT CAST(date_bin(INTERVAL '90' MINUTE, CAST(ts AS TIMESTAMP), TIMESTAMP '2001-01-01 00:30:00') AS TIMESTAMP_NTZ) AS bucket, count(*) AS n FROM {events} GROUP BY 1", events=_table(spark, sf_dir, "events"))


def sql_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated table function and a correlated subquery by LATERAL."""
    return spark.sql(
        "SELECT n_name, w.pos, w.col AS part, t.top FROM {nation} n, LATERAL posexplode(split(n.n_name, ' ')) w, LATERAL (SELECT max(c_acctbal) AS top FROM {customer} c WHERE c.c_nationkey = n.n_nationkey) t",
        nation=_table(spark, sf_dir, "nation"), customer=_table(spark, sf_dir, "customer"),
    )


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a cross-modal index: the lineage depends on the label."""
    kinds = F.element_at(F.array(*map(F.lit, ("transcript", "document", "image", "audio", "video"))), (F.col("vec_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), kinds.alias("kind"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"), F.col("embedding").alias("values"), F.lit("file:///a").alias("source_uri"),
        F.concat(F.lit("v"), (F.col("label") % 2).cast("string")).alias("source_version"), F.lit("embed-v1").alias("operator_version"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("model_version"),
        F.lit("{}").alias("parameters_json"), F.col("vec_id").alias("insert_ordinal"),
    )


def cross_modal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of one lineage, whatever their kind."""
    query = _table(spark, sf_dir, "embeddings").where("vec_id = 1").select(F.col("embedding").alias("query"))
    rows = search.rank(_index(spark, sf_dir), query, 20, 0, Lineage("file:///a", "v1", "embed-v1"), "insert_ordinal")
    return rows.select("id", "kind", "text", F.round(F.col("score").cast("double"), 6).alias("score"), "ranking_semantics")


def lineage_transcript_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("media_id"), "turn", "text", F.col("role").alias("source_uri"), F.lit("1").alias("source_version"), F.lit("t").alias("operator_version"),
        F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("model_version"), F.lit("{}").alias("parameters_json"), F.col("conv_id").alias("c"),
    )
    return search.search_transcripts(turns, "THE", 500, ["c", "turn", "text"], Lineage("user", "1", "t")).select("media_id", "turn", "text")


def work_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of each supplier nation's work: what fits into the bounds, in waves."""
    work = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("batch"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("id"), (F.col("s_suppkey") * 37 % 11 + 1).alias("cost"), (F.col("s_suppkey") * 5 % 4).alias("segments"))
    return schedule.schedule(work, schedule.Limits(3, 12, 6, 2))


def work_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cold cost of each conversation: units times segments, null if it isn't representable."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("segments"))
    return turns.select("conv_id", "segments", F.try_multiply("segments", F.lit(7).cast("bigint")).alias("cost"))


def stable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages dealt into eight partitions by a hash that is the same everywhere."""
    sources = _table(spark, sf_dir, "pages").select(F.col("url").alias("uri"), F.lit("1").alias("source_version"))
    return partitions.tasks(sources, 8).groupBy("partition").agg(F.count("*").alias("n"), F.max("ordinal").alias("last"))


def result_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without a result, results without a source, and repeated ones."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uri"), F.lit("1").alias("source_version"), "doc_id")
    results = docs.where("doc_id % 10 != 3").unionByName(docs.where("doc_id % 10 = 4")).withColumn("uri", F.when(F.col("doc_id") % 10 == 5, F.concat("uri", F.lit("x"))).otherwise(F.col("uri")))
    return partitions.unaccounted(docs, results)


def frame_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"))
    return timeline.plan_frames(frames, 1_704_500_000_000, 1_705_500_000_000, 200, order="event_id")


def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of lines that are laid out with blanks."""
    lines = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("ordinal"), F.concat(F.lit(" "), "c_name", F.lit("  \t"), F.regexp_replace("c_mktsegment", "I", " "), F.when(F.col("c_acctbal") > 0, F.lit("   paid")).otherwise(F.lit(""))).alias("text"))
    return sections.table_cells(lines)


def refresh_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sources whose version the manifest doesn't hold."""
    rows = _table(spark, sf_dir, "pages").select(F.col("url").alias("source_uri"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("source_version"), F.lit("op").alias("operator_version"), F.lit("m").alias("model"), F.lit("1").alias("model_version"), F.lit("{}").alias("parameters_json"), "page_id")
    manifest = rows.where("page_id % 3 = 0").groupBy(F.col("source_uri").alias("uri")).agg(F.max("source_version").alias("source_version")).withColumn("lineage", F.lit(""))
    return derived.changed(rows, manifest).select("page_id", "source_uri", "source_version")


def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of each nation's name against its region's."""
    pairs = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.concat("n_name", F.lit(" of the "), "r_name").alias("reference"), F.concat(F.lit("the "), "r_name").alias("found"))
    return metrics.corpus_error_rate(pairs, "r_name").select("r_name", "errors", "words")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming window, run as a batch."""
    found = refresh.windowed(_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "1 hour", "event_type", slide="12 hours")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = refresh.sessions(_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "1 hour", "user_id")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


_SAME = "coalesce(source_version, '') = 'v1'"
_DOT = "list_reduce(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i] * q.embedding[i]), lambda a, b: a + b)"
SQL: dict[str, str | None] = {
    "sql_names": "SELECT c_custkey, strpos(c_name, '#')::INTEGER AS p, starts_with(c_name, 'Customer') AS s, ends_with(c_name, '7') AS e, lower(to_hex(c_custkey)) AS h, sha256(c_mktsegment) AS d, gcd(c_custkey, 360)::BIGINT AS g, lcm(c_custkey, 6)::BIGINT AS l, list_contains(string_split(c_name, '#'), 'Customer') AS a, array_to_string(string_split(c_name, '#'), '+') AS j, len(string_split(c_name, '#'))::INTEGER AS n FROM customer",
    "sql_date_bin": "SELECT time_bucket(INTERVAL 90 MINUTES, ts::TIMESTAMP, TIMESTAMP '2001-01-01 00:30:00') AS bucket, count(*) AS n FROM events GROUP BY 1",
    "sql_lateral": "SELECT n_name, (i - 1)::INTEGER AS pos, string_split(n_name, ' ')[i] AS part, t.top FROM nation n, range(1, len(string_split(n_name, ' ')) + 1) r(i), LATERAL (SELECT max(c_acctbal) AS top FROM customer c WHERE c.c_nationkey = n.n_nationkey) t",
    "cross_modal_rank": f"SELECT id, kind, text, round(s::DOUBLE, 6) AS score, 'ranked' AS ranking_semantics FROM (SELECT e.vec_id::VARCHAR AS id, ['transcript', 'document', 'image', 'audio', 'video'][e.vec_id % 5 + 1] AS kind, 'label ' || e.label AS text, {_DOT} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.label % 2 = 1 ORDER BY s DESC, id LIMIT 20)",
    "lineage_transcript_search": "SELECT conv_id::VARCHAR AS media_id, turn, text FROM (SELECT * FROM conversations WHERE role = 'user' AND contains(lower(text), 'the') ORDER BY conv_id, turn, text LIMIT 500)",
    "work_schedule": """
WITH RECURSIVE w AS (SELECT s_nationkey AS batch, lpad(s_suppkey::VARCHAR, 8, '0') AS id, (s_suppkey * 37 % 11 + 1)::BIGINT AS cost, (s_suppkey * 5 % 4)::BIGINT AS segments, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier),
r AS (SELECT batch, 0::BIGINT AS k, NULL::VARCHAR AS id, 0::BIGINT AS cost, 0::BIGINT AS segments, false AS admitted, 0::BIGINT AS n, 0::BIGINT AS c, 0::BIGINT AS s FROM (SELECT DISTINCT batch FROM w)
  UNION ALL SELECT w.batch, w.k, w.id, w.cost, w.segments, r.n < 3 AND r.c + w.cost <= 12 AND r.s + w.segments <= 6, CASE WHEN r.n < 3 AND r.c + w.cost <= 12 AND r.s + w.segments <= 6 THEN r.n + 1 ELSE r.n END,
    CASE WHEN r.n < 3 AND r.c + w.cost <= 12 AND r.s + w.segments <= 6 THEN r.c + w.cost ELSE r.c END, CASE WHEN r.n < 3 AND r.c + w.cost <= 12 AND r.s + w.segments <= 6 THEN r.s + w.segments ELSE r.s END FROM r JOIN w ON w.batch = r.batch AND w.k = r.k + 1)
SELECT batch, id, cost, segments, admitted, CASE WHEN admitted THEN ((n - 1) // 2)::BIGINT END AS wave FROM r WHERE k > 0""",
    "work_cost": "SELECT conv_id, count(*) AS segments, count(*) * 7 AS cost FROM conversations GROUP BY conv_id",
    "stable_tasks": """
WITH RECURSIVE s AS (SELECT DISTINCT url AS uri, encode(url || chr(1) || '1') AS b FROM pages WHERE url IS NOT NULL),
h AS (SELECT uri, hex(b) AS x, 0 AS i, 14695981039346656037::HUGEINT AS v FROM s
  UNION ALL SELECT uri, x, i + 1, (xor(v, (CASE WHEN i = length(x) // 2 - 2 THEN 0 ELSE (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 END)::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT FROM h WHERE i < length(x) // 2)
SELECT (v % 8)::INTEGER AS partition, count(*) AS n, (count(*) - 1)::INTEGER AS last FROM h WHERE i = length(x) // 2 GROUP BY 1""",
    "result_check": """
SELECT doc_id::VARCHAR AS uri, '1' AS source_version, 'missing' AS problem FROM documents WHERE doc_id % 10 IN (3, 5)
UNION ALL SELECT doc_id || 'x', '1', 'unexpected' FROM documents WHERE doc_id % 10 = 5 UNION ALL SELECT doc_id::VARCHAR, '1', 'repeated' FROM documents WHERE doc_id % 10 = 4""",
    "frame_plan": "SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1704500000000 AND 1705500000000 ORDER BY event_id LIMIT 200",
    "layout_tables": r"""
WITH l AS (SELECT c_nationkey AS doc_id, c_custkey AS ordinal, [c_name, replace(c_mktsegment, 'I', ' ')] || CASE WHEN c_acctbal > 0 THEN ['paid'] ELSE [] END AS cells FROM customer),
n AS (SELECT doc_id FROM l GROUP BY 1 HAVING count(*) >= 2)
SELECT doc_id, ordinal AS row_ordinal, (unnest(range(len(cells))))::INTEGER AS column_ordinal, unnest(cells) AS text FROM l WHERE doc_id IN (SELECT doc_id FROM n)""",
    "refresh_changes": "WITH r AS (SELECT url AS source_uri, md5(coalesce(html, '')) AS source_version, page_id FROM pages), m AS (SELECT source_uri AS uri, max(source_version) AS v FROM r WHERE page_id % 3 = 0 GROUP BY 1) SELECT page_id, source_uri, source_version FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE uri = source_uri AND v = source_version)",
    "word_errors": "WITH w AS (SELECT r_name, len(regexp_extract_all(lower(n_name), '[a-z0-9]+')) AS k, len(regexp_extract_all(lower(r_name), '[a-z0-9]+')) AS m FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT r_name, sum(k + 1)::BIGINT AS errors, sum(k + 2 + m)::BIGINT AS words FROM w GROUP BY 1",
    "event_windows": "SELECT w AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOURS, ts::TIMESTAMP, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOURS, ts::TIMESTAMP, TIMESTAMP '1970-01-01') - INTERVAL 12 HOURS]) AS w FROM events WHERE ts IS NOT NULL) GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT user_id, CASE WHEN ts::TIMESTAMP < lag(ts::TIMESTAMP) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new, event_id, ts FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: globals()[k] for k in SQL}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, s in SQL.items() if s}
