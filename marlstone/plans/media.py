"""Media, search, timeline and change-detection operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import media
from marlstone.operators import lineage, search, sections, timeline


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"), F.col("embedding").alias("values"))


def _first_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query"))


def _shown(ranked: DataFrame) -> DataFrame:
    """Scores to six places, for display: they are ranked as they are."""
    return ranked.withColumn("score", F.round(F.col("score").cast("double"), 6))


def semantic_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.rank(_records(spark, sf_dir), _first_vector(spark, sf_dir), 10))


def semantic_topk_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.rank(_records(spark, sf_dir), _first_vector(spark, sf_dir), 10, candidates=100))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.rank_hybrid(_records(spark, sf_dir), _first_vector(spark, sf_dir), "label 3", 100, 0.5).limit(10))


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", search.keyword_score(F.col("text"), "the An the zz").alias("score"))


def transcript_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), (F.col("turn") * 1000).alias("start_millis"), (F.col("turn") * 1000 + 1000).alias("end_millis"), "text")
    return search.search_transcripts(turns, "AN", 1024, ["media_id", "start_millis", "text"])


def media_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _table(spark, sf_dir, "pages").select("page_id", media.media(F.col("url"), F.lit("document")).alias("media"))
    return refs.select("page_id", media.media_uri(F.col("media")).alias("uri"), media.media_type(F.col("media")).alias("media_type"), F.col("media.storage_mode").alias("storage_mode"), media.valid_uri(F.col("media.uri")).alias("valid"))


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(_table(spark, sf_dir, "documents"))


def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_transcripts(document_sections(spark, sf_dir), "the", 1024, ["doc_id", "ordinal"])


def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.table_cells(document_sections(spark, sf_dir))


def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("millis"))
    return timeline.sample_frames(frames, 3_600_000, "user_id")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uri"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("source_version"), "lang")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("uri", F.when(F.col("lang") == "en", F.col("source_version")).otherwise("stale").alias("source_version"))


def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.changed_sources(_features(spark, sf_dir), _manifest(spark, sf_dir)).select("uri", "source_version")


def refresh_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.counters(changed_sources(spark, sf_dir))


_SCORE = "list_reduce(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i] * q.embedding[i]), lambda a, b: a + b)"
_SCORED = f"SELECT e.vec_id AS id, 'label ' || e.label AS text, {_SCORE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE len(e.embedding) = len(q.embedding)"
_KEYWORDS = "(contains(text, 'label')::INT + contains(text, '3')::INT)::FLOAT / 2::FLOAT"
_LINES = r"SELECT doc_id, (unnest(range(len(l))))::INTEGER AS ordinal, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)"
_CHANGED = "SELECT doc_id AS uri, md5(coalesce(text, '')) AS source_version FROM documents WHERE lang IS NULL OR lang <> 'en'"
_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "semantic_topk_exact": f"SELECT id, text, round(score::DOUBLE, 6) AS score, 'ranked' AS ranking_semantics FROM (SELECT * FROM ({_SCORED}) ORDER BY score DESC, id LIMIT 10)",
    "semantic_topk_approximate": f"SELECT id, text, round(score::DOUBLE, 6) AS score, 'approximate' AS ranking_semantics FROM (SELECT * FROM (SELECT * FROM ({_SCORED}) ORDER BY id LIMIT 100) ORDER BY score DESC, id LIMIT 10)",
    "hybrid_search": f"SELECT id, text, round(s::DOUBLE, 6) AS score, 'ranked' AS ranking_semantics FROM (SELECT id, text, (0.5::FLOAT * score + 0.5::FLOAT * {_KEYWORDS})::FLOAT AS s FROM (SELECT * FROM ({_SCORED}) ORDER BY score DESC, id LIMIT 100) ORDER BY s DESC, id LIMIT 10)",
    "keyword_scores": f"SELECT doc_id, (2 * contains(t, 'the')::INT + contains(t, 'an')::INT + contains(t, 'zz')::INT) / 4.0::DOUBLE AS score FROM (SELECT doc_id, {_ASCII} AS t FROM documents)",
    "transcript_search": "SELECT conv_id AS media_id, turn * 1000 AS start_millis, turn * 1000 + 1000 AS end_millis, text FROM conversations WHERE contains(lower(text), 'an') ORDER BY 1, 2, 4 LIMIT 1024",
    "media_references": r"SELECT page_id, url AS uri, 'document' AS media_type, 'external' AS storage_mode, coalesce(regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') AND NOT regexp_matches(lower(url), '[?&](signature|sig|token|access_token|x-amz-signature|x-goog-signature)(=|&|#|$)'), false) AS valid FROM pages",
    "document_sections": _LINES,
    "document_search": f"SELECT * FROM ({_LINES}) WHERE contains(lower(text), 'the') ORDER BY doc_id, ordinal LIMIT 1024",
    "document_tables": rf"WITH c AS (SELECT doc_id, ordinal, regexp_split_to_array(text, '[ \t]{{2,}}') AS cells FROM ({_LINES})), r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM c WHERE len(cells) >= 2) SELECT doc_id, ordinal AS row_ordinal, unnest(range(len(cells)))::INTEGER AS column_ordinal, unnest(cells) AS text FROM r WHERE n >= 2",
    "frame_sampling": "WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS millis FROM events WHERE ts IS NOT NULL), r AS (SELECT user_id, min(millis) AS millis FROM e GROUP BY user_id UNION ALL SELECT r.user_id, min(e.millis) AS millis FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.millis >= r.millis + 3600000 GROUP BY r.user_id, r.millis) SELECT user_id, millis FROM r",
    "changed_sources": _CHANGED,
    "refresh_counters": f"SELECT count(*) AS emitted_rows, count(DISTINCT uri) AS changed_sources FROM ({_CHANGED})",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: globals()[k] for k in SQL}


def oracle_sql() -> dict[str, str]:
    return SQL
