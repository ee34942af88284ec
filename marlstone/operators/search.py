"""Transcript search, exact and approximate vector ranking, its hybrid with keywords, and ranking across kinds of media.

All of it works on DataFrames: a scan with pushed-down lineage filters, one expression for the score, and a top-k that keeps ``limit`` rows a task. Orders use the raw
score; rounding is left to whoever shows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.model import EngineError, Lineage, check_dimensions, check_limit

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contains_folded(text: Column, query: str) -> Column:
    """``text`` holds ``query`` whatever the case. An empty query is in every text, in none that is null."""
    return F.contains(F.lower(text), F.lower(F.lit(query)))


def search_transcripts(segments: DataFrame, query: str, limit: int, order: list[str], lineage: Lineage | None = None) -> DataFrame:
    """The first ``limit`` segments, by ``order``, that hold ``query``; only those of exactly ``lineage`` if one is given."""
    rows = segments if lineage is None else compatible(segments, lineage)
    return rows.where(contains_folded(F.col("text"), query)).orderBy(*order).limit(check_limit(limit))


def compatible(rows: DataFrame, lineage: Lineage) -> DataFrame:
    """``rows`` (source_uri, source_version, operator_version, model, model_version, parameters_json) of exactly ``lineage``."""
    names = ("source_uri", "source_version", "operator_version", "model", "model_version", "parameters_json")
    for name, value in zip(names, lineage.row(), strict=True):
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows


def dot(a: Column, b: Column) -> Column:
    """Inner product without normalisation, summed in single precision from the left; null if the lengths differ."""
    products = F.zip_with(a.cast("array<float>"), b.cast("array<float>"), lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float")))


def keyword_score(text: Column, query: str) -> Column:
    """The share of the query's blank-separated terms, repeats included, that the text holds, ASCII letters in either case."""
    terms = [t.translate(str.maketrans(_UPPER, _LOWER)) for t in query.split()]
    if not terms:
        return F.lit(0.0)
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def rank(records: DataFrame, query: list[float] | DataFrame, limit: int, candidates: int = 0, lineage: Lineage | None = None, order: str | None = None) -> DataFrame:
    """``records`` (id, text, values, ..) with the ``limit`` highest scores, highest first, ties by id, and ``ranking_semantics``.

    ``query`` is a vector, or a one-row table whose column ``query`` is one; no row, no result. Rows of other lengths aren't ranked. ``candidates`` over 0 ranks the first so
    many rows by ``order`` only and marks the result ``approximate``; else all rows are and it is ``ranked``.
    """
    check_limit(limit)
    check_limit(candidates)
    rows = records if lineage is None else compatible(records, lineage)
    if isinstance(query, DataFrame):
        rows = rows.crossJoin(F.broadcast(query.select(F.col("query").alias("_query")).limit(1)))
    else:
        check_dimensions(len(query))
        rows = rows.withColumn("_query", F.array(*[F.lit(float(x)).cast("float") for x in query]))
    rows = rows.where(F.size("values") == F.size("_query"))
    if candidates:
        rows = rows.orderBy(order or "id").limit(candidates)
    scored = rows.withColumn("score", dot(F.col("values"), F.col("_query"))).where("score is not null").drop("values", "_query")
    return scored.orderBy(F.desc("score"), "id").limit(limit).withColumn("ranking_semantics", F.lit("approximate" if candidates else "ranked"))


def rank_hybrid(records: DataFrame, query: list[float] | DataFrame, words: str, limit: int, weight: float, candidates: int = 0, lineage: Lineage | None = None, order: str | None = None) -> DataFrame:
    """The result of :func:`rank`, scored again as weight * semantic + (1 - weight) * keyword and ordered anew: what isn't in it by meaning doesn't come in by words."""
    if not 0 <= weight <= 1:
        raise EngineError("semantic_weight", "weight must be from 0 to 1")
    first = rank(records, query, limit, candidates, lineage, order)
    semantic, keyword = F.lit(float(weight)).cast("float") * F.col("score"), F.lit(1.0 - float(weight)).cast("float") * keyword_score(F.col("text"), words).cast("float")
    return first.withColumn("score", (semantic + keyword).cast("float")).orderBy(F.desc("score"), "id")


def rank_records(index: DataFrame, query: list[float], limit: int, lineage: Lineage, candidates: int = 0) -> DataFrame:
    """:func:`rank` over an index of vectors (with insert_ordinal, and kind if it spans kinds of media): id, kind if any, text, score, ranking_semantics."""
    kept = [c for c in ("id", "kind", "text") if c in index.columns]
    return rank(index, query, limit, candidates, lineage, "insert_ordinal").select(*kept, "score", "ranking_semantics")
