"""Stable partitions of sources, tasks of a partition, and checks of what comes back.

Spark's scheduler hands out tasks, retries them and notices lost workers; what is kept here is what must not depend on it: which partition a source is in, the order inside and
between partitions, and that results are complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.model import EngineError
from marlstone.operators.providers import fnv1a


def stable_partition(uri: str, version: str, partitions: int) -> int:
    """64-bit FNV-1a of the address, a zero byte and the version, modulo the number of partitions: the same on every machine."""
    if partitions < 1:
        raise EngineError("partitions", "the number of partitions must be positive")
    return fnv1a(uri.encode() + b"\0" + version.encode()) % partitions


def partition_column(uri: Column, version: Column, partitions: int) -> Column:
    """:func:`stable_partition` for rows, batch by batch; null for a null address or version."""
    if partitions < 1:
        raise EngineError("partitions", "the number of partitions must be positive")

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for uris, versions in batches:
            yield pd.Series([None if u is None or v is None else stable_partition(u, v, partitions) for u, v in zip(uris, versions, strict=True)], dtype="Int32")

    return run(uri, version)


def tasks(sources: DataFrame, partitions: int) -> DataFrame:
    """partition, ordinal, uri, source_version: the sources of each partition that has any, by address and version, each once."""
    from pyspark.sql import Window

    rows = sources.select("uri", "source_version").distinct().withColumn("partition", partition_column(F.col("uri"), F.col("source_version"), partitions))
    return rows.select("partition", (F.row_number().over(Window.partitionBy("partition").orderBy("uri", "source_version")) - 1).alias("ordinal"), "uri", "source_version")


def ordered_results(results: DataFrame) -> DataFrame:
    """Results (partition, ordinal, ..) in the order of their tasks."""
    return results.orderBy("partition", "ordinal")


def unaccounted(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """uri, source_version, problem: sources without a result (``missing``), results without a source (``unexpected``), and sources with several (``repeated``). Empty if all is well."""
    key = ["uri", "source_version"]
    a, b = wanted.groupBy(*key).agg(F.count("*").alias("w")), results.groupBy(*key).agg(F.count("*").alias("r"))
    problem = F.when(F.col("r").isNull(), "missing").when(F.col("w").isNull(), "unexpected").when(F.col("r") > 1, "repeated")
    same = F.col("a.uri").eqNullSafe(F.col("b.uri")) & F.col("a.source_version").eqNullSafe(F.col("b.source_version"))
    both = a.alias("a").join(b.alias("b"), same, "full")
    return both.select(F.coalesce("a.uri", "b.uri").alias("uri"), F.coalesce("a.source_version", "b.source_version").alias("source_version"), problem.alias("problem")).where("problem is not null")


def checked(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` if every wanted source has exactly one, and nothing else does."""
    if bad := unaccounted(wanted, results).limit(3).collect():
        raise EngineError("incomplete_results", "; ".join(f"{r['problem']}: {r['uri']}" for r in bad))
    return results


def on_driver(work: list, action) -> list:
    """``action`` of each item, once and in order: for work that must not be repeated, which Spark's tasks may be."""
    return [action(item) for item in work]
