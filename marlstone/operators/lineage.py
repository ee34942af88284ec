"""Change detection between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_sources(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of ``features`` whose (uri, source_version) the manifest does not hold: a missing uri counts as changed."""
    return features.join(manifest.select("uri", "source_version").distinct(), ["uri", "source_version"], "left_anti")


def counters(changed: DataFrame) -> DataFrame:
    """emitted_rows and changed_sources of a refresh."""
    return changed.agg(F.count("*").alias("emitted_rows"), F.count_distinct("uri").alias("changed_sources"))
