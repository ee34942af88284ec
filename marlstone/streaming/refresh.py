"""Structured Streaming forms of the incremental refresh and of windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.sources.derived import Store


def refresh_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, full_lineage: bool = False) -> StreamingQuery:
    """Refresh ``store`` from Parquet files of its rows that appear in ``folder``: what is there now, batch by batch, then end.

    A batch that is run again after a failure emits nothing twice, since the manifest already has its versions.
    """
    rows = spark.readStream.schema(store.schema).parquet(folder)
    return rows.writeStream.foreachBatch(lambda df, _: store.refresh(df, full_lineage) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str, late: str, key: str, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """start, end, key, n: events of each window of event time; on a stream, those more than ``late`` behind the newest are left out and windows are closed."""
    window = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    found = events.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(events: DataFrame, gap: str, late: str, key: str, ts: str = "ts") -> DataFrame:
    """start, end, key, n: runs of a key's events that are less than ``gap`` apart."""
    found = events.withWatermark(ts, late).groupBy(F.session_window(F.col(ts), gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_of(events: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """Events without those that repeat ``keys`` within ``late`` of the first."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
