"""Incremental refresh of derived features and vector-index rows into immutable Parquet snapshots.

A manifest, itself a table (uri, source_version, lineage), says what was emitted last for each source. A refresh joins the rows to it, writes the changed ones into a new
folder under the store, then a new generation of the manifest, and then makes both current by replacing one small file. A crash leaves the old state; what it left
behind is named by no pointer. Nothing of the rows reaches the driver but counts.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import model
from marlstone.sources.files import locked, replace_json

MANIFEST = "uri string, source_version string, lineage string"


def fingerprint(uri: str = "source_uri") -> Column:
    """One value for all of a row's lineage."""
    parts = ("operator_version", "model", "model_version", "parameters_json")
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in (uri, "source_version", *parts)])).cast("binary"), 256)


def changed(rows: DataFrame, manifest: DataFrame, full_lineage: bool = False) -> DataFrame:
    """``rows`` (source_uri, source_version, ..) whose version the manifest doesn't hold for their source: a source that it doesn't know has changed.

    With ``full_lineage`` a change of operator, model or parameters counts too.
    """
    same = F.col("source_uri") == F.col("_uri")
    known = manifest.select(F.col("uri").alias("_uri"), F.col("source_version").alias("_version"), F.col("lineage").alias("_lineage"))
    same &= fingerprint() == F.col("_lineage") if full_lineage else F.col("source_version") == F.col("_version")
    return rows.join(known, same, "left_anti")


def recorded(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest after ``rows``: the last version of each source, in the order of ``ordinal`` if there is such a column, else of the versions themselves."""
    order = F.col("ordinal") if "ordinal" in rows.columns else F.col("source_version")
    new = rows.select(F.col("source_uri").alias("uri"), "source_version", fingerprint().alias("lineage"), order.cast("string" if "ordinal" not in rows.columns else "bigint").alias("o"))
    new = new.groupBy("uri").agg(F.max_by(F.struct("source_version", "lineage"), F.struct("o", "source_version", "lineage")).alias("v")).select("uri", "v.*")
    return manifest.join(new.select("uri"), "uri", "left_anti").unionByName(new)


@dataclass(frozen=True)
class Refresh:
    emitted_rows: int
    changed_sources: int
    snapshot: str | None


class Store:
    """A folder of snapshots with their manifest. ``schema`` is that of the rows: :data:`marlstone.model.FEATURES` or :data:`marlstone.model.INDEX_ROWS`."""

    def __init__(self, spark: SparkSession, root: str | Path, schema: str = model.FEATURES):
        self.spark, self.root, self.schema = spark, Path(root), schema
        self.root.mkdir(parents=True, exist_ok=True)

    def _current(self) -> dict:
        path = self.root / "current.json"
        return json.loads(path.read_text()) if path.exists() else {"manifest": None, "snapshots": []}

    def manifest(self) -> DataFrame:
        name = self._current()["manifest"]
        return self.spark.read.schema(MANIFEST).parquet(str(self.root / name)) if name else self.spark.createDataFrame([], MANIFEST)

    def rows(self) -> DataFrame:
        """All rows of all snapshots, oldest first written."""
        names = self._current()["snapshots"]
        return self.spark.read.schema(self.schema).parquet(*[str(self.root / n) for n in names]) if names else self.spark.createDataFrame([], self.schema)

    def snapshot(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(str(self.root / name))

    def frame(self, rows: list) -> DataFrame:
        """:class:`marlstone.model.Feature` or :class:`marlstone.model.IndexRow` values as a table."""
        return self.spark.createDataFrame([r.row() for r in rows], self.schema)

    def refresh(self, rows: DataFrame, full_lineage: bool = False) -> Refresh:
        """Emit the rows of changed sources and advance the manifest. Unchanged input emits nothing and leaves the store as it is."""
        with locked(self.root / "writer.lock", True, "writer_busy"):
            before = self._current()
            made = f"snapshot-{uuid.uuid4().hex}"
            found = changed(rows, self.manifest(), full_lineage)
            kept = [c for c in (*self.spark.createDataFrame([], self.schema).columns, "ordinal") if c in rows.columns]
            found.select(*kept).write.parquet(str(self.root / made))
            written = self.spark.read.parquet(str(self.root / made))
            counts = written.agg(F.count("*").alias("n"), F.count_distinct("source_uri").alias("u")).first()
            if not counts["n"]:
                return Refresh(0, 0, None)
            name = f"manifest-{uuid.uuid4().hex}"
            recorded(self.manifest(), written).write.parquet(str(self.root / name))
            replace_json(self.root / "current.json", {"manifest": name, "snapshots": [*before["snapshots"], made]})
            return Refresh(counts["n"], counts["u"], made)


def to_embeddings(rows: DataFrame) -> DataFrame:
    """Index rows with their values as vectors: text that isn't a JSON array of numbers becomes null."""
    return rows.withColumn("values", F.from_json("values_json", "array<float>")).drop("values_json")
