"""Shared helpers: tables in the cluster's shared folder, and column utilities."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that the operators treat as separators.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

#: Keys that are sent to every task at most: 2**20 keys of two numbers are some 60 MB. Beyond it both sides are shuffled by key.
BROADCAST_KEYS = 1 << 20

#: Rows of whole texts that are sent to a Python worker at once, at most.
TEXT_ROWS = 1000

_local_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a session without that setting (a test) gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _local_dir[app] = tempfile.mkdtemp(prefix="marlstone-")
    return _local_dir[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside sends TEXT_ROWS rows to Python workers at once, at most: a batch is held several times over, in the JVM and in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            fs.delete(path, True)


def worker_cache() -> dict:
    """What lives as long as a Python worker: functions that are shipped by value have no module of their own to keep things in."""
    return vars(sys.modules.setdefault("_marlstone_kept", types.ModuleType("_marlstone_kept")))


def kept_for(owner: str) -> dict:
    """:func:`worker_cache` for tasks of ``owner`` alone: what tasks of another one left is dropped first, as it would count against this one's memory."""
    kept = worker_cache()
    if kept.get("owner") != owner:
        for name in [k for k in kept if not k.startswith("__")]:
            del kept[name]
        kept["owner"] = owner
        give_back()
    return kept


def give_back() -> None:
    """Return the freed memory of a Python worker, or of the driver's Python, to the system: it outlives tasks and operators, and what it holds counts against the executor or driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def return_heaps(spark: SparkSession) -> None:
    """Have each executor's JVM collect its garbage and return unused heap, dead buffers and classes to the system: otherwise what one operator once needed counts against the next.

    One short task an executor, in the driver's JVM if it runs the tasks. Results don't depend on it: an executor that gets none keeps its heap.
    """
    n = max(1, len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1)  # the driver is among them
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added until no column of ``df`` has them in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sized(keys: DataFrame) -> DataFrame:
    """``keys``, a staged table, as the side of a join: broadcast if it has BROADCAST_KEYS rows at most, else left to a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without(docs: DataFrame, doc_id: Column, check: Column, lost: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, check) are in ``lost``; of those in ``repeated`` one row a key stays.

    Of rows that repeat a key the one whose columns come first as JSON stays. ``lost`` and ``repeated`` (doc_id, check) are staged tables without repeats and without a common key.
    Whole rows are shuffled only if there are more than BROADCAST_KEYS keys; rows of repeated keys are reduced before they are.
    """
    a, b = fresh(docs, "lost_id", "lost_check")
    named = lambda keys: keys.select(F.col("doc_id").alias(a), F.col("check").alias(b))
    same = doc_id.eqNullSafe(F.col(a)) & (check == F.col(b))
    kept = docs.join(sized(named(lost)), same, "left_anti")
    if repeated.isEmpty():
        return kept
    again = sized(named(repeated))
    whole = F.struct(*map(column, docs.columns))
    one = docs.join(again, same).groupBy(a, b).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.join(again, same, "left_anti").union(one)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_blanks(text: Column) -> Column:
    """``text`` (null: empty) with every character of ``[\\x20\\x09-\\x0D]`` deleted."""
    out = F.coalesce(text, F.lit(""))
    for ch in BLANKS:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: the folds of the contracts. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))
