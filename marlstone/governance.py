"""Permits, budgets, deadlines and cancellation of queries, and a record of each.

A query's Spark jobs carry its id as a tag: cancelling it, or its deadline, interrupts the jobs with that tag. Results are read partition by partition.
"""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marlstone.model import EngineError

#: Queries at once by default, and ended queries that are remembered.
QUERIES, IO, REMEMBERED = 4, 16, 10_000
TERMINAL = ("succeeded", "failed", "cancelled", "deadline_exceeded")


class Governor:
    """Numbers of queries, CPU-bound and reading calls at once. A thread that has a permit of a kind may take it again."""

    def __init__(self, queries: int = QUERIES, cpu: int = 4, io: int = IO):
        if min(queries, cpu, io) < 1:
            raise EngineError("permits", "all numbers of permits must be positive")
        self._free = {k: threading.Semaphore(n) for k, n in (("query", queries), ("cpu", cpu), ("io", io))}
        self._held = threading.local()

    @contextlib.contextmanager
    def permit(self, kind: str, wait: float | None = 0) -> Iterator[None]:
        """``wait``: seconds, or None for as long as it takes."""
        held = self._held.__dict__
        if not held.get(kind):
            got = self._free[kind].acquire(timeout=wait) if wait else self._free[kind].acquire(blocking=wait is None)
            if not got:
                raise EngineError("resource_exhausted", f"no {kind} permit is free")
        held[kind] = held.get(kind, 0) + 1
        try:
            yield
        finally:
            held[kind] -= 1
            if not held[kind]:
                self._free[kind].release()


class ByteBudget:
    """Bytes that may be held at once."""

    def __init__(self, size: int):
        if size < 1:
            raise EngineError("byte_budget", "a byte budget must be positive")
        self.size, self.used, self._lock = size, 0, threading.Lock()

    @contextlib.contextmanager
    def take(self, n: int) -> Iterator[None]:
        with self._lock:
            if n < 0 or self.used + n > self.size:
                raise EngineError("resource_exhausted", f"{n} bytes don't fit into the budget")
            self.used += n
        try:
            yield
        finally:
            with self._lock:
                self.used -= n


@dataclass
class Query:
    id: str
    text: str
    created: float
    deadline: float | None = None  # monotonic
    status: str = "pending"
    started: float | None = None
    ended: float | None = None
    rows: int = 0
    batches: int = 0
    error: str | None = None
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def elapsed(self) -> float:
        """Seconds since the query was made, until it ended."""
        return (self.ended or time.monotonic()) - self.created

    def audit(self) -> dict:
        return {"id": self.id, "status": self.status, "elapsed_millis": int(1000 * self.elapsed()), "rows": self.rows, "batches": self.batches, "error": self.error}


class Queries:
    """Registered queries by id; the oldest ended ones are forgotten first."""

    def __init__(self, spark: SparkSession, governor: Governor | None = None):
        self.spark, self.governor = spark, governor or Governor()
        self._known: OrderedDict[str, Query] = OrderedDict()
        self._lock = threading.Lock()

    def create(self, text: str, seconds: float | None = None) -> str:
        now = time.monotonic()
        own = Query(str(uuid.uuid4()), text, now, None if seconds is None else now + seconds)
        with self._lock:
            self._known[own.id] = own
            for k in [k for k, q in self._known.items() if q.status in TERMINAL][: max(0, len(self._known) - REMEMBERED)]:
                del self._known[k]
        return own.id

    def get(self, query_id: str) -> Query:
        try:
            return self._known[query_id]
        except KeyError as e:
            raise EngineError("query_missing", f"there is no query {query_id}") from e

    def _end(self, own: Query, status: str, error: str | None = None) -> bool:
        with own.lock:
            if own.status in TERMINAL:
                return False
            own.status, own.ended, own.error = status, time.monotonic(), error
            return True

    def cancel(self, query_id: str) -> bool:
        """Whether the query had not ended before."""
        own = self.get(query_id)
        done = self._end(own, "cancelled")
        if done:
            self.spark.sparkContext.cancelJobsWithTag(own.id)
        return done

    def run(self, query_id: str, df: DataFrame | None = None) -> Iterator[pa.RecordBatch]:
        """The result of a query (or of ``df`` in its name) in batches, one partition at a time. Leaving off early cancels it."""
        own = self.get(query_id)
        if own.status != "pending":
            raise EngineError("query_state", f"the query is {own.status}")
        with contextlib.ExitStack() as held:
            try:
                held.enter_context(self.governor.permit("query"))
            except EngineError as e:
                self._end(own, "failed", e.code)
                raise
            timer = None
            if own.deadline is not None:
                left = own.deadline - time.monotonic()
                if left <= 0:
                    self._end(own, "deadline_exceeded")
                    raise EngineError("deadline_exceeded", "the query's deadline has passed")

                def late() -> None:
                    if self._end(own, "deadline_exceeded"):
                        self.spark.sparkContext.cancelJobsWithTag(own.id)

                timer = threading.Timer(left, late)
                timer.daemon = True
                timer.start()
            with own.lock:
                if own.status == "pending":
                    own.status, own.started = "running", time.monotonic()
            self.spark.sparkContext.addJobTag(own.id)
            try:
                result = df if df is not None else self.spark.sql(own.text)
                for batch in batches(result):
                    if own.status in TERMINAL:
                        raise EngineError(own.status, f"the query is {own.status}")
                    own.rows, own.batches = own.rows + batch.num_rows, own.batches + 1
                    yield batch
                self._end(own, "succeeded")
            except GeneratorExit:
                self._end(own, "cancelled")
                raise
            except Exception as e:
                if own.status in TERMINAL:
                    raise EngineError(own.status, f"the query is {own.status}") from e
                self._end(own, "failed", type(e).__name__)
                raise
            finally:
                if timer:
                    timer.cancel()
                self.spark.sparkContext.removeJobTag(own.id)


def batches(df: DataFrame, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """A result in Arrow batches of at most ``rows`` rows, of its schema even if there is no row. A partition is computed when it is asked for, so a slow reader holds the query back."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    held: list = []
    some = False

    def made() -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)]
        return pa.record_batch(columns, schema=schema)

    for row in df.toLocalIterator():
        held.append([_plain(v) for v in row])
        if len(held) == rows:
            some = True
            yield made()
            held = []
    if held or not some:
        yield made()


def _plain(value):
    if isinstance(value, tuple) and hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return [(k, _plain(v)) for k, v in value.items()]
    return value
