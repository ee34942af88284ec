"""Timelines: greedy sampling of frames, plans of frames by range and number, and windows that predicates allow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.model import EngineError


def sample_frames(frames: DataFrame, every: int, key: str = "uri", millis: str = "millis") -> DataFrame:
    """Greedy sampling of each timeline: the first frame, then each first one at least ``every`` milliseconds after the last taken.

    Times are sorted within a task and read in a stream, so a timeline of any length needs no memory. A taken frame decides the next one, so a timeline
    is one task's. Null times are left out; a null key is a timeline.
    """
    kind = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, owner, following = False, None, 0
        for batch in batches:
            keys, times, taken = batch.column(0), batch.column(1).to_numpy(), []
            edges = pc.or_kleene(pc.not_equal(keys.slice(1), keys.slice(0, max(0, len(keys) - 1))), pc.xor(pc.is_null(keys.slice(1)), pc.is_null(keys.slice(0, max(0, len(keys) - 1))))).fill_null(False).to_numpy(zero_copy_only=False)
            cuts = [0, *(i + 1 for i, e in enumerate(edges.tolist()) if e), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                now = keys[a].as_py()
                at = a
                if not begun or now != owner:
                    begun, owner, following = True, now, int(times[a])
                while (at := at + int(times[at:b].searchsorted(following))) < b:
                    taken.append(at)
                    following = int(times[at]) + every
            yield batch.take(pa.array(taken, pa.int64()))

    if every < 1:
        raise EngineError("every", "every must be positive")
    rows = frames.where(F.col(millis).isNotNull()).select(key, F.col(millis).cast("long").alias(millis))
    return rows.repartition(key).sortWithinPartitions(key, millis).mapInArrow(run, f"`{key}` {kind}, `{millis}` bigint")


def plan_frames(frames: DataFrame, start: int | None = None, end: int | None = None, limit: int | None = None, millis: str = "millis", order: str | None = None) -> DataFrame:
    """The first ``limit`` frames, in the order given, from ``start`` to ``end`` milliseconds, both included. ``order`` (by default the time) is the column of the input's order."""
    if limit is not None and limit < 0:
        raise EngineError("limit", "limit must not be negative")
    rows = frames
    if start is not None:
        rows = rows.where(F.col(millis) >= start)
    if end is not None:
        rows = rows.where(F.col(millis) <= end)
    return rows.orderBy(order or millis).limit(limit) if limit is not None else rows


def allowed_window(start: int, end: int, filters: list[tuple[str, str, int]], chunk: int) -> tuple[int, int]:
    """The window of a timeline that filters (column, operator, milliseconds) on ``start_millis`` and ``end_millis`` leave, widened to whole chunks counted from ``start``.

    So the grid of chunks stays as it was, and filtering the chunks afterwards gives the same rows as decoding everything. Other columns and operators are left out.
    """
    low, high = start, end
    for name, op, value in filters:
        if name == "end_millis" and op in (">", ">=", "=") or name == "start_millis" and op in (">", ">=", "="):
            low = max(low, value - (chunk if name == "end_millis" else 0))
        if name == "start_millis" and op in ("<", "<=", "=") or name == "end_millis" and op in ("<", "<=", "="):
            high = min(high, value + (chunk if name == "start_millis" else 0) + 1)
    low = start + max(0, (low - start) // chunk) * chunk
    high = min(end, start + -(-max(0, high - start) // chunk) * chunk)
    return low, max(low, high)
