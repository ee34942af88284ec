"""Bounded cold work: what it costs, what is admitted and in which waves, and whether a search is answered from an index or by a provider."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.model import MOST_TRANSCRIPT_SEGMENTS, EngineError, Lineage, MediaRef, Segment
from marlstone.operators import search
from marlstone.operators.providers import Transcription, TranscriptionRequest

#: Costs and counts are unsigned 64-bit integers.
MOST_UNITS = 2**64 - 1


@dataclass(frozen=True)
class Limits:
    """Bounds of a schedule, all positive."""

    work_items: int
    total_cost: int
    total_segments: int
    parallelism: int

    def __post_init__(self) -> None:
        if min(self.work_items, self.total_cost, self.total_segments, self.parallelism) < 1:
            raise EngineError("schedule_limits", "all limits of a schedule must be positive")


@dataclass(frozen=True)
class Work:
    id: str
    cost: int
    segments: int


@dataclass(frozen=True)
class CostModel:
    lookup: int
    per_segment: int

    def cold(self, segments: int) -> int:
        cost = self.per_segment * segments
        if cost > MOST_UNITS:
            raise EngineError("work_limit", "the cost of this work isn't representable")
        return cost


@dataclass(frozen=True)
class Schedule:
    admitted: tuple[Work, ...]
    skipped: tuple[str, ...]
    parallelism: int

    @property
    def cost(self) -> int:
        return sum(w.cost for w in self.admitted)

    @property
    def segments(self) -> int:
        return sum(w.segments for w in self.admitted)

    def waves(self) -> list[tuple[Work, ...]]:
        return [self.admitted[i : i + self.parallelism] for i in range(0, len(self.admitted), self.parallelism)]


def build(work: list[Work], limits: Limits) -> Schedule:
    """By id, what still fits into all bounds is admitted; what doesn't is skipped and uses up nothing, so later and smaller work may still be admitted."""
    admitted, skipped, cost, segments = [], [], 0, 0
    ids = [w.id for w in work]
    if any(not i.strip() for i in ids):
        raise EngineError("work_id", "a work id must not be blank")
    if len(set(ids)) < len(ids):
        raise EngineError("work_id", "work ids must differ")
    for w in sorted(work, key=lambda w: w.id.encode()):
        if len(admitted) < limits.work_items and cost + w.cost <= limits.total_cost and segments + w.segments <= limits.total_segments:
            admitted.append(w)
            cost, segments = cost + w.cost, segments + w.segments
        else:
            skipped.append(w.id)
    return Schedule(tuple(admitted), tuple(skipped), limits.parallelism)


def schedule(work: DataFrame, limits: Limits, key: str = "batch") -> DataFrame:
    """:func:`build` for each ``key`` of ``work`` (key, id, cost, segments): key, id, cost, segments, admitted, wave (null if skipped).

    An admission depends on all before it, so one key's work is folded in order; different keys are folded side by side. Ids of a key must differ.
    """
    unit = "array<struct<id:string,cost:bigint,segments:bigint,admitted:boolean>>"
    start = F.expr(f"named_struct('n', 0L, 'cost', 0L, 'segments', 0L, 'out', cast(array() as {unit}))")

    def step(acc, w):
        fits = (acc["n"] < limits.work_items) & (acc["cost"] <= limits.total_cost - w["cost"]) & (acc["segments"] <= limits.total_segments - w["segments"])
        add = lambda name, value: (acc[name] + F.when(fits, value).otherwise(F.lit(0).cast("bigint"))).alias(name)
        return F.struct(add("n", F.lit(1).cast("bigint")), add("cost", w["cost"]), add("segments", w["segments"]), F.concat(acc["out"], F.array(F.struct(w["id"].alias("id"), w["cost"].alias("cost"), w["segments"].alias("segments"), fits.alias("admitted")))).alias("out"))

    own = F.array_sort(F.collect_list(F.struct("id", F.col("cost").cast("bigint").alias("cost"), F.col("segments").cast("bigint").alias("segments"))))
    rows = work.groupBy(key).agg(F.aggregate(own, start, step)["out"].alias("w")).select(key, F.explode("w").alias("w")).select(key, "w.*")
    place = F.sum(F.col("admitted").cast("int")).over(Window.partitionBy(key).orderBy("id"))
    return rows.withColumn("wave", F.when(F.col("admitted"), F.floor((place - 1) / limits.parallelism)))


@dataclass(frozen=True)
class SearchRequest:
    media: MediaRef
    lineage: Lineage
    query: str
    limit: int
    max_cold_segments: int
    costs: CostModel

    def __post_init__(self) -> None:
        if self.lineage.media_uri != self.media.uri:
            raise EngineError("search_source", "the lineage must be the medium's own")
        if not 1 <= self.max_cold_segments <= MOST_TRANSCRIPT_SEGMENTS:
            raise EngineError("transcript_limit", f"1 to {MOST_TRANSCRIPT_SEGMENTS} segments")


@dataclass(frozen=True)
class Explanation:
    strategy: str  # persisted_index or cold_extraction
    cost: int
    schedule: Schedule | None
    limits: Limits


def explain(index: DataFrame, request: SearchRequest, limits: Limits) -> Explanation:
    """Whether rows of exactly the request's lineage are persisted, and if not, what the cold work costs and whether it is admitted."""
    if not search.compatible(index, request.lineage).isEmpty():
        return Explanation("persisted_index", request.costs.lookup, None, limits)
    cost = request.costs.cold(request.max_cold_segments)
    return Explanation("cold_extraction", cost, build([Work(request.media.uri, cost, request.max_cold_segments)], limits), limits)


def matching_segments(index: DataFrame, request: SearchRequest, limits: Limits, provider: Transcription) -> list[tuple]:
    """Up to ``limit`` matching segments (media_id, start_millis, end_millis, text, confidence_millis): from the index, or else from ``provider`` within the schedule."""
    found = explain(index, request, limits)
    if not request.limit:
        return []
    if found.strategy == "persisted_index":
        rows = search.search_transcripts(index, request.query, request.limit, ["insert_ordinal"], request.lineage)
        return [tuple(r) for r in rows.select("media_id", "start_millis", "end_millis", "text", "confidence_millis").collect()]  # at most `limit` rows
    if not found.schedule.segments:
        return []
    most = min(found.schedule.segments, MOST_TRANSCRIPT_SEGMENTS)
    return cold_segments(provider, [request.media], request.query, request.lineage, request.limit, most)


def cold_segments(provider: Transcription, media: list[MediaRef], query: str, lineage: Lineage, limit: int, most: int = MOST_TRANSCRIPT_SEGMENTS) -> list[tuple]:
    """The first ``limit`` segments of ``media``, in order, that hold ``query``; providers are called only until there are so many."""
    out: list[Segment] = []
    for medium in media:
        if len(out) >= limit:
            break
        for s in provider.transcribe(TranscriptionRequest(medium, lineage, max_segments=most)):
            if s.lineage != lineage:
                raise EngineError("provider_lineage", "a provider's result must be of the lineage that was asked for")
            if query.lower() in s.text.lower():
                out.append(s)
    return [s.row()[:5] for s in out[:limit]]


def strategy(index: DataFrame, lineage: Lineage) -> str:
    return "cold" if search.compatible(index, lineage).isEmpty() else "indexed"
