"""What models an application may give the engine. Without one, the engine refuses: it never makes results up."""

from __future__ import annotations

import json
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.model import MOST_IMAGE_TAGS, MOST_OCR_BYTES, MOST_OCR_RESULTS, MOST_TRANSCRIPT_SEGMENTS, EngineError, Lineage, MediaRef, Segment, Unavailable, check_dimensions


@dataclass(frozen=True)
class TranscriptionRequest:
    media: MediaRef
    lineage: Lineage
    start_millis: int = 0
    end_millis: int = 2**63 - 1
    max_segments: int = MOST_TRANSCRIPT_SEGMENTS

    def __post_init__(self) -> None:
        if self.end_millis < self.start_millis:
            raise EngineError("transcription_request", "a request must not end before it starts")


class Transcription(Protocol):
    def transcribe(self, request: TranscriptionRequest) -> list[Segment]: ...


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...


@dataclass(frozen=True)
class ImageRequest:
    """Encoded image bytes for one provider call."""

    data: bytes
    media_type: str | None
    lineage: Lineage
    max_results: int = MOST_OCR_RESULTS

    def __post_init__(self) -> None:
        if len(self.data) > MOST_OCR_BYTES:
            raise EngineError("provider_input", f"an image may have {MOST_OCR_BYTES} bytes at most")
        if not 1 <= self.max_results <= MOST_OCR_RESULTS:
            raise EngineError("provider_limit", f"1 to {MOST_OCR_RESULTS} results")


@dataclass(frozen=True)
class OcrText:
    ordinal: int
    text: str
    lineage: Lineage
    confidence_millis: int | None = None


@dataclass(frozen=True)
class ImageMetadata:
    lineage: Lineage
    media_type: str | None = None
    width: int | None = None
    height: int | None = None


@dataclass(frozen=True)
class ImageUnderstanding:
    lineage: Lineage
    caption: str | None = None
    tags: tuple[str, ...] = field(default=())


class NoProvider:
    """Stands where no provider has been given."""

    def __init__(self, capability: str):
        self.capability = capability

    def _refuse(self, *_):
        raise Unavailable(self.capability)

    transcribe = embed = recognize = inspect = understand = _refuse


def _same_lineage(found: Lineage, asked: Lineage) -> None:
    if found != asked:
        raise EngineError("provider_lineage", "a provider's result must be of the lineage that was asked for")


def run_ocr(provider, request: ImageRequest) -> list[OcrText]:
    rows = provider.recognize(request)
    if len(rows) > request.max_results:
        raise EngineError("provider_limit", f"more than {request.max_results} results")
    for row in rows:
        _same_lineage(row.lineage, request.lineage)
    return rows


def run_image_metadata(provider, request: ImageRequest) -> ImageMetadata:
    found = provider.inspect(request)
    _same_lineage(found.lineage, request.lineage)
    return found


def run_image_understanding(provider, request: ImageRequest) -> ImageUnderstanding:
    found = provider.understand(request)
    _same_lineage(found.lineage, request.lineage)
    if len(found.tags) > MOST_IMAGE_TAGS:
        raise EngineError("provider_limit", f"more than {MOST_IMAGE_TAGS} tags")
    return found


# --- a deterministic embedder, for tests

#: The parameters of 64-bit FNV-1a (fixed values).
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def _lower_ascii(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


class HashEmbedder:
    """Counts of hashed words, as unit vectors: no model, always the same result."""

    def __init__(self, dimensions: int):
        self.dimensions = check_dimensions(dimensions)

    def embed(self, text: str) -> list[float]:
        out = np.zeros(self.dimensions, np.float32)
        for word in text.split():
            out[fnv1a(_lower_ascii(word).encode("utf-8", "surrogatepass")) % self.dimensions] += 1
        norm = np.sqrt((out * out).sum(dtype=np.float32))
        return (out / norm if norm else out).tolist()


def embed_column(provider: Embedder, text: Column) -> Column:
    """``provider``'s vectors of a column of texts (null: null), batch by batch; the provider travels with the plan."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else provider.embed(t))

    return run(text)


# --- providers as programs of their own


@dataclass(frozen=True)
class Program:
    """A program that reads one JSON request from its input and writes one JSON answer. It is run without a shell, in a folder of its own, and stopped in time."""

    argv: tuple[str, ...]
    seconds: float = 60.0
    most_bytes: int = 64 << 20

    def __post_init__(self) -> None:
        if not 1 <= len(self.argv) <= 64:
            raise EngineError("provider_program", "1 to 64 arguments")

    def ask(self, request: dict, stopped: Callable[[], bool] = lambda: False) -> dict:
        with tempfile.TemporaryDirectory() as folder, open(f"{folder}/answer", "w+b") as answer:
            Path(folder, "request").write_text(json.dumps(request))
            with open(f"{folder}/request", "rb") as given:
                run = subprocess.Popen(list(self.argv), cwd=folder, stdin=given, stdout=answer, stderr=subprocess.DEVNULL)
            end, kind = time.monotonic() + self.seconds, None
            try:
                while run.poll() is None and kind is None:
                    kind = "cancelled" if stopped() else "deadline" if time.monotonic() > end else "output_limit" if Path(folder, "answer").stat().st_size > self.most_bytes else None
                    time.sleep(0.01)
            finally:
                if run.poll() is None:
                    run.kill()
                run.wait()
            if kind:
                raise EngineError(kind, f"a provider was stopped: {kind}")
            if run.returncode:
                raise EngineError("provider_failed", "a provider ended with an error")
            answer.seek(0)
            try:
                found = json.loads(answer.read(self.most_bytes + 1))
            except ValueError as e:
                raise EngineError("provider_answer", "a provider's answer isn't JSON") from e
            if not isinstance(found, dict):
                raise EngineError("provider_answer", "a provider's answer must be an object")
            return found


class ProgramEmbedder:
    """Embeddings of batches of up to 1,024 texts by a :class:`Program`: ``{"texts": [..]}`` -> ``{"vectors": [[..]]}``."""

    MOST = 1024

    def __init__(self, program: Program, dimensions: int):
        self.program, self.dimensions = program, check_dimensions(dimensions)

    def embed_all(self, texts: list[str], stopped: Callable[[], bool] = lambda: False) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.MOST):
            own = texts[at : at + self.MOST]
            found = self.program.ask({"texts": own, "dimensions": self.dimensions}, stopped).get("vectors")
            if not isinstance(found, list) or len(found) != len(own) or any(not isinstance(v, list) or len(v) != self.dimensions or not np.isfinite(np.array(v, float)).all() for v in found):
                raise EngineError("provider_answer", "one finite vector of the right length is due for each text")
            out += [[float(x) for x in v] for v in found]
        return out

    def embed(self, text: str) -> list[float]:
        return self.embed_all([text])[0]


class ProgramTranscription:
    """Transcripts by a :class:`Program`: ``{"uri", "start_millis", "end_millis", "max_segments"}`` -> ``{"segments": [{"start_millis", "end_millis", "text", "confidence_millis"?}]}``. Segments out of the window are left out."""

    def __init__(self, program: Program):
        self.program = program

    def transcribe(self, request: TranscriptionRequest) -> list[Segment]:
        found = self.program.ask({"uri": request.media.uri, "start_millis": request.start_millis, "end_millis": request.end_millis, "max_segments": request.max_segments}).get("segments")
        if not isinstance(found, list) or len(found) > request.max_segments:
            raise EngineError("provider_answer", "a list of segments is due, no longer than asked for")
        try:
            rows = [(int(s["start_millis"]), int(s["end_millis"]), str(s["text"]), s.get("confidence_millis")) for s in found]
        except (KeyError, TypeError, ValueError) as e:
            raise EngineError("provider_answer", "a segment lacks a field") from e
        return [Segment(request.media.uri, a, b, text, request.lineage, c) for a, b, text, c in rows if a >= request.start_millis and b <= request.end_millis]


