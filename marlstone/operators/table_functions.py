"""Table functions for SQL: documents and audio by address or content, also LATERAL over a column, and searches over the session's indexes.

Functions of files are Python table functions that run in tasks: over a column of addresses they are as parallel as its rows. Searches are SQL table functions that
Catalyst inlines: a scan and a top-k.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from marlstone.model import MOST_RESULTS, MOST_SEARCH_RESULTS, EngineError, Lineage
from marlstone.operators import audio, documents
from marlstone.operators.providers import ImageRequest, NoProvider, run_ocr

SECTIONS = "source_uri string, source_version string, ordinal int, heading string, text string"
TABLES = "source_uri string, source_version string, table_ordinal int, row_ordinal int, column_ordinal int, text string"
IMAGES = "source_uri string, source_version string, ordinal int, name string, media_type string, bytes binary"
FOUND = "source_uri string, source_version string, kind string, ordinal int, text string"
OCR = "source_uri string, source_version string, image_ordinal int, ordinal int, text string, confidence_millis int"
FRAMES = "source_uri string, timestamp_millis bigint, width int, height int, rgb24 binary"
AUDIO = "source_uri string, start_millis bigint, end_millis bigint, sample_rate_hz int, channel_count int, f32le binary"
#: Frames and their bytes in a call.
MOST_FRAMES, MOST_FRAME_BYTES = 32, 64 << 20


def local_path(uri: str) -> str:
    """The path of a ``file:`` address or of a plain path; other stores are read by Spark (see :func:`documents_at`)."""
    parts = urlsplit(uri)
    if parts.scheme == "file" and parts.netloc in ("", "localhost"):
        return unquote(parts.path)
    if len(parts.scheme) > 1:
        raise EngineError("unsupported_store", f"{parts.scheme} isn't a local store")
    return uri


def _document(uri: str) -> tuple[bytes, str]:
    path = local_path(uri)
    data, stat = documents.read_file(path), Path(path).stat()
    return data, f"size:{stat.st_size};mtime_ns:{stat.st_mtime_ns}"


def _sections(uri: str, version: str, data: bytes) -> Iterator[tuple]:
    return ((uri, version, s.ordinal, s.heading, s.text) for s in documents.sections(data))


def _tables(uri: str, version: str, data: bytes) -> Iterator[tuple]:
    return ((uri, version, t.ordinal, r, c, text) for t in documents.tables(data) for r, row in enumerate(t.rows) for c, text in enumerate(row))


def _images(uri: str, version: str, data: bytes, with_bytes: bool) -> Iterator[tuple]:
    return ((uri, version, i.ordinal, i.name, i.media_type, i.data if with_bytes else None) for i in documents.images(data))


@udtf(returnType=SECTIONS)
class DocumentSections:
    def eval(self, uri: str):
        if uri is not None:
            data, version = _document(uri)
            yield from _sections(uri, version, data)


@udtf(returnType=TABLES)
class DocumentTables:
    def eval(self, uri: str):
        if uri is not None:
            data, version = _document(uri)
            yield from _tables(uri, version, data)


@udtf(returnType=IMAGES)
class DocumentImages:
    def eval(self, uri: str, include_bytes: bool = False):
        if uri is not None:
            data, version = _document(uri)
            yield from _images(uri, version, data, bool(include_bytes))


@udtf(returnType=FOUND)
class DocumentSearch:
    def eval(self, uri: str, query: str, limit: int):
        data, version = _document(uri)
        yield from ((uri, version, *row) for row in documents.search(data, query, limit))


@udtf(returnType=AUDIO)
class AudioSegments:
    def eval(self, uri: str, start: int, end: int, segment: int, limit: int, include_payload: bool = False):
        for c in audio.decode(local_path(uri), start, end, segment, limit):
            yield uri, c.start_millis, c.end_millis, audio.RATE, 1, c.payload if include_payload else None


def ocr_function(provider):
    """DocumentOcr with ``provider``: text of each embedded image until ``limit`` rows."""

    @udtf(returnType=OCR)
    class DocumentOcr:
        def eval(self, uri: str, limit: int):
            data, version = _document(uri)
            lineage, left = Lineage(uri, version, "document-ocr-v1"), limit
            for image in documents.images(data):
                if left <= 0:
                    return
                for row in run_ocr(provider, ImageRequest(image.data, image.media_type, lineage, min(left, 1024)))[:left]:
                    left -= 1
                    yield uri, version, image.ordinal, row.ordinal, row.text, row.confidence_millis

    return DocumentOcr


def frames_function(decoder):
    """VideoFrames with ``decoder.frames(path)``, an iterator of (millis or None, width, height, rgb24): the first frame from ``start`` on, then each first one ``every`` later."""

    @udtf(returnType=FRAMES)
    class VideoFrames:
        def eval(self, uri: str, start: int, end: int, every: int, limit: int, include_rgb24: bool = False):
            if every < 1 or start < 0 or end < start or not 0 <= limit <= MOST_FRAMES:
                raise EngineError("video_request", f"a window from 0 on, a positive step and at most {MOST_FRAMES} frames")
            following, taken, size = start, 0, 0
            for millis, width, height, rgb in decoder.frames(local_path(uri)) if limit else ():
                if millis is None or millis > end or taken == limit:
                    return
                if millis >= following:
                    size += len(rgb) if include_rgb24 else 0
                    if size > MOST_FRAME_BYTES:
                        raise EngineError("payload_budget", "decoded frames would exceed 64 MiB")
                    taken, following = taken + 1, millis + every
                    yield uri, millis, width, height, rgb if include_rgb24 else None

    return VideoFrames


class NoDecoder:
    def frames(self, path: str):
        return NoProvider("video decoding")._refuse()


def register(spark: SparkSession, ocr=None, decoder=None) -> None:
    """All functions of files under their SQL names."""
    functions = {
        "document_sections": DocumentSections, "document_tables": DocumentTables, "document_images": DocumentImages, "document_search": DocumentSearch, "audio_segments": AudioSegments,
        "document_ocr": ocr_function(ocr or NoProvider("document OCR")), "video_frames": frames_function(decoder or NoDecoder()),
    }
    for name, function in functions.items():
        spark.udtf.register(name, function)


def documents_at(spark: SparkSession, path: str, what: str = "sections") -> DataFrame:
    """``sections``, ``tables`` or ``images`` of all files at ``path`` (a folder or pattern in any store that Spark reads): each file is one row of one task.

    Files beyond the size limit fail the job when they are listed, before any is read.
    """
    schema, made = {"sections": (SECTIONS, _sections), "tables": (TABLES, _tables), "images": (IMAGES, lambda *a: _images(*a, True))}[what]
    files = spark.read.format("binaryFile").load(path)
    size = F.when(F.col("length") > documents.DEFAULT.input_bytes, F.raise_error(F.lit("a document exceeds the size limit"))).otherwise(F.col("length"))
    rows = files.select("path", F.concat(F.lit("size:"), size.cast("string")).alias("version"), "content")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for uri, version, data in batch.itertuples(index=False):
                found = list(made(uri, version, data))
                if found:
                    yield pd.DataFrame(found, columns=names)

    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return rows.mapInPandas(run, schema)


def register_searches(spark: SparkSession, transcripts: str, embeddings: str, embedder: str | None) -> None:
    """transcript_search(query, limit), semantic_search(query, limit, candidates) and hybrid_search(query, limit, candidates, weight) over two views; ``embedder`` is a SQL function of a text."""
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION transcript_search(query STRING, n INT)
RETURNS TABLE (media_id STRING, start_millis BIGINT, end_millis BIGINT, text STRING, confidence_millis INT, source_uri STRING, source_version STRING)
RETURN SELECT media_id, start_millis, end_millis, text, confidence_millis, source_uri, source_version FROM (
  SELECT *, row_number() OVER (ORDER BY insert_ordinal) AS place FROM {transcripts} WHERE contains(lower(text), lower(transcript_search.query)) ORDER BY insert_ordinal LIMIT {MOST_SEARCH_RESULTS})
WHERE place <= transcript_search.n""")
    if embedder is None:
        return
    dot = "aggregate(zip_with(values, q, (x, y) -> x * y), CAST(0 AS FLOAT), (s, x) -> CAST(s + x AS FLOAT))"
    for name, extra, score, weight in (("semantic_search", "", "score", ""), ("hybrid_search", ", weight DOUBLE", "CAST(CAST(hybrid_search.weight AS FLOAT) * score + CAST(1 - hybrid_search.weight AS FLOAT) * share AS FLOAT)", "")):
        words = f"filter(split({name}.query, '\\\\s+'), w -> w != '')"
        low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        share = f"CAST(coalesce(try_divide(size(filter({words}, w -> contains({low.format('text')}, {low.format('w')}))), size({words})), 0) AS FLOAT)"
        spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, n INT, candidates INT{extra})
RETURNS TABLE (id STRING, text STRING, score FLOAT, ranking_semantics STRING)
RETURN SELECT id, text, {score} AS score, if({name}.candidates > 0, 'approximate', 'ranked') AS ranking_semantics FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM (
    SELECT id, text, {dot} AS score, {share} AS share FROM (
      SELECT e.*, row_number() OVER (ORDER BY insert_ordinal) AS nth, v.q FROM {embeddings} e CROSS JOIN (SELECT {embedder}({name}.query) AS q) v) r
    WHERE size(values) = size(q) AND ({name}.candidates = 0 OR nth <= {name}.candidates))
  ORDER BY score DESC, id LIMIT {MOST_RESULTS})
WHERE place <= {name}.n ORDER BY 3 DESC, 1""")
