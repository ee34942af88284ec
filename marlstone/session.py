"""The engine's session: registration of tables, SQL with the engine's functions, searches over session indexes, and governed queries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import export, model
from marlstone.functions import names
from marlstone.governance import Governor, Queries
from marlstone.model import Embedding, EngineError, Lineage, MediaRef, Segment
from marlstone.operators import audio, documents, schedule, search, table_functions
from marlstone.operators.providers import HashEmbedder, NoProvider, TranscriptionRequest
from marlstone.sources import delta
from marlstone.sources.catalog import check_identifier

#: What a statement may begin with where only reading is allowed.
_READING = re.compile(r"\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*\(*\s*(SELECT|WITH|VALUES|EXPLAIN|SHOW|DESCRIBE|DESC|TABLE|FROM)\b", re.I | re.S)
_WRITING = re.compile(r"\b(INSERT\s+(INTO|OVERWRITE)|MERGE\s+INTO|DELETE\s+FROM|UPDATE\s+\S+\s+SET|DROP|TRUNCATE|ALTER|CREATE)\b", re.I)


def is_reading(text: str) -> bool:
    """Whether a statement can only read: by its first word, and since a WITH or an EXPLAIN may go before a change, by none of the words for one outside of strings."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", text)
    return bool(_READING.match(text)) and not _WRITING.search(bare) and ";" not in bare.rstrip().rstrip(";")


class MediaSession:
    """``mock_dimensions`` gives a deterministic embedder for tests; without it or ``embedder`` vector searches are refused."""

    def __init__(self, spark: SparkSession, mock_dimensions: int | None = None, embedder=None, transcription=None, ocr=None, decoder=None, governor: Governor | None = None, read_only: bool = False):
        self.spark, self.read_only = spark, read_only
        self.embedder = embedder or (HashEmbedder(mock_dimensions) if mock_dimensions is not None else NoProvider("embedding model"))
        self.transcription = transcription or NoProvider("transcription")
        self.queries = Queries(spark, governor)
        self._segments: DataFrame = spark.createDataFrame([], model.SEGMENTS)
        self._persisted: DataFrame = self._segments
        self._embeddings: DataFrame = spark.createDataFrame([], model.EMBEDDINGS)
        self._cross_modal: DataFrame = spark.createDataFrame([], model.CROSS_MODAL)
        self._next = {"segments": 0, "persisted": 0, "embeddings": 0, "cross_modal": 0}
        self._lineage: Lineage | None = None
        self._dimensions: dict[str, int] = {}
        self._embeds = not isinstance(self.embedder, NoProvider)
        names.register(spark)
        table_functions.register(spark, ocr, decoder)
        if self._embeds:
            provider = self.embedder
            spark.udf.register("embed_text", F.udf(lambda text: None if text is None else [float(x) for x in provider.embed(text)], "array<float>"))
        self._show()

    def _show(self) -> None:
        self._segments.createOrReplaceTempView("_session_segments")
        self._embeddings.createOrReplaceTempView("_session_embeddings")
        table_functions.register_searches(self.spark, "_session_segments", "_session_embeddings", "embed_text" if self._embeds else None)

    # --- registration

    def register_media_refs(self, table: str, media: list[MediaRef]) -> None:
        """A view of one column, ``media``."""
        self.spark.createDataFrame([(m.row(),) for m in media], f"media {model.MEDIA}").createOrReplaceTempView(check_identifier(table))

    def register_parquet(self, table: str, path: str, remote: bool = False) -> None:
        """A lazy view of Parquet files; other stores than the local one only with ``remote``."""
        if not remote:
            path = table_functions.local_path(path)
        self.spark.read.parquet(path).createOrReplaceTempView(check_identifier(table))

    def register_files(self, table: str, path: str, kind: str, schema: str | None = None, **options) -> None:
        """A lazy view of CSV, JSON, ORC, text or Arrow IPC files."""
        if kind == "arrow":
            df = arrow_files(self.spark, path)
        elif kind in ("csv", "json", "orc", "text"):
            reader = self.spark.read.options(**options)
            df = (reader.schema(schema) if schema else reader).format(kind).load(path)
        else:
            raise EngineError("file_kind", "csv, json, orc, text or arrow")
        df.createOrReplaceTempView(check_identifier(table))

    def register_table(self, table: str, df: DataFrame, schema: str | None = None) -> None:
        """A view of any DataFrame; in a ``schema`` (made if need be) it is written as a table of the session catalog."""
        check_identifier(table)
        if schema is None:
            df.createOrReplaceTempView(table)
            return
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{check_identifier(schema)}`")
        df.write.mode("overwrite").saveAsTable(f"`{schema}`.`{table}`")

    def register_parquet_in_schema(self, schema: str, table: str, path: str, catalog: str = "spark_catalog") -> None:
        """An external table ``catalog.schema.table`` over Parquet files; nothing is copied."""
        for name in (catalog, schema, table):
            check_identifier(name)
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{catalog}`.`{schema}`")
        self.spark.sql(f"DROP TABLE IF EXISTS `{catalog}`.`{schema}`.`{table}`")
        self.spark.sql(f"CREATE TABLE `{catalog}`.`{schema}`.`{table}` USING parquet LOCATION '{path.replace(chr(39), chr(39) * 2)}'")

    def register_catalog(self, name: str, implementation: str, **options: str) -> None:
        """Attach a whole catalog by the class of its plug-in; its tables are ``name.schema.table``."""
        self.spark.conf.set(f"spark.sql.catalog.{check_identifier(name)}", implementation)
        for k, v in options.items():
            self.spark.conf.set(f"spark.sql.catalog.{name}.{k}", v)

    def register_delta(self, table: str, root: str, version: int | None = None) -> None:
        delta.register(self.spark, check_identifier(table), root, version)

    def register_documents(self, table: str, path: str, what: str = "sections") -> None:
        """Sections, tables or images of all documents at a path of any store that Spark reads."""
        table_functions.documents_at(self.spark, path, what).createOrReplaceTempView(check_identifier(table))

    def register_remote_document_sections(self, table: str, media: MediaRef, fetch: Callable[[MediaRef], tuple[bytes, str | None]]) -> None:
        """Sections of one document that ``fetch`` gives with its etag; the version is the etag, or the size."""
        data, etag = fetch(media)
        version = etag or f"size:{len(data)}"
        rows = [(media.uri, version, s.ordinal, s.heading, s.text) for s in documents.sections(data)]
        self.spark.createDataFrame(rows, table_functions.SECTIONS).createOrReplaceTempView(check_identifier(table))

    def register_audio_chunks(self, table: str, media: MediaRef, start: int, end: int, segment: int, limit: int, include_payload: bool = False) -> None:
        """Chunks of a local recording, decoded when the view is read."""
        audio.chunk_samples(start, end, segment, limit)
        args = (f"'{media.uri.replace(chr(39), chr(39) * 2)}'", *map(str, (start, end, segment, limit)), str(include_payload).lower())
        self.spark.sql(f"SELECT * FROM audio_segments({', '.join(args)})").createOrReplaceTempView(check_identifier(table))

    def register_video_frames(self, table: str, media: MediaRef, start: int, end: int, every: int, limit: int, include_rgb24: bool = False) -> None:
        args = (f"'{media.uri.replace(chr(39), chr(39) * 2)}'", *map(str, (start, end, every, limit)), str(include_rgb24).lower())
        self.spark.sql(f"SELECT * FROM video_frames({', '.join(args)})").createOrReplaceTempView(check_identifier(table))

    # --- session indexes

    def _numbered(self, kind: str, rows: list[tuple], schema: str) -> DataFrame:
        first = self._next[kind]
        self._next[kind] += len(rows)
        return self.spark.createDataFrame([(*r, first + k) for k, r in enumerate(rows)], schema)

    def register_transcript_segments(self, rows: list[Segment]) -> None:
        self._segments = self._segments.unionByName(self._numbered("segments", [r.row() for r in rows], model.SEGMENTS))
        self._show()

    def register_persisted_transcript_segments(self, rows: list[Segment]) -> None:
        """Segments that a media search may use in the place of cold work of exactly their lineage."""
        self._persisted = self._persisted.unionByName(self._numbered("persisted", [r.row() for r in rows], model.SEGMENTS))

    def register_embedding_records(self, rows: list[Embedding]) -> None:
        """All of one lineage, source included, and of one length. All are taken or none."""
        lineage = self._lineage or (rows[0].lineage if rows else None)
        if any(r.lineage != lineage for r in rows):
            raise EngineError("embedding_lineage", "the session's embeddings must be of one lineage")
        self._admit("embeddings", rows)
        self._lineage = lineage
        self._embeddings = self._embeddings.unionByName(self._numbered("embeddings", [r.row() for r in rows], model.EMBEDDINGS))
        self._show()

    def register_cross_modal_records(self, rows: list[Embedding]) -> None:
        if any(r.kind is None for r in rows):
            raise EngineError("kind", "records of several kinds must name theirs")
        self._admit("cross_modal", rows)
        self._cross_modal = self._cross_modal.unionByName(self._numbered("cross_modal", [r.row() for r in rows], model.CROSS_MODAL))

    def _admit(self, kind: str, rows: list[Embedding]) -> None:
        lengths = {len(r.values) for r in rows} | ({self._dimensions[kind]} if kind in self._dimensions else set())
        if len(lengths) > 1:
            raise EngineError("embedding_dimensions", "all vectors of an index have one length")
        if self._next[kind] + len(rows) > model.MOST_RESULTS:
            raise EngineError("index_capacity", f"an index holds {model.MOST_RESULTS} rows at most")
        self._dimensions |= {kind: n for n in lengths}

    # --- searches

    def transcript_search(self, query: str, limit: int = 100) -> DataFrame:
        """By insertion order, over all lineages; an empty query is in every segment."""
        model.check_limit(limit, model.MOST_SEARCH_RESULTS)
        found = search.search_transcripts(self._segments, query, limit, ["insert_ordinal"])
        return found.select("media_id", "start_millis", "end_millis", "text", "confidence_millis", "source_uri", "source_version")

    def semantic_search(self, query: str, limit: int = 10, candidates: int = 0) -> DataFrame:
        return self._ranked(query, limit, candidates, None)

    def hybrid_search(self, query: str, limit: int = 10, candidates: int = 0, weight: float = 0.5) -> DataFrame:
        return self._ranked(query, limit, candidates, weight)

    def _ranked(self, query: str, limit: int, candidates: int, weight: float | None) -> DataFrame:
        if not query.strip():
            raise EngineError("empty_query", "a search by meaning needs a query")
        with self.queries.governor.permit("cpu"):
            vector = self.embedder.embed(query)
        args = (candidates, self._lineage, "insert_ordinal")
        found = search.rank(self._embeddings, vector, limit, *args) if weight is None else search.rank_hybrid(self._embeddings, vector, query, limit, weight, *args)
        return found.select("id", "text", "score", "ranking_semantics")

    def search_cross_modal(self, vector: list[float], lineage: Lineage, limit: int = 10, candidates: int = 0) -> DataFrame:
        return search.rank_records(self._cross_modal, vector, limit, lineage, candidates)

    def document_search(self, uri: str, query: str, limit: int = 100) -> DataFrame:
        data = documents.read_file(table_functions.local_path(uri))
        rows = [(uri, f"size:{len(data)}", *r) for r in documents.search(data, query, limit)]
        return self.spark.createDataFrame(rows, table_functions.FOUND)

    def explain_media_search(self, request: schedule.SearchRequest, limits: schedule.Limits) -> schedule.Explanation:
        return schedule.explain(self._persisted, request, limits)

    def media_search(self, request: schedule.SearchRequest, limits: schedule.Limits) -> list[tuple]:
        with self.queries.governor.permit("cpu"):
            return schedule.matching_segments(self._persisted, request, limits, self.transcription)

    def transcribe(self, uri: str, media_type: str, lineage: Lineage, start: int = 0, end: int = 2**63 - 1, max_segments: int = model.MOST_TRANSCRIPT_SEGMENTS) -> int:
        """Transcribe a medium into the session's index; returns the number of segments."""
        if media_type not in ("audio", "video"):
            raise EngineError("media_type", "audio or video")
        if not 1 <= max_segments <= model.MOST_TRANSCRIPT_SEGMENTS:
            raise EngineError("transcript_limit", f"1 to {model.MOST_TRANSCRIPT_SEGMENTS} segments")
        with self.queries.governor.permit("cpu"):
            rows = self.transcription.transcribe(TranscriptionRequest(MediaRef(uri, media_type), lineage, start, end, max_segments))
        if len(rows) > max_segments or any(r.lineage != lineage for r in rows):
            raise EngineError("provider_lineage", "a provider's result must be of the lineage and number that was asked for")
        self.register_transcript_segments(rows)
        return len(rows)

    def media_metadata(self, uri: str) -> tuple[int | None, int, int]:
        return audio.media_metadata(table_functions.local_path(uri))

    def audio_metadata(self, uri: str) -> tuple[int, int]:
        return audio.audio_metadata(table_functions.local_path(uri))

    # --- SQL

    def plan(self, text: str, args: dict | list | None = None) -> DataFrame:
        """A statement's lazy result; a read-only session refuses statements that could change something."""
        if self.read_only and not is_reading(text):
            raise EngineError("read_only", "this session only reads")
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def sql(self, text: str, args: dict | list | None = None) -> list[dict[str, str | None]]:
        """All rows as display strings."""
        return export.display_rows(self.plan(text, args))

    execute = sql

    def explain(self, text: str, mode: str = "FORMATTED") -> str:
        """The plan of a statement; a statement that begins with EXPLAIN is taken as it is."""
        own = text if re.match(r"\s*EXPLAIN\b", text, re.I) else f"EXPLAIN {mode} {text}"
        return self.plan(own).first()[0]

    def sql_arrow(self, text: str, args: dict | list | None = None) -> pa.RecordBatchReader:
        return export.reader(self.plan(text, args))

    def sql_arrow_ipc(self, text: str, args: dict | list | None = None) -> bytes:
        return export.arrow_bytes(self.plan(text, args))

    def catalog_tables(self) -> list[tuple[str | None, str | None, str]]:
        """(catalog, schema, table) of all that is registered, the session's own views left out."""
        found = [(t.catalog, (t.namespace or [None])[-1], t.name) for t in self.spark.catalog.listTables()]
        for db in self.spark.catalog.listDatabases():
            found += [(t.catalog, (t.namespace or [db.name])[-1], t.name) for t in self.spark.catalog.listTables(db.name) if not t.isTemporary]
        return sorted({t for t in found if not t[2].startswith("_session_")}, key=str)

    # --- governed queries

    def create_query(self, text: str, seconds: float | None = None) -> str:
        return self.queries.create(text, seconds)

    def cancel_query(self, query_id: str) -> bool:
        return self.queries.cancel(query_id)

    def query_status(self, query_id: str) -> str:
        return self.queries.get(query_id).status

    def query_audit(self, query_id: str) -> dict:
        return self.queries.get(query_id).audit()

    def execute_query(self, query_id: str) -> Iterator[pa.RecordBatch]:
        own = self.queries.get(query_id)
        return self.queries.run(query_id, self.plan(own.text))

    def collect_with_progress(self, text: str, told: Callable[[int], None]) -> pa.Table:
        """The whole result, with the number of rows so far told after each batch."""
        found, n = [], 0
        query_id = self.create_query(text)
        for batch in self.execute_query(query_id):
            found.append(batch)
            n += batch.num_rows
            told(n)
        return pa.Table.from_batches(found)


def arrow_files(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, stream or file format, in any store that Spark reads; the schema is that of the first file. A file is one task's."""
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")

    def opened(raw: bytes) -> pa.RecordBatchReader:
        source = pa.BufferReader(raw)
        return pa.ipc.open_file(source).read_all().to_reader() if raw[:6] == b"ARROW1" else pa.ipc.open_stream(source)

    first = files.first()
    if first is None:
        raise EngineError("no_files", f"no file at {path}")
    schema = opened(bytes(first["content"])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for own in opened(raw.as_py()):
                    yield pa.record_batch([own.column(f.name).cast(f.type) for f in schema], schema=schema)

    return files.mapInArrow(run, from_arrow_schema(schema))


# --- volumes and metadata of a Unity-style catalog service


def volume_media_ref(path: str, media_type: str) -> MediaRef:
    """``/Volumes/catalog/schema/volume/rest`` as a reference that names the volume."""
    parts = path.split("/")
    if len(parts) < 6 or parts[:2] != ["", "Volumes"] or any(p in ("", ".", "..") for p in parts[2:]):
        raise EngineError("volume_path", "/Volumes/catalog/schema/volume/file is due")
    catalog, schema, volume = map(check_identifier, parts[2:5])
    return MediaRef(f"unity-volume://{catalog}/{schema}/{volume}/{'/'.join(parts[5:])}", media_type, catalog_ref=f"{catalog}.{schema}.{volume}", metadata={"volume_path": path})


def register_resolved_table(session: MediaSession, table: str, resolved: dict, version: int | None = None) -> None:
    """Register a table that a catalog service has described: managed or external, Parquet or Delta, at a local address. Others are refused by name."""
    kind, form, place = resolved.get("table_type"), resolved.get("data_source_format"), resolved.get("storage_location") or ""
    if kind not in ("MANAGED", "EXTERNAL") or form not in ("PARQUET", "DELTA"):
        raise EngineError("unsupported_table", f"{kind} tables in {form} can't be registered")
    if urlsplit(place).scheme != "file":
        raise EngineError("unsupported_table", "only tables at a local address can be registered")
    path = unquote(urlsplit(place).path)
    if not Path(path).exists():
        raise EngineError("table_missing", "the table's address doesn't exist")
    if form == "DELTA":
        session.register_delta(table, path, version)
    else:
        session.register_parquet(table, path)


def attach_schema(session: MediaSession, tables: list[dict]) -> tuple[list[str], dict[str, str]]:
    """Register all tables of a listing that can be; the others are reported with the reason."""
    done, refused = [], {}
    for t in tables:
        try:
            register_resolved_table(session, t["name"], t)
            done.append(t["name"])
        except EngineError as e:
            refused[t["name"]] = e.code
    return done, refused
