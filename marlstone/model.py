"""Value classes of the engine, their checks, and the schemas of its relations."""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import asdict, dataclass, field
from urllib.parse import parse_qsl, urlsplit

from marlstone.functions.media import CREDENTIALS

#: Bounds that are part of results (fixed values).
MOST_RESULTS, MOST_SEARCH_RESULTS, MOST_DIMENSIONS = 10_000, 1_024, 4_096
MOST_TRANSCRIPT_SEGMENTS, MOST_OCR_BYTES, MOST_OCR_RESULTS, MOST_IMAGE_TAGS = 1_024, 32 << 20, 1_024, 256
STORAGE_MODES = ("external", "managed", "inline")
KINDS = ("transcript", "document", "image", "audio", "video")

MEDIA = "struct<uri:string,media_type:string,mime_type:string,size_bytes:bigint,etag:string,modified_at:timestamp_ntz,catalog_ref:string,storage_mode:string,metadata:map<string,string>>"
_LINEAGE = "source_uri string, source_version string, operator_version string, model string, model_version string, parameters_json string"
SEGMENTS = f"media_id string, start_millis bigint, end_millis bigint, text string, confidence_millis int, {_LINEAGE}, insert_ordinal bigint"
EMBEDDINGS = f"id string, text string, values array<float>, {_LINEAGE}, insert_ordinal bigint"
CROSS_MODAL = f"id string, kind string, text string, values array<float>, {_LINEAGE}, insert_ordinal bigint"
FEATURES = f"media {MEDIA}, source_uri string, source_version string, feature_kind string, payload_json string, operator_version string, model string, model_version string, parameters_json string"
INDEX_ROWS = f"id string, text string, values_json string, {_LINEAGE}"
TRANSCRIPTS = "source_uri string, source_version string, start_millis bigint, end_millis bigint, text string, confidence_millis int, operator_version string, model string, model_version string, parameters_json string"


class EngineError(ValueError):
    """A request that the engine refuses, with a stable code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Unavailable(EngineError):
    """No provider has been given for what is asked."""

    def __init__(self, capability: str):
        super().__init__("provider_unavailable", f"no {capability} provider has been given")


def check_uri(uri: str) -> str:
    """``uri`` if it is absolute and carries neither a user nor a credential among its query parameters."""
    parts = urlsplit(uri)
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", parts.scheme or ""):
        raise EngineError("relative_uri", f"not an absolute address: {uri}")
    if parts.username or parts.password is not None or any(k.lower() in CREDENTIALS for k, _ in parse_qsl(parts.query, keep_blank_values=True)):
        raise EngineError("credential_in_uri", "a media address must not carry credentials")
    return uri


def canonical(value) -> str:
    """JSON in one form for equal values: sorted keys, no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def refuse_credentials(value) -> None:
    """Refuse JSON in which a key, at any depth, contains ``token`` or ``secret``, or is ``signature`` or ``sig``, in any case."""
    if isinstance(value, dict):
        for key, inner in value.items():
            low = str(key).lower()
            if "token" in low or "secret" in low or low in ("signature", "sig"):
                raise EngineError("credential_in_payload", f"a payload must not hold the credential-like field {key}")
            refuse_credentials(inner)
    elif isinstance(value, list):
        for inner in value:
            refuse_credentials(inner)


def check_dimensions(n: int) -> int:
    if not 1 <= n <= MOST_DIMENSIONS:
        raise EngineError("embedding_dimensions", f"vectors have 1 to {MOST_DIMENSIONS} components")
    return n


def check_limit(limit: int, most: int = MOST_RESULTS) -> int:
    if not 0 <= limit <= most:
        raise EngineError("limit", f"limit must be from 0 to {most}")
    return limit


@dataclass(frozen=True)
class MediaRef:
    """A portable reference to a medium; never its bytes."""

    uri: str
    media_type: str
    storage_mode: str = "external"
    mime_type: str | None = None
    size_bytes: int | None = None
    etag: str | None = None
    modified_at: datetime.datetime | None = None
    catalog_ref: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_uri(self.uri)
        if not self.media_type.strip():
            raise EngineError("empty_media_type", "media_type must not be blank")
        if self.storage_mode not in STORAGE_MODES:
            raise EngineError("storage_mode", f"storage_mode is one of {', '.join(STORAGE_MODES)}")

    def row(self) -> tuple:
        return (self.uri, self.media_type, self.mime_type, self.size_bytes, self.etag, self.modified_at, self.catalog_ref, self.storage_mode, dict(self.metadata))


@dataclass(frozen=True)
class Lineage:
    """What a derived row was made from and by. Two lineages are compatible only if all of it is equal."""

    media_uri: str
    source_version: str
    operator_version: str
    model: str | None = None
    model_version: str | None = None
    parameters: dict[str, str] = field(default_factory=dict)

    def is_compatible_with(self, other: Lineage) -> bool:
        return self == other

    def row(self) -> tuple:
        return (self.media_uri, self.source_version, self.operator_version, self.model, self.model_version, canonical(self.parameters))

    def plain(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Segment:
    """A piece of a transcript; times in milliseconds, confidence in thousandths."""

    media_id: str
    start_millis: int
    end_millis: int
    text: str
    lineage: Lineage
    confidence_millis: int | None = None

    def __post_init__(self) -> None:
        if self.end_millis < self.start_millis:
            raise EngineError("transcript_range", "a segment must not end before it starts")

    def row(self) -> tuple:
        return (self.media_id, self.start_millis, self.end_millis, self.text, self.confidence_millis, *self.lineage.row())


@dataclass(frozen=True)
class Embedding:
    id: str
    text: str
    values: tuple[float, ...]
    lineage: Lineage
    kind: str | None = None

    def __post_init__(self) -> None:
        check_dimensions(len(self.values))
        if self.kind is not None and self.kind not in KINDS:
            raise EngineError("kind", f"kind is one of {', '.join(KINDS)}")

    def row(self) -> tuple:
        head = (self.id, self.text) if self.kind is None else (self.id, self.kind, self.text)
        return (*head, [float(v) for v in self.values], *self.lineage.row())


@dataclass(frozen=True)
class Feature:
    """A derived feature with a canonical JSON payload."""

    media: MediaRef
    lineage: Lineage
    feature_kind: str
    payload_json: str

    def __post_init__(self) -> None:
        value = json.loads(self.payload_json)
        if not self.feature_kind.strip():
            raise EngineError("empty_feature_kind", "feature_kind must not be blank")
        if self.lineage.media_uri != self.media.uri:
            raise EngineError("source_uri_mismatch", "the lineage's address must be the reference's")
        refuse_credentials(value)
        object.__setattr__(self, "payload_json", canonical(value))

    def row(self) -> tuple:
        uri, version, *rest = self.lineage.row()
        return (self.media.row(), uri, version, self.feature_kind, self.payload_json, *rest)


@dataclass(frozen=True)
class IndexRow:
    """A row of a persisted vector index: its values are JSON, so that any client can read the table."""

    id: str
    text: str
    values_json: str
    lineage: Lineage

    def __post_init__(self) -> None:
        if not self.id.strip():
            raise EngineError("empty_index_id", "an index row's id must not be blank")

    @staticmethod
    def of(row: Embedding) -> IndexRow:
        return IndexRow(row.id, row.text, canonical([float(v) for v in row.values]), row.lineage)

    def row(self) -> tuple:
        return (self.id, self.text, self.values_json, *self.lineage.row())


@dataclass(frozen=True)
class ByteRange:
    start: int
    end: int
    source_length: int

    def __post_init__(self) -> None:
        if self.start < 0 or self.start >= self.end:
            raise EngineError("byte_range", "a byte range must not be empty")
        if self.end > self.source_length:
            raise EngineError("byte_range", "a byte range must end within its source")

    def __len__(self) -> int:
        return self.end - self.start
