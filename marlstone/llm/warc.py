"""WARC archives: a writer of one gzip member a record, and a sequential reader that verifies what it reads.

Archives lie in a folder that all executors reach (by default under ``spark.checkpoint.dir``). Every writing task makes files under names of its own and
reports them as rows; the reader opens reported files only, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_path, sized, stage

#: Shorter payloads are never revisits.
LEAST_BYTES = 100
#: A new archive begins once one has this many bytes.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
LEVEL = 2
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(hexed: str) -> str:
    return "sha256:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds the whole record."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers)]
    lines += [f"WARC-Block-Digest: {_base32(hashlib.sha256(block).hexdigest())}", f"Content-Length: {len(block)}"]
    raw = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    target = "".join((url or "").split()) or f"urn:page:{page_id}"
    own = [("WARC-Target-URI", target), ("WARC-Payload-Digest", _base32(digest)), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Bytes", str(len(payload)))]
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id}')}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        return record("response", name, [*own, ("Content-Type", "application/http;msgtype=response")], head + payload)
    own += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {refers_to}')}>"), ("X-Refers-To", str(refers_to)), ("Content-Type", "application/http;msgtype=response")]
    return record("revisit", name, own, head)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


class Damaged(ValueError):
    """An archive that does not hold what its frames or digests say."""


def members(source) -> Iterator[bytes]:
    """The content of each gzip member of a file object, inflated chunk by chunk; only one record is held at a time."""
    inflate, parts, fed = zlib.decompressobj(31), [], False
    while chunk := source.read(CHUNK):
        while chunk:
            fed = True
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error as e:
                raise Damaged(f"bad gzip member: {e}") from e
            chunk = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, fed = zlib.decompressobj(31), [], False
    if fed:
        raise Damaged("the last gzip member is cut off")


def parse(raw: bytes) -> Record:
    """Content-length framing and digests of one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise Damaged("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = headers.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Damaged("content length does not frame the record")
    found = Record(headers, rest[:-4])
    if (d := headers.get("warc-block-digest")) and d != _base32(hashlib.sha256(found.block).hexdigest()):
        raise Damaged("block digest differs")
    if headers.get("warc-type") == "response" and (d := headers.get("warc-payload-digest")) and d != _base32(hashlib.sha256(found.payload).hexdigest()):
        raise Damaged("payload digest differs")
    return found


def read_archive(path: str) -> Iterator[Record]:
    """The records of an archive in any store that Arrow opens by its address, in order."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression=None, buffer_size=CHUNK) as source:
        yield from map(parse, members(source))


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        out, done = None, []

        def close() -> None:
            nonlocal out
            if out:
                out.close()
                done[-1][2] = size
            out = None

        size = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None or size >= ARCHIVE_BYTES:
                    close()
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, size = store.open_output_stream(f"{base}/{name}", compression=None), 0
                    done.append([f"{folder}/{name}", 0, 0])
                    size += out.write(record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", [("Content-Type", "application/warc-fields"), ("WARC-Filename", name)], b"format: WARC File Format 1.1\r\n")) or 0
                number = lambda x: None if pd.isna(x) else int(x)
                raw = page_record(number(row.page_id), row.url, (row.html or "").encode("utf-8", "surrogatepass"), row.payload_digest, number(row.refers_to))
                out.write(raw)
                size += len(raw)
                done[-1][1] += 1
        close()
        if done:
            yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return run


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, expected in zip(batch["path"], batch["records"], strict=True):
            rows: list = []
            n = 0
            for r in read_archive(path):
                kind, h = r.headers["warc-type"], r.headers
                if kind == "warcinfo":
                    continue
                n += 1
                digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha256:")).hex()
                size = len(r.payload) if kind == "response" else int(h["x-payload-bytes"])
                rows.append((int(h["x-page-id"]) if h["x-page-id"] else None, size, digest, kind, int(h["x-refers-to"]) if "x-refers-to" in h else None))
                if len(rows) == 5000:
                    yield _frame(rows)
                    rows = []
            if n != expected:
                raise Damaged(f"{path} has {n} records; {expected} were written")
            yield _frame(rows)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def write_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one record a row of ``pages`` (page_id, url, html) into archives; returns their path, records and bytes.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least LEAST_BYTES bytes the one with the smallest page_id is the
    response and all others revisit it; rows that repeat that page_id are responses too. Rows with a null page_id are responses. Extra columns are ignored whatever their
    names; an empty table gives no archives. Pages are not shuffled to find revisits unless those are more than BROADCAST_KEYS.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("payload_digest"), F.length(payload).alias("n"))
    first = rows.where(f"n >= {LEAST_BYTES} and page_id is not null").groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    repeats = stage(
        rows.where(f"n >= {LEAST_BYTES} and page_id is not null").select("page_id", "payload_digest").join(first, "payload_digest").where("page_id != first").select("page_id", "payload_digest", F.col("first").alias("refers_to")).distinct(),
        "revisits",
    )
    decided = rows.join(sized(repeats), ["page_id", "payload_digest"], "left").select("page_id", "url", "html", "payload_digest", "refers_to")
    archives = stage(decided.mapInPandas(_write(folder), "path string, records bigint, bytes bigint"), "archives")
    discard(repeats)
    return archives


#: Tasks that read archives, at most.
READERS = 1 << 13


def read_pages(archives: DataFrame) -> DataFrame:
    """Per page record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to. Anything damaged fails the job.

    There are as many reading tasks as archives, READERS at most; they are dealt out by ranges of their names, which are random.
    """
    tasks = max(1, min(READERS, archives.count()))
    listed = archives.select("path", "records").repartitionByRange(tasks, "path")
    return listed.mapInPandas(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """:func:`write_pages` into a new folder, then :func:`read_pages`. No pages, no archives, no rows."""
    return read_pages(write_pages(pages))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
