"""Secret scan with structural confirmation.

Patterns give the base spans. Beyond them, base64 and hex candidates are decoded and only reported when what they hold parses:
DER whose nested lengths fit exactly and whose shape is a key's, SSH key blobs with consistent length prefixes, or signed tokens whose
header is JSON with an algorithm and whose other parts decode. Keys state their own length, so they are found at any place of a run, behind letters or a
slash and before others; base64 may be wrapped over lines, also with escaped line ends. Decoded text is searched once more.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, give_back

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Any text with a match of ASSIGN holds one of these in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: A run is matched whole, so the least length can stand in the pattern without changing which matches survive.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "token", "der_key", "ssh_key")
BASE = frozenset(KINDS[:3])

#: Dot-separated parts; a JSON object begins with a brace, then a blank or a quote.
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,}")
HEADER = re.compile(r"e[wy](?=[A-Za-z0-9_-]{6})")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY)-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: Lines of base64 with real or escaped ends; all but the last are of one length.
LINE_END = re.compile(r"(?:\r?\n|\\r\\n|\\n)[ \t]*")
WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]{{40,80}}(?:{LINE_END.pattern}[A-Za-z0-9+/_-]{{1,80}}={{0,2}})+")
HEX_CODED = re.compile(r"[0-9a-f]{48,}|[0-9A-F]{48,}")
#: What a DER sequence, an SSH blob and an SSH container begin with, in base64 and in hex.
KEY_BASE64 = re.compile(r"M[A-P]|AAAA|b3BlbnNzaC1rZXktdjEA")
KEY_HEX = re.compile(r"30|000000|6f70656e7373682d6b65792d763100", re.I)
#: Keys and token headers are no longer than this; it bounds the work on runs that look like one at every place.
KEY_BYTES, HEADER_CHARS = 1 << 16, 1 << 12
#: Object identifiers that open an AlgorithmIdentifier of a key: RSA, EC, Ed25519/X25519 family, DSA.
KEY_OIDS = RSA_OID, EC_OID, EDWARDS_OID, DSA_OID = (bytes.fromhex("2a864886f70d0101"), bytes.fromhex("2a8648ce3d02"), bytes.fromhex("2b65"), bytes.fromhex("2a8648ce38"))
#: Those of password-based encryption: PKCS#5 and PKCS#12.
SEALED_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: Fields of an SSH public key by its type.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """The elements (tag, content or children) that fill ``data[at:end]`` exactly, or None if any nested length doesn't fit."""
    end = len(data) if end is None else end
    out: list = []
    while at < end:
        if depth > 16 or at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            size = int.from_bytes(data[at : at + width], "big")
            if size < 0x80:
                return None
            at += width
        if at + size > end:
            return None
        if tag & 0x20:
            inner = der(data, at, at + size, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + size]))
        at += size
    return out


def der_size(head: bytes) -> int | None:
    """Bytes of the sequence that ``head`` begins, its own header included."""
    if len(head) < 2 or head[0] != 0x30:
        return None
    size, width = head[1], head[1] & 0x7F
    if not size & 0x80:
        return 2 + size
    if not 1 <= width <= 3 or len(head) < 2 + width:
        return None
    return 2 + width + int.from_bytes(head[2 : 2 + width], "big")


def _sequence(data: bytes) -> list | None:
    top = der(data)
    return top[0][1] if top and len(top) == 1 and isinstance(top[0][1], list) and top[0][0] == 0x30 else None


def _is_rsa_private(parts: list) -> bool:
    return len(parts) >= 9 and all(t == 2 for t, _ in parts[:9])


def _is_sec1(parts: list) -> bool:
    return len(parts) >= 2 and [t for t, _ in parts[:2]] == [2, 4] and parts[0][1] == b"\x01" and len(parts[1][1]) in (28, 32, 48, 66)


def _holds_key(oid: bytes, octets: bytes) -> bool:
    """The octets of a PKCS#8 private key, by its algorithm."""
    if oid.startswith(RSA_OID):
        return _is_rsa_private(_sequence(octets) or [])
    if oid.startswith(EC_OID):
        return _is_sec1(_sequence(octets) or [])
    inner = der(octets)
    return bool(inner) and len(inner) == 1 and inner[0][0] == (4 if oid.startswith(EDWARDS_OID) else 2)


def is_der_key(data: bytes) -> bool:
    """PKCS#1 keys, PKCS#8 private keys, plain or encrypted, SEC1 EC keys and SubjectPublicKeyInfo."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    parts = _sequence(data)
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if _is_rsa_private(parts) or _is_sec1(parts):
        return True
    if tags == [2, 2]:  # PKCS#1 public
        return len(parts[0][1]) >= 48 and len(parts[1][1]) <= 8
    alg = next((own for t, own in parts[:2] if t == 0x30), None)
    oid = alg[0][1] if alg and alg[0][0] == 6 else b""
    if tags[:3] == [2, 0x30, 4]:  # PKCS#8
        return oid.startswith(KEY_OIDS) and _holds_key(oid, parts[2][1])
    if tags == [0x30, 4]:  # PKCS#8, encrypted
        return oid.startswith(SEALED_OIDS) and len(parts[1][1]) >= 24
    if tags == [0x30, 3]:  # SubjectPublicKeyInfo
        return oid.startswith(KEY_OIDS)
    return False


def ssh_size(data: bytes) -> int | None:
    """Bytes of the SSH key that ``data`` begins: a public key blob (named type, as many fields as it has) or the private container."""

    def field(at: int) -> int | None:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if at + 4 <= len(data) and end <= len(data) else None

    private = data.startswith(b"openssh-key-v1\0")
    at, left = (15, 3) if private else (0, 1)
    while left:
        if (end := field(at)) is None:
            return None
        if not at:
            left = SSH_FIELDS.get(data[4:end], 0)
            if not left:
                return None
        at, left = end, left - 1
    if private:  # the number of keys, as many public blobs, and the private part
        if not 1 <= (keys := int.from_bytes(data[at : at + 4], "big")) <= 64:
            return None
        at += 4
        for _ in range(keys + 1):
            if (at := field(at)) is None:
                return None
    return at


def token_size(dotted: str, at: int) -> int | None:
    """Characters of the signed or encrypted token that begins at ``at``: a JSON header with an algorithm, and parts that decode."""
    parts = dotted[at:].split(".", 5)
    head = unbase64(parts[0])
    if head is None or head[:1] != b"{":
        return None
    try:
        head = json.loads(head)
    except (ValueError, RecursionError):
        return None
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
        return None
    need = 5 if isinstance(head.get("enc"), str) else 3
    own = parts[:need]
    if len(own) < need or any(unbase64(p) is None for p in own[1:]):
        return None
    if need == 3 and (not own[1] or bool(own[2]) == (head["alg"].lower() == "none")) or need == 5 and not (own[2] and own[3] and own[4]):
        return None
    return len(".".join(own))


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text.translate({45: 43, 95: 47}) + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _key_at(read, room: int) -> tuple[str, int] | None:
    """The kind and bytes of the key at the start of what ``read`` (number of bytes -> bytes) gives of ``room`` bytes."""
    head = read(min(room, 24))
    size = der_size(head)
    if size is not None:
        return ("der_key", size) if 24 <= size <= min(room, KEY_BYTES) and is_der_key(read(size)) else None
    if head.startswith(b"openssh-key-v1\0") or head[4:8] in (b"ssh-", b"ecds"):
        data = read(min(room, KEY_BYTES))
        if (size := ssh_size(data)) and size >= 24:
            return "ssh_key", size
    return None


def _base64_keys(run: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the keys in a run of base64 letters, from left to right, none inside another."""
    run = run.rstrip("=").translate({45: 43, 95: 47})
    done = 0
    for m in KEY_BASE64.finditer(run):
        at = m.start()
        if at < done or len(run) - at < 32:
            continue
        read = lambda n, a=at: base64.b64decode((p := run[a : a + -(-4 * n // 3)]) + "=" * (-len(p) % 4))[:n]
        if found := _key_at(read, (len(run) - at) * 3 // 4):
            done = at - (-4 * found[1] // 3)
            yield at, done, found[0]


def _hex_keys(run: str) -> Iterator[tuple[int, int, str]]:
    done = 0
    for m in KEY_HEX.finditer(run):
        at = m.start()
        if at >= done and (found := _key_at(lambda n, a=at: bytes.fromhex(run[a : a + 2 * n]), (len(run) - at) // 2)):
            done = at + 2 * found[1]
            yield at, done, found[0]


def _inside(data: bytes | None, depth: int) -> str | None:
    """The kind of secret in decoded bytes that are text."""
    if not data or depth or len(data) < 24 or not data.isascii():
        return None
    found = structures(data.decode(), depth + 1)
    return found[0][2] if found else None


def _armoured(text: str) -> Iterator[tuple[int, int, str]]:
    missing, done = set(), 0
    for m in ARMOUR.finditer(text):
        end = f"-----END {m[1]}-----"
        if m.start() < done or end in missing:
            continue
        if (stop := text.find(end, m.end())) < 0:
            missing.add(end)
            continue
        lines = [x.strip(" \t\"',+") for x in re.split(r"\r?\n|\\r\\n|\\n|\r", text[m.end() : stop])]
        heads = [x for x in lines if ":" in x]
        data = unbase64("".join("".join(x for x in lines if ":" not in x).split()))
        if data is None:
            continue
        sealed = any("ENCRYPTED" in x for x in heads) and any(x.startswith("DEK-Info") for x in heads) and len(data) >= 64 and len(data) % 8 == 0
        found = ("der_key", len(data)) if sealed else _key_at(lambda n, d=data: d[:n], len(data))
        if found and found[1] == len(data):
            done = stop + len(end)
            yield m.start(), done, found[0]


def structures(text: str, depth: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is confirmed by its structure."""
    out = []
    if "." in text and HEADER.search(text):
        for m in DOTTED.finditer(text):
            first = m[0].index(".")
            for h in HEADER.finditer(m[0], max(0, first - HEADER_CHARS), first):
                if size := token_size(m[0], h.start()):
                    out.append((m.start() + h.start(), m.start() + h.start() + size, "token"))
                    break
    armoured = list(_armoured(text)) if "-----BEGIN " in text else []
    out += armoured
    free = lambda a: not any(p <= a < q for p, q, _ in armoured)
    runs = [(m[0], [(0, m.start())]) for m in BASE64.finditer(text) if free(m.start())]
    for m in WRAPPED.finditer(text) if "\n" in text or "\\n" in text else ():
        if not free(m.start()):
            continue
        ends = [(0, 0), *((x.start(), x.end()) for x in LINE_END.finditer(m[0])), (len(m[0]), len(m[0]))]
        lines = [(b, m[0][b:c]) for (_, b), (c, _) in zip(ends, ends[1:], strict=False)]
        many = next((k for k, (_, x) in enumerate(lines) if len(x) != len(lines[0][1])), len(lines))
        if many < len(lines) and len(lines[many][1]) < len(lines[0][1]):
            many += 1
        if many > 1:
            runs.append(("".join(x for _, x in lines[:many]), _places(lines[:many], m.start())))
    for run, places in runs:
        keys = [p for p, _ in places]
        spot = lambda k, keys=keys, places=places: places[bisect_right(keys, k) - 1]
        place = lambda k, spot=spot: spot(k)[1] + k - spot(k)[0]
        found = list(_base64_keys(run))
        pad = len(run) - len(run.rstrip("="))
        body = len(run) - pad
        for a, b, kind in found:
            if len(places) == 1 or spot(a) != spot(b - 1):
                out.append((place(a), place(b - 1) + 1 + (pad if b == body else 0), kind))
        if not found and (kind := _inside(unbase64(run), depth)):
            out.append((place(0), place(len(run) - 1) + 1, kind))
    for m in HEX_CODED.finditer(text):
        found = list(_hex_keys(m[0]))
        out += [(m.start() + a, m.start() + b, kind) for a, b, kind in found]
        if not found and (kind := _inside(bytes.fromhex(m[0][: len(m[0]) // 2 * 2]), depth)):
            out.append((m.start(), m.end(), kind))
    return out


def _places(lines: list[tuple[int, str]], start: int) -> list[tuple[int, int]]:
    out, at = [], 0
    for offset, x in lines:
        out.append((at, start + offset))
        at += len(x)
    return out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text in code points, by start, then kind as listed in KINDS."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted({*out, *structures(text)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def spans_of(text: Column) -> Column:
    """All spans of a whole text. Only texts go to Python workers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            slices = (batch.slice(at, 500).to_pylist() for at in range(0, len(batch), 500))
            yield pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in scan(t)] for texts in slices for t in texts], pa.list_(_SPAN))
        give_back()

    return F.arrow_udf(run, SPANS)(text)


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``spans``: array of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no span; texts of any length are scanned whole; repeated rows each get theirs; an empty table gives no rows. Equal starts are ordered by
    KINDS. A column of ``docs`` that is named spans is replaced; columns of any other name are kept as they are.
    """
    return docs.select(*[column(c) for c in keep or docs.columns if c.lower() != "spans"], spans_of(column(text_col)).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of the result of :func:`find_secrets`."""
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
