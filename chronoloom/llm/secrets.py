"""Secret scans: plain patterns, and encoded keys and tokens that are decoded and parsed before they are reported."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_value, each_text, only

#: Kinds of spans, in the order used for equal starts. The first three are plain patterns, the others are confirmed by their structure.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pkcs1", "pkcs8", "sec1", "openssh", "jwt", "dsa", "encrypted")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A text without any of these (lower-cased) cannot hold an assignment.
NAMES = ("passw", "secret", "token", "api")

#: Anything may stand between the marks: ``armoured_kind`` sorts it out.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)*)-----END \1-----", re.DOTALL)
#: Line ends and tabs written as escapes, also twice escaped, and escaped slashes.
ESCAPED, SLASH = re.compile(r"(?<!\\)\\+(?:[nrt]|u000[9aAdD])"), re.compile(r"(?<!\\)\\+/")
HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
KEPT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")
#: Ends and beginnings of string literals that are joined, with the operator between.
JOINED = re.compile(r"""["'`][\s+.,;\\&_]*$|^[\s+.&]*["'`]""")

BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{30,}={0,2}")
HEXED = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{60,}")
#: A key starts with the tag of an ASN.1 sequence (M and one of A to P in base64) or the name of the key container.
BASE64_KEY, HEXED_KEY = re.compile("M[A-P]|b3BlbnNzaC1rZXktdjE"), re.compile("30|6f70656e7373682d6b65792d763100", re.IGNORECASE)
#: Starts in each other's parts count, hence the look ahead. The shortest header that names an algorithm has 14 characters.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{14,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*))")

CONTAINER = b"openssh-key-v1\0"
#: Object identifiers of password-based encryption begin with these (PKCS #5 and PKCS #12).
ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06


def decoded(run: str) -> bytes | None:
    """Base64 or base64url, with or without padding; None if it is neither."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) elements that fill ``data`` exactly; None if the lengths do not add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
        if at + size > len(data):
            return None
        out.append((tag, data[at:at + size]))
        at += size
    return out


def key_kind(data: bytes | None) -> str | None:
    """Which private key encoding the bytes are: nested lengths have to fit to the last byte."""
    if not data:
        return None
    if data.startswith(CONTAINER):
        return "openssh" if _container_fits(data[len(CONTAINER):]) else None
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return None
    inner = elements(outer[0][1])
    if inner and [tag for tag, _ in inner] == [SEQUENCE, OCTETS]:
        algorithm = elements(inner[0][1])
        return "encrypted" if algorithm and algorithm[0][0] == OID and algorithm[0][1].startswith(ENCRYPTION) and inner[1][1] else None
    if not inner or len(inner) < 2 or inner[0][0] != INTEGER or len(inner[0][1]) != 1:
        return None
    tags, version = [tag for tag, _ in inner], inner[0][1][0]
    if version <= 1 and len(inner) >= 9 and set(tags[:9]) == {INTEGER}:
        return "pkcs1"
    if version == 0 and len(inner) == 6 and set(tags) == {INTEGER} and len(inner[1][1]) >= 64 and 16 <= len(inner[2][1]) <= 33:
        return "dsa"
    if version <= 1 and len(inner) >= 3 and tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = elements(inner[1][1])
        return "pkcs8" if algorithm and algorithm[0][0] == OID and algorithm[0][1] else None
    if version == 1 and tags[1] == OCTETS and all(tag in (0xA0, 0xA1) for tag in tags[2:]) and 20 <= len(inner[1][1]) <= 66:
        return "sec1"
    return None


def _container_fits(data: bytes) -> bool:
    """cipher, kdf, kdf options as counted strings, the number of keys, then as many public keys and one private block."""
    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at:at + 4], "big")
        at += 4 + size
        return data[at - size:at] if at <= len(data) else None

    at = 0
    if not string() or not string() or string() is None or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    return 1 <= keys <= 16 and all(string() for _ in range(keys + 1)) and at == len(data)


def _may_fill(head: bytes, size: int) -> bool:
    """Whether ``size`` bytes that begin with ``head`` (8 or more) may be one key: the container, or a sequence of that very length."""
    if head[:1] != bytes([SEQUENCE]):
        return CONTAINER.startswith(head[:8])
    n = head[1] & 0x7F if head[1] >= 0x80 else 0
    return n <= 4 and (int.from_bytes(head[2:2 + n], "big") if n else head[1]) + 2 + n == size


def _base64_key(run: str) -> tuple[int, str] | None:
    """Start and kind of the key that ends with a run of base64 characters; other characters may touch it before, as the n of an
    escaped line end does."""
    bare = run.rstrip("=")
    for m in BASE64_KEY.finditer(bare):
        n = len(bare) - m.start()
        if n < 30:
            break
        if n % 4 != 1 and _may_fill(decoded(bare[m.start():m.start() + 12]) or b"\0", n * 3 // 4) and (kind := key_kind(decoded(run[m.start():]))):
            return m.start(), kind
    return None


def _hexed_key(run: str) -> tuple[int, str] | None:
    for m in HEXED_KEY.finditer(run):
        n = len(run) - m.start()
        if n < 60:
            break
        if n % 2 == 0 and _may_fill(bytes.fromhex(run[m.start():m.start() + 16]), n // 2) and (kind := key_kind(bytes.fromhex(run[m.start():]))):
            return m.start(), kind
    return None


def _inner(row: str) -> str:
    """The row without the marks around it."""
    first, end = 0, len(row)
    while first < end and row[first] not in KEPT:
        first += 1
    while end > first and row[end - 1] not in KEPT:
        end -= 1
    return row[first:end]


def armoured_kind(body: str) -> str | None:
    """The kind of key between armour marks: lines joined over white space, escaped line ends, quote marks and header lines."""
    split = SLASH.sub("/", ESCAPED.sub("\n", body)).splitlines()
    for literals in (False, True):
        rows = [_inner(JOINED.sub("", row) if literals else row) for row in split]
        rows = [row for row in rows if not HEADER.match(row)]
        if kind := key_kind(decoded("".join("".join(rows).split()))):
            return kind
    return None


def signed_token(run: str) -> bool:
    """Whether the first two parts are JSON objects and the first names an algorithm."""
    parts = run.split(".")
    try:
        header, claims = (json.loads(decoded(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in the text: code points, end exclusive, by start and then kind."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    armoured = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if kind := armoured_kind(m[2]):
                armoured.append((m.start(), m.end(), kind))
    out += armoured
    for pattern, key in ((BASE64, _base64_key), (HEXED, _hexed_key)):
        for m in pattern.finditer(text):
            if (found := key(m[0])) and (pattern is HEXED or not any(a <= m.start() < b for a, b, _ in armoured)):
                out.append((m.start() + found[0], m.end(), found[1]))
    for m in JWT.finditer(text):
        # the first letter may belong to an escape before the token
        for at in (0, 1) if m.start() and text[m.start() - 1] == "\\" else (0,):
            if signed_token(m[1][at:]):
                out.append((m.start() + at, m.end(1), "jwt"))
                break
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) per input row, from the whole text in one pass without a shuffle.

    A null text has no spans. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    by_value()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans(t)] for t in each_text(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = only(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                 "spans array<struct<kind string, start long, end long>>")
