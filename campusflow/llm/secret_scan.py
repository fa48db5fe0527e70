"""Secrets in texts: patterns first, then structural confirmation of encoded candidates.

Three kinds are found by pattern alone.  The others are reported only when a candidate, decoded from base64
or hex, has the structure of a key or token: DER lengths that nest exactly, the fields of a known private
key, an OpenSSH key's length-prefixed strings, or a signed token whose header names an algorithm.  PEM blocks
are read between their BEGIN and END lines; elsewhere a base64 key may start anywhere in a run and ends where
its lengths say.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.llm.rows import unpacked, whole_rows

# The three base patterns.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
# Candidates for confirmation.
TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----((?:[A-Za-z0-9+/=\s]++|\\[nr])*+)-----END")
# Between the characters of a candidate; line feeds may be written as escapes.
BREAKS = re.compile(r"(?:\s|\\[nr])+")
# A DER sequence starts with 0x30 and a length; the OpenSSH magic is the same text every time.
KEY_START = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjEA")
MIN_KEY = 24
HEX_PAIRS = re.compile(r"(?:[0-9a-fA-F]{2}){24,}")

KINDS = ("assign", "access", "hex", "signed_token", "der_key", "ssh_key", "hex_key")
# Object identifiers of private-key algorithms (RSA, EC, Ed25519, X25519, DSA), as DER bytes.
ALGORITHMS = (
    bytes.fromhex("2a864886f70d010101"),
    bytes.fromhex("2a8648ce3d0201"),
    bytes.fromhex("2b6570"),
    bytes.fromhex("2b656e"),
    bytes.fromhex("2a8648ce380401"),
)
SSH_MAGIC = b"openssh-key-v1\x00"


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at ``at``; None if its length is malformed or runs over ``end``."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 0x80:
        size = length & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        length, at = int.from_bytes(data[at : at + size], "big"), at + size
    return (tag, at, at + length) if at + length <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``at`` to ``end`` exactly."""
    found = []
    while at < end:
        element = _element(data, at, end)
        if element is None or len(found) > 16:
            return None
        found.append(element)
        at = element[2]
    return found


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key: PKCS#8, PKCS#1 (RSA) or SEC 1 (EC), with exact nested lengths."""
    whole = _element(data, 0, len(data))
    if whole is None or whole[0] != 0x30 or whole[2] != len(data):
        return False
    parts = _children(data, whole[1], whole[2])
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 1:
        return False
    tags = [p[0] for p in parts]
    if tags[:3] == [0x02, 0x30, 0x04]:
        names = _children(data, *parts[1][1:])
        return bool(names) and names[0][0] == 0x06 and data[names[0][1] : names[0][2]] in ALGORITHMS
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return all(p[2] > p[1] for p in parts)
    return tags[:2] == [0x02, 0x04] and data[parts[0][1]] == 1 and all(t in (0xA0, 0xA1) for t in tags[2:])


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: its magic, then cipher, KDF and options as strings."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


def _ssh_end(data: bytes) -> int | None:
    """Where an OpenSSH private key ends: after its public keys and the private part; None if it is cut short."""
    at = len(SSH_MAGIC)
    for _ in range(3):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def _from_base64(text: str) -> bytes | None:
    plain = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def _bytes_at(plain: str, at: int, characters: int) -> bytes:
    """What the next characters stand for; a last one that is no whole byte is left out."""
    part = plain[at : at + characters]
    return _from_base64(part[:-1] if len(part) % 4 == 1 else part) or b""


def _key_at(plain: str, at: int) -> tuple[str, int] | None:
    """The kind of the key that starts at a place of unbroken base64, and the place after its last character."""
    if plain[at] == "b":
        data = _bytes_at(plain, at, len(plain) - at)
        if not is_ssh_key(data):
            return None
        size = _ssh_end(data)
        kind, end = "ssh_key", len(plain.rstrip("=")) if size is None else at + (4 * size + 2) // 3
    else:
        head = _bytes_at(plain, at, 12)
        if len(head) < 9 or head[0] != 0x30:
            return None
        long = head[1] & 0x7F if head[1] >= 0x80 else 0
        if long > 4 or head[1] == 0x80 or head[2 + long] != 0x02:
            return None
        size = 2 + long + (int.from_bytes(head[2 : 2 + long], "big") if long else head[1])
        kind, end = "der_key", at + (4 * size + 2) // 3
        if end > len(plain) or not is_private_key(_bytes_at(plain, at, end - at)):
            return None
    return (kind, end) if end - at >= MIN_KEY else None


def _keys(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """The keys between two places of a text that hold base64 and breaks, as (kind, start, end), from the left.

    A key may start at any character and ends where its own lengths say, so what stands before or after it
    does not matter.  Padding that a key needs belongs to it.
    """
    plain = BREAKS.sub("", text[start:end])
    places, at = None, 0
    while m := KEY_START.search(plain, at):
        found = _key_at(plain, m.start())
        if found is None:
            at = m.start() + 1
            continue
        if places is None:
            breaks = {p for b in BREAKS.finditer(text, start, end) for p in range(*b.span())}
            places = [p for p in range(start, end) if p not in breaks]
        kind, at = found
        last = places[at - 1] + 1
        padding = -(at - m.start()) % 4
        yield kind, places[m.start()], last + next(k for k in range(padding, -1, -1) if text.startswith("=" * k, last))


def is_signed_token(text: str) -> bool:
    """Whether the text is header.payload.signature with JSON in the first two and an algorithm in the header."""
    header, payload, _ = text.split(".")
    try:
        head, body = json.loads(_from_base64(header) or b""), json.loads(_from_base64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def scan(text: str) -> list[tuple[str, int, int]]:
    """All findings of one text as (kind, start, end) in code points, by start and then by kind.

    Each of the first three kinds is the leftmost non-overlapping matches of its pattern, without those that
    are too short.
    """
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A run of 16 or more is the same match for both patterns; this one skips the short runs quickly.
    found += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    if "eyJ" in text:
        found += [("signed_token", *m.span()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    blocks = PEM.finditer(text) if "PRIVATE KEY-----" in text else ()
    keys = [key for m in blocks for key in _keys(text, *m.span(1))]
    starts, ends = [key[1] for key in keys], [key[2] for key in keys]
    for m in BASE64.finditer(text):
        for key in _keys(text, *m.span()):
            before = bisect_right(starts, key[1])
            if not before or ends[before - 1] <= key[1]:
                found.append(key)
    found += keys
    for m in HEX_PAIRS.finditer(text):
        if m[0].startswith("30") and is_private_key(bytes.fromhex(m[0])):
            found.append(("hex_key", *m.span()))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def _scanned(batches: Iterator[pa.RecordBatch], text: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("row")
        texts = rows.flatten()[rows.type.get_field_index(text)]
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py() or "")] for t in texts]
        yield pa.RecordBatch.from_arrays([rows, pa.array(found, kind)], ["row", "spans"])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``spans``: an array of (kind, start, end), by start and then by kind.

    Places are code points, the end is exclusive.  A NULL or empty text has no spans.  Every row is scanned by
    itself, without a shuffle, so repeated rows each get their spans.  A caller's column named ``spans`` is
    replaced.  A text is held whole by its task, whatever its length; beyond that, one batch of rows is.
    """
    rows = whole_rows(docs)
    spans = "array<struct<kind: string, start: long, end: long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = rows.withColumn("spans", F.lit(None).cast(spans)).schema
    scanned = rows.mapInArrow(lambda batches: _scanned(batches, text, kind), schema)
    return unpacked(scanned, docs.columns, {"spans": F.col("spans")})
