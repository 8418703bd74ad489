"""Secret scan with structural confirmation.

Three patterns give the base spans.  Four more kinds are reported only when
the candidate decodes and its structure holds: base64 or hex text must parse
as nested DER whose lengths fill their parents exactly and whose members form
a private key; OpenSSH keys must consist of length-prefixed strings; signed
tokens need a JSON header that names an algorithm, a JSON object as payload
and a signature that decodes.  The body of a PEM block may stand in escaped,
joined, quoted or commented lines.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: kinds in the order that breaks ties, and base patterns ---
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20

PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
DASHES = re.compile(r"-{5,}")
ESCAPED_CODE = re.compile(r"\\+u([0-9A-Fa-f]{4})")
ESCAPED_SLASH = re.compile(r"\\+/")
ESCAPED_END = re.compile(r"\\+[nrt]|<br\s*/?>|&(?:[a-z]+|#x?[0-9A-Fa-f]+);")
ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED[^A-Za-z0-9]+DEK-Info:\s*[A-Z0-9-]+,\s*[0-9A-Fa-f]+")
LINE_SUM = re.compile(r"""["'`]\s*\+\s*(?=\\*["'`]|\Z)""")      # strings added up in source
NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/_=-]+")
BASE64_DER = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/_-]{39,}={0,2}")
HEX_DER = re.compile(r"(?<![0-9A-Za-z])30[0-9A-Fa-f]{62,}")
BASE64_SSH = re.compile(r"(?<![A-Za-z0-9+/_-])b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]{20,}={0,2}")
SIGNED_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])e[w-z][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{8,}")
SSH_MAGIC = b"openssh-key-v1\x00"
MAX_DEPTH = 12

Span = tuple[str, int, int]


def unbase64(text: str) -> bytes | None:
    """Either alphabet, with or without padding; None unless all of it decodes."""
    body = text.rstrip("=").translate({45: "+", 95: "/"})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """[(tag, content or members)] when data[at:end] is a gapless run of DER
    values with exact nested lengths, else None."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if at + 2 > end or data[at] & 31 == 31 or depth > MAX_DEPTH:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 128:
            wide = size & 127
            if not 1 <= wide <= 4 or at + wide > end:
                return None
            size = int.from_bytes(data[at:at + wide], "big")
            at += wide
            if size < 128 or size >> 8 * (wide - 1) == 0:    # not the shortest form
                return None
        if at + size > end:
            return None
        content = der(data, at, at + size, depth + 1) if tag & 32 else data[at:at + size]
        if content is None:
            return None
        out.append((tag, content))
        at += size
    return out


def is_key(data: bytes) -> bool:
    """DER of a private key: numbers only (traditional RSA or DSA), version
    and octets (EC), version, algorithm and octets, or algorithm and octets
    (encrypted)."""
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = top[0][1]
    tags = [t for t, _ in parts]
    numbers = [int.from_bytes(c, "big") for t, c in parts if t == 2]
    algorithm = [c for t, c in parts if t == 0x30 and c and c[0][0] == 6]
    octets = [c for t, c in parts if t == 4]
    if tags[:1] == [2] and numbers[0] <= 1:
        if len(numbers) == len(parts) and len(parts) in (6, 9):
            return all(n.bit_length() > 64 for n in numbers[1:3])
        if tags[1:2] == [4]:
            return len(parts[1][1]) >= 20
        return tags[1:3] == [0x30, 4] and bool(algorithm) and len(octets[0]) >= 16
    return tags == [0x30, 4] and bool(algorithm) and len(octets[0]) >= 32


def is_ssh_key(data: bytes) -> bool:
    """Cipher, key derivation, its options, the number of keys, public keys."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for k in range(3):
        size = int.from_bytes(data[at:at + 4], "big")
        at += 4 + size
        if at + 4 > len(data) or (k < 2 and size == 0):
            return False
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys):
        size = int.from_bytes(data[at:at + 4], "big")
        if size < 4 or at + 4 + size > len(data) or int.from_bytes(data[at + 4:at + 8], "big") > size - 4:
            return False
        at += 4 + size
    return at + 4 <= len(data) and at + 4 + int.from_bytes(data[at:at + 4], "big") <= len(data)


def is_signed_token(text: str) -> bool:
    head, body, mark = text.split(".")
    try:
        first, second = (json.loads(unbase64(x) or b"") for x in (head, body))
    except ValueError:
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and first["alg"].lower() != "none" and isinstance(second, dict) and unbase64(mark) is not None


def base_spans(text: str) -> Iterator[Span]:
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= MIN_VALUE:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def is_pem_key(raw: str) -> bool:
    """Whether the text between the two marks of a PEM block is a key: as it
    stands, or without escapes, white space, quotes and line prefixes."""
    data = unbase64("".join(x.strip() for x in raw.split("\n") if ":" not in x))
    if data and (is_key(data) or is_ssh_key(data) or ("Proc-Type: 4,ENCRYPTED" in raw and len(data) >= 32)):
        return True
    plain = ESCAPED_SLASH.sub("/", ESCAPED_END.sub("\n", ESCAPED_CODE.sub(lambda m: chr(int(m[1], 16)), raw)))
    lines = plain.split("\n")
    prefix = lines[-1]                           # what stands before the end mark stands before every line
    cut = [x.removeprefix(prefix) if x.startswith(prefix) else x.removeprefix(prefix.rstrip()) for x in lines[1:]]
    for body in (plain, "\n".join([lines[0], *cut])):
        bare = ENCRYPTED.sub("\n", body)
        kept = "\n".join(x for x in LINE_SUM.sub("", bare).split("\n") if ":" not in x)
        data = unbase64(NOT_BASE64.sub("", kept))
        if data and (is_key(data) or is_ssh_key(data) or (bare != body and len(data) >= 32 and len(data) % 8 == 0)):
            return True
    return False


def confirmed_spans(text: str) -> Iterator[Span]:
    if "PRIVATE KEY-----" in text:
        at = 0
        while m := PEM_BEGIN.search(text, at):
            at = m.end()
            close = f"-----END {m[1]}-----"
            dashes = DASHES.search(text, at)
            if not dashes or not text.startswith(close, end := dashes.end() - 5):
                continue
            if is_pem_key(text[at:end]):
                yield "pem", m.start(), end + len(close)
    for m in BASE64_DER.finditer(text):
        data = unbase64(m[0])
        if data and is_key(data):
            yield "der", m.start(), m.end()
    for m in HEX_DER.finditer(text):
        if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
            yield "der", m.start(), m.end()
    if "b3BlbnNzaC1rZXktdjE" in text:
        for m in BASE64_SSH.finditer(text):
            data = unbase64(m[0])
            if data and is_ssh_key(data):
                yield "ssh", m.start(), m.end()
    if "." in text:
        for m in SIGNED_TOKEN.finditer(text):
            if is_signed_token(m[0]):
                yield "jwt", m.start(), m.end()


def find(text: str) -> list[Span]:
    """All spans by start, then kind as listed."""
    return sorted([*base_spans(text), *confirmed_spans(text)], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` without the text, with all spans of each whole text in array
    column ``out`` (code points, end exclusive, ordered).  Null and empty
    texts have none; repeated rows stay; a column named ``out`` is replaced;
    an empty table stays empty.  One scan, no shuffle."""
    fields = [f for f in docs.schema.fields if f.name not in (text, out)]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` {SPANS}"

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t)] if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, _SPAN_TYPE)], names=[*names, out])

    return docs.mapInArrow(run, schema)


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """Column: kind:start:end, comma-joined, of the given kinds."""
    return F.concat_ws(",", F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by
    ``mark``; all rows and columns stay, null texts stay null, repeated rows
    stay repeated, and an empty table stays empty."""
    names = docs.columns

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        parts, at = [], 0
        for _, a, b in find(t):
            if a >= at:
                parts += [t[at:a], mark]
            at = max(at, b)
        return "".join([*parts, t[at:]]) if parts else t

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([clean(t) for t in c.to_pylist()], pa.string()) if n == text else c for n, c in zip(names, batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)
