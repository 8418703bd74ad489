"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be the last of its
encoding.  A table of these last tokens is the whole state: the encoding is
read by walking it backwards, an append only fills in the new entries, and an
edit keeps the entries before it and stops as soon as the entries behind it
fall back into step.

A token ``t`` that ends at byte ``i`` is the last token of prefix ``i`` when
the prefix before it, ending in token ``p``, and ``t`` stay apart: encoding
the bytes of ``p`` and ``t`` together gives just ``[p, t]``.  That is decided
by undoing merges from the highest rank down (``_apart``).
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.pieces import PieceEncoder

CACHED_SEAMS = 400_000           # decided token pairs kept per worker
DECODE_MAX_TOKENS = 1 << 20      # ids turned back into bytes at once


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """The merges behind a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.max_len = max(map(len, ranks))
        self.parts: list[tuple[int, int]] = [(r, r) for r in range(self.size)]
        self.merged: dict[tuple[int, int], int] = {}
        self.tails = {b[i:] for b in ranks for i in range(len(b))}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(len(token) - 1, 0, -1):
                left, right = ranks.get(token[:cut], rank), ranks.get(token[cut:], rank)
                if left < rank and right < rank and self._apart(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break

    def _apart(self, left: int, right: int) -> bool:
        """No merge of a lower rank joins bytes across the seam of the two."""
        merged, parts, limit = self.merged, self.parts, self.size
        while True:
            joint = merged.get((left, right))
            if joint is not None and joint < limit:
                return False
            if left > right:
                limit = left
                left = parts[left][1]
                if left == limit:
                    limit = right + 1
                    right = parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = parts[right][0]
                if right + 1 == limit:
                    limit = left
                    left = parts[left][1]
                    if left == limit:
                        return True


class PrefixTable:
    """Last tokens of all prefixes of a byte string (one piece)."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data = bpe, b""
        self.last: list[int] = []        # last[i]: last token of data[:i + 1]
        self.append(data)

    def truncate(self, n: int) -> None:
        self.data = self.data[:n]
        del self.last[n:]

    def append(self, more: bytes) -> None:
        """Entries for the new prefixes; older ones never change."""
        self.data += more
        self._fill(len(self.data))

    def _fill(self, until: int, stop=None) -> None:
        data, last, bpe = self.data, self.last, self.bpe
        ranks, tails, bytes_of, apart, seams = bpe.ranks, bpe.tails, bpe.bytes_of, bpe._apart, _seams(bpe)
        for i in range(len(last) + 1, until + 1):
            n = 1
            while True:
                tail = data[i - n:i]
                token = ranks.get(tail)
                if token is not None:
                    if n == i:
                        break
                    seam = (last[i - n - 1], token)
                    ok = seams.get(seam)
                    if ok is None:
                        if len(seams) > CACHED_SEAMS:
                            seams.clear()
                        ok = seams[seam] = apart(*seam)
                    if ok:
                        break
                n += 1
                if n > i or data[i - n:i] not in tails:
                    raise ValueError("these ranks cannot encode every byte string")
            last.append(token)
            if stop is not None and stop(i):
                return

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` for data[begin:end]; returns how many entries were
        computed.  Behind the edit, ``max_len`` equal entries in a row decide
        all that follow, as an entry looks no further back."""
        old_last, shift, span = self.last, len(new) - (end - begin), self.bpe.max_len
        tail = self.data[end:]
        self.data, self.last = self.data[:begin] + new + tail, old_last[:begin]
        same, edge = 0, begin + len(new)

        def in_step(i: int) -> bool:
            nonlocal same
            if i > edge:
                same = same + 1 if old_last[i - 1 - shift] == self.last[i - 1] else 0
            return same >= span

        self._fill(len(self.data), in_step)
        made = len(self.last) - begin
        self.last += old_last[len(self.last) - shift:]
        return made

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i - 1])
            i -= len(self.bpe.bytes_of[out[-1]])
        return out[::-1]


def _seams(bpe: Bpe) -> dict[tuple[int, int], bool]:
    if not hasattr(bpe, "seams"):
        bpe.seams = {}
    return bpe.seams


def encode_pieces(bpe: Bpe, data: list[bytes]) -> list[list[int]]:
    """Ids of distinct pieces.  They are taken in byte order, so each keeps
    the table entries of the prefix that it shares with the one before."""
    out: list = [None] * len(data)
    table = PrefixTable(bpe)
    for k in sorted(range(len(data)), key=data.__getitem__):
        new, old, n = data[k], table.data, 0
        most = min(len(new), len(old))
        while n < most and new[n] == old[n]:
            n += 1
        table.truncate(n)
        table.append(new[n:])
        out[k] = table.tokens()
    return out


_cached: dict = {}


def encoder(path: str) -> tuple[Bpe, PieceEncoder]:
    """Per worker process: the merges of a rank file and its piece cache."""
    if path not in _cached:
        bpe = Bpe(read_ranks(path))
        _cached[path] = (bpe, PieceEncoder(lambda new: encode_pieces(bpe, new)))
    return _cached[path]


def decode(bpe: Bpe, ids: np.ndarray):
    """Byte chunks of the ids."""
    for i in range(0, len(ids), DECODE_MAX_TOKENS):
        yield b"".join(map(bpe.bytes_of.__getitem__, ids[i:i + DECODE_MAX_TOKENS].tolist()))


def encode(docs: DataFrame, rank_file: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text in array column ``out``
    (null text: no ids).  A column of that name is replaced."""
    fields = [f for f in docs.schema.fields if f.name != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` array<bigint>"

    def run(batches):
        _, pieces = encoder(rank_file)
        for batch in batches:
            batch = batch.select([f.name for f in fields])
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for i, ids in pieces.encode(texts):
                part = batch.slice(i, len(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], names=[*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def roundtrip_digests(docs: DataFrame, rank_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and return (doc_id, n_tokens,
    ids_sha256, decoded_sha256).  Null text counts as empty; empty texts have
    no tokens; repeated rows give repeated rows; other columns are not read.
    One scan, no shuffle; work is done in slices of about a million code
    points, so a batch of long texts stays small."""
    import hashlib

    def run(batches):
        bpe, pieces = encoder(rank_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, all_ids in pieces.encode(texts):
                rows = []
                for ids in all_ids:
                    back = hashlib.sha256()
                    for chunk in decode(bpe, ids):
                        back.update(chunk)
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), back.hexdigest()))
                n, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
