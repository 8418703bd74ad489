"""Packing token sequences into fixed windows with a bounded set of open ones.

Each partition keeps ``open_windows`` partly filled windows.  A document that
is longer than a window first gives off full windows; its rest goes to the
open window where it fits best.  When none fits and no further window may be
opened, the fullest is topped up with the head of the piece and emitted, and
the remainder is placed anew.  At the end of the partition the windows still
open are merged: their pieces, fullest window first, are cut into full
windows and one run of sequences whose lengths are powers of two, which need
no padding.  So nothing is padded, memory is bounded by the open windows plus
one document, and no row leaves its partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.pieces import PieceEncoder

WINDOW = 2048
OPEN_WINDOWS = 64
END_ID = 1
_PARTITION_BITS = 40             # sequence numbers of one partition
# fixed value: the split of byte-level BPE files
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_cached: dict = {}


def tokenizer(path: str) -> PieceEncoder:
    """Per worker process: the encoder of a ``tokenizers`` file.  Strings of
    special tokens in a text are ordinary text.

    Where the file is a plain byte-level BPE whose merges give rising ids, an
    id is its token's rank, and pieces are merged by rank directly; any other
    file goes through the library."""
    if path not in _cached:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks = _ranks(path)
        if ranks is not None:
            import tiktoken

            by_rank = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _cached[path] = PieceEncoder(lambda new: [by_rank(p.decode("utf-8")) for p in new])
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            _cached[path] = PieceEncoder(lambda new: [e.ids for e in tok.encode_batch_fast([p.decode("utf-8") for p in new], add_special_tokens=False)])
    return _cached[path]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the other bytes, in order, follow
    from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Ids by token bytes, if the ids are the ranks of the merges."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocabulary, letters = model["vocab"], _byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary[a + b] for a, b in merges]
    if any(i >= j for i, j in zip(ids, ids[1:])) or any(max(vocabulary[a], vocabulary[b]) >= i for (a, b), i in zip(merges, ids)) or len(ids) + 256 != len(vocabulary):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}


class Packer:
    """Online packing.  ``emit(pieces)`` gets each finished sequence as a list
    of (document, start, ids); documents are opaque."""

    def __init__(self, emit: Callable[[list], None], window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.emit, self.window, self.most = emit, window, open_windows
        self.open: list[tuple[int, int]] = []    # (ids held, number), ascending
        self.held: dict[int, list] = {}
        self.number = 0

    def add(self, doc, ids: np.ndarray) -> None:
        at = 0
        while len(ids) - at >= self.window:
            self.emit([(doc, at, ids[at:at + self.window])])
            at += self.window
        while at < len(ids):
            rest = len(ids) - at
            k = bisect_right(self.open, (self.window - rest, self.number)) - 1
            if k < 0 and len(self.open) < self.most:
                self.number += 1
                self.held[self.number] = [(doc, at, ids[at:].copy())]
                insort(self.open, (rest, self.number))
                return
            used, number = self.open.pop(k)      # best fit, or (k = -1) the fullest
            take = min(rest, self.window - used)
            self.held[number].append((doc, at, ids[at:at + take].copy()))
            at += take
            if used + take == self.window:
                self.emit(self.held.pop(number))
            else:
                insort(self.open, (used + take, number))

    def close(self) -> None:
        """Merge what is still open."""
        todo = [p for _, number in reversed(self.open) for p in self.held[number]]
        left = sum(len(ids) for *_, ids in todo)
        self.open, self.held = [], {}
        todo.reverse()
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            left -= size
            out = []
            while size:
                doc, at, ids = todo.pop()
                if len(ids) > size:
                    todo.append((doc, at + size, ids[size:]))
                    ids = ids[:size]
                out.append((doc, at, ids))
                size -= len(ids)
            self.emit(out)


def pack(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True, end_id: int = END_ID, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Tokenize every whole text, append ``end_id``, and pack the ids.

    Returns one row per piece: (doc_id, start, length, ids as little-endian
    unsigned 32-bit binary, their ids_crc32, doc_tokens, sequence_id, offset);
    without ``keep_ids`` the ids themselves are null.  Null and empty
    texts give the one id ``end_id``; rows with a null or a repeated doc_id
    are packed as documents of their own; other columns are not read.  An
    empty table gives no pieces.  Sequence ids carry the partition number, so
    a task that is run again gives the same rows.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << _PARTITION_BITS
        pieces = tokenizer(tokenizer_file)
        rows: list[tuple] = []
        done = 0

        def emit(parts: list) -> None:
            nonlocal done
            offset = 0
            for (doc, total), start, ids in parts:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc, start, len(ids), raw if keep_ids else None, zlib.crc32(raw), total, base + done, offset))
                offset += len(ids)
            done += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        packer = Packer(emit, window, open_windows)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, all_ids in pieces.encode(texts):
                for key, ids in zip(keys[i:i + len(all_ids)], all_ids):
                    packer.add((key, len(ids) + 1), np.concatenate([ids, end]))
                if len(rows) > 500:
                    yield flush()
        packer.close()
        if rows:
            yield flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
