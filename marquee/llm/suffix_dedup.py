"""Exact removal of repeated byte strings, by buckets that are refined.

A byte goes when a 100-byte string that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start).

1. One scan cuts every text into anchored segments (``byte_segments``) and
   keeps, per task, the earliest occurrence of each (bucket, segment); later
   ones are removed at once.  So a passage in a third of all documents gives
   a row per task, not one per document.
2. A shuffle by bucket, sorted by segment and position, streams past: later
   occurrences of a segment are removed.  A bucket that still holds different
   segments stays open.
3. The documents that hold open segments give the bytes, and a second shuffle
   by bucket brings those together.  There the windows are sorted by
   bucket-pointer refinement (``bucket_pointers``): from q-gram buckets on,
   each bucket is sorted on the bucket identifiers of later offsets and the
   updates are reused, to a depth of 100 bytes; neighbours are then compared
   byte for byte.  Windows of buckets with very many segments are shuffled
   one by one instead, by their identifiers, combined per task as in 1.
4. Removed ranges meet their documents.

The identifiers of steps 1 and 2, which distribute the work, have 128 bits
(bucket and segment, or two window hashes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import byte_segments as seg
from marquee.llm.bucket_pointers import refined, same_as_before
from marquee.llm.byte_segments import LENGTH
from marquee.session import materialize

SLICE_BYTES = 300_000
BUCKET_IN_TASK = 256             # open segments of one bucket that a task compares at once
COMBINED_KEYS = 100_000          # repeated keys that a task remembers
CONTEXT_BYTES = 500_000          # open segments refined at once
_TIE_BITS, _LOW_BITS = 24, 8     # place: start, tie of the document, flag and number of windows
_FLAG = 64
NO_ID = (1 << 63) - 1            # null doc_ids come last

_ROW = "k1 long, k2 long, doc long, place long, stop int"
_NAMES = ["k1", "k2", "doc", "place", "stop"]


def _row_batch(k1, k2, doc, place, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(doc), pa.array(place), pa.array(stop.astype(np.int32))], names=_NAMES)


class Combiner:
    """Per task: earliest place of each key (k1, k2).  Rows that are later
    than a known one are split off; what is left goes to the shuffle."""

    def __init__(self) -> None:
        self.first: dict[int, tuple[int, int, int]] = {}

    def __call__(self, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices to send on, indices that are later)."""
        order = np.lexsort((place, doc, k2, k1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(order)))
        head = np.repeat(order[heads], size)
        at, from_ = place[order] >> _LOW_BITS, place[head] >> _LOW_BITS
        later = (doc[order] > doc[head]) | (doc[order] == doc[head]) & (at > from_)
        send = np.zeros(len(order), dtype=bool)
        send[order[heads]] = True
        gone = np.zeros(len(order), dtype=bool)
        gone[order[later]] = True
        several = (size > 1).tolist()
        first = self.first
        for i, more, key, other in zip(order[heads].tolist(), several, k1[order[heads]].tolist(), k2[order[heads]].tolist()):
            known = first.get(key ^ other)
            if known is not None and known[0] == key:
                mine = (int(doc[i]), int(place[i]) >> _LOW_BITS)
                if mine > known[1:]:
                    send[i], gone[i] = False, True
                elif mine < known[1:]:
                    first[key ^ other] = (key, *mine)
                else:
                    send[i] = False
            elif more and known is None and len(first) < COMBINED_KEYS:
                first[key ^ other] = (key, int(doc[i]), int(place[i]) >> _LOW_BITS)
        return np.flatnonzero(send), np.flatnonzero(gone)


def _places(start: np.ndarray, tie: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << (_TIE_BITS + _LOW_BITS)) | (tie.astype(np.int64) << _LOW_BITS) | low


def _start(place: np.ndarray) -> np.ndarray:
    return place >> (_TIE_BITS + _LOW_BITS)


def _slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(sizes):
        j, size = i, 0
        while j < len(sizes) and (j == i or size + sizes[j] <= limit):
            size += sizes[j]
            j += 1
        yield i, j
        i = j


def _scan(batches) -> Iterator[pa.RecordBatch]:
    """Step 1: (doc, tie, bytes) -> rows of _ROW; ``stop`` is 0 for a segment
    to compare, else the end of a removed range that begins at the place."""
    combine = Combiner()
    for batch in batches:
        docs, ties, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for i, j in _slices([len(t) for t in texts], SLICE_BYTES):
            data = np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8)
            doc_at = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])])
            at, low, high, bucket, own, repeats = seg.segments(data, doc_at)
            if not len(at):
                continue
            doc, start = docs[i:j][at], low - doc_at[at]
            place = _places(start, ties[i:j][at], (high - low) | np.where(repeats, _FLAG, 0))
            send, gone = combine(bucket, own, doc, place)
            stop = np.zeros(len(at), dtype=np.int64)
            stop[gone] = (start + (high - low) + LENGTH)[gone]
            # removed ranges ride along, spread by document
            k1 = bucket.copy()
            k1[gone] = seg.mix(doc[gone].astype(np.uint64) + start[gone].astype(np.uint64))
            keep = np.concatenate([send, gone])
            yield _row_batch(k1[keep], own[keep], doc[keep], place[keep], stop[keep])


_FOUND = "doc long, tie int, begin int, stop int, bucket long"


def _found(doc, place, begin, stop, bucket=None) -> pa.RecordBatch:
    tie = (place >> _LOW_BITS) & ((1 << _TIE_BITS) - 1)
    buckets = pa.nulls(len(doc), pa.int64()) if bucket is None else pa.array(bucket)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie.astype(np.int32)), pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32)), buckets], names=["doc", "tie", "begin", "stop", "bucket"])


class _Earliest:
    """Rows sorted by (k1, k2, doc, place), batch after batch: which are first
    of their key, and which are later than the first."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.doc = self.at = 0

    def __call__(self, k1, k2, doc, place) -> tuple[np.ndarray, np.ndarray]:
        at = place >> _LOW_BITS
        new = np.ones(len(k1), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        new[0] = self.key != (int(k1[0]), int(k2[0]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(k1)), -1))
        first_doc = np.where(head >= 0, doc[head], self.doc)
        first_at = np.where(head >= 0, at[head], self.at)
        self.key, self.doc, self.at = (int(k1[-1]), int(k2[-1])), int(first_doc[-1]), int(first_at[-1])
        return new, (doc > first_doc) | (doc == first_doc) & (at > first_at)


def _by_bucket(batches) -> Iterator[pa.RecordBatch]:
    """Step 2: removed ranges (bucket null) and open segments."""
    earliest = _Earliest()
    bucket, pending = None, None                 # bucket in hand; its only segment so far, as (doc, place)

    def open_rows(doc, place, keys) -> pa.RecordBatch:
        start = _start(place)
        return _found(doc, place, start, start + (place & (_FLAG - 1)) + LENGTH, keys)

    for batch in batches:
        k1, k2, doc, place, stop = (batch.column(c).to_numpy() for c in range(5))
        done = stop > 0
        if done.any():
            yield _found(doc[done], place[done], _start(place[done]), stop[done])
            k1, k2, doc, place = (x[~done] for x in (k1, k2, doc, place))
        if not len(k1):
            continue
        new, later = earliest(k1, k2, doc, place)
        if later.any():
            start = _start(place[later])
            yield _found(doc[later], place[later], start, start + (place[later] & (_FLAG - 1)) + LENGTH)
        k1, doc, place = k1[new], doc[new], place[new]           # one row per segment
        if not len(k1):
            continue
        change = np.ones(len(k1), dtype=bool)
        change[1:] = k1[1:] != k1[:-1]
        change[0] = bucket != int(k1[0])
        if pending is not None:
            if not change[0] or int(pending[1]) & _FLAG:
                yield open_rows(np.array([pending[0]]), np.array([pending[1]]), np.array([bucket]))
            pending = None
        heads = np.flatnonzero(change)
        size = np.diff(np.append(heads, len(k1)))
        alone = np.zeros(len(k1), dtype=bool)
        alone[heads[size == 1]] = True
        bucket = int(k1[-1])
        if alone[-1]:
            pending = (int(doc[-1]), int(place[-1]))
        give = ~alone | (place & _FLAG > 0)
        if alone[-1]:
            give[-1] = False
        if give.any():
            yield open_rows(doc[give], place[give], k1[give])
    if pending is not None and pending[1] & _FLAG:
        yield open_rows(np.array([pending[0]]), np.array([pending[1]]), np.array([bucket]))


def _refine(batches) -> Iterator[pa.RecordBatch]:
    """Step 3, per document: bytes of its open segments, or their windows."""
    combine = Combiner()
    names = [*_NAMES, "context"]
    for batch in batches:
        docs, ties, texts, lists = (batch.column(c).to_pylist() for c in ("__doc", "__tie", "__data", "opened"))
        k1, doc, place, context = [], [], [], []
        hot: list[tuple] = []
        for d, tie, text, opened in zip(docs, ties, texts, lists):
            for o in opened:
                begin, piece = o["begin"], text[o["begin"]:o["stop"]]
                if o["many"]:
                    hot.append((d, tie, begin, piece))
                else:
                    k1.append(o["bucket"])
                    doc.append(d)
                    place.append(begin << (_TIE_BITS + _LOW_BITS) | tie << _LOW_BITS)
                    context.append(piece)
        if k1:
            zero = np.zeros(len(k1), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(zero), pa.array(doc, pa.int64()), pa.array(place, pa.int64()), pa.array(zero.astype(np.int32)), pa.array(context, pa.binary())], names=names)
        if hot:
            first, second, of, offset = _windows([h[3] for h in hot])
            doc_ = np.array([h[0] for h in hot], dtype=np.int64)[of]
            place_ = _places(np.array([h[2] for h in hot])[of] + offset, np.array([h[1] for h in hot])[of], 0)
            send, gone = combine(first, second, doc_, place_)
            stop = np.zeros(len(of), dtype=np.int64)
            stop[gone] = _start(place_[gone]) + LENGTH
            first[gone] = seg.mix(first[gone] ^ doc_[gone].astype(np.uint64))
            keep = np.concatenate([send, gone])
            plain = _row_batch(first[keep], second[keep], doc_[keep], place_[keep], stop[keep])
            yield pa.RecordBatch.from_arrays([*plain.columns, pa.nulls(len(keep), pa.binary())], names=names)


def _windows(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the byte strings: two identifiers, which string, offset."""
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    size = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    n = size - LENGTH + 1
    of = np.repeat(np.arange(len(contexts)), n)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[of] + offset
    return seg.identifiers(data)[1][at], seg.second_identifiers(data, at), of, offset


def _resolve(batches) -> Iterator[pa.RecordBatch]:
    """Step 3, per bucket: ranges of windows that are not the earliest."""
    earliest = _Earliest()
    held: list[tuple] = []
    size = 0

    def compare() -> pa.RecordBatch | None:
        nonlocal held, size
        data = b"".join(h[3] for h in held)
        sizes = np.fromiter((len(h[3]) for h in held), dtype=np.int64, count=len(held))
        n = sizes - LENGTH + 1
        ends = np.cumsum(n)
        offset = np.arange(ends[-1]) - np.repeat(ends - n, n)
        of = np.repeat(np.arange(len(held)), n)
        at = np.repeat(np.cumsum(sizes) - sizes, n) + offset
        doc = np.array([h[1] for h in held], dtype=np.int64)[of]
        place = np.array([h[2] for h in held], dtype=np.int64)[of] + (offset << (_TIE_BITS + _LOW_BITS))
        held, size = [], 0
        window = np.full(len(data), -1)
        window[at] = np.arange(len(at))
        sorted_ = refined(data, sizes, LENGTH)
        sorted_ = sorted_[window[sorted_] >= 0]
        number = window[sorted_]
        group = np.cumsum(~same_as_before(data, sorted_, LENGTH))
        order = number[np.lexsort((place[number], doc[number], group))]
        key = np.sort(group)
        _, later = _Earliest()(key, key, doc[order], place[order])
        gone = order[later]
        if not len(gone):
            return None
        # windows in a row of one segment make one range
        gone.sort()
        run = np.ones(len(gone), dtype=bool)
        run[1:] = (np.diff(gone) > 1) | (of[gone][1:] != of[gone][:-1])
        a = gone[run]
        b = gone[np.append(np.flatnonzero(run)[1:], len(gone)) - 1]
        return _found(doc[a], place[a], _start(place[a]), _start(place[b]) + LENGTH)

    last = None
    for batch in batches:
        k1, k2, doc, place, stop = (batch.column(c).to_numpy() for c in range(5))
        context = batch.column(5)
        loose = context.is_null().to_numpy(zero_copy_only=False)
        if loose.any():
            done = loose & (stop > 0)
            if done.any():
                yield _found(doc[done], place[done], _start(place[done]), stop[done])
            single = loose & ~done
            if single.any():
                _, later = earliest(k1[single], k2[single], doc[single], place[single])
                if later.any():
                    start = _start(place[single][later])
                    yield _found(doc[single][later], place[single][later], start, start + LENGTH)
        for i in np.flatnonzero(~loose).tolist():
            bucket = int(k1[i])
            if size >= CONTEXT_BYTES and bucket != last and (out := compare()) is not None:
                yield out
            last = bucket
            held.append((bucket, int(doc[i]), int(place[i]), context[i].as_py()))
            size += len(held[-1][3])
    if held and (out := compare()) is not None:
        yield out


def _cut(data: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, list[tuple[int, int]]]:
    """(removed bytes, maximal removed runs, kept runs)."""
    kept, at, removed, spans = [], 0, 0, 0
    for begin, stop in ranges:
        if stop <= at and spans:
            continue
        if begin > at or not spans:
            spans += 1
            if begin > at:
                kept.append((at, begin))
            at = max(at, begin)
        removed += stop - at
        at = stop
    if at < len(data):
        kept.append((at, len(data)))
    return removed, spans, kept


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", clean: bool = False) -> DataFrame:
    """``docs`` with, appended: n_bytes, n_removed, n_spans (maximal removed
    runs), ``kept``, the array of [begin, stop) byte runs that stay, and
    kept_sha256 of their bytes.  The text column goes, or with ``clean``
    holds what stays; characters cut by a run are dropped.

    Null text counts as empty and loses nothing, like any text of less than
    100 bytes.  Matches never cross documents.  Rows with equal doc_id and
    text are one document and get equal results; different texts under one
    doc_id are separate documents, at equal starts in a fixed order of their
    hashes; null doc_ids come last.  Columns of the five names are replaced,
    and an empty table stays empty."""
    spark = docs.sparkSession
    added = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept_columns = docs.drop(*added)
    names = kept_columns.columns
    out = [f for f in kept_columns.schema.fields if clean or f.name != text]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    tie = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND((1 << _TIE_BITS) - 1).cast("int")
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary")).alias("__data")
    rows = kept_columns.withColumns({"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), "__tie": tie})
    found = materialize(rows.select("__doc", "__tie", data).mapInArrow(_scan, _ROW).repartition(n, "k1").sortWithinPartitions("k1", "k2", "doc", "place").mapInArrow(_by_bucket, _FOUND), "repeats-found")
    opened = found.where("bucket is not null")
    many = materialize(opened.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_IN_TASK).select("bucket", F.lit(True).alias("many")), "repeats-many")
    opened = (opened.join(many, "bucket", "left").groupBy("doc", "tie").agg(F.collect_list(F.struct("begin", "stop", "bucket", F.coalesce("many", F.lit(False)).alias("many"))).alias("opened")))
    # the documents are shuffled once; both joins read that shuffle
    by_doc = rows.repartition(n, "__doc", "__tie")

    def same(side: DataFrame):
        return (by_doc["__doc"] == side["doc"]) & (by_doc["__tie"] == side["tie"])

    contexts = by_doc.join(opened, same(opened)).select(*names, "__doc", "__tie", data, "opened").mapInArrow(_refine, _ROW + ", context binary")
    resolved = contexts.repartition(n, "k1").sortWithinPartitions("k1", "k2", "doc", "place").mapInArrow(_resolve, _FOUND)
    gone = found.where("bucket is null").unionByName(resolved).groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("gone"))

    def finish(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_out, texts = [], []
            for value, ranges in zip(batch.column(text), batch.column("gone")):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                removed, spans, kept = _cut(data, [(r["begin"], r["stop"]) for r in ranges.as_py() or ()])
                digest = hashlib.sha256()
                for a, b in kept:
                    digest.update(data[a:b])
                rows_out.append((len(data), removed, spans, [list(k) for k in kept], digest.hexdigest()))
                if clean:
                    texts.append("".join(data[a:b].decode("utf-8", "ignore") for a, b in kept) if removed else value.as_py())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows_out), kinds)] if rows_out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if f.name == text else batch.column(f.name) for f in out), *columns], names=[*(f.name for f in out), *added])

    joined = by_doc.join(gone, same(gone), "left").select(*names, "gone")
    return joined.mapInArrow(finish, types + ", n_bytes long, n_removed long, n_spans long, kept array<array<long>>, kept_sha256 string")
