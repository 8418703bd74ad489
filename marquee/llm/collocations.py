"""Collocations: frequent phrases of two to four words, scored by their
lowest-scoring cut.

A phrase's occurrences are the suffixes of the text that begin with it, so
its count is the size of an equal partition when suffix pointers are sorted
by multikey three-way quicksort to four words.  A first pass counts single
words over the whole corpus; those that are too rare are abandoned, and what
is left is known to the tasks by a bitmap of bounded size (a rare word that
shares its bit is only abandoned later).  Tasks then sort the pointers of
their own texts, slice by slice, and write the distinct suffixes with their
counts, routed by a hash of their language and first two words into buckets.
Each bucket is sorted again as a whole, one word deeper at a time, and
partitions below the least count are abandoned at every depth.

The number of buckets follows from the size of the texts.  A bucket that
holds too much, as with a pair of words that makes up a large share of the
corpus, is divided by a hash of the whole suffix as it is sent (the first pass
has counted the suffixes of every bucket); the counts of its pairs and triples are then added up over its parts.  Memory is bounded
by a slice or a part.

Results for odd input: null texts are empty; a null language is ``und``;
empty texts have no words; texts of any length are taken whole; repeated rows
count each; equal scores and counts rank by the phrase's bytes; an empty
table has no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.shingles import ODD, mix, word_hashes
from marquee.session import materialize

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
COVERED = 80                     # percent of a phrase's count in a longer one that drops it
SCALE = 2_000_000
SLICE_WORDS = 1 << 19            # pointers sorted at once in a task
PENDING = 1 << 21                # sorted suffixes that a task gathers before it writes them
KEPT_WORDS = 1 << 18             # numbered words that a task keeps
BUCKET_BYTES = 1 << 23           # of text, on average, behind a bucket
BUCKET_ENTRIES = 1 << 21         # suffixes and words of a bucket; larger ones are divided
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28    # of the map of frequent words (at most 32 MB); one Spark bitmap has 2**15
CHUNK = 1 << 24                  # characters; longer texts are read in chunks that end at a break
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BREAKS = b".,;:!?\n\x0b\x0c\r"
TO_BREAK = bytes(46 if c in BREAKS else c for c in LOWER)     # every break becomes a full stop


def quicksort(words: np.ndarray, at: np.ndarray, first: np.ndarray, depth: int, weight: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of pointers ``at`` into ``words``, with
    0 after the last word of a suffix.  All partitions of a round are split
    at once: each around the word of its middle pointer at its own depth,
    into less, equal and greater; the equal part goes one word deeper.

    ``first`` is the partition that each pointer is in at the start, in
    rising order.  Partitions of a weight below ``least`` are abandoned;
    pointers of one partition that has reached ``depth`` words, or the end of
    its suffixes, are equal.  Returns the order of the pointers kept (as
    indices into ``at``) and the partition number of each, rising."""
    n = len(at)
    starts = _partitions(first)
    # a partition's place among all is the start of its run, which splitting never changes
    place = np.repeat(starts, np.diff(np.r_[starts, n])).astype(np.int32)
    order, at = np.arange(n, dtype=np.int32), at.astype(np.int32)
    deep = np.zeros(n, np.int8)
    done_order, done_rank = [], []
    while len(order):
        begin = _partitions(place)
        size = np.diff(np.r_[begin, len(order)])
        load = size if weight is None else np.add.reduceat(weight[order], begin)
        live = load >= least
        out = live & ((deep[begin] >= depth) | (size == 1) & (least == 0))
        if out.any() or not live.all():
            mask = np.repeat(out, size)
            done_order.append(order[mask])
            done_rank.append(place[mask])
            stay = live & ~out
            mask = np.repeat(stay, size)
            order, place, deep, size = order[mask], place[mask], deep[mask], size[stay]
            if not len(order):
                break
            begin = np.cumsum(size) - size
        key = words[at[order] + deep]
        pivot = np.repeat(key[begin + size // 2], size)
        less, more = key < pivot, key > pivot
        n_less = np.add.reduceat(less, begin, dtype=np.int32)
        n_more = np.add.reduceat(more, begin, dtype=np.int32)
        lows, tops = np.flatnonzero(less), np.flatnonzero(more)
        mids = np.flatnonzero(~(less | more))
        n_equal = size - n_less - n_more

        def spread(counts: np.ndarray, start: np.ndarray) -> np.ndarray:
            """New positions of one side's elements, partition by partition."""
            ends = np.cumsum(counts)
            return np.arange(ends[-1]) + np.repeat(start - (ends - counts), counts)

        # every side keeps its order within its partition
        source = np.empty(len(order), np.int32)
        middle, high = begin + n_less, begin + n_less + n_equal
        source[spread(n_less, begin)] = lows
        to_mid = spread(n_equal, middle)
        source[to_mid] = mids
        to_top = spread(n_more, high)
        source[to_top] = tops
        order, deep = order[source], deep[source]      # places are equal within a partition
        base = place[begin]
        place[to_mid] = np.repeat(base + n_less, n_equal)
        place[to_top] = np.repeat(base + n_less + n_equal, n_more)
        deep[to_mid] = np.where(key[mids] == 0, depth, deep[to_mid] + 1)
    if not done_order:
        return order, place
    order, rank = np.concatenate(done_order), np.concatenate(done_rank)
    by = np.argsort(rank, kind="stable")
    return order[by], rank[by]


class Words:
    """Numbers of words, from 1; 0 ends a piece."""

    def __init__(self) -> None:
        self.names: list[bytes] = [b"."]
        outer = self

        class Ids(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = n = len(outer.names)
                outer.names.append(word)
                return n
        self.ids = Ids({b".": 0})

    def encode(self, text: str) -> np.ndarray:
        """Word numbers of a text with a 0 after every piece."""
        found = text.encode("utf-8", "surrogatepass").translate(TO_BREAK).replace(b".", b" . ").split()
        found.append(b".")
        return np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found))


BREAK = re.compile("[.,;:!?\n\x0b\x0c\r]")


def _chunks(text: str) -> Iterator[str]:
    """The text, a long one in chunks that end where a piece does."""
    start = 0
    while len(text) - start > CHUNK:
        end = BREAK.search(text, start + CHUNK)
        if end is None:
            break
        yield text[start:end.end()]
        start = end.end()
    if start < len(text):
        yield text[start:]


def _partitions(rank: np.ndarray) -> np.ndarray:
    """Where the partitions of a sorted run begin."""
    return np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)


def _pack(langs: list[str], names: list[bytes], columns: list[np.ndarray]) -> bytes:
    """Suffixes (lang, w1 to w4, count), with the names they use, as one
    compressed blob; numbers go byte by byte, as their high bytes are zeros."""
    used = np.unique(np.concatenate(columns[1:5]))
    out = [columns[0], *[np.searchsorted(used, c) for c in columns[1:5]], columns[5]]
    head = json.dumps([langs, len(columns[0])]).encode()
    vocabulary = b"\n".join([names[i] for i in used.tolist()])
    planes = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in out)
    return zlib.compress(struct.pack("<II", len(head), len(vocabulary)) + head + vocabulary + planes, 1)


def _unpack(blob: bytes) -> tuple[list[str], list[bytes], list[np.ndarray]]:
    raw = zlib.decompress(blob)
    a, b = struct.unpack_from("<II", raw)
    langs, n = json.loads(raw[8:8 + a])
    planes = np.frombuffer(raw, np.uint8, offset=8 + a + b).reshape(6, 4, n)
    return langs, raw[8 + a:8 + a + b].split(b"\n"), [np.ascontiguousarray(c.T).view("<i4").ravel() for c in planes]


def _hash(langs: list[str], names: list[bytes], *columns: np.ndarray) -> np.ndarray:
    """The same for equal languages and words in every task."""
    def of(strings: list[bytes]) -> np.ndarray:
        ends = np.cumsum([0, *map(len, strings)])
        return word_hashes(b"".join(strings), ends[:-1], ends[1:])
    tables = [of([x.encode("utf-8", "surrogatepass") for x in langs])] + [of(names)] * (len(columns) - 1)
    out = np.zeros(len(columns[0]), np.uint64)
    for table, column in zip(tables, columns):
        out = mix(out * np.uint64(ODD) + table[column])
    return out


def _group(langs: list[str], names: list[bytes], columns: list[np.ndarray], bucket: np.ndarray, parts: dict[int, int]) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, parts, part, blob) of suffixes by bucket; a bucket of several
    parts is divided by a hash of the whole suffix."""
    order = np.argsort(bucket, kind="stable")
    begin = _partitions(bucket[order])
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)]):
        here = order[a:b]
        k = int(bucket[here[0]])
        n = parts.get(k, 1)
        if n == 1:
            yield k, 1, 0, _pack(langs, names, [x[here] for x in columns])
            continue
        part = (_hash(langs, names, *[x[here] for x in columns[:5]]) % np.uint64(n)).astype(np.int64)
        for own in np.unique(part).tolist():
            yield k, n, own, _pack(langs, names, [x[here[part == own]] for x in columns])


class Slices:
    """Texts as slices of word numbers.  Numbers hold from slice to slice,
    until ``forget``."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.words, self.langs = Words(), {}

    def of(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(language of each position, words with MAX_WORDS zeros behind)."""
        texts, of, held = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in _chunks(text or ""):
                    texts.append(self.words.encode(part))
                    of.append(self.langs.setdefault(lang, len(self.langs)))
                    held += len(texts[-1])
                    if held >= SLICE_WORDS:
                        yield np.repeat(np.array(of, np.int32), [len(t) for t in texts]), np.concatenate([*texts, np.zeros(MAX_WORDS, np.int32)])
                        texts, of, held = [], [], 0
        if texts:
            yield np.repeat(np.array(of, np.int32), [len(t) for t in texts]), np.concatenate([*texts, np.zeros(MAX_WORDS, np.int32)])


def _counted(buckets: int):
    """Words of a task's texts with their counts, (lang, word, n), and how
    many suffixes go to each bucket, (bucket, n)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        slices, seen, sent = Slices(), {}, np.zeros(buckets, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            names = slices.words.names
            for lang, i in slices.langs.items():
                counts = seen.pop(i, None)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([names[k] for k in at.tolist()], pa.binary()), pa.nulls(len(at), pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "word", "bucket", "n"])

        for lang, words in slices.of(batches):
            at = np.flatnonzero(words[:len(lang)])
            for i in np.unique(lang).tolist():
                counts = np.bincount(words[at[lang[at] == i]], minlength=len(slices.words.names))
                if i in seen:
                    counts[:len(seen[i])] += seen[i]
                seen[i] = counts
            at = at[words[at + 1] > 0]
            sent += np.bincount((_hash(list(slices.langs), slices.words.names, lang[at], words[at], words[at + 1]) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
            if len(slices.words.names) * max(1, len(seen)) > KEPT_WORDS:
                yield from rows()
                slices.forget()
        yield from rows()
        at = np.flatnonzero(sent)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(sent[at])], names=["lang", "word", "bucket", "n"])
    return run


def _bits(size: int):
    """Number of the bit of each frequent word (lang, word), from 1."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, own = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            names = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array((_hash(langs.tolist(), names, own, np.arange(len(names))) % np.uint64(size)).astype(np.int64) + 1)], names=["bit"])
    return run


_BLOB_NAMES, _BLOB_TYPES = ["bucket", "parts", "part", "blob"], (pa.int32(), pa.int64(), pa.int64(), pa.binary())


def _local(buckets: int, frequent: np.ndarray, parts: dict[int, int]):
    """Texts as routed blobs: (bucket, parts, part, blob).
    A word without its bit in ``frequent`` is too rare, and so is every phrase
    with it: suffixes end before it."""
    def known(langs: list[str], names: list[bytes], lang: np.ndarray, word: np.ndarray) -> np.ndarray:
        bit = _hash(langs, names, lang, word) % np.uint64(8 * len(frequent))
        return (frequent[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def sort(langs: list[str], names: list[bytes], lang: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        """Distinct suffixes (lang, w1 to w4, count) and their buckets."""
        at = np.flatnonzero(words[:len(lang)])
        lead = lang[at] * np.int64(len(names)) + words[at]
        by = np.argsort(lead, kind="stable")
        at, lead = at[by], lead[by]
        first = _partitions(lead)
        often = np.repeat(known(langs, names, lang[at[first]], words[at[first]]), np.diff(np.r_[first, len(at)]))
        words[at[~often]] = 0
        at, lead = at[often], lead[often]
        paired = words[at + 1] > 0
        at, lead = at[paired], lead[paired]
        order, rank = quicksort(words, at + 1, lead, MAX_WORDS - 1)
        at, new = at[order], _partitions(rank)
        count, at = np.diff(np.r_[new, len(at)]).astype(np.int32), at[new]
        columns = [lang[at], words[at]]
        for k in range(1, MAX_WORDS):
            columns.append(np.where(columns[-1] == 0, np.int32(0), words[at + k]))
        return [*columns, count, (_hash(langs, names, *columns[:3]) % np.uint64(buckets)).astype(np.int32)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        slices, pending = Slices(), []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = []
            for i in range(len(pending[0])):     # one after the other, to hold little twice
                columns.append(np.concatenate([p[i] for p in pending]))
                for p in pending:
                    p[i] = None
            pending.clear()
            bucket = columns.pop()
            for row in _group(list(slices.langs), slices.words.names, columns, bucket, parts):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOB_TYPES)], names=_BLOB_NAMES)

        for lang, words in slices.of(batches):
            pending.append(sort(list(slices.langs), slices.words.names, lang, words))
            many = len(slices.words.names) > KEPT_WORDS
            if many or sum(len(p[0]) for p in pending) >= PENDING:
                yield from flush()
            if many:
                slices.forget()
        if pending:
            yield from flush()
    return run


def _routed(least: int):
    """Counts (lang, phrase, f, words, exact) of phrases of two words and
    more from blobs (bucket, parts, part, blob) sorted by bucket and part, all
    of one pair in one partition.  Where a bucket has parts, phrases of two
    and three words may have more of their count in other parts, and all are
    given."""
    def sort(blobs: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        words = Words()
        suffixes = []
        while blobs:
            own_langs, names, columns = _unpack(blobs.pop())
            to_lang = np.array([langs.setdefault(x, len(langs)) for x in own_langs], np.int32)
            to_word = np.fromiter(map(words.ids.__getitem__, names), np.int32, len(names))
            suffixes.append([to_lang[columns[0]], *[to_word[c] for c in columns[1:5]], columns[5]])
        names, codes = words.names, list(langs)
        columns = []
        for i in range(6):
            columns.append(np.concatenate([x[i] for x in suffixes]))
            for x in suffixes:
                x[i] = None
        n = columns.pop()
        lead = columns[0] * np.int64(len(names)) + columns[1]
        by = np.argsort(lead, kind="stable")
        flat = np.stack([c[by] for c in columns], 1)
        mass, at, part = n[by].astype(np.int64), np.arange(len(by), dtype=np.int32) * 5 + 2, lead[by]
        flat = flat.ravel()
        del columns, lead
        for depth in (2, 3, 4):              # each time one word deeper, within the partitions kept
            exact = parts == 1 or depth == 4
            order, rank = quicksort(flat, at, part, 1, mass, least if exact else 1)
            at, mass, new = at[order], mass[order], _partitions(rank)
            if not len(new):
                break
            f, here = np.add.reduceat(mass, new), at[new] - depth
            there = flat[at[new]] > 0        # not the ends of shorter suffixes
            f, here = f[there], here[there]
            phrases = zip(*[[names[i] for i in flat[here + k].tolist()] for k in range(1, depth + 1)])
            yield pa.RecordBatch.from_arrays([pa.array([codes[i] for i in flat[here].tolist()], pa.string()), pa.array([b" ".join(p) for p in phrases], pa.binary()), pa.array(f, pa.int64()),
                                              pa.array(np.full(len(f), depth), pa.int32()), pa.array(np.full(len(f), exact))], names=["lang", "phrase", "f", "words", "exact"])
            longer = flat[at] > 0
            at, mass, part = at[longer] + 1, mass[longer], rank[longer]

    def run(batches) -> Iterator[pa.RecordBatch]:
        head, blobs = None, []
        for batch in batches:
            for *place, blob in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                if place != head:
                    if blobs:
                        yield from sort(blobs, head[1])
                    head, blobs = place, []
                blobs.append(blob.as_py())
        if blobs:
            yield from sort(blobs, head[1])
    return run


def frequent_words(rows: DataFrame, least: int, buckets: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """Words (lang, phrase, f) with at least ``least`` occurrences, the
    number of word occurrences by language, the number of suffixes by bucket,
    and the words as a bitmap by hash: 16 bits a word, MOST_BITS at most, so
    its size is bounded."""
    counted = rows.mapInArrow(_counted(buckets), "lang string, word binary, bucket int, n long")
    words = materialize(counted.groupBy("lang", "word", "bucket").agg(F.sum("n").alias("f")), "phrases-words")
    sizes, words = words.where("bucket is not null").select("bucket", "f"), words.where("bucket is null").select("lang", "word", "f")
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least)
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * often.count()).bit_length()))
    bits = often.select("lang", "word").mapInArrow(_bits(size), "bit long")
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    # bucket k, from 1 on, has the bits from (k - 1) * LEAST_BITS on
    bitmap = np.zeros(size // 8 + LEAST_BITS // 8, np.uint8)
    for r in maps.collect():
        own = np.frombuffer(bytes(r["map"]), np.uint8)
        start = (r["k"] - 1) * LEAST_BITS // 8
        bitmap[start:start + len(own)] |= own
    return often.select("lang", F.col("word").alias("phrase"), "f"), n, sizes, bitmap[:size // 8]


def phrases(docs: DataFrame, least: int = MIN_COUNT, bucket_bytes: int = BUCKET_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to four words that occur at least ``least`` times in a
    language, (lang, phrase, f, words) with the phrase as bytes, and the
    number of word occurrences by language, (lang, n)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    buckets = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes
    singles, n, sizes, bitmap = frequent_words(rows, least, buckets)
    # buckets far beyond the mean only: at most one for every ``bucket_entries`` words
    parts = {r["bucket"]: -(-r["f"] // bucket_entries) for r in sizes.where(F.col("f") > bucket_entries).collect()}
    sent = rows.mapInArrow(_local(buckets, bitmap, parts), "bucket int, parts long, part long, blob binary")
    sent = sent.repartition(2 * buckets, "bucket", "part").sortWithinPartitions("bucket", "parts", "part")
    found = materialize(sent.mapInArrow(_routed(least), "lang string, phrase binary, f long, words int, exact boolean"), "phrases-found")
    summed = found.where("not exact").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    kept = [found.where("exact").select("lang", "phrase", "f", "words"), summed.select("lang", "phrase", "f", "words"), singles.withColumn("words", F.lit(1))]
    return materialize(kept[0].unionByName(kept[1]).unionByName(kept[2]), "phrases"), n


def _split() -> Column:
    return F.split(F.col("phrase").cast("string"), " ")


def _joined(start, length) -> Column:
    return F.array_join(F.slice(F.col("w"), start, length), " ").cast("binary")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The ``top`` collocations of each language of ``docs`` (lang, text):
    (lang, rank, phrase, a, l, r, n, score).  A phrase that is contained in a
    longer one with at least ``covered`` percent of its count is left out."""
    found, n = phrases(docs, least)
    candidates = found.where("words >= 2").withColumn("w", _split())
    inside = F.transform(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1), lambda i: F.struct(F.array_join(F.slice(F.col("w"), i, F.col("m")), " ").cast("binary").alias("phrase")))
    parts = candidates.where("words >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).select("lang", F.explode(inside).alias("p"), "f")
    within = parts.groupBy("lang", F.col("p.phrase").alias("phrase")).agg(F.max("f").alias("longer"))
    kept = candidates.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("f").cast("decimal(38,0)") * covered))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", _joined(F.lit(1), F.col("k")).alias("head"), _joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    count = found.select("lang", "phrase", "f")
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(count.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    exact = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.cast("long").alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
