"""Near-duplicate documents: BagMinHash signatures, bands, verified overlap.

BagMinHash: every shingle with its count is a weighted element.  Its weight
axis is discretised at the integers and grouped into the dyadic intervals
(0,1], (1,2], (2,4], (4,8] ...; each interval carries a Poisson process of
points in time whose rate is its length, seeded by the shingle, so all
documents see the same points.  A point has a height inside its interval and
a random signature component; a document counts the points that lie below its
weight, and each component keeps the earliest.  Two components agree with
probability equal to the weighted Jaccard similarity.  Points are made in
order of time, and a process ends once it is later than the worst component.

Bands of components give buckets.  Every bucket first links its members to
its most central one, which meets the most others in all its buckets, each
pair verified on the exact multisets; classes are the components of these
links.  Then buckets that still hold several classes compare across classes,
except for pairs that cannot reach the similarity: by their sizes, by the
triangle inequality of the Jaccard distance to the pivot, or because what they
can share is too little: what both share with the pivot, and of the rest only
shingles that some other open text holds.  So no candidate link between
different texts is lost, and a large group of copies costs a pair per member
rather than per pair.  Equal texts are one representative throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.components import components
from marquee.llm.shingles import WORDS, by_slice, canonical, mix, multisets, overlap
from marquee.session import materialize

SIMILARITY = 0.8
BANDS, ROWS = 32, 5              # at similarity 0.8 a pair shares no band with probability 3e-6
PAIRS_IN_RUN = 64                # partners of one document that a verifying task compares in a row
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signatures(shingle: np.ndarray, count: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """(n_docs, size) earliest points; infinite where a document is empty."""
    best = np.full(n_docs * size, np.inf)
    # processes: (element, interval), interval j > 0 is (2**(j-1), 2**j]
    intervals = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    owner = np.repeat(np.arange(len(shingle)), intervals)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(intervals) - intervals, intervals)
    length = np.where(level > 0, 1 << np.maximum(level - 1, 0), 1)
    low = np.where(level > 0, length, 0)
    seed = mix(shingle[owner] + mix(level.astype(np.uint64) + np.uint64(1)))
    whose, weight = doc[owner], count[owner]
    time = np.zeros(len(owner))
    nth, step = 0, (1 << 64) - 1
    latest = np.full(n_docs, np.inf)
    while len(seed):
        nth += 1
        r = mix(seed + np.uint64(nth * 0x9E3779B97F4A7C15 & step))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        live = time <= latest[whose]
        if not live.all():
            seed, whose, weight, time, length, low = (x[live] for x in (seed, whose, weight, time, length, low))
            if not len(seed):
                break
        r = mix(seed ^ np.uint64(nth * 0xD1342543DE82EF95 & step))
        part = (r >> np.uint64(32)).astype(np.int64) * size >> 32
        height = low + 1 + ((r & np.uint64(0xFFFFFFFF)).astype(np.int64) * length >> 32)
        below = height <= weight
        np.minimum.at(best, (whose * size + part)[below], time[below])
        latest = best.reshape(n_docs, size).max(axis=1)
    return best.reshape(n_docs, size)


def band_keys(best: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) keys; equal only for the same band."""
    bits = best.view(np.uint64).reshape(len(best), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(best), bands))
    for k in range(rows):
        key = mix(key * _GOLDEN + bits[:, :, k])
    return key


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """(doc_id, tie, digest of the canonical text, n shingles, band keys) of
    docs (doc_id, tie, text)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [canonical(t) for t in batch.column(2).to_pylist()]
            for i, part in by_slice(texts):
                shingle, count, doc, at = multisets(part, words)
                keys = band_keys(signatures(shingle, count, doc, len(part), bands * rows), bands, rows).view(np.int64)
                sums = np.concatenate([[0], np.cumsum(count)])
                n = sums[at[1:]] - sums[at[:-1]]
                digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in part]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]), pa.int32()), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), batch.column(1).slice(i, len(part)), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), lists], names=["doc_id", "tie", "digest", "n", "keys"])

    return docs.select("doc_id", "tie", "text").mapInArrow(run, "doc_id long, tie long, digest binary, n long, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b, shared, similarity) of all ``pairs`` (a, b) over ``texts`` (rep, text).

    The partners of an ``a`` with many are dealt in runs of about PAIRS_IN_RUN
    by a hash, so they go to many tasks; each run gets a's text once and
    streams the partners' texts past it."""
    many = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRS_IN_RUN), "minhash-many")
    run = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n", F.lit(1)) / F.lit(PAIRS_IN_RUN))))
    dealt = pairs.join(many, "a", "left").select("a", "b", run.alias("run"))
    heads = dealt.select("a", "run", F.lit(None).cast("long").alias("b"), F.col("a").alias("rep")).distinct()
    both = heads.unionByName(dealt.select("a", "run", "b", F.col("b").alias("rep"))).join(texts, "rep").select("a", "run", "b", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(n, "a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())

    def compare(batches) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts_ = [canonical(t) for t in batch.column(3).to_pylist()]
            out: list[tuple] = []
            for i, part in by_slice(texts_):
                shingle, count, _, at = multisets(part, words)
                for k in range(len(part)):
                    own = shingle[at[k]:at[k + 1]], count[at[k]:at[k + 1]]
                    if b[i + k] is None:
                        head = own[0].copy(), own[1].copy()
                    else:
                        shared, near = overlap(head, own)
                        out.append((a[i + k], b[i + k], shared, near))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "shared", "similarity"])

    return ordered.mapInArrow(compare, "a long, b long, shared long, similarity double")


def own_weight(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(rep, lone): how much of each text's multiset no other of ``texts``
    (rep, text) holds; texts without such shingles don't appear."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column(0).to_numpy()
            for i, part in by_slice([canonical(t) for t in batch.column(1).to_pylist()]):
                shingle, count, doc, _ = multisets(part, words)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(rep[i:i + len(part)][doc]), pa.array(count.astype(np.int64))], names=["shingle", "rep", "count"])

    held = texts.select("rep", "text").mapInArrow(run, "shingle long, rep long, count long")
    single = held.groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"), F.min("count").alias("count")).where("rep = last")
    return single.groupBy("rep").agg(F.sum("count").alias("lone"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rep_id, class_id), a row per row of ``docs``: the smallest
    doc_id with equal words, and the smallest doc_id of the class, the
    connected component of texts whose five-word shingle multisets have a
    weighted Jaccard similarity of ``similarity`` or more.

    Null text counts as empty; texts without words equal each other and
    nothing else; texts of fewer than five words have one shingle.  Words
    are runs without white space, in lower case.  Repeated rows share their
    class; rows with a null doc_id come back as a class of their own (null
    class_id) and take no part.  Each text of an id that has several gets the
    class of its own words; where two texts have the same smallest id, the
    one with the smaller hash is searched and both share its class.  Other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    seen = materialize(sketch(rows_in.where("doc_id is not null"), bands, rows), "minhash-sketch")
    reps = materialize(seen.groupBy("digest").agg(F.min_by(F.struct("n", "keys"), F.struct("doc_id", "tie")).alias("x"), F.min(F.struct("doc_id", "tie")).alias("r")).select("digest", F.col("r.doc_id").alias("rep"), "r.tie", "x.n", "x.keys"), "minhash-reps")
    # of different texts under one representative id, the one with the least hash stands for it
    one = reps.groupBy("rep").agg(F.min(F.struct("tie", "digest")).alias("x")).select("rep", F.col("x.digest").alias("digest"))
    searched = reps.join(one, ["rep", "digest"])
    # buckets of two or more; each has its most central member as pivot
    banded = searched.select("rep", "n", F.explode("keys").alias("key"))
    buckets = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "minhash-buckets")
    members = materialize(banded.join(buckets, "key"), "minhash-members")
    central = materialize(members.groupBy("rep").agg(F.sum("size").alias("met")), "minhash-central")
    pivots = materialize(members.join(central, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("of"))).alias("x")).select("key", (-F.col("x.of")).alias("pivot")), "minhash-pivots")
    members = materialize(members.join(pivots, "key").select("key", "pivot", "rep", "n"), "minhash-pivoted")
    wanted = searched.join(central, "rep", "left_semi").select("rep", "tie")
    texts = rows_in.join(wanted, (rows_in["doc_id"] == wanted["rep"]) & (rows_in["tie"] == wanted["tie"]), "left_semi").select(F.col("doc_id").alias("rep"), "text")
    texts = materialize(texts.dropDuplicates(["rep"]), "minhash-texts")

    star = members.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    stars = materialize(verify(star, texts), "minhash-stars")
    links = stars.where(F.col("similarity") >= similarity).select("a", "b")
    classes = components(links)
    # across the classes of a bucket: outsiders of the pivot's class with all others
    placed = materialize(members.join(classes.withColumnRenamed("node", "rep"), "rep", "left")
                         .join(stars.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "shared", (1 - F.col("similarity")).alias("far")), ["pivot", "rep"], "left")
                         .select("key", "pivot", "rep", "n", F.coalesce("shared", "n").alias("shared"), F.coalesce("component", "rep").alias("class"), F.coalesce("far", F.lit(0.0)).alias("far")), "minhash-placed")
    mixed = materialize(placed.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.max(F.when(F.col("rep") == F.col("pivot"), F.col("class"))).alias("home")).where("least < most").select("key", "home"), "minhash-mixed")
    open_ = placed.join(mixed, "key").where("rep != pivot")
    lone = own_weight(texts.join(open_.select("rep").unionByName(open_.select(F.col("pivot").alias("rep"))).distinct(), "rep", "left_semi"))
    # beyond what it shares with the pivot, only shingles of other open texts can be common
    open_ = open_.join(lone, "rep", "left").withColumn("rest", F.col("n") - F.col("shared") - F.coalesce("lone", F.lit(0)))
    open_ = materialize(open_.where(F.col("shared") + F.col("rest") >= similarity * F.col("n") - 1e-6).drop("lone"), "minhash-open")
    x, y = open_.where("class != home").alias("x"), open_.alias("y")
    limit = 1 - similarity
    need = (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-6
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.class") != F.col("y.class")) & ((F.col("y.class") == F.col("y.home")) | (F.col("x.rep") < F.col("y.rep")))
                   & (F.abs(F.col("x.far") - F.col("y.far")) <= limit + 1e-9) & (F.least("x.shared", "y.shared") + F.least("x.rest", "y.rest") >= need))
    more = materialize(verify(cross.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), texts), "minhash-cross")
    found = links.unionByName(more.where(F.col("similarity") >= similarity).select("a", "b"))
    classes = components(found)
    of = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.col("rep").alias("rep_id"), F.coalesce("component", "rep").alias("class_id"))
    out = seen.select("doc_id", "digest").join(of, "digest").select("doc_id", "rep_id", "class_id")
    nulls = rows_in.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("rep_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(nulls)
