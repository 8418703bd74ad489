"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; the rings
of a pivot are its annuli.  For a query q, an annulus of pivot p with
distances [near, far] and squared norms up to m, the triangle inequality
gives |q - x| >= gap, the distance from |q - p| to [near, far], and with
2 <q, x> = |q|^2 + |x|^2 - |q - x|^2 the bound (|q|^2 + m - gap^2) / 2.  Each
query first searches the annulus with its best bound; its k-th score there is
where the search proper begins.  That takes annuli by falling bound, and ends
for a query when its k-th score exceeds the next bound.

Pivots and ring edges come from a bounded sample and only steer the work:
every vector is indexed, and results are exact for any pivots.  The directory
of annuli has at most PIVOTS * RINGS entries whatever the size of the table.

Queries and vectors travel in blocks of bounded size.  A task holds a run of
vector blocks, of annuli next to each other, and the blocks of queries that
want them pass by: each vector is sent once for every LANE_BLOCKS query blocks
(a million queries), and each query once for every run that can hold one of
its best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import materialize

PIVOTS, RINGS = 32, 8
SAMPLE_ROWS = 8192               # vectors, the first by a hash of their id, from which pivots and edges are taken
BLOCK_ROWS, QUERY_ROWS = 2048, 1024
BLOCKS_IN_RUN = 64               # vector blocks that a task holds, at most
LANE_BLOCKS = 1024               # query blocks that pass by one copy of a run
EXACT = 1 << 53                  # whole numbers up to here are exact as doubles
SCALE = 1024


def quantized(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component.  Vectors that are
    null or hold a null or non-finite component, and null ids, are left out;
    an empty vector stays, repeated rows stay, other columns are not read, an
    empty table gives no rows."""
    x = F.col("e")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    got = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    return got.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T, 0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Centres of the sample: farthest points, then a few means."""
    if not len(sample):
        return sample
    picked = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(picked) < min(n, len(sample)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[picked[-1:]])[:, 0])
    pivots = sample[picked]
    for _ in range(rounds):
        of = _distances(sample, pivots).argmin(axis=1)
        pivots = np.stack([sample[of == k].mean(axis=0) if (of == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots


class Best:
    """The best k (score, id) of each query of a block, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()   # scores below cannot be among the best
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.vec = np.zeros(0, dtype=np.int64)

    def offer(self, who: np.ndarray, scores: np.ndarray, vecs: np.ndarray) -> None:
        """scores: a row for each of the queries ``who``, a column per vector."""
        r, c = np.nonzero((scores >= self.floor[who][:, None]) & (vecs[None, :] != self.ids[who][:, None]))
        query, score, vec = np.concatenate([self.query, who[r]]), np.concatenate([self.score, scores[r, c]]), np.concatenate([self.vec, vecs[c]])
        order = np.lexsort((vec, -score, query))
        query, score, vec = query[order], score[order], vec[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.score, self.vec = query[keep], score[keep], vec[keep]
        count = np.bincount(self.query, minlength=len(self.ids))
        full = np.flatnonzero(count >= self.k)
        self.floor[full] = np.maximum(self.floor[full], self.score[np.searchsorted(self.query, full, side="right") - 1])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.vec), pa.array(self.score.astype(np.int64))], names=["query_id", "vec_id", "score"])


_HITS = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, rings: int = RINGS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every
    query with all vectors but those of its own id, ties to the smaller id.

    ``vectors`` and ``queries`` are (vec_id, v array<bigint>) without nulls.
    Several query rows of one id count as one, the least; repeated vectors
    are candidates each.  Shorter vectors are filled up with zeros.  Vectors
    whose squared length passes 2**53, where scores would no longer be exact,
    raise ``ValueError``.  An empty table or no queries give no rows; other
    columns are not read."""
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow().column("v").combine_chunks()
    points = _matrix(sample, width)
    centres = choose_pivots(points, pivots)
    far = _distances(points, centres)
    of = far.argmin(axis=1)
    edges = np.stack([np.quantile(far[of == p, p], np.arange(1, rings) / rings) if (of == p).any() else np.full(rings - 1, np.inf) for p in range(len(centres))])

    def keyed(batches) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            x = _matrix(batch.column(1), width)
            d = _distances(x, centres)
            p = d.argmin(axis=1)
            own = d[np.arange(len(x)), p]
            ring = (own[:, None] > edges[p]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((p * rings + ring).astype(np.int32)), pa.array(own), pa.array((x * x).sum(axis=1)), pa.array(np.arange(seen, seen + len(x)))], names=["vec_id", "v", "annulus", "far", "norm", "nth"])
            seen += len(x)

    index = materialize(vectors.select("vec_id", "v").mapInArrow(keyed, "vec_id long, v array<long>, annulus int, far double, norm double, nth long"), "topk-index")
    directory = index.groupBy("annulus").agg(F.min("far"), F.max("far"), F.max("norm"), F.count(F.lit(1))).orderBy("annulus").collect()   # at most pivots * rings rows
    annuli, near_, far_, norm_, count_ = (np.array(c) for c in zip(*map(tuple, directory)))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries, longest = asked.select(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double")))).first()
    if max(norm_.max(), longest or 0) > EXACT:
        raise ValueError("squared lengths beyond 2**53: scores would not be exact")
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = F.element_at(F.create_map(*[F.lit(int(y)) for a, c in zip(annuli, count_) for y in (a, -(-c // BLOCK_ROWS))]), F.col("annulus"))
    slack = 1e-6 * (1 + norm_.max())             # the bounds are floating point

    def bounds(q: np.ndarray) -> np.ndarray:
        d = _distances(q, centres)[:, annuli // rings]
        gap = np.maximum(np.maximum(d - far_, near_ - d), 0)
        return ((q * q).sum(axis=1)[:, None] + norm_ - gap * gap) / 2 + slack

    def blocked(key: list, table: pa.Table) -> pa.Table:
        x = _matrix(table.column("v").combine_chunks(), width)
        data = x.astype(kept)
        ids = table.column("vec_id").to_numpy()
        return pa.table({"block": pa.array([key[-1].as_py()], pa.int64()), "annulus": pa.array([int(table.column("annulus")[0].as_py())], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    kept = np.int32 if max(norm_.max(), longest or 0) < float(1 << 62) and math.sqrt(max(norm_.max(), longest or 0)) < (1 << 31) - 1 else np.int64
    packed = "block long, annulus int, ids binary, data binary"
    # blocks are numbered through the annuli, so runs of them hold few
    sizes = -(-count_ // BLOCK_ROWS)
    first_block = np.cumsum(sizes) - sizes
    n_blocks = int(sizes.sum())
    in_run = max(1, min(BLOCKS_IN_RUN, n_blocks // (2 * spark.sparkContext.defaultParallelism)))
    runs = -(-n_blocks // in_run)
    begins = F.element_at(F.create_map(*[F.lit(int(y)) for a, b in zip(annuli, first_block) for y in (a, b)]), F.col("annulus"))
    block = begins.cast("long") + F.pmod(F.xxhash64("vec_id", "v", "nth"), parts)
    blocks = materialize(index.withColumn("block", block).select("block", "vec_id", "v", "annulus").groupBy("block").applyInArrow(blocked, packed), "topk-blocks")
    n_heads = -(-n_queries // QUERY_ROWS)
    batch = F.pmod(F.xxhash64("vec_id"), F.lit(n_heads))
    query_blocks = materialize(asked.select(batch.alias("block"), "vec_id", "v", F.lit(0).alias("annulus")).groupBy("block").applyInArrow(blocked, packed).select(F.col("block").alias("queries"), "ids", "data"), "topk-queries")

    def unpack(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, dtype=np.int64), np.frombuffer(data, dtype=kept).reshape(-1, width).astype(np.float64)

    def runs_of(wanted: np.ndarray) -> list[int]:
        """Runs with blocks of the annuli at these places."""
        return sorted({r for i in wanted.tolist() for r in range(int(first_block[i]) // in_run, int(first_block[i] + sizes[i] - 1) // in_run + 1)})

    def homes(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                home = np.unique(bounds(unpack(ids, data)[1]).argmax(axis=1))
                first = sorted({int(first_block[i]) // in_run for i in home.tolist()})       # where the best annulus begins: enough for a floor
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(first), pa.int64()), pa.array(first, pa.int32())], names=["queries", "run"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = -(-n_heads // LANE_BLOCKS)
    column_of = {int(a): i for i, a in enumerate(annuli)}

    def search(pairs: DataFrame, heads: DataFrame, only_home: bool) -> DataFrame:
        """Best of every query over the blocks of the runs it is paired with;
        heads are the query blocks, with the floors of their scores."""
        run = F.floor(F.col("block") / in_run).cast("int")
        held = blocks.select(run.alias("run"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "annulus", "ids", "data", F.lit(None).cast("binary").alias("floors"))
        lane = F.pmod(F.col("queries"), F.lit(lanes)).cast("int")
        passing = pairs.join(heads, "queries").select("run", lane.alias("lane"), F.lit(1 << 30).alias("annulus"), "ids", "data", "floors")
        rows = held.unionByName(passing).repartition(min(n, runs * lanes), "run", "lane").sortWithinPartitions("run", "lane", "annulus")

        def expand(batches) -> Iterator[pa.RecordBatch]:
            at, here = None, []
            for batch in batches:
                for *place, annulus, ids, data, floors in zip(*(batch.column(c).to_pylist() for c in ("run", "lane", "annulus", "ids", "data", "floors"))):
                    if place != at:
                        at, here = place, []
                    if annulus < 1 << 30:
                        here.append((column_of[annulus], *unpack(ids, data)))
                        continue
                    own, q = unpack(ids, data)
                    limit = bounds(q)
                    best, home = Best(own, k, None if floors is None else np.frombuffer(floors, dtype=np.float64)), limit.argmax(axis=1)
                    for column, vecs, x in sorted(here, key=lambda b: -limit[:, b[0]].max()):
                        who = np.flatnonzero(home == column if only_home else limit[:, column] >= best.floor)
                        if len(who):
                            best.offer(who, q[who] @ x.T, vecs)
                    yield best.rows()

        return rows.mapInArrow(expand, _HITS)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    open_heads = query_blocks.withColumn("floors", F.lit(None).cast("binary"))
    seeds = search(query_blocks.mapInArrow(homes, "queries long, run int"), open_heads, True)
    floors = materialize(seeds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k), "topk-floors")
    floors_of = floors.withColumn("queries", F.pmod(F.xxhash64("query_id"), F.lit(n_heads))).groupBy("queries").agg(F.collect_list(F.struct("query_id", "floor")).alias("known"))

    def widen(batches) -> Iterator[pa.RecordBatch]:
        """Query blocks with an array of floors."""
        for batch in batches:
            out = []
            for ids, known in zip(batch.column("ids").to_pylist(), batch.column("known").to_pylist()):
                floor = {x["query_id"]: x["floor"] for x in known or ()}
                out.append(np.array([floor.get(i, -np.inf) for i in np.frombuffer(ids, dtype=np.int64).tolist()], dtype=np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("queries"), batch.column("ids"), batch.column("data"), pa.array(out, pa.binary())], names=["queries", "ids", "data", "floors"])

    heads = materialize(query_blocks.join(floors_of, "queries", "left").mapInArrow(widen, "queries long, ids binary, data binary, floors binary"), "topk-heads")

    def wanted(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, data, floors in zip(*(c.to_pylist() for c in batch.columns)):
                limit = bounds(unpack(ids, data)[1])
                here = runs_of(np.flatnonzero((limit >= np.frombuffer(floors, dtype=np.float64)[:, None]).any(axis=0)))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(here), pa.int64()), pa.array(here, pa.int32())], names=["queries", "run"])

    hits = search(heads.mapInArrow(wanted, "queries long, run int"), heads, False)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
