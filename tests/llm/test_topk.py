import math
import random

import duckdb
import numpy as np
import pytest

from marquee.llm import queries
from marquee.llm import topk as K


def brute(vectors, asked, k):
    out = []
    for q, v in asked:
        hits = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("seed, pivots, block", [(1, 4, 2048), (2, 32, 7), (3, 1, 50)])
def test_equals_brute_force(spark, monkeypatch, seed, pivots, block):
    """Ties, repeated vectors, shorter vectors, small blocks and runs."""
    monkeypatch.setattr(K, "BLOCK_ROWS", block)
    monkeypatch.setattr(K, "QUERY_ROWS", 5)
    monkeypatch.setattr(K, "BLOCKS_IN_RUN", 3)
    rng = random.Random(seed)
    centres = [[rng.randrange(-60, 60) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.randrange(-4, 5) for c in rng.choice(centres)][:6 if i % 9 else 3]) for i in range(240)]
    rows += [(1000, rows[7][1]), (1000, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(4)
    got = K.top_k(df, df.where("vec_id % 20 = 0"), 7, pivots=pivots, rings=3).collect()
    asked = {i: v for i, v in rows if i % 20 == 0}
    assert sorted(map(tuple, got)) == brute(rows, asked.items(), 7)


def test_quantized_leaves_out_bad_vectors(spark):
    rows = [(1, [0.5, -0.5]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (None, [1.0, 1.0]), (6, [-0.0001, 0.9999])]
    got = {r.vec_id: r.v for r in K.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: [512, -512], 6: [-1, 1023]}


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1, 2]), (5, [3, 4])], "vec_id long, v array<long>")
    assert sorted(map(tuple, K.top_k(df, df).collect())) == [(0, 1, 5, 11), (5, 1, 0, 11)]
    assert K.top_k(df, df.limit(0)).count() == 0 and K.top_k(df.limit(0), df.limit(0)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op10_pivot_topk"]).fetchall()
    assert sorted(want) == sorted(map(tuple, queries.op10_pivot_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect()))
    assert isinstance(want[0][3], int) and np.isfinite(len(want))


def test_clashing_columns_repeated_queries_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERY_ROWS", 4)
    monkeypatch.setattr(K, "LANE_BLOCKS", 2)
    monkeypatch.setattr(K, "BLOCK_ROWS", 20)
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-9, 9) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, v array<long>, annulus int, block string, run int")
    asked = df.where("vec_id % 3 = 0")
    got = K.top_k(df, asked.unionByName(asked), 5).collect()
    assert sorted(map(tuple, got)) == brute(rows, [r for r in rows if r[0] % 3 == 0], 5)


def test_scores_that_would_not_be_exact_raise(spark):
    table = spark.createDataFrame([(0, [1e300, 1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<double>")
    vectors = K.quantized(table)
    with pytest.raises(Exception, match="2\\*\\*53|OVERFLOW|overflow"):
        K.top_k(vectors, vectors).collect()
    big = spark.createDataFrame([(0, [1 << 26, 0]), (1, [1, 1])], "vec_id long, v array<long>")
    assert sorted(map(tuple, K.top_k(big, big).collect())) == [(0, 1, 1, 1 << 26), (1, 1, 0, 1 << 26)]
    with pytest.raises(ValueError, match="exact"):
        K.top_k(big, spark.createDataFrame([(2, [1 << 27, 0])], "vec_id long, v array<long>"))
