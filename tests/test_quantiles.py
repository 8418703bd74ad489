import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.33, 0.5, 0.66, 0.999, 1.0]


def check(df, columns):
    want = df.agg(*[F.percentile(F.col(c).cast("double"), PROBS).alias(c) for c in columns]).first()
    got = Q.exact_quantiles(df, {c: PROBS for c in columns})
    for c in columns:
        assert got[c] == (want[c] or [None] * len(PROBS)), c


def test_equals_percentile(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(float(x), int(y), None if i % 3 else float(i), 7.0, None, float(z)) for i, (x, y, z) in enumerate(zip(rng.normal(size=3000), rng.integers(0, 5, 3000), np.exp(40 * rng.normal(size=3000))))]
    rows += [(1e308, 9, None, 7.0, None, 1e-300), (-1e308, -9, None, 7.0, None, -1e30)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double, e double, f double").repartition(7)
    check(df, list("abcdef"))
    monkeypatch.setattr(Q, "BUCKETS", 600)
    monkeypatch.setattr(Q, "READ", 5)
    check(df, list("abd"))


def test_one_repeated_value_and_many_distinct_ones(spark):
    check(spark.range(1_000_000).select(F.lit(3.5).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7.0).alias("y")), ["x", "y"])


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    check(spark.createDataFrame([(float(i) * i,) for i in range(n)] + [(None,)], "x double"), ["x"])
    with_nan = spark.createDataFrame([(float(i) * i,) for i in range(n)] + [(float("nan"),)], "x double")
    assert Q.exact_quantiles(with_nan, {"x": [0.5]}) == Q.exact_quantiles(with_nan.where("not isnan(x)"), {"x": [0.5]})


def test_no_global_percentile_in_the_plans(spark):
    import inspect

    from marquee.plans import ml, questions, reports

    for module in (ml, questions, reports):
        text = inspect.getsource(module)
        assert "F.percentile" not in text and "F.median" not in text
