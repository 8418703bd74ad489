from pyspark.sql import functions as F

from conftest import SF001
from marquee.plans import ml as ML
from marquee.plans import warehouse


def test_folds_are_stratified(spark):
    w = warehouse.load(spark, SF001)
    f = ML.tier_labels(ML.tier_features(w)).filter(F.col("tier").isNotNull())
    folds = ML.stratified_folds(f)
    sizes = {}
    for r in folds.groupBy("tier", "fold").count().collect():
        sizes.setdefault(r["tier"], []).append(r["count"])
    for v in sizes.values():
        assert len(v) == ML.FOLDS and max(v) - min(v) <= 1
    shares = {k: sum(v) for k, v in sizes.items()}
    total = sum(shares.values())
    assert all(0.30 <= s / total <= 0.36 for s in shares.values())


def test_small_run_end_to_end(spark):
    w = warehouse.load(spark, SF001)
    small = (ML.Candidate("RF", "rf", dict(numTrees=10, maxDepth=4, minInstancesPerNode=3)),)
    r = ML.run(w, small, k=3)
    assert r.winner.name == "RF"
    pred = r.predictions
    assert pred.count() == w["dim_film"].select("bk_film").distinct().count()
    assert pred.filter(~F.col("predicted_tier").isin("Low", "Mid", "High")).count() == 0
    lo, hi = pred.agg(F.min("tier_confidence"), F.max("tier_confidence")).first()
    assert 0 < lo <= hi <= 1
    assert r.cv.count() == 3


def test_tier_labels_are_terciles(spark):
    w = warehouse.load(spark, SF001)
    f = ML.tier_labels(ML.tier_features(w))
    stats = {r["tier"]: (r["n"], r["m"]) for r in
             f.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg("total_revenue").alias("m")).collect()}
    n = sum(v[0] for k, v in stats.items() if k is not None)
    assert all(0.30 <= stats[t][0] / n <= 0.37 for t in ML.TIERS)
    assert stats["High"][1] > stats["Mid"][1] > stats["Low"][1]
    assert f.filter(F.col("tier").isNull() & (F.col("total_revenue") > 0)).count() == 0
