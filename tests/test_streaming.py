import os
import tempfile

from conftest import SF001
from marquee.plans import warehouse
from marquee.streaming.incremental import FACT_KEYS, FactStore, append_batch, run_available


def test_available_now_append_is_idempotent(spark):
    fact = warehouse.load(spark, SF001)["stg_fact_daily_box_office"]
    n = fact.count()
    root = tempfile.mkdtemp(prefix="marquee-stream-")
    src, tgt, ck = (os.path.join(root, x) for x in ("src", "tgt", "ck"))
    fact.filter("fk_date < 19980101").write.parquet(os.path.join(src, "b1"))
    run_available(spark, os.path.join(src, "*"), fact.schema, tgt, ck)
    first = spark.read.parquet(tgt).count()
    # next delivery overlaps the first one (1997 again) and adds the rest
    fact.filter("fk_date >= 19970101").write.parquet(os.path.join(src, "b2"))
    run_available(spark, os.path.join(src, "*"), fact.schema, tgt, ck)
    out = spark.read.parquet(tgt)
    assert 0 < first < n
    assert out.count() == n
    assert out.dropDuplicates(FACT_KEYS).count() == n


def test_null_dates_and_redelivery(spark):
    """NULL keys equal each other; a batch that comes again adds nothing."""
    root = tempfile.mkdtemp(prefix="marquee-stream-")
    src, tgt, ck = (os.path.join(root, x) for x in ("src", "tgt", "ck"))
    rows = [(None, "a", 1), (None, "b", 2), (20200101, "a", 3), (20200101, "a", 2)]
    batch = spark.createDataFrame(rows, "fk_date int, fk_film string, gross int")
    nulls = batch.filter("fk_date is null")
    for k, part in enumerate([nulls, batch, batch, nulls]):
        part.write.parquet(os.path.join(src, f"b{k}"))
        run_available(spark, os.path.join(src, "*"), batch.schema, tgt, ck, keys=["fk_date", "fk_film"])
    got = sorted(map(tuple, spark.read.parquet(tgt).collect()), key=str)
    assert got == [(20200101, "a", 2), (None, "a", 1), (None, "b", 2)]


def test_loaded_side_is_not_moved(spark):
    fact = warehouse.load(spark, SF001)["stg_fact_daily_box_office"]
    store = FactStore(spark, os.path.join(tempfile.mkdtemp(prefix="marquee-fact-"), "f"), fact.schema, buckets=4)
    store.append(fact.filter("fk_date < 19980101"))
    fresh = store.fresh(fact.filter("fk_date >= 19970101"), "fk_date")
    lines = fresh._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, x in enumerate(lines) if "Scan parquet" in x and store.name in x)
    assert "SelectedBucketsCount" in lines[scan] or "Bucketed: true" in lines[scan]
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
        if "SortMergeJoin" in line and depth(line) <= at:
            break
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above), above
    assert "GreaterThanOrEqual(fk_date" in lines[scan]
    fresh.write.format("noop").mode("overwrite").save()


def test_replay_after_half_a_write(spark):
    rows = [(d, f, d + k) for d in range(40) for k, f in enumerate(["a", "b", None])]
    batch = spark.createDataFrame(rows, "fk_date int, fk_film string, gross int")
    path = os.path.join(tempfile.mkdtemp(prefix="marquee-fact-"), "f")
    store = FactStore(spark, path, batch.schema, ["fk_date", "fk_film"], 4)
    # the write of the batch got as far as some of its files
    store.append(batch.filter("fk_date % 3 = 0"))
    for _ in range(2):
        append_batch(batch, path, ["fk_date", "fk_film"], buckets=4)
        assert sorted(map(tuple, store.read().collect()), key=str) == sorted(rows, key=str)
    assert spark.read.parquet(path).count() == len(rows)
