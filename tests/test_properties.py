"""Property checks of SURVEY §5.2."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF001
from marquee.functions.clean import fill_missing
from marquee.operators import enrich as EN
from marquee.operators import match as MT
from marquee.operators import measures as M
from marquee.plans import warehouse
from marquee.sources import adapter
from marquee.sources import lookups as LK


def test_rollup_leaves_sum_to_grand_total(spark):
    w = warehouse.load(spark, SF001)
    h = M.revenue_hierarchy(warehouse.star(w, ("date",)), ["calendar_year", "calendar_season", "month_number"])
    leaf = h.filter(F.col("level_id") == 0).agg(F.sum("total_revenue")).first()[0]
    grand = h.filter(F.col("level_id") == 7).select("total_revenue").first()[0]
    total = w["fact_daily_box_office"].agg(F.sum("gross_revenue_per_day")).first()[0]
    assert abs(leaf - grand) < 1e-3 and abs(grand - float(total)) < 1e-3


def test_cache_upsert_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("b", 2, 21)], "t string, y int, id int")
    new = spark.createDataFrame([("b", 2, 30), ("c", None, 40)], "t string, y int, id int")
    once = EN.cache_upsert(old, new, ["t", "y"], ["id"])
    twice = EN.cache_upsert(once, new, ["t", "y"], ["id"])
    a = sorted(map(tuple, once.collect()), key=str)
    assert a == sorted(map(tuple, twice.collect()), key=str)
    assert a == sorted([("a", 1, 10), ("b", 2, 30), ("c", None, 40)], key=str)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(max_size=3)), st.one_of(st.none(), st.text(max_size=3))),
                min_size=1, max_size=8))
def test_fill_missing_keeps_existing(spark, pairs):
    df = spark.createDataFrame(pairs, "e string, c string")
    got = [r[0] for r in df.select(fill_missing("e", "c")).collect()]
    assert got == [e if e is not None else c for e, c in pairs]


def test_match_invariant_to_partitioning(spark):
    dv = adapter.driver(spark, SF001)
    wanted, cat = LK.wanted_titles(dv), LK.catalogue(dv)
    a = {r["row_id"]: r["matched_id"] for r in MT.pick(wanted, cat, MT.V2).collect()}
    b = {r["row_id"]: r["matched_id"] for r in MT.pick(wanted.repartition(13), cat.repartition(3), MT.V2).collect()}
    assert a == b
