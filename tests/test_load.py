"""What a question makes the load write, and what it reads."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import match as MT
from marquee.plans import catalog, warehouse
from marquee.sources import adapter
from marquee.sources import lookups as LK
from marquee.sources import schemas as SC
from marquee.sources.io import tagged_entities

FACTS = (warehouse.STG_FACT, warehouse.DW_FACT)


@pytest.fixture()
def folder(spark, tmp_path):
    """Three films, one of them without a lineitem; film 2 comes twice."""
    return write(spark, tmp_path, [(1, 1, 10.5), (1, 1, 2.0), (1, 3, 4.25), (2, 2, 8.0), (2, 5, 1.0), (9, 1, 7.0), (None, 1, 3.0)])


def write(spark, tmp_path, items):
    tables = {
        "region": spark.createDataFrame([(0, "NORTH")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame([(0, "ALAND", 0), (1, "BLAND", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": spark.createDataFrame([(i, f"Supplier#{i:09d}", i % 2) for i in range(5)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": spark.createDataFrame([(i, f"Customer#{i:09d}", i % 2) for i in range(63)], "c_custkey long, c_name string, c_nationkey int"),
        "part": spark.createDataFrame([(i, f"title {i}", "Brand", "TYPE", 10 + i, 900.0 + i) for i in (1, 2, 2, 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": spark.createDataFrame([(1, None)], "o_orderkey long, o_orderdate timestamp_ntz"),
        "lineitem": spark.createDataFrame(items, "l_partkey long, day int, l_extendedprice double").select(
            F.lit(1).cast("long").alias("l_orderkey"), "l_partkey", F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), "l_extendedprice",
            F.expr("cast(make_date(1996, 1, day) as timestamp_ntz)").alias("l_shipdate")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def written(spark, folder):
    w = warehouse.load(spark, folder)
    return [t for t in FACTS if w.written(t)]


def test_a_dimension_does_not_wait_for_the_facts(spark, folder):
    films = {(r["sk_film"], r["bk_film"], r["film_release_year"]) for r in catalog.QUERIES["dim_film_sk"](spark, folder).collect()}
    assert films == {(1, "F00000001", 1996), (2, "F00000002", 1996), (3, "F00000002", 1996), (4, "F00000003", None)}
    assert written(spark, folder) == []
    days = [r["full_date"] for r in catalog.QUERIES["dim_date"](spark, folder).collect()]
    assert len(days) == 5 and written(spark, folder) == []
    fact = catalog.QUERIES["fact_sk"](spark, folder)
    assert fact.count() == 2 + 2 * 2 and written(spark, folder) == [warehouse.DW_FACT]      # film 2 comes twice, film 9 is unknown


def test_dimensions_with_keys_are_written_on_demand(spark, folder):
    """Staging is all that the chain from the sheet reads of a load."""
    w = warehouse.load(spark, folder)
    dims = [dw for dw, *_ in warehouse.DIMS]
    assert w[warehouse.STG_FACT].count() and not any(map(w.written, dims)) and all(dw in w for dw in dims)
    assert w.rows("dim_film", ["bk_film"]).count() == 4 and all(map(w.written, dims)) and w["dim_film"] is w["dim_film"]


def test_tables_of_a_load(spark, folder):
    w = warehouse.load(spark, folder)
    assert set(w) == {*warehouse.STAGING, *SC.WAREHOUSE} and len(w) == len(set(w)) and "other" not in w
    with pytest.raises(KeyError):
        w["other"]
    staged = sorted(map(str, w[warehouse.STG_FACT].collect()))
    lazy = warehouse.build(spark, folder)
    for name in w:
        assert w[name].columns == lazy[name].columns and w[name].count() == lazy[name].count(), name
    assert staged == sorted(map(str, warehouse.load_staging(adapter.staging(spark, folder))[warehouse.STG_FACT].collect()))


def test_columns_of_an_unwritten_fact(spark, folder):
    w = warehouse.load(spark, folder)
    columns = ["fk_film", "fk_date", "gross_revenue_per_day"]
    before = w.rows(warehouse.STG_FACT, columns)
    plan = before._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert sorted(map(str, before.collect())) == sorted(map(str, w[warehouse.STG_FACT].select(*columns).collect()))
    assert w.rows(warehouse.STG_FACT, ["days_since_release"]).count() == 5


def test_a_lineitem_without_a_day_stops_the_load(spark, tmp_path):
    folder = write(spark, tmp_path, [(1, 1, 10.5), (1, None, 2.0)])
    with pytest.raises(Exception, match="fk_date is NULL"):
        catalog.QUERIES["dim_film_sk"](spark, folder).collect()


def test_film_totals_before_and_after_the_fact_is_written(spark, folder):
    w = warehouse.load(spark, folder)
    before = sorted(map(tuple, warehouse.film_totals(w).collect()))
    assert written(spark, folder) == []
    assert [(f, d, float(r)) for f, d, r in before] == [(1, 19960101, 16.75), (2, 19960102, 9.0), (3, 19960102, 9.0)]
    w[warehouse.DW_FACT].count()
    assert written(spark, folder) == [warehouse.DW_FACT]
    assert sorted(map(tuple, warehouse.film_totals(w).collect())) == before
    assert sorted(map(tuple, warehouse.film_totals({warehouse.DW_FACT: w[warehouse.DW_FACT]}).collect())) == before


def test_tier_labels_write_no_fact(spark, folder):
    got = {r["bk_film"]: r["total_revenue"] for r in catalog.QUERIES["n_tier_labels"](spark, folder).collect()}
    assert got == {"F00000001": 16.75, "F00000002": 9.0, "F00000003": 0.0} and written(spark, folder) == []


def test_geography_writes_no_fact(spark, folder):
    rows = {r["movie_id"]: r["geo_company"] for r in catalog.QUERIES["c15_company_geography"](spark, folder).collect()}
    assert set(rows) == {1, 2, 9} and written(spark, folder) == []


def test_entities_without_the_sheet(spark, folder):
    w = warehouse.load(spark, folder)
    spec = {"film": ["bk_film", "film_title"], "actor": ["bk_actor", "surname_actor"], "company": ["bk_production_company", "country_production_company"],
            "daily": ["fk_date", "bk_film", "bk_actor", "bk_director", "bk_production_company", "gross_revenue_per_day", "days_since_release"]}
    want = tagged_entities(LK.raw_daily(adapter.driver(spark, folder), w), spec)
    got = LK.daily_entities(w, spec)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    few = {k: v for k, v in spec.items() if k != "daily"}
    assert sorted(map(str, LK.daily_entities(w, few).collect())) == sorted(map(str, tagged_entities(LK.raw_daily(adapter.driver(spark, folder), w), few).collect()))
    # the text of the records is joined to the keys of the facts, not to the facts
    plan = LK.daily_entities(w, spec)._jdf.queryExecution().executedPlan().toString()
    assert "customer" not in plan and "film_age" not in plan


def test_first_days_need_no_daily_sums(spark, folder):
    dv = adapter.driver(spark, folder)
    plan = adapter.part_days(dv)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and plan.count("Exchange") == 1
    got = {r[0]: tuple(map(str, r[1:])) for r in adapter.part_days(dv).collect()}
    assert got == {1: ("1996-01-01", "1996-01-03", "0"), 2: ("1996-01-02", "1996-01-05", "0"), 9: ("1996-01-01", "1996-01-01", "0"), None: ("1996-01-01", "1996-01-01", "0")}
    assert sorted(map(str, adapter.shared_first(dv).collect())) == sorted(map(str, adapter.first_day(adapter.daily_revenue(dv)).collect()))


def test_match_inputs_are_dealt_out(spark, folder):
    """One file of films, but as many tasks as Spark has for its titles."""
    dv = adapter.driver(spark, folder)
    for df in (LK.catalogue(dv), LK.wanted_titles(dv), LK.movie_details(dv)):
        assert "hashpartitioning(p_partkey" in df._jdf.queryExecution().executedPlan().toString()
    assert MT.prepare_catalogue(LK.catalogue(dv)).count() == 4
