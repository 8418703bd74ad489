"""DQ rules against the known counts of FIXTURES.md §2."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from marquee.operators import quality as DQ
from marquee.plans import warehouse


def counts(log):
    return {(r["id_check"], r["etl_table"], r["etl_checktype"]): (int(r["description_result"][-10:]), r["etl_result"])
            for r in log.collect()}


def test_clean_sf0001_all_ok(spark):
    log = counts(DQ.run_rules(warehouse.load(spark, SF001)))
    assert len(log) == 17
    assert all(v == (0, "OK") for v in log.values())


def test_dirty_sf0001(spark):
    log = counts(DQ.run_rules(warehouse.load(spark, SF001, dirty=True)))
    fact = "stg_fact_daily_box_office"
    assert log[(1, "stg_dim_film", DQ.CHECK_BK)] == (1, "FAIL")
    assert log[(2, "stg_dim_film", DQ.CHECK_ATTR)] == (2, "FAIL")
    assert log[(3, fact, DQ.CHECK_PK)] == (33, "FAIL")
    assert log[(4, fact, DQ.CHECK_FK.format("Actor"))] == (102, "FAIL")
    assert log[(5, fact, DQ.CHECK_REV)] == (19, "FAIL")
    assert log[(6, fact, DQ.CHECK_DAYS)] == (2385, "FAIL")
    assert log[(7, fact, DQ.CHECK_REV_DAYS)] == (918, "FAIL")
    for label in ("Date", "Film", "Production Company", "Director"):
        assert log[(4, fact, DQ.CHECK_FK.format(label))] == (0, "OK")


def test_gate_waiver_sf001(spark):
    log = DQ.run_rules(warehouse.load(spark, SF01))
    fails = log.filter(F.col("etl_result") == "FAIL").collect()
    assert [(r["id_check"], r["etl_table"]) for r in fails] == [(2, "stg_dim_film")]
    assert int(fails[0]["description_result"][-10:]) == 8
    with pytest.raises(DQ.GateError):
        DQ.gate(log)
    assert DQ.gate(log, waivers=[(2, "stg_dim_film")]) == []


def test_r2_detail_is_the_failing_rows(spark):
    t = warehouse.load(spark, SF01)
    assert DQ.r2_detail(t).count() == 8


def test_totals_match_fixture(spark):
    w = warehouse.load(spark, SF001)
    f = w["fact_daily_box_office"]
    assert f.count() == 5967
    total = f.agg(F.sum("gross_revenue_per_day")).first()[0]
    assert str(total) == "317364757.31"
    film = w["dim_film"]
    assert film.count() == 200
    assert film.agg(F.countDistinct("film_genre")).first()[0] == 104
    assert str(film.agg(F.sum("imdb_rating")).first()[0]) == "1034.3"


def test_orphans_are_looked_up_per_key(spark, tmp_path):
    """The parents meet the counted keys, not a row for every key of every
    fact row."""
    fact = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, None)], "fk_a int, fk_b int")
    t = {DQ.FACT: fact, "a": spark.createDataFrame([(1,), (1,), (None,)], "k int"), "b": spark.createDataFrame([(7,), (9,)], "k int")}
    for name, df in t.items():       # written tables, whose sizes Spark knows
        df.write.parquet(f"{tmp_path}/{name}")
    t = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in t}
    got = DQ.orphan_rows_all(t, (("A", "fk_a", "a", "k"), ("B", "fk_b", "b", "k")))
    assert {r["fk"]: r["n"] for r in got.collect()} == {"fk_a": 2, "fk_b": 2}
    kinds = [line.strip(" :+-").split()[0] for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    below = kinds[kinds.index("Join"):kinds.index("Generate")]
    assert "Aggregate" in below
