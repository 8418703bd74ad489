import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from marquee.operators import enrich as EN
from marquee.plans import catalog, ml, pipeline, sheet, warehouse
from marquee.sources import lookups as LK
from marquee.sources.io import tagged_entities, write_entities


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entities_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "a", 6.0), (2, None, 6.0), (1, "a", 5.0), (None, None, None)], "bk int, t string, v double")
    spec = {"film": ["bk", "t"], "daily": ["bk", "v"]}
    parts = write_entities(df, spec, str(tmp_path / "e"))
    assert sorted(map(tuple, parts["film"].collect()), key=str) == sorted([(1, "a"), (2, None), (None, None)], key=str)
    assert sorted(map(tuple, parts["daily"].collect()), key=str) == sorted([(1, 5.0), (1, 6.0), (2, 6.0), (None, None)], key=str)
    assert parts["film"].columns == ["bk", "t"] and tagged_entities(df.limit(0), spec).count() == 0


def test_the_sheet_is_evaluated_once(spark):
    """One scan of the fact below the split, and one shuffle of its rows."""
    raw = LK.raw_sheet(warehouse.load(spark, SF001))
    text = plan(tagged_entities(raw, {k: [c for c in v if c in raw.columns] for k, v in sheet.ENTITIES.items()}))
    assert text.count("ReadSchema: struct<fk_date:int") == 1 and text.count("Generate explode") == 1
    fact = plan(catalog.QUERIES["d12_most_frequent_studio"](spark, SF001))
    assert "film_title" not in fact and "customer.parquet" not in fact


def test_chain(spark):
    root = tempfile.mkdtemp(prefix="marquee-sheet-")
    dw = sheet.run(spark, SF001, root, sheet.WAIVED)
    for folder in (sheet.SHEET_DIR, sheet.ENTITY_DIR, sheet.CACHE_DIR, pipeline.STAGING_DIR, pipeline.DW_DIR, pipeline.LOG_DIR):
        assert os.path.isdir(f"{root}/{folder}")
    raw = LK.raw_sheet(warehouse.load(spark, SF001))
    assert dw["sheet"].count() == raw.count() == dw["fact_daily_box_office"].count() == 5967
    # what the sheet had stays, what it lacked is filled
    had = {r["bk_film"]: r["film_runtime_min"] for r in raw.select("bk_film", "film_runtime_min").distinct().collect()}
    got = {r["bk_film"]: r["film_runtime_min"] for r in dw["dim_film"].collect()}
    assert all(got[b] == v for b, v in had.items() if v is not None) and sum(v is not None for v in got.values()) > sum(v is not None for v in had.values())
    # again: the cache is warm, the tables are the same
    films = sorted(map(str, dw["dim_film"].collect()))
    again = sheet.run(spark, SF001, root, sheet.WAIVED)
    assert {r["match_source"] for r in again["sheet"].select("match_source").distinct().collect()} == {"cache"}
    assert sorted(map(str, again["dim_film"].collect())) == films


def test_geography_chain(spark):
    countries = spark.createDataFrame([("Aland", "aa", "North"), ("Bland", "BB", "South")], "name string, iso2 string, continent string")
    geo = spark.createDataFrame([("One", 0, None, None, None), ("One", 1, " Town ", " aland", None), ("Two", 0, "", None, "bb"), ("Main", 0, "Mainz", None, None)], "name string, pos int, hq string, country string, iso2 string")
    chosen = spark.createDataFrame([(1, "One", None, None), (2, "Two", "Twin", None), (3, "Three", "Trent", "East"), (4, "Four", None, None)], "k int, company_name string, city string, continent string")
    rows = spark.createDataFrame([(1, None, None, "Main", "Bland"), (2, None, None, "Main", None), (3, "Known", None, "Main", "Bland"), (4, None, None, "Main", "bland "), (5, None, None, "Main", None), (6, None, "West", None, None)],
                                 "k int, city string, continent string, main_studio string, country string")
    got = {r["k"]: tuple(r)[1:] for r in EN.company_geography(rows, "k", chosen, geo, countries).collect()}
    assert got == {1: ("One", "Town", "binding", "North", "binding"),            # the code comes from the country label
                   2: ("Two", "Twin", "company", "South", "binding"), 3: ("Three", "Known", "known", "East", "company"),
                   4: ("Four", None, None, "South", "country"), 5: ("Main", "Mainz", "binding", None, None), 6: (None, None, None, "West", "known")}


def test_model_tables(spark, tmp_path):
    trend = spark.createDataFrame([("Drama", "Growing", 5.0, 1)], "film_genre string, genre_trend string, genre_projected_revenue double, extra int")
    tiers = spark.createDataFrame([("F1", "t", "Drama", "Long", "Fall", "PG", "High", 0.5)], "bk_film string, film_title string, film_genre string, runtime_segment string, release_season string, film_age_classification string, predicted_tier string, tier_confidence double")
    for _ in range(2):
        out = ml.write_outputs(spark, trend, tiers, str(tmp_path))
        assert out["ml_genre_trends"].collect() == [("Drama", "Growing", 5.0)] and out["ml_tier_predictions"].collect() == tiers.collect()
    import pytest
    with pytest.raises(Exception, match="predicted_tier is NULL"):
        ml.write_outputs(spark, trend, tiers.withColumn("predicted_tier", F.lit(None).cast("string")), str(tmp_path))


def test_entities_of_rows_are_dealt_out(spark, tmp_path, monkeypatch):
    """Rows that are mostly distinct are not gathered by the tasks that read
    them: they are dealt over tasks of a bounded number, repeats meet there."""
    from marquee.sources import io
    monkeypatch.setattr(io, "TASK_ROWS", 100)
    rows = [(i % 7, f"t{i % 7}", i % 450, i % 3) for i in range(900)] + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "bk int, t string, day int, v int").coalesce(1)
    spec = {"film": ["bk", "t"], "daily": ["bk", "day", "v"]}
    assert io.row_tasks(df, 100) == 10
    text = plan(io.dealt_entities(df, spec, 10))
    assert "REPARTITION_BY_NUM" in text and ", 10)" in text
    parts = io.write_entities(df, spec, str(tmp_path / "e"))
    for name, cols in spec.items():
        want = {tuple(r) for r in df.select(*cols).distinct().collect()}
        got = [tuple(r) for r in parts[name].collect()]
        assert len(got) == len(want) and set(got) == want and parts[name].columns == cols


def test_the_sheet_is_written_by_bounded_tasks(spark, monkeypatch):
    """Writing by year sorts the wide rows of each task."""
    from marquee.operators import match as MT
    from marquee.sources import adapter, io
    monkeypatch.setattr(io.row_tasks, "__defaults__", (500,))
    raw = LK.raw_sheet(warehouse.load(spark, SF001))
    dv = adapter.driver(spark, SF001)
    out = sheet.enrich(spark, dv, raw, MT.match_cache(spark, tempfile.mkdtemp(prefix="marquee-sheet-") + "/cache"))
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 5967 and len(sizes) > 6 and max(sizes) < 2000


def test_daily_rows_meet_their_text_in_one_join(spark, tmp_path):
    """The text of film, people and company is joined to the distinct keys of
    the facts; each daily row is sent once, narrow, and not once per record."""
    from test_load import write
    folder = write(spark, tmp_path, [(1, 1, 10.5), (1, 1, 2.0), (1, 3, 4.25), (2, 2, 8.0), (2, 5, 1.0), (9, 1, 7.0), (None, 1, 3.0)])
    for sf in (folder, SF001):
        w = warehouse.load(spark, sf)
        raw, heads = LK.raw_sheet(w), LK.sheet_heads(w)
        rows = LK.sheet_rows(heads, w, 3)
        assert sorted(rows.columns) == sorted(raw.columns)
        assert sorted(map(str, rows.select(*raw.columns).collect())) == sorted(map(str, raw.collect()))
    assert rows.count() == 5967 and heads.count() < 500
    text = plan(LK.sheet_rows(spark.createDataFrame(heads.collect(), heads.schema), w, 3))
    assert text.count("Join") == 1 and text.count("fk_date") and "customer" not in text
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 3


def test_the_chain_writes_no_raw_sheet(spark, monkeypatch):
    from marquee.operators import match as MT
    names, written = [], sheet.materialize
    monkeypatch.setattr(sheet, "materialize", lambda df, name: names.append((name, "gross_revenue_per_day" in df.columns)) or written(df, name))
    monkeypatch.setattr(MT, "match_cache", lambda *_: None)
    monkeypatch.setattr(MT, "full_match", lambda wanted, *_: (_ for _ in ()).throw(KeyError("here")))
    import pytest
    with pytest.raises(KeyError, match="here"):
        sheet.stage(spark, SF001, tempfile.mkdtemp(prefix="marquee-sheet-"))
    assert names and not any(daily for _, daily in names)


def test_release_lets_shuffle_files_go(spark):
    import time

    from marquee.session import release
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: manager.getAllFiles().size()
    spark.range(1000).repartition(50).write.format("noop").mode("overwrite").save()
    before = files()
    assert before
    release(spark)
    end = time.time() + 30
    while files() >= before and time.time() < end:
        time.sleep(0.2)
    assert files() < before
