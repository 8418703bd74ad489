import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions import clean as C
from marquee.sources import io
from marquee.sources.schemas import STG_DIM_ACTOR


def test_read_csv_typed(spark):
    d = tempfile.mkdtemp(prefix="marquee-csv-")
    path = os.path.join(d, "a.csv")
    with open(path, "w") as fh:
        fh.write("bk_actor,first_name_actor,surname_actor,nationality_actor,age_actor\nA1,Ann,Lee,X,41\nA2,Bo,,Y,n/a\n")
    df = io.read_csv(spark, path, STG_DIM_ACTOR)
    rows = sorted(map(tuple, df.collect()))
    assert rows == [("A1", "Ann", "Lee", "X", 41), ("A2", "Bo", None, "Y", None)]


def test_require_ensure_first_present(spark):
    df = spark.createDataFrame([("t", "S")], "Title string, Distributor string")
    with pytest.raises(io.SchemaError):
        io.require_columns(df, ["Title", "Date"])
    assert io.first_present(df, ["Studio", "distributor"]) == "Distributor"
    assert io.first_present(df, ["Studio"]) is None
    out = io.ensure_columns(df, T.StructType([T.StructField("Year", T.IntegerType())]))
    assert out.schema["Year"].dataType == T.IntegerType() and out.first()["Year"] is None


def test_conform_varchar_limits(spark):
    schema = T.StructType([T.StructField("etl_result", T.StringType())])
    df = spark.createDataFrame([("OK",), ("x" * 11,)], "etl_result string")
    with pytest.raises(Exception):
        io.conform(df, schema).collect()
    assert [r[0] for r in io.conform(df.limit(1), schema).collect()] == ["OK"]


def test_conform_not_null_and_name_limits(spark):
    from marquee.sources.schemas import STG_DIM_ACTOR

    layout = "bk_actor string, first_name_actor string, surname_actor string, nationality_actor string, age_actor int"
    good = [("A1", "Ann", None, None, None)]
    assert io.conform(spark.createDataFrame(good, layout), STG_DIM_ACTOR).count() == 1
    for bad in ((None, "Ann", None, None, 3), ("A1", "x" * 101, None, None, 3)):
        with pytest.raises(Exception, match="is NULL|longer than"):
            io.conform(spark.createDataFrame([bad], layout), STG_DIM_ACTOR).collect()


def test_split_entities(spark):
    df = spark.createDataFrame([("F1", "A", 1), ("F1", "A", 2), ("F2", "B", 3)], "bk string, t string, v int")
    parts = io.split_entities(df, {"film": ["bk", "t"], "daily": ["bk", "v"]})
    assert parts["film"].count() == 2 and parts["daily"].count() == 3


def test_small_cleaners(spark):
    df = spark.createDataFrame([("/p.jpg", " N/A ", "12.5", None)], "p string, ph string, n string, g string")
    r = df.select(C.poster_url("p", "https://img/x").alias("u"), C.poster_url(F.lit(None).cast("string"), "b")
                  .alias("u0"), C.placeholder_null("ph").alias("ph"), C.to_number("n").alias("n"),
                  C.or_unknown("g").alias("g"), C.clamp_zero(F.lit(-3)).alias("z"),
                  C.safe_ratio(F.lit(1), F.lit(0)).alias("r"),
                  C.business_key(F.lit(" The  Film "), F.lit(None)).alias("bk"),
                  C.claim_year(F.lit('{"P571":[{"mainsnak":{"datavalue":{"value":{"time":"+1923-04-04T00:00:00Z"}}}}]}'))
                  .alias("cy")).first()
    assert r["u"] == "https://img/x/p.jpg" and r["u0"] is None and r["ph"] is None and r["n"] == 12.5
    assert r["g"] == "Unknown" and r["z"] == 0.0 and r["r"] is None and r["bk"] == "the film|" and r["cy"] == 1923


def test_stage_tables_can_be_dropped(spark, monkeypatch):
    import os

    from marquee import session

    # other results of the test session stay: the folder is one of its own
    root = session._tables(spark) + "-dropped"
    monkeypatch.setattr(session, "_tables", lambda _: root)
    kept = session.materialize(spark.range(3), "t")
    assert kept.count() == 3 and os.path.isdir(root.replace("file:", ""))
    assert session.drop_tables(spark) and not os.path.isdir(root.replace("file:", ""))
    assert not session.drop_tables(spark)


def test_stamp_sees_changed_files(spark, tmp_path):
    from marquee.sources import adapter

    spark.range(2).write.parquet(str(tmp_path / "part.parquet"))
    first = adapter._stamp(spark, str(tmp_path))
    assert first == adapter._stamp(spark, str(tmp_path))
    spark.range(2).write.mode("append").parquet(str(tmp_path / "part.parquet"))
    assert first != adapter._stamp(spark, str(tmp_path))
