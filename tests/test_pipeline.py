import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from marquee.operators.quality import GateError
from marquee.plans import pipeline as PL


def snapshot(dw):
    f = dw["fact_daily_box_office"]
    film = dw["dim_film"]
    return (f.count(), str(f.agg(F.sum("gross_revenue_per_day")).first()[0]),
            sorted((r["bk_film"], r["sk_film"]) for r in film.select("bk_film", "sk_film").collect()))


def test_rerun_gives_same_tables(spark):
    root = tempfile.mkdtemp(prefix="marquee-pipe-")
    a = snapshot(PL.run_all(spark, SF001, root))
    b = snapshot(PL.run_all(spark, SF001, root))
    assert a == b and a[0] == 5967
    log = spark.read.parquet(f"{root}/{PL.LOG_DIR}")
    assert log.count() == 34  # two validation runs appended


def test_gate_stops_dirty_load(spark):
    root = tempfile.mkdtemp(prefix="marquee-pipe-")
    with pytest.raises(GateError):
        PL.run_all(spark, SF001, root, dirty=True)
