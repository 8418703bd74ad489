from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marquee.plans import questions as Q


def tiny_warehouse(spark, facts):
    """facts = [(genre, year, revenue)] -> minimal fact / film / date frames."""
    genres = sorted({g for g, _, _ in facts})
    film = spark.createDataFrame([(i + 1, f"F{i}", g) for i, g in enumerate(genres)],
                                 "sk_film int, bk_film string, film_genre string")
    years = sorted({y for _, y, _ in facts})
    date = spark.createDataFrame([(y * 10000 + 101, y) for y in years], "sk_date int, calendar_year int")
    fk = {g: i + 1 for i, g in enumerate(genres)}
    fact = spark.createDataFrame([(y * 10000 + 101, fk[g], Decimal(str(v))) for g, y, v in facts],
                                 "fk_date int, fk_film int, gross_revenue_per_day decimal(18,2)")
    return {"fact_daily_box_office": fact, "dim_film": film, "dim_date": date}


def test_genre_trend_golden(spark):
    w = tiny_warehouse(spark, [("A", 2022, 10), ("A", 2023, 20), ("A", 2024, 25), ("B", 2024, 7)])
    got = {r["film_genre"]: r for r in Q.genre_trend(w).collect()}
    assert got["A"]["genre_trend"] == "Growing"
    assert got["A"]["genre_projected_revenue"] == pytest.approx(33.333333, rel=1e-6)
    assert got["B"]["genre_trend"] == "Stable" and got["B"]["genre_projected_revenue"] == pytest.approx(7.0)


def test_quantile_interpolation(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    assert df.agg(F.percentile("x", 0.33)).first()[0] == pytest.approx(2.32)


def test_week_delta(spark):
    wk = spark.createDataFrame([("g", 1, 10), ("g", 2, 15), ("g", 4, 30), ("g", 5, 20)],
                               "film_genre string, week_no int, rev int")
    got = sorted((r["week_no"], r["delta"]) for r in Q.weekly_change(wk, ["film_genre"]).collect())
    assert got == [(1, None), (2, 5), (4, None), (5, -10)]
