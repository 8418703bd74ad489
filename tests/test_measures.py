"""Hierarchies and sums by film and day on a small star of its own."""

import datetime
import itertools
from decimal import Decimal

import pytest

from marquee.operators import measures as M


@pytest.fixture(scope="module")
def star(spark):
    dates = [(d, datetime.date(2000 + d // 4, 1 + d % 4 * 3, 1 + d), 2000 + d // 4, ["dry", "wet", None][d % 3]) for d in range(12)]
    films = [(f, Decimal(100 + f)) for f in range(7)]
    rows = [(f if f < 7 else None, d, Decimal(f * 10 + d), d) for f in range(8) for d in range(12) if (f * 5 + d) % 3]
    return M.Star({
        "dim_date": spark.createDataFrame(dates, "sk_date int, proper_date date, calendar_year int, season string"),
        "dim_film": spark.createDataFrame(films, "sk_film int, film_budget_usd decimal(18,2)"),
        "fact_daily_box_office": spark.createDataFrame(rows, "fk_film int, fk_date int, gross_revenue_per_day decimal(18,2), days_since_release int")})


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_hierarchy_counts_distinct_films_at_every_level(star):
    levels = ["calendar_year", "season"]
    df = M.revenue_hierarchy(star, levels)
    dates = {r["sk_date"]: (r["calendar_year"], r["season"]) for r in star.dims["dim_date"][0].collect()}
    want = {}
    for r, depth in itertools.product(star.fact.collect(), range(3)):
        at = dates[r["fk_date"]][:depth] + (None,) * (2 - depth)
        total, films = want.setdefault((*at, (3, 1, 0)[depth]), [0.0, set()])
        want[(*at, (3, 1, 0)[depth])][0] = total + float(r["gross_revenue_per_day"])
        films.update({r["fk_film"]} - {None})
    got = {(r["calendar_year"], r["season"], r["level_id"]): [r["total_revenue"], r["n_films"]] for r in df.collect()}
    assert got == {k: [total, len(films)] for k, (total, films) in want.items()}
    # only totals of the lowest level are expanded, not the rows of films
    assert [x for x in optimized(df) if "Expand" in x] and not any("fk_film" in x for x in optimized(df) if "Expand" in x)


def test_film_days_are_not_reduced_to_themselves(star):
    df = star.grouped(["calendar_year", "fk_film"], ["film_budget_usd"], {"rev": ("sum", M.G)})
    assert sum("Aggregate" in x for x in optimized(df)) == 1
    assert dict(df.dtypes)["rev"] == "decimal(38,2)"
    want = {}
    for r in star.fact.filter("fk_film is not null").collect():
        key = (2000 + r["fk_date"] // 4, r["fk_film"], Decimal(100 + r["fk_film"]))
        want[key] = want.get(key, 0) + r["gross_revenue_per_day"]
    assert {(r["calendar_year"], r["fk_film"], r["film_budget_usd"]): r["rev"] for r in df.collect()} == want
