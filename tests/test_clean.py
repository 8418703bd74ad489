"""Golden vectors of FIXTURES.md §3 for the scalar cleaners."""

import pytest
from pyspark.sql import functions as F

from marquee.functions import clean as C


def one(spark, expr, *vals, schema="a string"):
    df = spark.createDataFrame([tuple(vals)], schema)
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("text,out", [
    ("  The Dune: Part Two (2024) ", "the dune part two"),
    ("Amélie (2001)", "am lie"),
    ("WALL·E", "wall e"),
    ("M3GAN!", "m3gan"),
    ("2012 (2009) Director's Cut", "2012 2009 director s cut"),
    (None, ""),
])
def test_norm_title(spark, text, out):
    assert one(spark, C.norm_title("a"), text) == out


def test_norm_title_variants(spark):
    assert one(spark, C.norm_title("a", "keep_edges"), "M3GAN!") == "m3gan "
    assert one(spark, C.norm_title("a", "year_anywhere"), "2012 (2009) Director's Cut") == "2012 director s cut"


@pytest.mark.parametrize("text,out", [("120 min", 120), ("N/A", None), ("2 h", None), ("1,020 min", None)])
def test_minutes(spark, text, out):
    assert one(spark, C.minutes("a"), text) == out


@pytest.mark.parametrize("text,out", [("English, French, ", 2), (None, None), ("", None)])
def test_token_count(spark, text, out):
    assert one(spark, C.token_count("a"), text) == out


@pytest.mark.parametrize("text,out", [("$1,234,567", 1234567), ("N/A", None), ("$12.5M", None)])
def test_money(spark, text, out):
    assert one(spark, C.money("a"), text) == out


@pytest.mark.parametrize("text,out", [("Burbank, California", "Burbank"), ("Tokyo", "Tokyo"), ("", None)])
def test_city(spark, text, out):
    assert one(spark, C.first_part("a"), text) == out


@pytest.mark.parametrize("text,out", [("New York City, New York, USA", "USA"), (" , ", None)])
def test_nationality(spark, text, out):
    assert one(spark, C.last_part("a"), text) == out


@pytest.mark.parametrize("text,out", [("+1923-04-04T00:00:00Z", 1923), (None, None)])
def test_inception(spark, text, out):
    assert one(spark, C.inception_year("a"), text) == out


@pytest.mark.parametrize("text,out", [("2021-09-15", 2021), ("21", None), ("", None)])
def test_prefix_year(spark, text, out):
    assert one(spark, C.prefix_year("a"), text) == out


@pytest.mark.parametrize("e,c,out", [
    (None, "1970-05-01", "1970-05-01"), ("1970", "1970-05-01", "1970-05-01"), ("1971", "1970-05-01", "1971"),
    ("1970-05-01", "1970", "1970-05-01"), ("1970-05-01", "1970-06-02", "1970-05-01"), ("1970", "bad", "1970"),
    ("", "bad", "bad"),
])
def test_better_date(spark, e, c, out):
    assert one(spark, C.better_date("a", "b"), e, c, schema="a string, b string") == out


@pytest.mark.parametrize("mins,out", [(None, "Unknown"), (89, "Short"), (90, "Standard"), (120, "Standard"),
                                      (121, "Long")])
def test_runtime_segment(spark, mins, out):
    assert one(spark, C.runtime_segment("a"), mins, schema="a int") == out


def test_date_key_and_dimension(spark):
    from marquee.functions.dates import dim_date
    r = dim_date(spark, "2024-12-25", "2024-12-25").first()
    assert r["sk_date"] == 20241225 and r["weekday_name"] == "Wednesday" and r["weekday_number"] == 3
    assert r["is_holiday"] and r["holiday_name"] == "Christmas Day" and r["calendar_season"] == "Winter"
    assert r["full_date"] == "Wednesday, December 25, 2024"


def test_awards(spark):
    s = C.award_counts("a")
    r = one(spark, s, "Won 2 Oscars. 10 wins & 5 nominations total")
    assert tuple(r) == (10, 5, 2, 0)
    r = one(spark, s, "Nominated for 1 Oscar. 3 wins & 8 nominations total")
    assert tuple(r) == (3, 8, 0, 1)
    assert tuple(one(spark, s, "N/A")) == (None, None, None, None)


def test_genre_blend_and_tokens(spark):
    assert one(spark, C.genre_blend("a"), "Animation, Adventure, Comedy") == "AnimationAdventureComedy"
    assert one(spark, C.nth_token("a", 1), "USA , France") == "France"
    assert one(spark, C.nth_token("a", 2), "USA , France") is None
    assert float(one(spark, C.percent("a"), "85%")) == 85.0


def test_split_name(spark):
    r = one(spark, C.split_name("a"), "  Ana   Maria Lopez ")
    assert (r["first_name"], r["surname"]) == ("Ana", "Maria Lopez")
    r = one(spark, C.split_name("a"), "Zendaya")
    assert (r["first_name"], r["surname"]) == ("Zendaya", None)


def test_row_year(spark):
    df = spark.createDataFrame([("2023", None), ("2023.0", "2021-05-01"), (None, "5/1/2023"), ("x", "junk")],
                               "y string, d string")
    got = [r[0] for r in df.select(C.row_year("y", "d")).collect()]
    assert got == [2023, 2021, 2023, None]


def test_dq_message(spark):
    assert one(spark, C.dq_message("n: ", F.lit(7)), "x") == "n:          7"
