"""Business questions BQ1-BQ13 and the genre trend forecast BQP1.

The reference ships only the one-line questions; every definition below is
a [decision] written identically in the oracle SQL.  Conventions:

* ``rev`` = SUM(gross_revenue_per_day), summed as decimal, cast to double
  only on output (exact and order-independent);
* averages are ``sum / count`` of exact sums, so every engine rounds once;
* film attributes are averaged over distinct films, never over fact rows.

Scale pattern used throughout: aggregate the fact to the grain the question
needs (film, film x date-attribute, ...) with partial aggregation, *then*
join the dimensions, which by then are small; skewed films are summed
map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.clean import bracket, clamp_zero
from marquee.operators.measures import Star, weekly_revenue
from marquee.operators.quantiles import exact_quantiles
from marquee.plans.warehouse import star
from marquee.session import materialize

# --- fixed values [decision]: brackets (upper bound exclusive, label) -----
RUNTIME_BRACKETS = ((90, "Under 90"), (121, "90-120"))
RUNTIME_TOP = "Over 120"
IMDB_BRACKETS = ((5, "Below 5"), (7, "5-6.9"), (8, "7-7.9"))
IMDB_TOP = "8+"
RT_BRACKETS = ((40, "Below 40"), (60, "40-59"), (80, "60-79"))
RT_TOP = "80+"
TOP_FILMS = 50
TOP_RATED = 5
TREND_THRESHOLD = 0.05
WEEK_ORIGIN = "1970-01-05"  # a Monday: week_no = floor(days since / 7)


def scalar(one_row: DataFrame):
    """Value of a one-row global aggregate (a single number to the driver)."""
    row = one_row.first()
    return None if row is None else row[0]


def dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(num, den) -> Column:
    """sum / count as a single double division (NULL on an empty group)."""
    return F.try_divide(dbl(num), dbl(den))


def film_revenue(w: dict[str, DataFrame], extra_keys=()) -> DataFrame:
    """Fact summed to film grain (plus optional FK keys)."""
    return (w["fact_daily_box_office"].groupBy("fk_film", *extra_keys)
            .agg(F.sum("gross_revenue_per_day").alias("rev"), F.count(F.lit(1)).alias("n_days")))


def films_with_revenue(w: dict[str, DataFrame], extra_keys=()) -> DataFrame:
    fr = film_revenue(w, extra_keys)
    film = w["dim_film"]
    return fr.join(film, fr["fk_film"] == film["sk_film"])


def top_films(w: dict[str, DataFrame], n: int = TOP_FILMS) -> DataFrame:
    """Top-n films by revenue, ties by surrogate key (a top-k report: the
    limit is the feature; Spark plans TakeOrderedAndProject)."""
    return films_with_revenue(w).orderBy(F.desc("rev"), F.asc("sk_film")).limit(n)


# ---------------------------------------------------------------- BQ1
def bq1(w: dict[str, DataFrame], n: int = TOP_FILMS) -> DataFrame:
    """Actors in the top-n grossing films: films and revenue per actor."""
    top = top_films(w, n).select("sk_film")
    fa = film_revenue(w, ["fk_actor"])
    j = fa.join(top, fa["fk_film"] == top["sk_film"])
    per_actor = j.groupBy("fk_actor").agg(F.countDistinct("fk_film").alias("n_top_films"),
                                          F.sum("rev").alias("rev"))
    actor = w["dim_actor"]
    return per_actor.join(actor, per_actor["fk_actor"] == actor["sk_actor"]).select(
        "bk_actor", "first_name_actor", "surname_actor", "n_top_films",
        dbl("rev").alias("top_films_revenue"))


# ---------------------------------------------------------------- BQ2
def awarded(c="film_awards_won") -> Column:
    return F.when(F.col(c) > 0, F.lit("Yes")).otherwise(F.lit("No"))


def _film_stats(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_films"),
            ratio(F.sum("rev"), F.count(F.lit(1))).alias("avg_film_revenue"),
            ratio(F.sum("imdb_rating"), F.count("imdb_rating")).alias("avg_imdb_rating"),
            ratio(F.sum("rt_rating"), F.count("rt_rating")).alias("avg_rt_rating")]


def bq2(w: dict[str, DataFrame]) -> DataFrame:
    """Awarded (awards_won > 0) vs not: films, average film revenue, ratings."""
    f = films_with_revenue(w).withColumn("awarded", awarded())
    return f.groupBy("awarded").agg(*_film_stats(f))


def bq2_genre(w: dict[str, DataFrame]) -> DataFrame:
    """BQ2 second output: the same split per genre."""
    f = films_with_revenue(w).filter(F.col("film_genre").isNotNull()).withColumn("awarded", awarded())
    return f.groupBy("film_genre", "awarded").agg(
        F.count(F.lit(1)).alias("n_films"),
        ratio(F.sum("rev"), F.count(F.lit(1))).alias("avg_film_revenue"))


# ---------------------------------------------------------------- BQ3
def runtime_bracket(c="film_runtime_min") -> Column:
    return bracket(F.col(c), RUNTIME_BRACKETS, RUNTIME_TOP)


def bq3(w: dict[str, DataFrame]) -> DataFrame:
    """Runtime segments: average film revenue, average daily revenue, IMDb."""
    f = films_with_revenue(w).withColumn("runtime_bracket", runtime_bracket())
    return f.groupBy("runtime_bracket").agg(
        F.count(F.lit(1)).alias("n_films"),
        ratio(F.sum("rev"), F.count(F.lit(1))).alias("avg_film_revenue"),
        ratio(F.sum("rev"), F.sum("n_days")).alias("avg_daily_revenue"),
        ratio(F.sum("imdb_rating"), F.count("imdb_rating")).alias("avg_imdb_rating"))


# ---------------------------------------------------------------- BQ4
def weekly_change(weekly: DataFrame, keys: list[str], week: str = "week_no",
                  value: str = "rev") -> DataFrame:
    """Value minus the value of the previous calendar week of the same
    group; NULL when that week has no row.  Written as an equi-join on
    (keys, week - 1) instead of a window so skewed groups split under AQE."""
    prev = weekly.select(*keys, (F.col(week) + 1).alias(week), F.col(value).alias("_prev"))
    j = weekly.join(prev, [*keys, week], "left")
    return j.select(*keys, week, value, (F.col(value) - F.col("_prev")).alias("delta"))


def genre_weekly(w: dict[str, DataFrame]) -> DataFrame:
    return weekly_revenue(Star(w), ["film_genre"]).filter(F.col("film_genre").isNotNull())


def bq4(w: dict[str, DataFrame]) -> DataFrame:
    """Genres by average week-over-week revenue change, largest first."""
    ch = weekly_change(genre_weekly(w), ["film_genre"])
    return ch.groupBy("film_genre").agg(
        ratio(F.sum("delta"), F.count("delta")).alias("avg_weekly_change"),
        F.count("delta").alias("n_changes")).orderBy(F.abs("avg_weekly_change").desc(), "film_genre")


# ---------------------------------------------------------------- BQ5
def bq5(w: dict[str, DataFrame]) -> DataFrame:
    """Filming country vs production-company country."""
    fr = film_revenue(w, ["fk_production_company"])
    film, comp = w["dim_film"], w["dim_production_company"]
    j = (fr.join(film, fr["fk_film"] == film["sk_film"])
         .join(comp, fr["fk_production_company"] == comp["sk_production_company"]))
    g = j.groupBy("main_filming_country", "country_production_company").agg(
        F.countDistinct("fk_film").alias("n_films"), dbl(F.sum("rev")).alias("total_revenue"))
    return g.withColumn("same_country",
                        F.col("main_filming_country") == F.col("country_production_company"))


# ---------------------------------------------------------------- BQ6
def bq6(w: dict[str, DataFrame]) -> DataFrame:
    """Per director: average film revenue, runtime and ratings."""
    f = films_with_revenue(w, ["fk_director"])
    per = f.groupBy("fk_director").agg(
        F.count(F.lit(1)).alias("n_films"),
        ratio(F.sum("rev"), F.count(F.lit(1))).alias("avg_film_revenue"),
        ratio(F.sum("film_runtime_min"), F.count("film_runtime_min")).alias("avg_runtime_min"),
        ratio(F.sum("imdb_rating"), F.count("imdb_rating")).alias("avg_imdb_rating"),
        ratio(F.sum("rt_rating"), F.count("rt_rating")).alias("avg_rt_rating"))
    d = w["dim_director"]
    return per.join(d, per["fk_director"] == d["sk_director"]).select(
        "bk_director", "first_name_director", "surname_director", "n_films",
        "avg_film_revenue", "avg_runtime_min", "avg_imdb_rating", "avg_rt_rating")


# ---------------------------------------------------------------- BQ7
def best_of(df: DataFrame, keys: list[str], label: str, value: str = "rev") -> Column:
    """Label with the largest value in the group, ties -> smallest label."""
    return F.min_by(F.col(label), F.struct(-F.col(value), F.col(label)))


def bq7(w: dict[str, DataFrame]) -> DataFrame:
    """Per genre: revenue, films, average IMDb and runtime, best season."""
    f, d = w["fact_daily_box_office"], w["dim_date"]
    fs = (f.join(d.select("sk_date", "calendar_season"), f["fk_date"] == d["sk_date"])
          .groupBy("fk_film", "calendar_season").agg(F.sum("gross_revenue_per_day").alias("rev")))
    film = w["dim_film"].filter(F.col("film_genre").isNotNull())
    gs = (fs.join(film.select("sk_film", "film_genre"), fs["fk_film"] == film["sk_film"])
          .groupBy("film_genre", "calendar_season").agg(F.sum("rev").alias("rev")))
    genre = gs.groupBy("film_genre").agg(
        dbl(F.sum("rev")).alias("total_revenue"),
        best_of(gs, ["film_genre"], "calendar_season").alias("best_season"),
        dbl(F.max("rev")).alias("best_season_revenue"))
    fr = films_with_revenue(w).filter(F.col("film_genre").isNotNull())
    films = fr.groupBy("film_genre").agg(
        F.count(F.lit(1)).alias("n_films"),
        ratio(F.sum("imdb_rating"), F.count("imdb_rating")).alias("avg_imdb_rating"),
        ratio(F.sum("film_runtime_min"), F.count("film_runtime_min")).alias("avg_runtime_min"))
    return genre.join(films, "film_genre").select(
        "film_genre", "total_revenue", "n_films", "avg_imdb_rating", "avg_runtime_min",
        "best_season", "best_season_revenue")


# ---------------------------------------------------------------- BQ8
def bq8(w: dict[str, DataFrame]) -> DataFrame:
    """Revenue by IMDb bracket x Rotten-Tomatoes bracket."""
    f = films_with_revenue(w).select(
        bracket(F.col("imdb_rating"), IMDB_BRACKETS, IMDB_TOP).alias("imdb_bracket"),
        bracket(F.col("rt_rating"), RT_BRACKETS, RT_TOP).alias("rt_bracket"), "rev")
    return f.groupBy("imdb_bracket", "rt_bracket").agg(
        F.count(F.lit(1)).alias("n_films"), dbl(F.sum("rev")).alias("total_revenue"),
        ratio(F.sum("rev"), F.count(F.lit(1))).alias("avg_film_revenue"))


# ---------------------------------------------------------------- BQ9
def bq9(w: dict[str, DataFrame]) -> DataFrame:
    """Age classification x calendar season x genre."""
    f, d = w["fact_daily_box_office"], w["dim_date"]
    fs = (f.join(d.select("sk_date", "calendar_season"), f["fk_date"] == d["sk_date"])
          .groupBy("fk_film", "calendar_season")
          .agg(F.sum("gross_revenue_per_day").alias("rev"), F.count(F.lit(1)).alias("n_days")))
    film = w["dim_film"]
    j = fs.join(film, fs["fk_film"] == film["sk_film"]).select(
        F.coalesce("film_age_classification", F.lit("Unknown")).alias("film_age_classification"),
        "calendar_season", F.coalesce("film_genre", F.lit("Unknown")).alias("film_genre"),
        "rev", "n_days")
    return j.groupBy("film_age_classification", "calendar_season", "film_genre").agg(
        dbl(F.sum("rev")).alias("total_revenue"),
        ratio(F.sum("rev"), F.sum("n_days")).alias("avg_daily_revenue"))


# ---------------------------------------------------------------- BQ10
def bq10(w: dict[str, DataFrame]) -> DataFrame:
    """Weekdays by average daily (all-film) revenue, highest first."""
    f, d = w["fact_daily_box_office"], w["dim_date"]
    per_day = f.groupBy("fk_date").agg(F.sum("gross_revenue_per_day").alias("rev"))
    j = per_day.join(d, per_day["fk_date"] == d["sk_date"])
    return j.groupBy("weekday_number", "weekday_name").agg(
        F.count(F.lit(1)).alias("n_days"),
        ratio(F.sum("rev"), F.count(F.lit(1))).alias("avg_daily_revenue")).orderBy(F.col("avg_daily_revenue").desc(), "weekday_number")


# ---------------------------------------------------------------- BQ11
def bq11(w: dict[str, DataFrame], n: int = TOP_FILMS) -> DataFrame:
    """Languages of the top-n films: primary and secondary mentions."""
    top = top_films(w, n)
    langs = top.select(F.explode(F.array(
        F.struct(F.col("primary_language_film").alias("language"), F.lit(1).alias("p"), F.lit(0).alias("s")),
        F.struct(F.col("secondary_language_film").alias("language"), F.lit(0).alias("p"), F.lit(1).alias("s"))
    )).alias("x")).select("x.*").filter(F.col("language").isNotNull())
    return langs.groupBy("language").agg(
        F.count(F.lit(1)).alias("n_films"), F.sum("p").cast("bigint").alias("n_primary"),
        F.sum("s").cast("bigint").alias("n_secondary"))


# ---------------------------------------------------------------- BQ12
def bq12(w: dict[str, DataFrame], n: int = TOP_RATED) -> DataFrame:
    """Top-n rated films among high-budget (>= median) and low-budget films.

    The median is selected exactly over film-grain rows (never fact rows);
    the per-class top-n is a ranked window that Spark limits per
    group before the shuffle (WindowGroupLimit)."""
    f = materialize(films_with_revenue(w), "films-with-revenue")
    [med] = exact_quantiles(f, {"film_budget_usd": [0.5]})["film_budget_usd"]
    j = f.withColumn("budget_class", F.when(dbl("film_budget_usd") >= F.lit(med), F.lit("High"))
                     .otherwise(F.lit("Low")))
    from pyspark.sql import Window
    win = Window.partitionBy("budget_class").orderBy(
        F.desc_nulls_last("imdb_rating"), F.desc_nulls_last("rt_rating"), F.asc("bk_film"))
    r = j.withColumn("rank_in_class", F.row_number().over(win)).filter(F.col("rank_in_class") <= n)
    return r.select("budget_class", F.col("rank_in_class").cast("int"), "bk_film", "film_title",
                    dbl("imdb_rating").alias("imdb_rating"), dbl("rt_rating").alias("rt_rating"),
                    dbl("film_budget_usd").alias("film_budget_usd"))


# ---------------------------------------------------------------- BQ13
def bq13(w: dict[str, DataFrame]) -> DataFrame:
    """Per year: best day, best calendar season, best marketing season."""
    f, d = w["fact_daily_box_office"], w["dim_date"]
    per_day = f.groupBy("fk_date").agg(F.sum("gross_revenue_per_day").alias("rev"))
    j = per_day.join(d, per_day["fk_date"] == d["sk_date"])
    day = j.groupBy("calendar_year").agg(
        F.min_by("proper_date", F.struct(-F.col("rev"), F.col("proper_date"))).alias("best_date"),
        dbl(F.max("rev")).alias("best_date_revenue"))
    season = j.groupBy("calendar_year", "calendar_season").agg(F.sum("rev").alias("rev"))
    season = season.groupBy("calendar_year").agg(
        best_of(season, ["calendar_year"], "calendar_season").alias("best_season"),
        dbl(F.max("rev")).alias("best_season_revenue"))
    mk = j.groupBy("calendar_year", "marketing_season").agg(F.sum("rev").alias("rev"))
    mk = mk.groupBy("calendar_year").agg(
        best_of(mk, ["calendar_year"], "marketing_season").alias("best_marketing_season"),
        dbl(F.max("rev")).alias("best_marketing_revenue"))
    return day.join(season, "calendar_year").join(mk, "calendar_year")


# ---------------------------------------------------------------- BQP1
def genre_year_revenue(w: dict[str, DataFrame]) -> DataFrame:
    """Revenue by (genre, calendar year), genre not null."""
    f, d = w["fact_daily_box_office"], w["dim_date"]
    fy = (f.join(d.select("sk_date", "calendar_year"), f["fk_date"] == d["sk_date"])
          .groupBy("fk_film", "calendar_year").agg(F.sum("gross_revenue_per_day").alias("rev")))
    film = w["dim_film"].filter(F.col("film_genre").isNotNull()).select("sk_film", "film_genre")
    return (fy.join(film, fy["fk_film"] == film["sk_film"])
            .groupBy("film_genre", F.col("calendar_year").alias("box_year"))
            .agg(F.sum("rev").alias("annual_revenue")))


def genre_trend(w: dict[str, DataFrame], threshold: float = TREND_THRESHOLD) -> DataFrame:
    """BQP1: per-genre least-squares trend of annual revenue (one aggregate).

    Slope and intercept come from exact decimal moment sums (n, Σx, Σy, Σxy,
    Σx²) — the closed form of ordinary least squares — so the result does
    not depend on summation order.  <2 years -> Stable and the mean (not
    clamped); else Growing/Declining when |slope| exceeds threshold x mean;
    projection at (global max year + 1), clamped at 0.
    """
    gy = genre_year_revenue(w)
    next_year = scalar(gy.agg(F.max("box_year") + 1))
    x, y = F.col("box_year").cast("bigint"), F.col("annual_revenue")
    m = gy.groupBy("film_genre").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(y * x).alias("sxy"))
    n = F.col("n")
    slope = F.try_divide(dbl(n * F.col("sxy") - F.col("sx") * F.col("sy")),
                         dbl(n * F.col("sxx") - F.col("sx") * F.col("sx")))
    mean = dbl("sy") / dbl(n)
    m = m.select("film_genre", "n", mean.alias("mean"), slope.alias("slope"),
                 dbl("sx").alias("sxd"), dbl("sy").alias("syd"), F.lit(next_year).cast("double").alias("nx"))
    proj = (F.col("syd") - F.col("slope") * F.col("sxd")) / dbl("n") + F.col("slope") * F.col("nx")
    thresh = F.col("mean") * F.lit(threshold)
    trend = (F.when(F.col("n") < 2, F.lit("Stable"))
             .when(F.col("slope") > thresh, F.lit("Growing"))
             .when(F.col("slope") < -thresh, F.lit("Declining"))
             .otherwise(F.lit("Stable")))
    value = F.when(F.col("n") < 2, F.col("mean")).otherwise(clamp_zero(proj))
    return m.select("film_genre", trend.alias("genre_trend"), value.alias("genre_projected_revenue"))
