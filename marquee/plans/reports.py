"""Report tables behind the dashboards.

Every report first reduces the fact to a small grain (film, weekday type,
days-since-release value, country, person) and only then ranks or takes
running shares, so the ordered windows run over bounded frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.measures import running_share
from marquee.operators.quantiles import exact_quantiles
from marquee.plans.questions import films_with_revenue
from marquee.session import materialize

G = "gross_revenue_per_day"
TIERS = (0.33, 0.66)        # budget tercile cut points [decision], as N2
DECAY_WINDOW = 70           # days of commercial life quoted by the reference
TOP_PEOPLE = 30


def _ratio(n, d):
    return F.try_divide(n.cast("double"), d.cast("double"))


def budget_tiers(w: dict[str, DataFrame]) -> DataFrame:
    """Films with revenue and a known (>0) budget, tagged Low/Mid/High by
    exact budget terciles (two scalars, selected over film-grain rows)."""
    f = materialize(films_with_revenue(w).filter(F.col("film_budget_usd") > 0), "films-with-budget")
    b = F.col("film_budget_usd").cast("double")
    q33, q66 = exact_quantiles(f, {"b": TIERS}, {"b": b})["b"]
    tier = F.when(b >= F.lit(q66), "High").when(b >= F.lit(q33), "Mid").otherwise("Low")
    return f.withColumn("budget_tier", tier)


def budget_tier_roi(w: dict[str, DataFrame]) -> DataFrame:
    """Revenue per budget dollar by budget tier."""
    t = budget_tiers(w)
    return t.groupBy("budget_tier").agg(
        F.count(F.lit(1)).alias("n_films"), F.sum("rev").cast("double").alias("total_revenue"),
        F.sum("film_budget_usd").cast("double").alias("total_budget"),
        _ratio(F.sum("rev"), F.sum("film_budget_usd")).alias("revenue_per_budget_dollar"))


def low_budget_genre_roi(w: dict[str, DataFrame]) -> DataFrame:
    """P1 (second table): genre ROI inside the low-budget tier."""
    t = budget_tiers(w).filter((F.col("budget_tier") == "Low") & F.col("film_genre").isNotNull())
    return t.groupBy("film_genre").agg(
        F.count(F.lit(1)).alias("n_films"),
        _ratio(F.sum("rev"), F.sum("film_budget_usd")).alias("revenue_per_budget_dollar"))


def weekend_share(w: dict[str, DataFrame]) -> DataFrame:
    """Revenue share of weekend vs weekday dates."""
    f, d = w["fact_daily_box_office"], w["dim_date"]
    per_day = f.groupBy("fk_date").agg(F.sum(G).alias("rev"))
    j = per_day.join(d.select("sk_date", "weekday_type"), per_day["fk_date"] == d["sk_date"])
    g = j.groupBy("weekday_type").agg(F.sum("rev").alias("rev"), F.count(F.lit(1)).alias("n_days"))
    total = g.agg(F.sum("rev")).first()[0]
    return g.select("weekday_type", "n_days", F.col("rev").cast("double").alias("total_revenue"),
                    _ratio(F.col("rev"), F.lit(total)).alias("revenue_share"))


def decay_curve(w: dict[str, DataFrame]) -> DataFrame:
    """Revenue by days since release and its cumulative share."""
    f = w["fact_daily_box_office"].filter(F.col("days_since_release").isNotNull())
    g = f.groupBy("days_since_release").agg(F.sum(G).alias("rev"))
    out = running_share(g, [F.col("days_since_release")], "rev", "cum_share")
    return out.select("days_since_release", F.col("rev").cast("double").alias("revenue"), "cum_share")


def decay_within(w: dict[str, DataFrame], days: int = DECAY_WINDOW) -> DataFrame:
    """Share of all revenue earned within ``days`` of release."""
    f = w["fact_daily_box_office"]
    return f.agg(_ratio(F.sum(F.when(F.col("days_since_release") <= days, F.col(G))), F.sum(G))
                 .alias("share_within_window"),
                 F.lit(days).alias("window_days"))


def country_share(w: dict[str, DataFrame]) -> DataFrame:
    """Revenue concentration by main filming country."""
    fr = films_with_revenue(w)
    g = fr.groupBy("main_filming_country").agg(F.sum("rev").alias("rev"))
    order = [F.desc("rev"), F.asc_nulls_first("main_filming_country")]
    out = running_share(g, order, "rev", "cum_share")
    out = out.withColumn("country_rank", F.row_number().over(Window.orderBy(*order)))
    total = Window.partitionBy(F.lit(1))
    return out.select("main_filming_country", F.col("country_rank").cast("int"),
                      F.col("rev").cast("double").alias("total_revenue"),
                      _ratio(F.col("rev"), F.sum("rev").over(total)).alias("revenue_share"), "cum_share")


def league_table(w: dict[str, DataFrame], who: str = "actor", n: int = TOP_PEOPLE) -> DataFrame:
    """P6 (F4): top-n people by total revenue, ties by business key.  An
    ordered limit (per-partition top n, then a merge of n x partitions rows)
    picks the n; ranks are then numbered over those n rows only."""
    fk, dim, sk, bk = {"actor": ("fk_actor", "dim_actor", "sk_actor", "bk_actor"),
                       "director": ("fk_director", "dim_director", "sk_director", "bk_director")}[who]
    f = w["fact_daily_box_office"]
    per = f.groupBy(fk).agg(F.sum(G).alias("rev"), F.countDistinct("fk_film").alias("n_films"))
    d = w[dim]
    j = per.join(d, per[fk] == d[sk])
    order = [F.desc("rev"), F.asc(bk)]
    top = j.orderBy(*order).limit(n)
    r = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return r.select(
        F.col("rank").cast("int"), bk, f"first_name_{who}", f"surname_{who}", f"nationality_{who}",
        F.col("rev").cast("double").alias("total_revenue"), "n_films")
