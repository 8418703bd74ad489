"""Semantic measures (O1-O18) and hierarchy rollups.

Each measure is ``f(star, by) -> DataFrame`` with one row per ``by`` group.
It names the keys it groups by, the attributes it needs and its sums, and
``Star`` resolves them: the fact is reduced to the foreign keys that matter,
then only the dimensions that hold a named column are joined, then the sums
are merged.  Where films are kept apart and days matter too there is nothing to
reduce (a fact row is a film's day): the rows are dealt out by film in tasks of
a bounded size, joined and summed there.  ``star`` may also be a frame that has all the columns already.
The reference documents these only by name, so each formula is a [decision]
stated in its docstring and mirrored in the oracle.

Entity-level measures (per film / actor / genre) aggregate the fact to the
entity grain first and average those totals second — budget and ratings are
film attributes and are never summed over fact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.clean import safe_ratio as _ratio

G, DAYS = "gross_revenue_per_day", "days_since_release"
STAR_DIMS = {"dim_film": ("fk_film", "sk_film"), "dim_date": ("fk_date", "sk_date"), "dim_actor": ("fk_actor", "sk_actor"),
             "dim_director": ("fk_director", "sk_director"), "dim_production_company": ("fk_production_company", "sk_production_company")}
# how partial sums are taken of fact rows, and merged
GRAIN = {"fk_film", "fk_date"}   # what tells fact rows apart
TASK_ROWS = 1 << 20              # fact rows of one task that aggregates by film
PARTIAL = {"sum": F.sum, "count": F.count, "max": F.max}
MERGED = {"sum": F.sum, "count": F.sum, "max": F.max}


class Star:
    """The loaded star, for measures: finds the dimension of a column."""

    def __init__(self, w: dict[str, DataFrame], fact: str = "fact_daily_box_office", dims=STAR_DIMS):
        self.fact = w[fact]
        self.dims = {name: (w[name], fk, sk) for name, (fk, sk) in dims.items() if name in w}
        if "dim_date" in self.dims and "proper_date" in w["dim_date"].columns:
            date, fk, sk = self.dims["dim_date"]
            self.dims["dim_date"] = (date.withColumn("week_no", week_no(F.col("proper_date"))), fk, sk)

    def dimension(self, column: str) -> str:
        for name, (dim, _, _) in self.dims.items():
            if column in dim.columns:
                return name
        raise KeyError(f"no dimension has {column}")

    def grouped(self, keys: list[str], attrs: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
        """One row per ``keys`` and ``attrs`` with the named sums of fact
        rows, ("sum" | "count" | "max", column)."""
        own = [k for k in keys if k in self.fact.columns]
        named: dict[str, list[str]] = {}
        for c in [*keys, *attrs]:
            if c not in own:
                named.setdefault(self.dimension(c), []).append(c)
        reduced_to = list(dict.fromkeys([*own, *[self.dims[d][1] for d in named]]))
        whole = "fk_film" in keys and bool(named) and GRAIN <= set(reduced_to)
        if whole:
            out = self.fact.select(*reduced_to, *dict.fromkeys(c for _, c in aggs.values() if c != "*" and c not in reduced_to))
            out = out.repartition(max(2, -(-self.fact.count() // TASK_ROWS)), "fk_film")
        else:
            out = _aggregated(self.fact, reduced_to, aggs, PARTIAL)
        for name, columns in named.items():
            dim, fk, sk = self.dims[name]
            out = out.join(dim.select(F.col(sk).alias("_sk"), *columns), F.col(fk) == F.col("_sk")).drop("_sk")
        if whole:
            out = _aggregated(out, [*keys, *attrs], aggs, PARTIAL)
            out = out.select(*[_as_merged(out, n) if n in aggs and aggs[n][0] == "sum" else F.col(n) for n in out.columns])
        elif named:
            out = _aggregated(out, [*keys, *attrs], {n: (kind, n) for n, (kind, _) in aggs.items()}, MERGED)
        return out


def _as_merged(df: DataFrame, name: str) -> Column:
    """A sum in the type that a sum of sums has."""
    kind = df.schema[name].dataType
    wide = T.DecimalType(min(38, kind.precision + 10), kind.scale) if isinstance(kind, T.DecimalType) else kind
    return F.col(name).cast(wide).alias(name)


def _aggregated(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]], how) -> DataFrame:
    if not aggs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[how[kind](F.lit(1) if c == "*" else F.col(c)).alias(n) for n, (kind, c) in aggs.items()])


def _grouped(star: Star | DataFrame, keys, attrs=(), **aggs) -> DataFrame:
    if isinstance(star, Star):
        return star.grouped(list(keys), list(attrs), aggs)
    return _aggregated(star, [*keys, *attrs], aggs, PARTIAL)


def _by(by) -> list[str]:
    return list(by or [])


def total_revenue(star, by=()) -> DataFrame:
    """Σ gross."""
    return _grouped(star, _by(by), r=("sum", G)).select(*_by(by), F.col("r").cast("double").alias("total_revenue"))


def total_films(star, by=()) -> DataFrame:
    """Distinct films with at least one fact row."""
    return _grouped(star, [*_by(by), "fk_film"]).groupBy(*_by(by)).agg(F.count("fk_film").alias("total_films"))


def avg_daily_revenue(star, by=()) -> DataFrame:
    """O1: Σ gross / fact rows."""
    g = _grouped(star, _by(by), r=("sum", G), n=("count", "*"))
    return g.select(*_by(by), _ratio(F.col("r"), F.col("n")).alias("avg_daily_revenue"))


def avg_days_since_release(star, by=()) -> DataFrame:
    """O2: mean of days_since_release over fact rows (NULL skipped)."""
    g = _grouped(star, _by(by), s=("sum", DAYS), n=("count", DAYS))
    return g.select(*_by(by), _ratio(F.col("s"), F.col("n")).alias("avg_days_since_release"))


def avg_film_attribute(star, by, attr: str, name: str) -> DataFrame:
    """Average of a film attribute over the distinct films in scope."""
    films = _grouped(star, [*_by(by), "fk_film"], [attr])
    return films.groupBy(*_by(by)).agg(_ratio(F.sum(attr), F.count(attr)).alias(name))


def avg_imdb_rating(star, by=()):
    return avg_film_attribute(star, by, "imdb_rating", "avg_imdb_rating")


def avg_rt_rating(star, by=()):
    return avg_film_attribute(star, by, "rt_rating", "avg_rt_rating")


def avg_entity_revenue(star, by, entity: str, name: str, known: bool = False) -> DataFrame:
    """Total per entity, then the mean over entities (D16);
    ``known``: entities that are NULL don't count."""
    e = _grouped(star, [*_by(by), entity], _rev=("sum", G))
    e = e.filter(F.col(entity).isNotNull()) if known else e
    return e.groupBy(*_by(by)).agg(_ratio(F.sum("_rev"), F.count(F.lit(1))).alias(name))


def avg_actor_revenue(star, by=()):
    return avg_entity_revenue(star, by, "fk_actor", "avg_actor_revenue")


def avg_genre_revenue(star, by=()):
    return avg_entity_revenue(star, by, "film_genre", "avg_genre_revenue", known=True)


def avg_revenue_per_film(star, by=()):
    return avg_entity_revenue(star, by, "fk_film", "avg_revenue_per_film")


def film_days(star, by=()) -> DataFrame:
    """Per film: its longest run (max days since release) and revenue."""
    return _grouped(star, [*_by(by), "fk_film"], ["film_genre"], film_days=("max", DAYS), film_revenue=("sum", G))


def avg_genre_days(star, by=()) -> DataFrame:
    """Per genre, the mean over its films of the film's max days."""
    f = film_days(star, by).filter(F.col("film_genre").isNotNull())
    return f.groupBy(*_by(by), "film_genre").agg(
        _ratio(F.sum("film_days"), F.count("film_days")).alias("avg_genre_days"))


def _vs_group(per: DataFrame, key: str, value: str, name: str, group_name: str) -> DataFrame:
    """Value minus the mean of its group, via a grouped aggregate joined
    back (skew-safe; a window would put a hot group in one task)."""
    avg = per.groupBy(key).agg(_ratio(F.sum(value), F.count(value)).alias(group_name))
    j = per.join(avg, key)
    return j.withColumn(name, F.col(value).cast("double") - F.col(group_name))


def kpi_days_vs_genre(star) -> DataFrame:
    """Film max days − genre average of film max days."""
    f = film_days(star).filter(F.col("film_genre").isNotNull())
    return _vs_group(f, "film_genre", "film_days", "kpi_days_vs_genre", "genre_avg_days").select(
        "fk_film", "film_genre", "film_days", "genre_avg_days", "kpi_days_vs_genre")


def kpi_revenue_vs_actor(star) -> DataFrame:
    """Film revenue − average film revenue of the same lead actor."""
    f = _grouped(star, ["fk_actor", "fk_film"], film_revenue=("sum", G))
    out = _vs_group(f, "fk_actor", "film_revenue", "kpi_revenue_vs_actor", "actor_avg_revenue")
    return out.select("fk_actor", "fk_film", F.col("film_revenue").cast("double").alias("film_revenue"),
                      "actor_avg_revenue", "kpi_revenue_vs_actor")


def kpi_revenue_vs_genre(star) -> DataFrame:
    """Film revenue − average film revenue of the genre."""
    f = film_days(star).filter(F.col("film_genre").isNotNull())
    out = _vs_group(f, "film_genre", "film_revenue", "kpi_revenue_vs_genre", "genre_avg_revenue")
    return out.select("fk_film", "film_genre", F.col("film_revenue").cast("double").alias("film_revenue"),
                      "genre_avg_revenue", "kpi_revenue_vs_genre")


def kpi_roi(star) -> DataFrame:
    """Film revenue / film budget (NULL when the budget is 0/NULL)."""
    f = _grouped(star, ["fk_film"], ["film_budget_usd"], rev=("sum", G)).withColumnRenamed("film_budget_usd", "budget")
    return f.select("fk_film", F.col("rev").cast("double").alias("film_revenue"),
                    F.col("budget").cast("double").alias("film_budget_usd"),
                    F.when(F.col("budget") > 0, _ratio(F.col("rev"), F.col("budget"))).alias("roi"))


def revenue_per_budget_dollar(star, by=()) -> DataFrame:
    """Σ film revenue / Σ film budget over the distinct films in scope."""
    f = _grouped(star, [*_by(by), "fk_film"], ["film_budget_usd"], rev=("sum", G))
    return f.groupBy(*_by(by)).agg(_ratio(F.sum("rev"), F.sum("film_budget_usd")).alias("revenue_per_budget_dollar"))


def revenue_last_week(star, by=(), days: int = 7, date_col: str = "proper_date") -> DataFrame:
    """Revenue of the last ``days`` days before the latest date of the
    whole fact (E9).  The latest date is one scalar."""
    last = _grouped(star, [date_col]).agg(F.max(date_col)).first()[0]
    recent = _grouped(star, [*_by(by), date_col], r=("sum", G)).filter(F.col(date_col) > F.date_sub(F.lit(last), days))
    return recent.groupBy(*_by(by)).agg(F.sum("r").cast("double").alias("revenue_last_week"))


def week_no(d: Column, origin: str = "1970-01-05") -> Column:
    return F.floor(F.datediff(d, F.lit(origin).cast("date")) / 7).cast("int")


def weekly_revenue_change(star, by=(), date_col: str = "proper_date") -> DataFrame:
    """O18 (E8): weekly revenue minus the previous calendar week's revenue
    of the same group; NULL when that week is absent.  Equi-join on
    (group, week − 1), null-safe on the group."""
    d = _weekly_delta(star, by, date_col)
    return d.select(*_by(by), "week_no", F.col("rev").cast("double").alias("weekly_revenue"),
                    F.col("_delta").cast("double").alias("weekly_revenue_change"))


def weekly_revenue(star, by=(), date_col: str = "proper_date") -> DataFrame:
    """Σ gross by group and calendar week: (by, week_no, rev)."""
    if not isinstance(star, Star):
        star = star.withColumn("week_no", week_no(F.col(date_col)))
    return _grouped(star, [*_by(by), "week_no"], rev=("sum", G))


def _weekly_delta(star, by=(), date_col: str = "proper_date") -> DataFrame:
    keys = _by(by)
    wk = weekly_revenue(star, by, date_col)
    prev = wk.select(*[F.col(k).alias(f"_p_{k}") for k in keys], (F.col("week_no") + 1).alias("_p_week"),
                     F.col("rev").alias("_prev"))
    cond = wk["week_no"] == prev["_p_week"]
    for k in keys:
        cond = cond & wk[k].eqNullSafe(prev[f"_p_{k}"])
    j = wk.join(prev, cond, "left")
    return j.select(*keys, "week_no", "rev", (F.col("rev") - F.col("_prev")).alias("_delta"))


def avg_weekly_change(star, by=()) -> DataFrame:
    """Mean of O18 over the weeks that have a previous week (exact
    decimal sum / count)."""
    ch = _weekly_delta(star, by)
    return ch.groupBy(*_by(by)).agg(_ratio(F.sum("_delta"), F.count("_delta")).alias("avg_weekly_change"))


def hierarchy(df: DataFrame, levels: list[str], aggs: list[Column]) -> DataFrame:
    """Totals at every level of a drill-down path plus the grand total.
    ``level_id`` = grouping_id (bit set = level rolled up)."""
    return df.rollup(*levels).agg(*aggs, F.grouping_id(*levels).alias("level_id"))


def revenue_hierarchy(star, levels: list[str]) -> DataFrame:
    """D15 for revenue and distinct films: the fact is reduced to (levels,
    film), and a film's rows are marked where they are its first of a group,
    for the groups of every depth (one sort by film and levels).  Sums of the
    marks are the distinct films, so the rollup's row expansion runs on the
    totals of the lowest level only."""
    pre = _grouped(star, [*levels, "fk_film"], _rev=("sum", G))
    depth = len(levels)
    marks = []
    for d in range(depth):
        nth = F.row_number().over(Window.partitionBy("fk_film", *levels[:d]).orderBy(*levels[d:]))
        marks.append(((nth == 1) & F.col("fk_film").isNotNull()).cast("int").alias(f"_first{d}"))
    marks.append(F.col("fk_film").isNotNull().cast("int").alias(f"_first{depth}"))
    lowest = pre.select(*levels, "_rev", *marks).groupBy(*levels).agg(F.sum("_rev").alias("_rev"), *[F.sum(f"_first{d}").alias(f"_first{d}") for d in range(depth + 1)])
    films = None
    for d in range(depth + 1):
        at, n = F.grouping_id(*levels) == (1 << (depth - d)) - 1, F.sum(f"_first{d}")
        films = F.when(at, n) if films is None else films.when(at, n)
    return hierarchy(lowest, levels, [F.sum("_rev").cast("double").alias("total_revenue"), films.alias("n_films")])


def running_share(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Cumulative share of ``value`` along ``order`` (E12).  Meant for
    pre-aggregated frames (days, countries): the single ordered window is
    bounded by the number of groups, not by the fact."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(F.lit(1))
    return df.withColumn(name, _ratio(F.sum(value).over(w), F.sum(value).over(total)))
