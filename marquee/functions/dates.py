"""Date dimension.

The dimension is generated from a one-row bounds frame with ``sequence`` +
``explode``: its size is the number of calendar days, independent of the
fact size.  Holidays are a broadcast lookup join (a fixed list, a few rows);
seasons are ``when`` chains built from parameter tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.clean import date_key

# --- fixed values [decision]: holiday calendar (month, day, name) ---------
HOLIDAYS = (
    (1, 1, "New Year's Day"),
    (2, 14, "Valentine's Day"),
    (7, 4, "Independence Day"),
    (10, 31, "Halloween"),
    (11, 11, "Veterans Day"),
    (12, 24, "Christmas Eve"),
    (12, 25, "Christmas Day"),
    (12, 31, "New Year's Eve"),
)

# --- fixed values [decision]: marketing seasons (name, from mmdd, to mmdd),
# first matching range wins, otherwise MARKETING_DEFAULT -------------------
MARKETING_SEASONS = (
    ("Holiday season", 1120, 1231),
    ("Holiday season", 101, 105),
    ("Award season", 106, 305),
    ("Summer blockbuster season", 501, 831),
    ("Fall festival season", 901, 1031),
)
MARKETING_DEFAULT = "Off season"

# --- fixed values [decision]: meteorological seasons by month -------------
CALENDAR_SEASONS = (
    ("Winter", (12, 1, 2)),
    ("Spring", (3, 4, 5)),
    ("Summer", (6, 7, 8)),
    ("Fall", (9, 10, 11)),
)


def calendar_season(d) -> Column:
    m = F.month(d)
    expr = None
    for name, months in CALENDAR_SEASONS:
        cond = m.isin(list(months))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def marketing_season(d, seasons: Sequence[tuple[str, int, int]] = MARKETING_SEASONS,
                     default: str = MARKETING_DEFAULT) -> Column:
    mmdd = F.month(d) * 100 + F.dayofmonth(d)
    expr = None
    for name, lo, hi in seasons:
        cond = mmdd.between(lo, hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(default))


def holiday_table(spark: SparkSession, holidays=HOLIDAYS) -> DataFrame:
    """Parameter table built JVM-side (no Python rows shipped)."""
    rows = [F.struct(F.lit(m).cast("int").alias("h_month"), F.lit(d).cast("int").alias("h_day"),
                     F.lit(n).alias("holiday_name")) for m, d, n in holidays]
    return spark.range(1).select(F.inline(F.array(*rows)))


def date_attributes(df: DataFrame, d: str = "proper_date", holidays: DataFrame | None = None,
                    seasons=MARKETING_SEASONS) -> DataFrame:
    """Add the 16 dimension columns to a frame with one date column."""
    c = F.col(d)
    wd = (F.weekday(c) + 1).cast("int")  # Monday = 1 [decision]
    out = df.select(
        date_key(c).alias("sk_date"),
        c.alias("proper_date"),
        F.date_format(c, "EEEE, MMMM d, yyyy").alias("full_date"),
        F.dayofmonth(c).cast("int").alias("monthday_number"),
        wd.alias("weekday_number"),
        F.date_format(c, "EEEE").alias("weekday_name"),
        F.when(wd >= 6, F.lit("Weekend")).otherwise(F.lit("Weekday")).alias("weekday_type"),
        F.date_format(c, "EEE").alias("weekday_name_short"),
        F.month(c).cast("int").alias("month_number"),
        F.date_format(c, "MMMM").alias("month_name"),
        F.date_format(c, "MMM").alias("month_name_short"),
        calendar_season(c).alias("calendar_season"),
        F.month(c).alias("_m"), F.dayofmonth(c).alias("_d"),
        marketing_season(c, seasons).alias("marketing_season"),
        F.year(c).cast("int").alias("calendar_year"),
    )
    if holidays is None:
        holidays = holiday_table(df.sparkSession)
    # fixed lookup of a handful of rows: broadcast is safe by construction
    out = out.join(F.broadcast(holidays),
                   (out["_m"] == holidays["h_month"]) & (out["_d"] == holidays["h_day"]), "left")
    return out.select(
        "sk_date", "proper_date", "full_date", "monthday_number", "weekday_number",
        "weekday_name", "weekday_type", "weekday_name_short", "month_number", "month_name",
        "month_name_short", "calendar_season",
        F.col("holiday_name").isNotNull().alias("is_holiday"), "holiday_name",
        "marketing_season", "calendar_year")


def dim_date_from_bounds(bounds: DataFrame, lo: str = "lo", hi: str = "hi", **kw) -> DataFrame:
    """Every calendar day between the bounds of a one-row frame."""
    days = bounds.select(F.explode(F.sequence(F.col(lo), F.col(hi), F.expr("interval 1 day")))
                         .alias("proper_date"))
    return date_attributes(days, **kw)


def dim_date(spark: SparkSession, start: str, end: str, **kw) -> DataFrame:
    bounds = spark.range(1).select(F.to_date(F.lit(start)).alias("lo"), F.to_date(F.lit(end)).alias("hi"))
    return dim_date_from_bounds(bounds, **kw)
