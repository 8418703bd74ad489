"""Driver tables -> box-office staging area (FIXTURES.md §1-§2).

The test data is TPC-H shaped; this adapter re-reads it as the box-office
star: parts are films, customers actors, suppliers directors and production
companies, lineitems grouped by (part, ship day) the daily fact.  All
foreign keys are arithmetic on ``p_partkey`` so the fact never joins the
actor/director/company tables just to get its keys.

Scale notes: the fact is one partial-aggregate shuffle of ``lineitem`` on
(part, day); the per-film first day is an aggregate of that (small) result
joined back on the part key, so a hot film is split by AQE skew handling
instead of landing in one window task.  ``nation``/``region`` lookups are broadcast
only after a bounded row-count check (``DriverFrames.bc``); nothing else is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.clean import date_key
from marquee.functions.dates import dim_date_from_bounds
from marquee.sources.tables import read_table

# --- fixed values: fixture encodings --------------------------------------
AGE_CLASSES = ("G", "PG", "PG-13", "R")          # p_partkey % 5, 4 -> NULL
LANGUAGES = ("English", "French", "German", "Spanish")  # p_partkey % 4


def key(prefix: str, x) -> Column:
    """KEY(p, x) = p || lpad(x, 8, '0')."""
    return F.concat(F.lit(prefix), F.lpad(x.cast("string"), 8, "0"))


def _pick(x: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(x == i, F.lit(v)) if expr is None else expr.when(x == i, F.lit(v))
    return expr


@dataclass
class DriverFrames:
    spark: SparkSession
    sf_dir: str
    n_supplier: int
    n_customer: int
    _frames: dict = field(default_factory=dict)

    def t(self, name, cols=None) -> DataFrame:
        # one relation per table: the file listing / footer read happens once
        if name not in self._frames:
            self._frames[name] = read_table(self.spark, self.sf_dir, name)
        df = self._frames[name]
        return df.select(*cols) if cols else df


_DRIVERS: dict = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and modification times of the tables' files as Spark's
    file systems report them, so that changed data is noticed on shared
    stores too, where folders have no time of their own."""
    sc = spark.sparkContext
    out = []
    for name in ("lineitem", "part", "orders", "customer", "supplier", "nation", "region"):
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files = fs.listStatus(path) if fs.exists(path) else []
        out.append(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))
    return tuple(out)


def driver(spark: SparkSession, sf_dir: str) -> DriverFrames:
    """Table handles + the two row counts used as modulus of the FK map,
    once per (application, folder, file stamps)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), _stamp(spark, sf_dir))
    if key not in _DRIVERS:
        _DRIVERS[key] = _driver(spark, sf_dir)
    return _DRIVERS[key]


def _driver(spark: SparkSession, sf_dir: str) -> DriverFrames:
    # two scalar row counts (one global aggregate job)
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey"]).agg(F.count(F.lit(1)).alias("n"))
    c = read_table(spark, sf_dir, "customer", ["c_custkey"]).agg(F.count(F.lit(1)).alias("n"))
    row = s.unionByName(c).collect()
    return DriverFrames(spark, sf_dir, row[0]["n"], row[1]["n"])


def fact_keys(dv: DriverFrames, p: Column) -> list[Column]:
    return [
        key("F", p).alias("fk_film"),
        key("C", p % F.lit(dv.n_supplier)).alias("fk_production_company"),
        key("D", (p * 13) % F.lit(dv.n_supplier)).alias("fk_director"),
        key("A", (p * 7) % F.lit(dv.n_customer)).alias("fk_actor"),
    ]


def daily_revenue(dv: DriverFrames) -> DataFrame:
    """(l_partkey, d, gross) — lineitem summed per part and ship day."""
    li = dv.t("lineitem", ["l_partkey", "l_shipdate", "l_extendedprice"])
    return (li.groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("d"))
            .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
                 .cast("decimal(18,2)").alias("gross")))


def first_day(daily: DataFrame) -> DataFrame:
    return daily.groupBy("l_partkey").agg(F.min("d").alias("d0"))


def part_days(dv: DriverFrames) -> DataFrame:
    """(l_partkey, d0, d1, undated): first and last ship day of each part and
    how many of its lineitems have none.  Two columns of lineitem, reduced
    within the tasks; the daily aggregate is not needed for it."""
    d = F.col("l_shipdate").cast("date")
    return (dv.t("lineitem", ["l_partkey", "l_shipdate"]).groupBy("l_partkey")
            .agg(F.min(d).alias("d0"), F.max(d).alias("d1"), F.count_if(d.isNull()).alias("undated")))


def shared_days(dv: DriverFrames) -> DataFrame:
    """``part_days``, written once per folder (stage boundary under the
    checkpoint folder)."""
    from marquee.session import materialize
    if "_days_materialized" not in dv._frames:
        dv._frames["_days_materialized"] = materialize(part_days(dv), "part_days")
    return dv._frames["_days_materialized"]


def shared_first(dv: DriverFrames) -> DataFrame:
    """Per-part first day, written once per folder: every film-level lookup
    reuses it instead of re-aggregating lineitem."""
    return shared_days(dv).select("l_partkey", "d0")


def undated(dv: DriverFrames) -> bool:
    """Whether a lineitem of a part has no ship day, which the fact's layout
    does not admit."""
    return not shared_days(dv).filter(F.col("l_partkey").isNotNull() & (F.col("undated") > 0)).isEmpty()


def stg_dim_film(dv: DriverFrames, first: DataFrame) -> DataFrame:
    part = dv.t("part")
    n1 = (dv.t("nation", ["n_nationkey", "n_name"])
            .withColumnsRenamed({"n_nationkey": "n1_key", "n_name": "n1_name"}))
    n2 = (dv.t("nation", ["n_nationkey", "n_name"])
            .withColumnsRenamed({"n_nationkey": "n2_key", "n_name": "n2_name"}))
    p = F.col("p_partkey")
    df = (part.join(first, part["p_partkey"] == first["l_partkey"], "left")
          .join(n1, (p % 25) == F.col("n1_key"), "left")
          .join(n2, ((p * 7) % 25) == F.col("n2_key"), "left"))
    return df.select(
        key("F", p).alias("bk_film"),
        F.col("p_name").alias("film_title"),
        F.year("d0").cast("int").alias("film_release_year"),
        F.when(p % 23 != 0, F.concat("p_type", "p_brand")).alias("film_genre"),
        _pick(p % 5, AGE_CLASSES).alias("film_age_classification"),
        _pick(p % 4, LANGUAGES).alias("primary_language_film"),
        F.when(p % 3 == 0, F.lit("Italian")).alias("secondary_language_film"),
        F.when(p % 29 != 0, 60 + 2 * F.col("p_size")).cast("int").alias("film_runtime_min"),
        ((10 + p % 91) / F.lit(10.0)).cast("decimal(3,1)").alias("imdb_rating"),
        F.when(p % 31 != 0, ((p * 37) % 101).cast("decimal(4,1)")).alias("rt_rating"),
        F.when(p % 19 == 0, F.lit(0).cast("decimal(18,2)"))
         .otherwise((F.col("p_retailprice").cast("decimal(18,2)") * 1000).cast("decimal(18,2)"))
         .alias("film_budget_usd"),
        F.col("n1_name").alias("main_filming_country"),
        F.when(p % 2 == 0, F.col("n2_name")).alias("secondary_filming_country"),
        F.lit(None).cast("string").alias("tertiary_filming_country"),
        F.greatest(p % 7 - 3, F.lit(0)).cast("int").alias("film_awards_won"),
        (p % 11).cast("int").alias("film_awards_nominations"),
        F.when(p % 97 == 0, 1).otherwise(0).cast("int").alias("film_oscars_won"),
        (p % 13).cast("int").alias("film_oscar_nominations"),
    )


def _person(df: DataFrame, nation: DataFrame, prefix: str, id_c: str, name_c: str,
            nat_c: str, role: str, age_base: int, age_mod: int) -> DataFrame:
    i = F.col(id_c)
    return df.join(nation, df[nat_c] == nation["n_nationkey"], "left").select(
        key(prefix, i).alias(f"bk_{role}"),
        F.split_part(name_c, F.lit("#"), F.lit(1)).alias(f"first_name_{role}"),
        F.split_part(name_c, F.lit("#"), F.lit(2)).alias(f"surname_{role}"),
        F.col("n_name").alias(f"nationality_{role}"),
        F.when(i % 13 != 0, age_base + i % age_mod).cast("int").alias(f"age_{role}"),
    )


def stg_dim_actor(dv: DriverFrames) -> DataFrame:
    return _person(dv.t("customer", ["c_custkey", "c_name", "c_nationkey"]),
                   dv.t("nation", ["n_nationkey", "n_name"]),
                   "A", "c_custkey", "c_name", "c_nationkey", "actor", 20, 60)


def stg_dim_director(dv: DriverFrames) -> DataFrame:
    return _person(dv.t("supplier", ["s_suppkey", "s_name", "s_nationkey"]),
                   dv.t("nation", ["n_nationkey", "n_name"]),
                   "D", "s_suppkey", "s_name", "s_nationkey", "director", 30, 50)


def stg_dim_company(dv: DriverFrames) -> DataFrame:
    s = dv.t("supplier", ["s_suppkey", "s_name", "s_nationkey"])
    geo = dv.t("nation", ["n_nationkey", "n_name", "n_regionkey"]).join(
        dv.t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    i = F.col("s_suppkey")
    return s.join(geo, s["s_nationkey"] == geo["n_nationkey"], "left").select(
        key("C", i).alias("bk_production_company"),
        F.col("s_name").alias("production_company"),
        F.col("n_name").alias("country_production_company"),
        F.col("r_name").alias("continent_production_company"),
        F.concat(F.lit("City"), (i % 7).cast("string")).alias("city_production_company"),
    )


def stg_fact(dv: DriverFrames, daily: DataFrame, first: DataFrame | None) -> DataFrame:
    """The daily fact; without ``first`` the same rows, but for the days since
    release: every part has a first day, so the join drops only null parts."""
    f = daily.filter(F.col("l_partkey").isNotNull()) if first is None else daily.join(first, "l_partkey")
    days = [] if first is None else [F.datediff("d", "d0").cast("int").alias("days_since_release")]
    return f.select(
        date_key(F.col("d")).alias("fk_date"),
        *fact_keys(dv, F.col("l_partkey")),
        F.col("gross").alias("gross_revenue_per_day"),
        *days,
    )


def stg_dim_date(days: DataFrame, lo: str = "d", hi: str = "d") -> DataFrame:
    bounds = days.agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    return dim_date_from_bounds(bounds)


def staging(spark: SparkSession, sf_dir: str, dv: DriverFrames | None = None,
            shared: bool = False) -> dict[str, DataFrame]:
    """The six clean staging tables.  With ``shared``, the film and date
    dimensions and the fact take the days of each part from ``shared_days``,
    so that the dimensions do not wait for the daily aggregate."""
    dv = dv or driver(spark, sf_dir)
    daily = daily_revenue(dv)
    first = shared_first(dv) if shared else first_day(daily)
    return {
        "stg_dim_date": stg_dim_date(shared_days(dv), "d0", "d1") if shared else stg_dim_date(daily),
        "stg_dim_film": stg_dim_film(dv, first),
        "stg_dim_actor": stg_dim_actor(dv),
        "stg_dim_director": stg_dim_director(dv),
        "stg_dim_production_company": stg_dim_company(dv),
        "stg_fact_daily_box_office": stg_fact(dv, daily, first),
    }


def dirty_staging(spark: SparkSession, sf_dir: str, dv: DriverFrames | None = None,
                  shared: bool = False) -> dict[str, DataFrame]:
    """FIXTURES §2: staging with known rule violations."""
    dv = dv or driver(spark, sf_dir)
    clean = staging(spark, sf_dir, dv, shared)
    film = clean["stg_dim_film"]
    film_no = F.substring("bk_film", 2, 8).cast("bigint")
    dirty_film = film.unionByName(film.filter(film_no % 500 == 0))
    actor = clean["stg_dim_actor"]
    dirty_actor = actor.filter(F.substring("bk_actor", 2, 8).cast("bigint") % 97 != 0)
    li = dv.t("lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_shipdate"])
    od = dv.t("orders", ["o_orderkey", "o_orderdate"])
    j = li.join(od, li["l_orderkey"] == od["o_orderkey"])
    ship, order = F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    dirty_fact = j.select(
        date_key(ship).alias("fk_date"),
        *fact_keys(dv, F.col("l_partkey")),
        F.when((F.col("l_linenumber") == 3) & (F.col("l_quantity") == 1), -gross)
         .otherwise(gross).cast("decimal(18,2)").alias("gross_revenue_per_day"),
        F.when(F.col("l_linenumber") != 7, F.datediff(ship, order)).cast("int")
         .alias("days_since_release"),
    )
    return {**clean, "stg_dim_film": dirty_film, "stg_dim_actor": dirty_actor,
            "stg_fact_daily_box_office": dirty_fact}


# --- text fixtures: dirty free-text columns derived from the driver tables,
# the inputs of the scalar cleaners (B1-B35).  Variants rotate with the key
# so every branch of every cleaner is exercised on whole tables.
def _case(x: Column, branches) -> Column:
    expr = None
    for i, v in enumerate(branches):
        expr = F.when(x == i, v) if expr is None else expr.when(x == i, v)
    return expr


def film_texts(dv: DriverFrames, first: DataFrame | None = None) -> DataFrame:
    if first is None:
        first = shared_first(dv)
    part = dv.t("part")
    nat = dv.t("nation", ["n_nationkey", "n_name"])
    n1 = nat.withColumnsRenamed({"n_nationkey": "k1", "n_name": "c1"})
    n2 = nat.withColumnsRenamed({"n_nationkey": "k2", "n_name": "c2"})
    p = F.col("p_partkey")
    df = (part.join(first, part["p_partkey"] == first["l_partkey"], "left")
          .join(n1, (p % 25) == F.col("k1"), "left").join(n2, ((p * 7) % 25) == F.col("k2"), "left"))
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    year, d0 = F.year("d0"), s("d0")
    wins, noms = F.greatest(p % 7 - 3, F.lit(0)), p % 11
    osc, osc_n = F.when(p % 97 == 0, 1).otherwise(0), p % 13
    tail = F.concat(s(wins), F.lit(" wins & "), s(noms), F.lit(" nominations total"))
    budget = s((F.col("p_retailprice").cast("decimal(18,2)") * 1000).cast("bigint"))
    primary = _pick(p % 4, LANGUAGES)
    ptype = F.col("p_type")
    return df.select(
        p.alias("p_partkey"),
        _case(p % 4, [F.concat("p_name", F.lit(" ("), s(year), F.lit(")")),
                      F.concat(F.upper("p_name"), F.lit("!")),
                      F.concat(F.lit("  "), "p_name", F.lit(": Part "), s("p_size"), F.lit(" ")),
                      F.col("p_name")]).alias("title_raw"),
        _case(p % 3, [F.substring(d0, 3, 8), d0, d0]).alias("release_text"),
        _case(p % 3, [F.concat(s(60 + 2 * F.col("p_size")), F.lit(" min")), F.lit("N/A"),
                      F.concat(s("p_size"), F.lit(" h"))]).alias("runtime_text"),
        _case(p % 3, [F.concat(primary, F.lit(", Italian, ")), primary, F.lit("")]).alias("languages_text"),
        _case(p % 3, [F.concat(F.lit("$"), F.substring(budget, 1, 3), F.lit(","), F.substring(budget, 4, 3)),
                      F.lit("N/A"), F.concat(F.lit("$"), s("p_size"), F.lit(".5M"))]).alias("budget_text"),
        F.when(p % 7 == 0, F.lit("N/A"))
         .when(osc > 0, F.concat(F.lit("Won "), s(osc), F.lit(" Oscars. "), tail))
         .when(osc_n > 0, F.concat(F.lit("Nominated for "), s(osc_n), F.lit(" Oscar. "), tail))
         .otherwise(tail).alias("awards_text"),
        F.concat(F.upper(F.substring(ptype, 1, 1)), F.lower(F.substring(ptype, 2, 100)), F.lit(", Drama"),
                 F.when(p % 2 == 0, F.lit(", Comedy")).otherwise(F.lit(""))).alias("genre_text"),
        F.when(p % 2 == 0, F.concat("c1", F.lit(" , "), "c2")).otherwise(F.col("c1")).alias("countries_text"),
        F.concat(s((p * 37) % 101), F.lit("%")).alias("rt_text"),
        F.when(p % 29 != 0, 60 + 2 * F.col("p_size")).cast("int").alias("runtime_min"),
    )


def person_texts(dv: DriverFrames) -> DataFrame:
    cust = dv.t("customer", ["c_custkey", "c_name", "c_nationkey"])
    nat = dv.t("nation", ["n_nationkey", "n_name"])
    c = F.col("c_custkey")
    s = lambda x: x.cast("string")
    y = 1950 + c % 40
    cy = F.when(c % 6 < 4, y).otherwise(y + 1)
    df = cust.join(nat, cust["c_nationkey"] == nat["n_nationkey"], "left")
    return df.select(
        c.alias("c_custkey"),
        F.concat(F.lit("  "), F.upper("c_name"), F.lit("   Studios ")).alias("studio_text"),
        _case(c % 5, [F.concat(F.lit("  First"), s(c % 17), F.lit("   Last"), s(c % 23), F.lit(" Jr ")),
                      F.concat(F.lit("Mono"), s(c % 9)), F.concat(F.lit("Ann"), s(c % 13), F.lit(" Lee"), s(c % 29)),
                      F.concat(F.lit("Ann"), s(c % 13), F.lit(" Lee"), s(c % 29)),
                      F.lit("   ")]).alias("name_text"),
        F.when(c % 7 == 0, F.lit(" , ")).otherwise(
            F.concat(F.lit("Town"), s(c % 11), F.lit(", Region"), s(c % 3), F.lit(", "), "n_name")).alias("birthplace"),
        _case(c % 6, [F.lit(""), F.concat(F.lit("City"), s(c % 7))]).otherwise(
            F.concat(F.lit("City"), s(c % 7), F.lit(", "), "n_name")).alias("hq_text"),
        _case(c % 4, [F.lit(None).cast("string"), s(y),
                      F.concat(s(y), F.lit("-0"), s(1 + c % 9), F.lit("-1"), s(c % 9)), F.lit("")]).alias("birth_existing"),
        _case(c % 5, [F.concat(s(cy), F.lit("-0"), s(1 + c % 9), F.lit("-2"), s(c % 9)), s(cy), F.lit("bad"),
                      F.lit(None).cast("string"),
                      F.concat(s(cy), F.lit("-1"), s(c % 3), F.lit("-0"), s(1 + c % 8))]).alias("birth_candidate"),
        F.when(c % 9 != 0, F.concat(F.lit("+"), s(1900 + c % 100), F.lit("-04-04T00:00:00Z"))).alias("inception_text"),
        s(F.date_add(F.lit("1995-01-01").cast("date"), (c % 400).cast("int"))).alias("hint_date"),
    )
