"""Data-quality rules, log and load gate.

Each rule returns a one-row DataFrame in the ``log_quality_checks`` layout;
``run_rules`` unions the 17 rows.  Physical choices, all aggregate-first so
a hot key is reduced map-side before any shuffle:

* duplicate keys / attribute groups: ``groupBy(..).count()`` (GROUP BY puts
  NULLs in one group, i.e. the null-safe comparison of the reference);
* orphan FKs: the fact is first reduced to (fk, rows) — bounded by the FK
  cardinality, not the fact size — then anti-joined with the dimension key;
* row predicates (rules 5-7): one scan with ``count_if`` for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.clean import dq_message, fail_ok

# --- fixed values: log texts of the reference's validation rules ----------
PHASE = "Staging Area"
CHECK_BK = "check integrity of BK"
MSG_BK = "number of rows with repeated BK: "
CHECK_ATTR = "check uniqueness of dimension attributes"  # [decision] no INSERT in the reference
MSG_ATTR = "number of rows with repeated attributes: "
CHECK_PK = "check integrity of fact PK (combo all FKs)"
MSG_PK = "number of rows with repeated PK: "
CHECK_FK = "check parent of FK for {} dimension"
MSG_FK = "number of rows without parent key: "
CHECK_REV = "business rule: gross revenue per day must be non-negative"
MSG_REV = "number of rows with negative gross revenue: "
CHECK_DAYS = "business rule: days since release must be non-negative"
MSG_DAYS = "number of rows with negative days since release: "
CHECK_REV_DAYS = "business rule: revenue rows must have days_since_release"
MSG_REV_DAYS = "number of rows with revenue but missing days_since_release: "

# film attributes of the reference's rule-2 investigation
FILM_ATTRS = ("film_title", "film_release_year", "film_runtime_min",
              "primary_language_film", "main_filming_country")

DIMENSIONS = (
    # (staging table, business key, rule-2 attributes or None = all non-key)
    ("stg_dim_film", "bk_film", FILM_ATTRS),
    ("stg_dim_actor", "bk_actor", None),
    ("stg_dim_director", "bk_director", None),
    ("stg_dim_production_company", "bk_production_company", None),
)
FACT = "stg_fact_daily_box_office"
FACT_KEYS = ("fk_date", "fk_film", "fk_production_company", "fk_director", "fk_actor")
PARENTS = (
    # (label, fact FK, staging dimension, parent key)
    ("Date", "fk_date", "stg_dim_date", "sk_date"),
    ("Film", "fk_film", "stg_dim_film", "bk_film"),
    ("Production Company", "fk_production_company", "stg_dim_production_company",
     "bk_production_company"),
    ("Director", "fk_director", "stg_dim_director", "bk_director"),
    ("Actor", "fk_actor", "stg_dim_actor", "bk_actor"),
)


def log_row(n: DataFrame, rule_id: int, table: str, check, message: str) -> DataFrame:
    """One log row from a one-row frame with column ``n`` (``check`` may be
    a column of ``n``)."""
    check_c = check if not isinstance(check, str) else F.lit(check)
    return n.select(F.lit(rule_id).cast("int").alias("id_check"),
                    F.lit(PHASE).alias("etl_phase"), F.lit(table).alias("etl_table"),
                    check_c.alias("etl_checktype"),
                    dq_message(message, F.col("n")).alias("description_result"),
                    fail_ok(F.col("n")).alias("etl_result"))


def duplicated_keys(df: DataFrame, keys) -> DataFrame:
    """Number of key values that occur more than once (groups, not rows)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.count_if(F.col("c") > 1).alias("n"))


def rows_in_duplicate_groups(df: DataFrame, attrs) -> DataFrame:
    """Rows whose attribute combination (NULL = NULL) is not unique."""
    g = df.groupBy(*attrs).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).cast("bigint").alias("n"))


def orphan_rows(fact: DataFrame, fk: str, dim: DataFrame, key: str) -> DataFrame:
    """C4: fact rows whose FK has no parent (a NULL FK is an orphan)."""
    per_key = fact.groupBy(F.col(fk).alias("_k")).agg(F.count(F.lit(1)).alias("c"))
    parents = dim.select(F.col(key).alias("_k")).distinct()
    miss = per_key.join(parents, "_k", "left_anti")
    return miss.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n"))


def rule_unique_key(t: dict[str, DataFrame], table: str, bk: str) -> DataFrame:
    return log_row(duplicated_keys(t[table], [bk]), 1, table, CHECK_BK, MSG_BK)


def rule_unique_attributes(t: dict[str, DataFrame], table: str, bk: str, attrs=None) -> DataFrame:
    df = t[table]
    attrs = list(attrs) if attrs else [c for c in df.columns if c != bk]
    return log_row(rows_in_duplicate_groups(df, attrs), 2, table, CHECK_ATTR, MSG_ATTR)


def rule_composite_key(t: dict[str, DataFrame]) -> DataFrame:
    return log_row(duplicated_keys(t[FACT], FACT_KEYS), 3, FACT, CHECK_PK, MSG_PK)


def rule_foreign_key(t: dict[str, DataFrame], label: str, fk: str, dim: str, key: str) -> DataFrame:
    return log_row(orphan_rows(t[FACT], fk, t[dim], key), 4, FACT, CHECK_FK.format(label), MSG_FK)


def rule_row_predicates(t: dict[str, DataFrame]) -> DataFrame:
    """Rules 5-7 in one scan of the fact."""
    g, d = F.col("gross_revenue_per_day"), F.col("days_since_release")
    counts = t[FACT].agg(F.count_if(g < 0).alias("r5"), F.count_if(d < 0).alias("r6"),
                         F.count_if(g.isNotNull() & d.isNull()).alias("r7"))
    rows = [(5, "r5", CHECK_REV, MSG_REV), (6, "r6", CHECK_DAYS, MSG_DAYS),
            (7, "r7", CHECK_REV_DAYS, MSG_REV_DAYS)]
    out = None
    for rid, c, check, msg in rows:
        r = log_row(counts.select(F.col(c).alias("n")), rid, FACT, check, msg)
        out = r if out is None else out.unionByName(r)
    return out


def orphan_rows_all(t: dict[str, DataFrame], parents=PARENTS) -> DataFrame:
    """Rule 4 for every FK in one pass over the fact: each row is exploded
    into (fk name, key as text) pairs and counted — the shuffle carries one
    row per distinct key per FK, not the fact — then one outer join with
    the union of the tagged parent keys keeps those without a parent (Spark
    moves an anti join below the count, to every exploded row).  Returns
    (fk, n)."""
    fact = t[FACT]
    pairs = F.explode(F.array(*[F.struct(F.lit(fk).alias("fk"), F.col(fk).cast("string").alias("k"))
                                for _, fk, _, _ in parents]))
    per_key = (fact.select(pairs.alias("p")).select("p.*")
               .groupBy("fk", "k").agg(F.count(F.lit(1)).alias("c")))
    keys = None
    for _, fk, dim, key in parents:
        d = t[dim].select(F.lit(fk).alias("fk"), F.col(key).cast("string").alias("k"))
        keys = d if keys is None else keys.unionByName(d)
    # a NULL FK never has a parent
    miss = per_key.join(keys.distinct().withColumn("_parent", F.lit(True)), ["fk", "k"], "left").filter(F.col("_parent").isNull())
    return miss.groupBy("fk").agg(F.sum("c").cast("bigint").alias("n"))


def rule_foreign_keys(t: dict[str, DataFrame]) -> DataFrame:
    """Rule 4, five log rows from one pass (FKs without orphans -> 0)."""
    counts = orphan_rows_all(t)
    spark = t[FACT].sparkSession
    labels = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(fk).alias("fk"), F.lit(CHECK_FK.format(label)).alias("check"))
        for label, fk, _, _ in PARENTS])))
    n = labels.join(counts, "fk", "left").select("check", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return log_row(n, 4, FACT, F.col("check"), MSG_FK)


def rule_parts(t: dict[str, DataFrame]) -> list[DataFrame]:
    parts = [rule_unique_key(t, tb, bk) for tb, bk, _ in DIMENSIONS]
    parts += [rule_unique_attributes(t, tb, bk, attrs) for tb, bk, attrs in DIMENSIONS]
    parts.append(rule_composite_key(t))
    parts.append(rule_foreign_keys(t))
    parts.append(rule_row_predicates(t))
    return parts


def run_rules_eager(t: dict[str, DataFrame], parallelism: int = 8) -> DataFrame:
    """The 17 checks evaluated as concurrent Spark jobs (each returns at most
    5 rows — the log is bounded by the rule count) and assembled into one
    log frame."""
    from concurrent.futures import ThreadPoolExecutor

    from marquee.sources.schemas import LOG_QUALITY_CHECKS

    parts = rule_parts(t)
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(parts)))) as pool:
        rows = [r for rs in pool.map(lambda d: d.collect(), parts) for r in rs]
    return t[FACT].sparkSession.createDataFrame([tuple(r) for r in rows], LOG_QUALITY_CHECKS)


def run_rules(t: dict[str, DataFrame]) -> DataFrame:
    """The 17 logged checks (4 + 4 + 1 + 5 + 3), as one lazy plan."""
    parts = rule_parts(t)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class GateError(RuntimeError):
    pass


def unwaived(log: DataFrame, waivers=()) -> DataFrame:
    """Failed checks that no (id_check, etl_table) of ``waivers`` excuses."""
    out = log.filter(F.col("etl_result") == "FAIL")
    for i, table in waivers:
        out = out.filter((F.col("id_check") != int(i)) | (F.col("etl_table") != table))
    return out


def gate(log: DataFrame, waivers=()) -> list:
    """Stop the load unless every FAIL is waived.

    ``waivers`` = iterable of (id_check, etl_table).  The log has one row per
    rule (17), so collecting it is bounded.
    """
    fails = unwaived(log, waivers).collect()
    if fails:
        raise GateError("; ".join(f"rule {r['id_check']} on {r['etl_table']}: "
                                  f"{r['description_result'].strip()}" for r in fails))
    return fails


def r2_detail(t: dict[str, DataFrame], table: str = "stg_dim_film", attrs=FILM_ATTRS) -> DataFrame:
    """Rows of the dimension inside duplicate attribute groups, ordered
    by the first two attributes and the business key, the first column."""
    df = t[table]
    dup = (df.groupBy(*attrs).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > 1)
           .select(*[F.col(a).alias(f"_d_{a}") for a in attrs]))
    cond = None
    for a in attrs:
        c = df[a].eqNullSafe(dup[f"_d_{a}"])
        cond = c if cond is None else cond & c
    return df.join(dup, cond, "left_semi").orderBy(*attrs[:2], df.columns[0])


def r7_detail(t: dict[str, DataFrame]) -> DataFrame:
    """Facts with revenue but no days since release, with the title."""
    f = t[FACT].filter(F.col("gross_revenue_per_day").isNotNull() & F.col("days_since_release").isNull())
    film = t["stg_dim_film"]
    return f.join(film, f["fk_film"] == film["bk_film"]).select(
        "film_title", "fk_date", F.col("gross_revenue_per_day").cast("double").alias("gross_revenue_per_day"),
        "days_since_release").orderBy("film_title", "fk_date")


def dw_fk_check(w: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """Post-load join smoke check (first n facts by date, film key)."""
    f, d, film = w["fact_daily_box_office"], w["dim_date"], w["dim_film"]
    j = f.join(d, f["fk_date"] == d["sk_date"]).join(film, f["fk_film"] == film["sk_film"])
    return j.orderBy("fk_date", "fk_film").limit(n).select(
        "fk_date", "proper_date", F.col("gross_revenue_per_day").cast("double").alias("gross_revenue_per_day"),
        "days_since_release", "film_title")
