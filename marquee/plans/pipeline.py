"""Pipeline glue (Q1-Q3, A8): stage -> validate (log + gate) -> load.

Each stage reads and writes Parquet tables under ``root`` with overwrite
semantics, so any stage can be re-run on its own and a full re-run gives
the same tables (surrogate keys are deterministic).  Writes go dimensions
first, then the fact, as the reference's clear-and-reload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import quality
from marquee.plans import warehouse
from marquee.sources import adapter
from marquee.sources.io import append_log
from marquee.sources.schemas import LOG_QUALITY_CHECKS, STAGING, WAREHOUSE

STAGING_DIR, DW_DIR, LOG_DIR = "staging", "dw", "log_quality_checks"


FACT_YEAR = "fact_year"  # directory partition of the written fact (fk_date div 10000)


def _read(spark: SparkSession, root: str, sub: str, names) -> dict[str, DataFrame]:
    """Read written tables back in their registry layout (the fact's year
    partition column is dropped; a filter on fk_date still prunes by it
    when the caller also filters ``fact_year``)."""
    out = {}
    for n, schema in names.items():
        df = spark.read.parquet(f"{root.rstrip('/')}/{sub}/{n}")
        out[n] = df.select(*[f.name for f in schema.fields])
    return out


def stage(spark: SparkSession, sf_dir: str, root: str, dirty: bool = False) -> dict[str, DataFrame]:
    """Q2: build the staging tables from the sources and write them."""
    make = adapter.dirty_staging if dirty else adapter.staging
    stg = warehouse.load_staging(make(spark, sf_dir))
    warehouse.persist_tables(stg, f"{root.rstrip('/')}/{STAGING_DIR}")
    return _read(spark, root, STAGING_DIR, STAGING)


def validate(spark: SparkSession, root: str, waivers=(), run_id: int | None = None) -> DataFrame:
    """17 rules over the written staging tables, appended to the log (one
    write), then the gate: raises unless every FAIL is waived."""
    stg = _read(spark, root, STAGING_DIR, STAGING)
    log_rows = quality.run_rules_eager(stg).select(*[F.col(f.name) for f in LOG_QUALITY_CHECKS.fields])
    if run_id is not None:
        log_rows = log_rows.withColumn("run_id", F.lit(run_id))
    append_log(log_rows, f"{root.rstrip('/')}/{LOG_DIR}")
    quality.gate(log_rows, waivers)
    return log_rows


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Dimensions with surrogate keys, then the fact, overwritten."""
    stg = _read(spark, root, STAGING_DIR, STAGING)
    dims = warehouse.load_dimensions(stg)
    fact = warehouse.load_fact(stg["stg_fact_daily_box_office"], dims)
    fact = fact.withColumn(FACT_YEAR, (F.col("fk_date") / 10000).cast("int"))
    tables = {**dims, "fact_daily_box_office": fact}
    warehouse.persist_tables(tables, f"{root.rstrip('/')}/{DW_DIR}", fact_partition=FACT_YEAR)
    return _read(spark, root, DW_DIR, WAREHOUSE)


def run_all(spark: SparkSession, sf_dir: str, root: str, waivers=(), dirty: bool = False) -> dict[str, DataFrame]:
    """Q1: stage -> validate -> load; the gate stops the load on an
    unwaived failure."""
    stage(spark, sf_dir, root, dirty)
    validate(spark, root, waivers)
    return load(spark, root)
