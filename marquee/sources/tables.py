"""Driver-table readers.  Column lists are passed down so the Parquet scan
only reads what a plan needs (Catalyst would prune anyway; being explicit
keeps ``ReadSchema`` minimal even through ``unionByName`` and caching)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def load_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in names}


def once(tables: Mapping[str, DataFrame], name: str, columns: list[str]) -> DataFrame:
    """Columns of a table for a reader that goes over it once: what ``rows``
    of a ``plans.warehouse.Warehouse`` gives; from other mappings the table's."""
    rows = getattr(tables, "rows", None)
    return rows(name, columns) if rows else tables[name].select(*columns)
