"""Readers, sinks and schema-conformance steps.

Everything here works on the schema (driver metadata) or returns lazy
DataFrames; nothing collects rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.sources.schemas import MAX_LENGTH


class SchemaError(ValueError):
    pass


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """A1/A2: typed CSV read, no inference; malformed cells become NULL."""
    return (spark.read.option("header", header).option("mode", "PERMISSIVE")
            .schema(schema).csv(path))


def require_columns(df: DataFrame, cols) -> DataFrame:
    """Fail before any job when an expected column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    return df


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add every column of ``schema`` that ``df`` lacks as a typed NULL."""
    add = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(add) if add else df


def first_present(df: DataFrame, aliases) -> str | None:
    """First alias present in the frame (``Studio``, ``Distributor``, ...)."""
    lower = {c.lower(): c for c in df.columns}
    for a in aliases:
        if a in df.columns:
            return a
        if a.lower() in lower:
            return lower[a.lower()]
    return None


def _cast(c: Column, t: T.DataType) -> Column:
    return c.try_cast(t) if hasattr(c, "try_cast") else c.cast(t)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A4: project to the table layout with safe casts.  A NULL where the
    layout has none, or a value longer than its VARCHAR limit, fails the job
    through ``raise_error``."""
    df = ensure_columns(df, schema)
    cols = []
    for f in schema.fields:
        c = _cast(F.col(f.name), f.dataType)
        limit = MAX_LENGTH.get(f.name)
        if limit is not None and isinstance(f.dataType, T.StringType):
            c = F.when(F.length(c) > F.lit(limit), F.raise_error(F.lit(f"{f.name} longer than {limit}"))).otherwise(c)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{f.name} is NULL")).cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def split_entities(df: DataFrame, spec: dict[str, list[str]]) -> dict[str, DataFrame]:
    """A10: split one consolidated frame into entity frames.

    ``spec`` maps entity name to its columns, the business key first.  Each
    entity is the distinct projection (a partial-aggregate shuffle on the
    projected columns, so the consolidated frame is never moved whole).
    """
    return {name: df.select(*cols).distinct() for name, cols in spec.items()}


def tagged_entities(df: DataFrame, spec: dict[str, list[str]]) -> DataFrame:
    """A10 in one pass: the distinct rows of all entities as (entity, and one
    struct column per entity, filled for its own rows).

    One scan of ``df`` emits a row per entity, repeats are dropped within the
    tasks, and one shuffle drops the rest."""
    def value(name: str, own: str) -> Column:
        row = F.struct(*[F.col(c) for c in spec[name]])
        return (row if name == own else F.when(F.lit(False), row)).alias(name)
    rows = [F.struct(F.lit(own).alias("entity"), *[value(name, own) for name in spec]) for own in spec]
    return df.select(F.explode(F.array(*rows)).alias("row")).select("row.*").distinct()


ROWS = "daily"                   # the entity at the grain of the rows
TASK_ROWS = 1 << 18              # rows of a wide table that one task holds


def row_tasks(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks that rows of a written table are dealt to."""
    return max(1, -(-df.count() // rows))


def dealt_entities(df: DataFrame, spec: dict[str, list[str]], tasks: int) -> DataFrame:
    """The rows of ``tagged_entities`` for a written table, which is read
    twice, in the columns that are needed.

    The entities that have few rows for many of ``df`` are split from its
    distinct rows in their columns, which are reduced within the tasks.  The
    rows of ``ROWS`` are mostly distinct: they are dealt out first, so that no
    task holds more of them than its share."""
    few = {name: cols for name, cols in spec.items() if name != ROWS}
    out = []
    if few:
        out.append(tagged_entities(df.select(*dict.fromkeys(c for cols in few.values() for c in cols)).distinct(), few))
    if ROWS in spec:
        rows = df.select(*spec[ROWS]).repartition(tasks, *spec[ROWS]).distinct()
        out.append(rows.select(F.lit(ROWS).alias("entity"), F.struct(*spec[ROWS]).alias(ROWS)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out).select("entity", *spec)


def write_entities(df: DataFrame, spec: dict[str, list[str]], path: str) -> dict[str, DataFrame]:
    """A10: the entities of a written table, written once, a folder each, and
    read back."""
    write_table(dealt_entities(df, spec, row_tasks(df)), path, partition_by=["entity"])
    written = df.sparkSession.read.parquet(path)
    return {name: written.filter(F.col("entity") == name).select(f"{name}.*") for name in spec}


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet sink (no Delta jar in this image)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_log(log: DataFrame, path: str) -> None:
    """Append the DQ rows of one validation run in a single write."""
    log.write.mode("append").parquet(path)
