"""Incremental daily append (I1) into a bucketed fact, in batch or as a
Structured Streaming job.

The fact is bucketed and sorted on its composite key, so comparing a batch
with it moves only the batch: the batch is dealt into the same buckets and
merged with the loaded files where they lie.  A row whose key is loaded is
never appended, so files that are delivered again, and batches that are
replayed after a write that failed half way, add nothing that is there.

New daily files land in a folder; an ``availableNow`` trigger processes
whatever is there and stops.  Progress lives in the checkpoint folder, so a
restarted (or executor-lost) run resumes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.enrich import fresh_rows

FACT_KEYS = ["fk_date", "fk_film", "fk_production_company", "fk_director", "fk_actor"]


class FactStore:
    """Parquet files under ``path``, bucketed by ``keys``.

    The table is declared over the folder when it is first used in an
    application, so the files are all that has to survive.  ``buckets`` (the
    session's shuffle partitions if not given) must stay the same for the
    life of the folder."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys=FACT_KEYS, buckets: int | None = None):
        self.spark, self.keys, self.columns = spark, list(keys), schema.names
        self.name = f"fact_{hashlib.md5(path.encode()).hexdigest()}"
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        on = ", ".join(f"`{k}`" for k in self.keys)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet CLUSTERED BY ({on}) SORTED BY ({on}) INTO {n} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def fresh(self, batch: DataFrame, range_col: str | None = None) -> DataFrame:
        """Rows of ``batch`` whose key is not loaded (NULLs equal each
        other); of rows that share a key the least stays.

        With ``range_col``, one of the keys, a pushed-down filter reads only
        loaded rows inside the batch's span of it.  Rows without a NULL in
        their key meet the loaded files bucket by bucket; the others, if
        any, are compared with the loaded rows that have one."""
        bounds = [F.min(range_col), F.max(range_col)] if range_col else [F.lit(None), F.lit(None)]
        some_null = F.lit(False)
        for k in self.keys:
            some_null = some_null | F.col(k).isNull()
        lo, hi, nulls = batch.agg(*bounds, F.count_if(some_null)).first()
        loaded = self.read().select(*self.keys)
        near = loaded.filter(F.col(range_col).between(lo, hi)) if range_col and lo is not None else loaded
        known = batch.filter(~some_null).join(near.hint("merge"), self.keys, "left_anti")
        rest = [c for c in self.columns if c not in self.keys]
        row = F.struct(*rest) if rest else F.struct(F.lit(0))
        once = known.groupBy(*self.keys).agg(F.min(row).alias("_row"))
        out = once.select(*[F.col(c) if c in self.keys else F.col(f"_row.{c}").alias(c) for c in self.columns])
        if nulls:
            out = out.unionByName(fresh_rows(loaded.filter(some_null), batch.filter(some_null), self.keys).select(*self.columns))
        return out

    def append(self, batch: DataFrame, range_col: str | None = None) -> None:
        self.fresh(batch, range_col).select(*self.columns).write.insertInto(self.name)


def append_batch(batch: DataFrame, target_path: str, keys=FACT_KEYS, range_col: str = "fk_date", buckets: int | None = None) -> None:
    """Append the rows of one micro-batch whose key is not loaded yet.  Only
    the target's rows inside the batch's ``range_col`` span are compared, so
    the work per batch follows the batch, not the loaded history."""
    batch = batch.persist()
    try:
        FactStore(batch.sparkSession, target_path, batch.schema, keys, buckets).append(batch, range_col)
    finally:
        batch.unpersist()


def run_available(spark: SparkSession, source_dir: str, schema: T.StructType, target_path: str,
                  checkpoint: str, keys=FACT_KEYS, buckets: int | None = None):
    """Process every file currently in ``source_dir`` and stop."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    q = (stream.writeStream.foreachBatch(lambda df, _epoch: append_batch(df, target_path, keys, buckets=buckets))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
