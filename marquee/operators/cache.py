"""A stored cache under keys (A7, C16): hash-bucketed folders, of which an
upsert rewrites only those that it touches.

An entry lies in the folder of its key's hash.  An upsert reads the folders
that its new entries fall into, merges them (new entries win), and overwrites
just these folders (dynamic partition overwrite).  It may be repeated after a
failure: the same entries give the same folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.enrich import cache_hits, cache_upsert
from marquee.session import materialize

BUCKET = "cache_bucket"


class KeyedCache:
    """Entries with the columns of ``schema``, one per value of ``keys``
    (NULLs equal); of new entries with equal keys the first by ``tie`` stays.
    ``buckets`` must stay the same for the life of the folder."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], tie: list[str], buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.tie, self.buckets = list(keys), list(tie), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast(self.schema[k].dataType) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        """All entries with their bucket; none before the first upsert."""
        full = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def hits(self, rows: DataFrame, value: str) -> DataFrame:
        """``rows`` with ``cached_<value>`` and ``cache_hit``."""
        return cache_hits(rows, self.read(), self.keys, value)

    def upsert(self, new: DataFrame) -> None:
        new = materialize(new.select(*self.schema.names).withColumn(BUCKET, self._bucket()), "cache-new")
        touched = [r[BUCKET] for r in new.select(BUCKET).distinct().collect()]       # at most ``buckets``
        if not touched:
            return
        old = self._stored().filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
        # written apart before the folders that it was read from are replaced
        merged = materialize(cache_upsert(old, new.drop(BUCKET), self.keys, self.tie).withColumn(BUCKET, self._bucket()), "cache-merged")
        merged.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
