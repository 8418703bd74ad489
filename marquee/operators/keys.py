"""Surrogate keys, key lookups and keep-first dedup.

``surrogate_key`` gives exactly ``row_number() OVER (ORDER BY bk)`` without
the single-partition window Spark would plan for it:

1. range-partition on the key and sort inside each partition;
2. tag rows with ``monotonically_increasing_id`` = partition index << 33 |
   position, in the same stage as the sort, so the position inside the
   sorted partition is free;
3. write that frame once under the shared checkpoint folder: the tags are
   fixed on disk (range sampling must not re-run on a recompute or after a
   lost executor) and lineage is cut;
4. per-partition row counts (one row per partition — bounded by the
   partition count, not the data) -> running offsets -> broadcast join.

Only step 1 shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import materialize

_POS_BITS = 33


def surrogate_key(df: DataFrame, bk: str | list[str], name: str,
                  num_partitions: int | None = None, dtype: str = "int") -> DataFrame:
    keys = [bk] if isinstance(bk, str) else list(bk)
    order = [F.col(k).asc_nulls_first() for k in keys]
    # Without an explicit count AQE may merge adjacent range partitions
    # (contiguous reducer ranges keep the global order), so a small
    # dimension is not written as thousands of tiny files.
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    tagged = (ranged.sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = materialize(tagged, f"sk-{name}")
    mid = F.col("_mid")
    pos = tagged.select(*[F.col(c) for c in df.columns],
                        mid.bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("_pos"),
                        F.shiftright(mid, _POS_BITS).alias("_pid"))
    counts = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_off"))
    # one row per partition: the broadcast is bounded by the partition count
    out = pos.join(F.broadcast(offsets), "_pid")
    return out.select((F.col("_off") + F.col("_pos") + 1).cast(dtype).alias(name),
                      *[F.col(c) for c in df.columns])


def lookup_keys(fact: DataFrame, lookups: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Replace business FKs by surrogate keys with inner equi-joins.

    ``lookups`` = [(fk_column, dim, bk_column, sk_column)].  Join strategy is
    left to AQE (dimension sizes are only known at run time).  Orphans drop
    out, as in the warehouse load; rule 4 reports them beforehand.
    """
    cols = fact.columns
    out = fact
    for fk, dim, bk, sk in lookups:
        d = dim.select(F.col(bk).alias(f"_bk_{fk}"), F.col(sk).alias(f"_sk_{fk}"))
        out = out.join(d, out[fk] == d[f"_bk_{fk}"], "inner")
    return out.select(*[F.col(f"_sk_{c}").alias(c) if any(c == fk for fk, *_ in lookups) else F.col(c)
                        for c in cols])


def keep_first(df: DataFrame, keys: list[str], order: list[Column], descending: bool = False) -> DataFrame:
    """One row per key, the first by ``order`` (deterministic).

    Written as an aggregate (``min_by``/``max_by`` of the whole row) rather
    than a ``row_number`` window, so partial aggregation runs map-side and a
    hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    pick = F.max_by if descending else F.min_by
    agg = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row"))
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
