"""Sharding by fixed virtual slots.

Every record hashes into one of thousands of slots; bytes and rows are summed
per slot; a small versioned table maps slots to shards.  Rebalancing edits
that table: slots move, the hash of a record never changes.  The law kept is
``bytes``: the shards' sizes are near equal.

A slot heavier than a small share of a shard (a repeated id, many rows
without one) is split into a fixed number of parts, dealt by row; the map has
an entry for each part.  The number of parts is bounded, so the map is too:
at most ``slots + split * HEAVY * shards`` entries, whatever the table's size.
Only those entries reach the driver.

Results for odd input: null texts have size 1 and the crc32 of the empty
string; rows with a null doc_id are dealt by their content; repeated rows are
kept, each with its own place; very long texts are never cut, so one that
outweighs a shard has a shard nearly to itself; an empty table gives no rows
and a map of empty slots; other columns are not read.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.session import checkpoint_dir, materialize

SLOTS = 8192                     # virtual slots, fixed for the life of a map
SPLIT = 64                       # parts of a heavy slot
HEAVY = 16                       # a slot is heavy beyond 1/HEAVY of a shard's fair share
TOLERANCE = 1e-4                 # rebalancing ends within this share of the fair size
MAP_SCHEMA = "slot int, part int, shard int, rows long, bytes long"


@dataclass
class SlotMap:
    """One version of the map, as entries (slot, part) -> [shard, rows,
    bytes]; part is -1 for a slot that is not split."""
    version: int
    entries: dict[tuple[int, int], list[int]]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s, p, *v) for (s, p), v in sorted(self.entries.items())], MAP_SCHEMA)


def store(spark: SparkSession, m: SlotMap, folder: str) -> None:
    """Write a version; versions are never overwritten."""
    m.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={m.version:06d}")


def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{folder}/version={version:06d}").collect()
    return SlotMap(version, {(r["slot"], r["part"]): [r["shard"], r["rows"], r["bytes"]] for r in rows})


def _sizes(m: SlotMap, shards: int) -> list[int]:
    out = [0] * shards
    for shard, _, size in m.entries.values():
        out[shard] += size
    return out


def rebalance(m: SlotMap, shards: int, only_into: int | None = None) -> SlotMap:
    """The next version: entries move from the fullest shard to emptier ones,
    or change places with theirs, while that narrows the gap between the two.
    With ``only_into`` entries move into that shard alone, as after growth by
    one shard.  Deterministic; few entries move when little has changed."""
    entries = {k: list(v) for k, v in m.entries.items()}
    held = [sorted((v[2], k) for k, v in entries.items() if v[0] == s and v[2]) for s in range(shards)]
    sizes = [sum(b for b, _ in h) for h in held]
    enough = TOLERANCE * sum(sizes) / shards

    def move(key: tuple[int, int], source: int, target: int) -> None:
        size = entries[key][2]
        at = bisect_left(held[source], (size, key))
        held[source].pop(at)
        held[target].insert(bisect_left(held[target], (size, key)), (size, key))
        entries[key][0] = target
        sizes[source] -= size
        sizes[target] += size

    def narrowed(source: int, target: int) -> bool:
        gap = sizes[source] - sizes[target]
        if gap <= enough:
            return False
        best = (gap, None, None)     # what is left of the gap, what moves there, what comes back
        at = bisect_left(held[source], (gap // 2, (-1, -1)))
        for size, key in held[source][max(0, at - 1):at + 1]:
            best = min(best, (abs(gap - 2 * size), key, None), key=lambda b: b[0])
        if only_into is None and best[0] > enough:
            for size, key in held[source]:
                at = bisect_left(held[target], (size - gap // 2, (-1, -1)))
                for back, other in held[target][max(0, at - 1):at + 1]:
                    best = min(best, (abs(gap - 2 * (size - back)), key, other), key=lambda b: b[0])
        if best[1] is None:
            return False
        move(best[1], source, target)
        if best[2] is not None:
            move(best[2], target, source)
        return True

    def edit() -> bool:
        full = sorted(range(shards), key=lambda s: -sizes[s])
        if only_into is not None:
            return any(narrowed(s, only_into) for s in full if s != only_into)
        return any(narrowed(full[0], t) for t in reversed(full[1:])) or any(narrowed(s, full[-1]) for s in full[1:-1])

    while edit():
        pass
    return SlotMap(m.version + 1, entries)


def grow(m: SlotMap, shards: int) -> SlotMap:
    """The map for one shard more than ``shards``: rows move only into it."""
    return rebalance(m, shards + 1, only_into=shards)


def _crc() -> Column:
    return F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).cast("long")


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), _crc().cast("string")))), F.lit(slots)).cast("int")


def _share() -> Column:
    """The part that a row has if its slot is split."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SPLIT)).cast("int")


def _part(m: SlotMap) -> Column:
    split = sorted({s for s, p in m.entries if p >= 0})
    return (F.when(F.col("slot").isin(split), F.col("part")).otherwise(-1) if split else F.lit(-1)).cast("int")


def tag(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, slot, part) of every row, written."""
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1
    rows = docs.select("doc_id", size.cast("long").alias("size"), _crc().alias("text_crc32"), _slot(slots).alias("slot"), _share().alias("part"))
    return materialize(rows, "slots-tagged")


def with_shard(docs: DataFrame, m: SlotMap, slots: int = SLOTS) -> DataFrame:
    """``docs`` with all its columns and the shard that the map gives each
    row, as for writing the shards; a column named shard is replaced."""
    table = m.frame(docs.sparkSession).select("slot", "part", "shard")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "shard"]).alias("row"), _slot(slots).alias("slot"), _share().alias("part"))
    return rows.withColumn("part", _part(m)).join(F.broadcast(table), ["slot", "part"]).select("row.*", "shard")


def start(tagged: DataFrame, shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: slots dealt in turn, heavy ones by part, with their rows
    and bytes."""
    per = materialize(tagged.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")), "slots-parts")
    whole = per.groupBy("slot").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    stats = {r["slot"]: (r["rows"], r["bytes"]) for r in whole.collect()}        # at most one row a slot
    limit = sum(b for _, b in stats.values()) / (shards * HEAVY)
    heavy = sorted(s for s, (n, b) in stats.items() if b > limit and n > 1)       # at most HEAVY * shards
    entries = {(s, -1): [s % shards, *stats.get(s, (0, 0))] for s in range(slots) if s not in set(heavy)}
    for r in per.where(F.col("slot").isin(heavy)).collect() if heavy else []:
        entries[r["slot"], r["part"]] = [(r["slot"] + r["part"]) % shards, r["rows"], r["bytes"]]
    return SlotMap(1, entries)


def place(tagged: DataFrame, m: SlotMap) -> DataFrame:
    """Every row with its shard and its place there, gapless from 0: the
    rows before its entry in the shard, and its number within the entry."""
    before, entries = {}, []
    for (slot, part), (shard, rows, _) in sorted(m.entries.items()):
        entries.append((slot, part, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + rows
    spark = tagged.sparkSession
    table = spark.createDataFrame(entries, "slot int, part int, shard int, first long")
    rows = tagged.withColumn("part", _part(m))
    number = F.row_number().over(Window.partitionBy("slot", "part").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("number", number - 1)
    # bounded by the number of entries, see above
    return numbered.join(F.broadcast(table), ["slot", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("number")).cast("long").alias("place"), F.col("slot").alias("virtual_slot"), "part")


def shard(docs: DataFrame, shards: int, folder: str | None = None, slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """Deal ``docs`` (doc_id, text) into ``shards``: the rows of ``place``,
    and the map, whose versions (as dealt, as rebalanced) are stored under
    ``folder`` (a new one in the checkpoint folder if not given)."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    tagged = tag(docs, slots)
    first = start(tagged, shards, slots)
    store(spark, first, folder)
    even = rebalance(first, shards)
    store(spark, even, folder)
    return place(tagged, even), even
