"""Exact quantiles of several columns by distributed selection.

``percentile`` and ``median`` as global aggregates bring every distinct value
to one reducer.  Here each wanted rank is found by narrowing: one pass counts
the values of every open interval in equal-width buckets (partial counts, so
little is shuffled), and the bucket that holds the rank, shrunk to its own
smallest and largest value, is the next interval.  An interval of one value is
an answer; one with few values is read.  Several columns and ranks share each
pass, and ranks in one bucket share its interval.  What reaches the driver is
bounded by the number of buckets and by ``READ``, not by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14                # of all open intervals of a pass together
READ = 1 << 14                   # values of all intervals that are read together


def _passed(rows: DataFrame, intervals: dict[int, tuple[float, float]], per: int) -> DataFrame:
    """(id, bucket, x) of the values in open intervals; the bucket is a
    rising function of the value, 0 at the low end, per - 1 at the high one."""
    table = rows.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in intervals.items()], "id int, lo double, hi double")
    half = F.lit(0.5)                # halves, so that no difference overflows
    share = (F.col("x") * half - F.col("lo") * half) / (F.col("hi") * half - F.col("lo") * half)
    bucket = F.least(F.floor(share * per).cast("int"), F.lit(per - 1))
    # one row per open interval, at most BUCKETS of them
    return rows.join(F.broadcast(table), "id").select("id", bucket.alias("bucket"), "x")


def order_statistics(df: DataFrame, wanted: Mapping[str, Sequence[int]], columns: Mapping[str, Column], ends: Mapping[str, tuple[int, float, float]]) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks of each column's non-null values, given
    (count, smallest, largest) of the columns."""
    names = [c for c in columns if wanted.get(c)]
    found: dict[tuple[str, int], float] = {}
    if not names:
        return found
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), columns[c].alias("x")) for i, c in enumerate(names)]))
    rows = df.select(cells.alias("cell")).select("cell.*").where("x is not null and not isnan(x)")
    # open intervals: id -> (column, rank of the first value, count, lo, hi, ranks)
    open_ = {i: (c, 0, *ends[c], sorted(set(wanted[c]))) for i, c in enumerate(names)}
    next_id = len(names)
    while True:
        for i in [i for i, (_, _, _, lo, hi, _) in open_.items() if lo == hi]:
            c, _, _, lo, _, ranks = open_.pop(i)
            found.update({(c, r): lo for r in ranks})
        if not open_:
            return found
        if sum(n for _, _, n, *_ in open_.values()) <= READ:
            ids = rows.sparkSession.createDataFrame([(i,) for i in open_], "id int")
            values: dict[int, list[float]] = {i: [] for i in open_}
            for r in rows.join(F.broadcast(ids), "id").collect():
                values[r["id"]].append(r["x"])
            for i, (c, first, _, _, _, ranks) in open_.items():
                values[i].sort()
                found.update({(c, r): values[i][r - first] for r in ranks})
            return found
        per = max(2, BUCKETS // len(open_))
        placed = _passed(rows, {i: (lo, hi) for i, (_, _, _, lo, hi, _) in open_.items()}, per)
        counts: dict[int, list] = {i: [] for i in open_}
        for r in placed.groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            counts[r["id"]].append((r["bucket"], r["n"], r["lo"], r["hi"]))
        kept, step = {}, []
        for i, (c, first, _, _, _, ranks) in open_.items():
            for bucket, n, lo, hi in sorted(counts[i]):
                here = [r for r in ranks if first <= r < first + n]
                if here:
                    kept[next_id] = (c, first, n, lo, hi, here)
                    step.append((i, bucket, next_id))
                    next_id += 1
                first += n
        down = rows.sparkSession.createDataFrame(step, "id int, bucket int, to int")
        rows = placed.join(F.broadcast(down), ["id", "bucket"]).select(F.col("to").alias("id"), "x")
        open_ = kept


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], columns: Mapping[str, Column] | None = None) -> dict[str, list[float | None]]:
    """Quantiles of each column at the probabilities given for it, with
    linear interpolation between neighbouring values, as ``percentile``.

    ``columns`` gives expressions for names that are not columns of ``df``.
    Nulls and NaN are not counted; a column without values has null quantiles.
    ``df`` is read once to begin with and once for each narrowing, so an
    expensive one should be a written table."""
    columns = {c: (columns or {}).get(c, F.col(c)).cast("double") for c in wanted}
    clean = {c: F.when(~F.isnan(x), x) for c, x in columns.items()}
    row = df.agg(*[f(x).alias(f"{p}{i}") for i, x in enumerate(clean.values()) for p, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    ends = {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(clean)}
    ranks = {c: sorted({r for p in ps for r in _neighbours(p, ends[c][0])}) for c, ps in wanted.items() if ends[c][0]}
    values = order_statistics(df, ranks, clean, ends)

    def quantile(c: str, p: float) -> float | None:
        n = ends[c][0]
        if not n:
            return None
        low, high = _neighbours(p, n)
        a, b, at = values[c, low], values[c, high], p * (n - 1)
        return a if a == b else (high - at) * a + (at - low) * b

    return {c: [quantile(c, p) for p in ps] for c, ps in wanted.items()}


def _neighbours(p: float, n: int) -> tuple[int, int]:
    at = p * (n - 1)
    return int(at), int(at) + (at > int(at))
