"""Random forest and multiclass boosting over binned rows, all
cross-validation folds at once.

The rows frame has (key long, label int, fold int, bins binary): ``key``
tells rows apart for the random draws, ``label`` is -1 for rows to be
predicted only, ``bins`` holds a 32-bit bin for each column.  With ``folds``
folds there are folds + 1 fits: fit f leaves out fold f, the last one uses
all labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.trees import DRAWN_BITS, FIXED, Columns, Grown, Held, Rule, Trees, as_poisson, as_uniform, grow, hashed, held_tree, packed, poisson, rehashed, uniform, unpacked
from marquee.session import materialize

PARTITION_ROWS = 1 << 14
LEAST_ROWS = 1 << 11             # of a partition, where there are fewer than cores
KEEP_ROUNDS = 10                 # rounds after which the scores are written
BLOCK_TREES = 100                # of a forest whose shares are added up together
SCORED = "key long, label int, fold int, bins binary, scores binary"
GROWN = "slot int, tree int, chunk long, payload binary"


@dataclass(frozen=True)
class Sample:
    """Numbers of labelled rows by (fold, class); fit f trains on the folds
    other than f."""
    counts: tuple[tuple[int, ...], ...]

    @property
    def folds(self) -> int:
        return len(self.counts)

    @property
    def classes(self) -> int:
        return len(self.counts[0])

    def of_fit(self, fit: int) -> np.ndarray:
        table = np.array(self.counts)
        return table.sum(0) - (table[fit] if fit < self.folds else 0)


def sample_of(rows: DataFrame, folds: int, classes: int) -> Sample:
    table = np.zeros((folds, classes), int)
    for r in rows.where("label >= 0").groupBy("fold", "label").count().collect():
        table[r["fold"], r["label"]] = r["count"]
    return Sample(tuple(map(tuple, table.tolist())))


def partitioned(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(max(1, -(-n // PARTITION_ROWS), min(_tasks(rows), -(-n // LEAST_ROWS))), "key")


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, label, fold, bins) of a batch; bins are columns x rows."""
    bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4").reshape(-1, width).T
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.ascontiguousarray(bins)


def _tasks(rows: DataFrame) -> int:
    return rows.sparkSession.sparkContext.defaultParallelism


# ------------------------------------------------------------ held tables
@dataclass
class HeldRows:
    """The rows of a whole table."""
    key: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    bins: np.ndarray | None          # columns x rows

    def learnt(self, fit: int) -> np.ndarray:
        """Whether the fit learns from a row."""
        return (self.label >= 0) & (self.fold != fit)


def _held(payloads: list[bytes], width: int) -> tuple[HeldRows, list[int]]:
    """The rows of packed batches, and the number of rows of each."""
    parts = []
    for payload in payloads:
        n = int(np.frombuffer(payload, "<u4", 1)[0])
        bins, marks = unpacked(payload[8 * n + 4:], width, 2)
        parts.append((np.frombuffer(payload, "<i8", n, 4), marks.astype(np.int32), bins.astype("<i4")))
    key, marks = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return HeldRows(key, marks[:, 0], marks[:, 1], np.concatenate([p[2] for p in parts], 1)), [len(p[0]) for p in parts]


def _by_slot(rows: DataFrame, width: int, slots: int, work: Callable, name: str) -> DataFrame:
    """What ``work`` makes of all rows in one task for each slot: GROWN rows
    (slot, tree, None, a tree) and (slot, None, chunk, scores of its rows),
    and once (-1, None, chunk, its rows as an Arrow batch).

    ``work`` is given (slot, HeldRows) and yields (tree, Grown) and, last,
    the scores (rows x any number)."""
    def send(batches) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            key, label, fold, bins = _read(batch, width)
            payload = np.uint32(len(key)).tobytes() + key.astype("<i8").tobytes() + packed(bins, np.stack([label, fold], 1))
            for slot in range(slots):
                yield _grown([(slot, None, task << 32 | number, payload)])

    def grow_slot(batches) -> Iterator[pa.RecordBatch]:
        sent: dict[int, dict[int, bytes]] = {}
        for batch in batches:
            for slot, _, chunk, payload in zip(*(c.to_pylist() for c in batch.columns)):
                sent.setdefault(slot, {})[chunk] = payload
        for slot, chunks in sent.items():
            order = sorted(chunks)
            if slot == 0:
                for chunk in order:
                    yield _grown([(-1, None, chunk, chunks[chunk])])
            held, sizes = _held([chunks.pop(chunk) for chunk in order], width)
            for tree, made in work(slot, held):
                if tree is not None:
                    yield _grown([(slot, tree, None, made.payload())])
                    continue
                ends = np.cumsum(sizes)
                for chunk, size, end in zip(order, sizes, ends.tolist()):
                    yield _grown([(slot, None, chunk, np.ascontiguousarray(made[end - size:end], "<f8").tobytes())])

    sent = rows.mapInArrow(send, GROWN).repartitionById(slots, F.col("slot"))
    return materialize(sent.mapInArrow(grow_slot, GROWN), name)


def _grown(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["slot", "tree", "chunk", "payload"])


def _trees_of(made: DataFrame, count: int, rule: Rule, n_stats: int) -> Trees:
    """Trees 0 to count - 1; a tree that was not grown stays a leaf of zeros."""
    trees, size = _no_trees(count, rule, n_stats), 1 << rule.depth + 1
    grown = made.where("tree is not null").select("tree", "payload").toArrow()
    for tree, payload in zip(grown["tree"].to_pylist(), grown["payload"]):
        payload = payload.as_py()
        trees.column[tree] = np.frombuffer(payload, np.int32, size)
        trees.cut[tree] = np.frombuffer(payload, np.int32, size, 4 * size)
        trees.stats[tree] = np.frombuffer(payload, np.int64, size * n_stats, 8 * size).reshape(size, n_stats)
        trees.gain[tree] = np.frombuffer(payload, np.float64, size, 8 * size + 8 * size * n_stats)
    return trees


def _rejoined(made: DataFrame, width: int, n: int, scores: Callable) -> DataFrame:
    """SCORED rows: ``scores`` of what all slots say, in their order."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        rows, parts = None, []

        def joined() -> pa.RecordBatch:
            held = _held([rows], width)[0]
            plain = pa.RecordBatch.from_arrays([pa.array(held.key), pa.array(held.label, pa.int32()), pa.array(held.fold, pa.int32()), pa.array([b.tobytes() for b in np.ascontiguousarray(held.bins.T, "<i4")], pa.binary())], names=["key", "label", "fold", "bins"])
            return _scored(plain, scores([np.frombuffer(p, "<f8").reshape(len(held.key), -1) for p in parts]))
        for batch in batches:
            for slot, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if slot >= 0:
                    parts.append(payload)
                    continue
                if rows is not None:
                    yield joined()
                rows, parts = payload, []
        if rows is not None:
            yield joined()

    said = made.where("tree is null").repartition(max(1, -(-n // PARTITION_ROWS)), "chunk").sortWithinPartitions("chunk", "slot")
    return said.select("slot", "payload").mapInArrow(run, SCORED)


# ------------------------------------------------------------ forest
@dataclass
class Forest:
    trees: Trees                     # of fit f: f * count to (f + 1) * count - 1
    count: int
    weights: np.ndarray              # fit x class

    def leaves(self) -> np.ndarray:
        """Class shares of every node, tree x node x class."""
        return leaf_shares(self.trees.stats, np.repeat(self.weights, self.count, 0)[:, None, :])

    def importances(self, fit: int) -> np.ndarray:
        """Mean over trees of each feature's share of the impurity decrease,
        by cell."""
        own = slice(fit * self.count, (fit + 1) * self.count)
        return _importances(self.trees, own, self.base, True)

    base: np.ndarray = None


def _importances(trees: Trees, own, base: np.ndarray, per_tree: bool) -> np.ndarray:
    """An ordered column counts in its first cell, a value in its own."""
    out = np.zeros(base[-1])
    for column, cut, gain in zip(trees.column[own], trees.cut[own], trees.gain[own]):
        inner = column >= 0
        cell = base[column[inner]] + np.where(trees.ordered[column[inner]], 0, cut[inner])
        total = gain[inner].sum() if per_tree else 1.0
        if total > 0:
            out += np.bincount(cell, gain[inner] / total, len(out))
    return out / out.sum() if out.sum() > 0 else out


def _forest_rule(sample: Sample, columns: Columns, count: int, depth: int, min_leaf: int, seed: int, limits: dict) -> tuple[np.ndarray, np.ndarray, Rule]:
    """(rows by fit and class, class weights by fit, rule).  Classes are
    weighted by n / (classes * class size), and each node looks at about the
    square root of the features."""
    sizes = np.array([sample.of_fit(f) for f in range(sample.folds + 1)])
    weights = sizes.sum(1, keepdims=True) / (sample.classes * np.maximum(sizes, 1))
    features = sum(1 if o else s for s, o in zip(columns.sizes, columns.ordered))
    return sizes, weights, Rule("gini", columns, depth, min_leaf, np.repeat(weights, count, 0), int(features ** 0.5) / features, seed, **limits)


def train_forest(rows: DataFrame, sample: Sample, columns: Columns, count: int, depth: int, min_leaf: int, seed: int, **limits) -> Forest:
    """``count`` trees for every fit, from rows that are drawn with Poisson(1)
    counts by (row, tree)."""
    return scored_forest(rows, sample, columns, count, depth, min_leaf, seed, **limits)[0]


def scored_forest(rows: DataFrame, sample: Sample, columns: Columns, count: int, depth: int, min_leaf: int, seed: int, **limits) -> tuple[Forest, DataFrame]:
    """The forest, and the rows with the class shares of every fit.

    A table of at most ``held_rows`` is sent whole to tasks that each grow a
    block of the trees of a fit and place the rows in them; otherwise all
    trees grow in shared passes.  Both ways give the same trees and scores."""
    fits, classes, width = sample.folds + 1, sample.classes, len(columns.sizes)
    sizes, weights, rule = _forest_rule(sample, columns, count, depth, min_leaf, seed, limits)
    blocks, n = _blocks(count), rows.count()
    if 0 < n <= rule.held_rows:
        def work(slot: int, held: HeldRows) -> Iterator[tuple]:
            fit, block = divmod(slot, len(blocks))
            learnt, shares = held.learnt(fit), np.zeros((classes, n))
            table, of_key = Held(held.bins, columns, np.maximum(held.label, 0), classes), hashed(seed, held.key)
            held.bins = None
            for t in range(fit * count + blocks[block].start, fit * count + blocks[block].stop):
                drawn = np.where(learnt, as_poisson(rehashed(of_key, 2, t)), 0)
                weight = np.where(drawn > 0, drawn * float(1 << DRAWN_BITS) + 1, 0.0)

                def sums(rows=None) -> np.ndarray:
                    both = table.sums(weight, rows).astype(np.int64)
                    return np.concatenate([(both & (1 << DRAWN_BITS) - 1).sum(1, keepdims=True), both >> DRAWN_BITS], 1)
                grown = held_tree(table, rule, t, sums(), sums, 1 + classes)
                own = leaf_shares(grown.stats, weights[fit])
                at = np.empty(n, np.intp)
                for node, there in grown.leaves:
                    at[slice(None) if there is None else there] = node
                for c in range(classes):
                    shares[c] += own[:, c].take(at)
                yield t, grown
            yield None, shares.T

        made = _by_slot(rows, width, fits * len(blocks), work, "forest-blocks")
        forest = Forest(_trees_of(made, fits * count, rule, 1 + classes), count, weights, columns.base)

        def scores(parts: list[np.ndarray]) -> np.ndarray:
            return np.concatenate([_block_mean(parts[f * len(blocks):(f + 1) * len(blocks)], count) for f in range(fits)], 1)
        return forest, materialize(_rejoined(made, width, n, scores), "forest-scores")

    def members(batch):
        key, label, fold, bins = _read(batch, width)

        def each() -> Iterator[tuple]:
            for fit in range(fits):
                own = np.flatnonzero((label >= 0) & (fold != fit))
                one_hot = np.eye(classes, dtype=np.int64)[label[own]]
                for t in range(fit * count, (fit + 1) * count):
                    drawn = poisson(seed, key[own], t)
                    here = np.flatnonzero(drawn)
                    yield t, own[here], np.concatenate([np.ones((len(here), 1), np.int64), one_hot[here] * drawn[here, None]], 1)
        return bins, each()

    trees = grow(rows, members, {t: int(sizes[t // count].sum()) for t in range(fits * count)}, rule, 1 + classes, _tasks(rows))
    forest = Forest(trees, count, weights, columns.base)
    return forest, materialize(forest_scores(rows, forest, width), "forest-scores")


def leaf_shares(stats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Class shares of nodes."""
    mass = stats[..., 1:] * weights
    return mass / np.maximum(mass.sum(-1, keepdims=True), 1e-300)


def _blocks(count: int) -> list[range]:
    return [range(start, min(start + BLOCK_TREES, count)) for start in range(0, count, BLOCK_TREES)]


def _block_mean(sums: list[np.ndarray], count: int) -> np.ndarray:
    """Mean of trees from the sums of their blocks, added in their order."""
    return np.sum(sums, 0) / count


def forest_scores(rows: DataFrame, forest: Forest, width: int) -> DataFrame:
    """Class shares of every fit: rows with ``scores`` (fit x class)."""
    model = rows.sparkSession.sparkContext.broadcast((forest.trees.column, forest.trees.cut, forest.trees.ordered, forest.leaves()))
    count = forest.count

    def run(batches) -> Iterator[pa.RecordBatch]:
        column, cut, ordered, leaves = model.value
        trees = Trees(column, cut, None, None, ordered)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                bins = _read(part, width)[3]
                shares = []
                for fit in range(len(column) // count):
                    sums = []
                    for block in _blocks(count):
                        own = fit * count + np.array(block)
                        sums.append(leaves[own[:, None], trees.positions(bins, own)].sum(0))
                    shares.append(_block_mean(sums, count))
                yield _scored(part, np.concatenate(shares, 1))

    return rows.mapInArrow(run, SCORED)


def _scored(batch: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([s.tobytes() for s in np.ascontiguousarray(scores, "<f8")], pa.binary())], names=["key", "label", "fold", "bins", "scores"])


# ------------------------------------------------------------ boosting
@dataclass
class Boosting:
    rounds: list[Trees]              # tree of fit f and class c: f * classes + c
    classes: int
    start: np.ndarray                # fit x class
    base: np.ndarray

    def importances(self, fit: int) -> np.ndarray:
        own = slice(fit * self.classes, (fit + 1) * self.classes)
        out = sum(_importances(t, own, self.base, False) * t.gain[own].sum() for t in self.rounds)
        return out / out.sum() if len(self.rounds) and out.sum() > 0 else out


def leaf_values(stats: np.ndarray, classes: int) -> np.ndarray:
    """The Newton step of every node."""
    residual, curvature = stats[..., 1], stats[..., 2]
    return np.where(curvature > 0, (classes - 1) / classes * residual / np.maximum(curvature, 1), 0.0)


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _splits(trees: Trees) -> Trees:
    """What places a row: the splits alone."""
    return Trees(trees.column, trees.cut, None, None, trees.ordered)


def _no_trees(n: int, rule: Rule, n_stats: int) -> Trees:
    shape = (n, 1 << rule.depth + 1)
    return Trees(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros((*shape, n_stats), np.int64), np.zeros(shape), np.array(rule.columns.ordered))


def train_boosting(rows: DataFrame, sample: Sample, columns: Columns, rounds: int, depth: int, rate: float, subsample: float, seed: int, keep: int = KEEP_ROUNDS, **limits) -> tuple[Boosting, DataFrame]:
    """Softmax boosting: in each round one tree a class and fit on the
    residuals, from the rows that (row, round, fit) draws.  Returns the model
    and the rows with ``scores``, the raw scores of every fit and class.

    Rounds are passes over the rows.  Where there are more than ``keep`` of
    them and at most ``held_rows`` rows, the rows are sent once to one task
    for each fit, which grows all its rounds and keeps the scores: what a task
    is sent stays bounded.  Otherwise scores are written every ``keep`` rounds; between,
    tasks add the trees since then, always in the same order.  Both ways give
    the same trees and scores."""
    fits, classes, width = sample.folds + 1, sample.classes, len(columns.sizes)
    sizes = np.array([sample.of_fit(f) for f in range(fits)])
    start = np.log(np.maximum(sizes, 1e-9) / np.maximum(sizes.sum(1, keepdims=True), 1))
    rule = Rule("friedman", columns, depth, 1, seed=seed, **limits)
    counts = {f * classes + c: int(sizes[f].sum()) for f in range(fits) for c in range(classes)}

    def raw_scores(batch, bins, pending) -> np.ndarray:
        raw = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f8").reshape(-1, fits * classes)
        for trees, values in pending:
            raw = raw + rate * values[np.arange(fits * classes)[:, None], trees.positions(bins)].T
        return raw

    def statistics(label, raw) -> Iterator[tuple[int, np.ndarray]]:
        """(class, statistics) of the drawn rows of a fit."""
        residual = np.eye(classes)[label] - softmax(raw)
        size = np.abs(residual)
        fixed = np.rint(np.stack([residual, size * (1 - size)]) * FIXED).astype(np.int64)
        for c in range(classes):
            yield c, np.stack([np.ones(len(label), np.int64), fixed[0, :, c], fixed[1, :, c]], 1)

    def members_of(pending, number: int):
        def members(batch):
            key, label, fold, bins = _read(batch, width)
            raw = raw_scores(batch, bins, pending).reshape(-1, fits, classes)

            def each() -> Iterator[tuple]:
                for fit in range(fits):
                    own = np.flatnonzero((label >= 0) & (fold != fit))
                    own = own[uniform(seed, key[own], number, fit) < subsample]
                    for c, stats in statistics(label[own], raw[own, fit]):
                        yield fit * classes + c, own, stats
            return bins, each()
        return members

    def fit_rounds(fit: int, held: HeldRows) -> Iterator[tuple]:
        """All trees of a fit, and the scores of all rows."""
        table, learnt = Held(held.bins, columns), held.learnt(fit)
        of_key, label, held.bins = hashed(seed, held.key), held.label, None
        raw = np.repeat(start[fit][:, None], len(label), 1)
        for number in range(rounds):
            drawn = learnt & (as_uniform(rehashed(of_key, 2, number, fit)) < subsample)
            once = drawn.astype(np.float64)
            of_root = table.sums(once)
            e = np.exp(raw - raw.max(0))
            e /= e.sum(0)
            for c in range(classes):
                residual = (label == c) - e[c]
                size = np.abs(residual)
                residual = np.where(drawn, np.rint(residual * FIXED), 0.0)
                curvature = np.where(drawn, np.rint(size * (1 - size) * FIXED), 0.0)

                def sums(rows=None) -> np.ndarray:
                    return np.concatenate([of_root if rows is None else table.sums(once, rows), table.sums(residual, rows)], 1).astype(np.int64)
                grown = held_tree(table, rule, fit * classes + c, sums(), sums, 3)
                for node, rows in grown.leaves:
                    own = int((curvature if rows is None else curvature.take(rows)).sum())
                    while node:
                        grown.stats[node, 2] += own
                        node //= 2
                values = leaf_values(grown.stats, classes)
                step = np.empty(len(label))
                for node, rows in grown.leaves:
                    step[slice(None) if rows is None else rows] = rate * values[node]
                raw[c] += step
                yield number * fits * classes + fit * classes + c, grown
        yield None, raw.T

    def updated(frame: DataFrame, pending) -> DataFrame:
        def run(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _scored(batch, raw_scores(batch, _read(batch, width)[3], pending))
        return frame.mapInArrow(run, SCORED)

    first = start.astype("<f8").tobytes()
    state = rows.select("key", "label", "fold", "bins", F.lit(first).alias("scores"))
    n = rows.count()
    if rounds > keep and 0 < n <= rule.held_rows:
        made = _by_slot(rows, width, fits, fit_rounds, "boosting-fits")
        trees = _trees_of(made, rounds * fits * classes, rule, 3)
        own = [slice(number * fits * classes, (number + 1) * fits * classes) for number in range(rounds)]
        done = [Trees(trees.column[r], trees.cut[r], trees.stats[r], trees.gain[r], trees.ordered) for r in own]
        return Boosting(done, classes, start, columns.base), materialize(_rejoined(made, width, n, lambda parts: np.concatenate(parts, 1)), "boosting-scores")
    state = state.persist()
    done, pending = [], []
    for number in range(rounds):
        trees = grow(state, members_of(pending, number), counts, rule, 3, _tasks(rows))
        done.append(trees)
        pending.append((_splits(trees), leaf_values(trees.stats, classes)))
        if len(pending) == keep or number == rounds - 1:
            # read back in as many partitions as were written, whatever their size
            after = materialize(updated(state, pending), "boosting-scores").persist()
            after.count()
            state.unpersist()
            state, pending = after, []
    return Boosting(done, classes, start, columns.base), state


def fold_counts(scored: DataFrame, folds: int, classes: int) -> dict[tuple[int, bool], list[tuple[int, int, int]]]:
    """(label, prediction, rows) of the labelled rows by fold left out and
    whether the rows are its own (test) or not (train)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            scores = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f8").reshape(len(label), folds + 1, classes)
            seen = np.zeros((folds, 2, classes, classes), np.int64)
            own = label >= 0
            for fit in range(folds):
                np.add.at(seen[fit], ((fold[own] == fit).astype(int), label[own], scores[own, fit].argmax(1)), 1)
            at = np.argwhere(seen)
            yield pa.RecordBatch.from_arrays([*[pa.array(at[:, i], pa.int32()) for i in range(4)], pa.array(seen[tuple(at.T)], pa.int64())], names=["fit", "test", "label", "prediction", "n"])

    out: dict[tuple[int, bool], list] = {}
    summed = scored.mapInArrow(run, "fit int, test int, label int, prediction int, n long").groupBy("fit", "test", "label", "prediction").agg(F.sum("n").alias("n"))
    for r in summed.collect():
        out.setdefault((r["fit"], bool(r["test"])), []).append((r["label"], r["prediction"], r["n"]))
    return out
