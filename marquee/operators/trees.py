"""Decision-tree ensembles over quantile-binned features, grown by Spark.

Rows hold the bin of every column.  A numeric column splits at a bin edge, a
category column splits one value from the rest, as its one-hot column would.
All trees that can grow together (every tree of a forest, every class of a
boosting round, all cross-validation folds) share each pass over the rows:

* a partition adds up, for every open node of every tree, integer statistics
  by (column, bin); the sums of a node meet in one task, which picks the best
  split.  What is sent does not grow with the rows, and only the splits reach
  the driver;
* the rows of a node that has at most ``task_rows`` are sent as they are, in
  the narrowest integers that hold them, and one task grows the whole subtree
  under it by the same rule; there are more such tasks where more is sent.

Tables of at most ``held_rows`` need no passes: tasks are sent all rows
(``Held``) and each grows many whole trees from them.

Statistics are integers (bagging counts, residuals in fixed point), so sums
do not depend on their order: the same trees come out for any number of
partitions and any ``task_rows``.  Bagging, subsampling and the choice of
features draw from hashes of (seed, row, tree, node), never from the state of
a task, so a task that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_ROWS = 1 << 17              # some MB as they are sent, a tree of a few hundred nodes
HELD = 16                        # times as many rows does a task hold that grows many trees (some hundred MB)
JOINT_CELLS = 1 << 12            # of columns that are counted together
FEW_ROWS = 1 << 12               # are counted column by column
EXACT_ROWS = 1 << 22             # have sums of FIXED numbers that doubles hold exactly
DRAWN_BITS = 26                  # of a sum of counts; the sum of drawn counts is above them
SENT_BYTES = 32 << 20            # of whole rows that one task is given
FIXED = float(1 << 30)           # residuals and curvatures are counted in units of 2**-30
NODES = "tree int, node int, column int, cut int, stats binary, gain double, left long, right long"


@dataclass(frozen=True)
class Columns:
    """Number of values of each column, and whether they are ordered."""
    sizes: tuple[int, ...]
    ordered: tuple[bool, ...]

    @cached_property
    def base(self) -> np.ndarray:
        return np.cumsum((0, *self.sizes))

    @cached_property
    def of_cell(self) -> np.ndarray:
        """The column of every cell."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @cached_property
    def feature(self) -> np.ndarray:
        """The feature of every cell, by its first cell: an ordered column is
        one feature, every value of another column is one."""
        return np.where(np.array(self.ordered)[self.of_cell], self.base[self.of_cell], np.arange(self.base[-1]))

    @cached_property
    def joint(self) -> list[list[int]]:
        """Columns whose values are counted together, as many as have at most
        JOINT_CELLS combinations."""
        out, cells = [], []
        for c in sorted(range(len(self.sizes)), key=lambda c: -self.sizes[c]):
            k = next((k for k, n in enumerate(cells) if n * self.sizes[c] <= JOINT_CELLS), None)
            if k is None:
                out.append([])
                cells.append(1)
                k = len(out) - 1
            out[k].append(c)
            cells[k] *= self.sizes[c]
        return out


@dataclass(frozen=True)
class Rule:
    """How trees grow.  ``kind``: "gini" on (rows, class counts) with class
    weights per tree, or "friedman" on (rows, residuals, curvature)."""
    kind: str
    columns: Columns
    depth: int
    min_leaf: int = 1
    weights: np.ndarray | None = None      # gini: tree x class
    share: float = 1.0                     # of the features that a node may use
    seed: int = 0
    task_rows: int = TASK_ROWS

    @property
    def held_rows(self) -> int:
        return min(HELD * self.task_rows, EXACT_ROWS)


@dataclass
class Trees:
    """Trees by heap index: the root is 1, the children of i are 2i, 2i+1."""
    column: np.ndarray               # tree x node; -1 for a leaf
    cut: np.ndarray
    stats: np.ndarray                # tree x node x statistic
    gain: np.ndarray
    ordered: np.ndarray = field(repr=False, default=None)

    def positions(self, bins: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """Node of every row (columns x rows) in every tree."""
        trees = np.arange(len(self.column)) if trees is None else trees
        n, flat = bins.shape[1], np.ascontiguousarray(bins).ravel()
        columns, cuts = self.column.ravel(), self.cut.ravel()
        at = np.ones((len(trees), n), np.intp)
        first, rows = trees[:, None] * self.column.shape[1], np.arange(n)[None, :]
        for _ in range(self.column.shape[1].bit_length() - 2):
            here = at + first
            column = columns.take(here)
            inner = column >= 0
            if not inner.any():
                break
            own = np.maximum(column, 0)
            value, cut = flat.take(own * n + rows), cuts.take(here)
            right = np.where(self.ordered.take(own), value > cut, value != cut)
            at = np.where(inner, 2 * at + right, at)
        return at


def hashed(*parts) -> np.ndarray:
    """Well-mixed 64-bit integers of broadcast integer parts."""
    return rehashed(np.uint64(0), 0, *parts)


def rehashed(out: np.ndarray, first: int, *parts) -> np.ndarray:
    """``hashed`` of ``first`` parts that gave ``out`` and of these parts."""
    with np.errstate(over="ignore"):
        for k, part in enumerate(parts, first):
            x = (np.asarray(part).astype(np.uint64) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15) + out
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = x ^ (x >> np.uint64(31))
    return out


def uniform(*parts) -> np.ndarray:
    return as_uniform(hashed(*parts))


def as_uniform(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _poisson_steps() -> np.ndarray:
    steps, p, total = [], np.exp(-1.0), 0.0
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    return np.array(steps)


def poisson(*parts) -> np.ndarray:
    """Counts with mean 1: the number of steps of its distribution below a
    uniform draw."""
    return as_poisson(hashed(*parts))


POISSON = _poisson_steps()
# the counts by the first 16 bits of a hash; -1 where a step is within them
_EDGES = np.searchsorted(POISSON, np.arange((1 << 16) + 1) / float(1 << 16), side="left")
_BY_BITS = np.where(_EDGES[:-1] == _EDGES[1:], _EDGES[:-1], -1).astype(np.int8)


def as_poisson(hashes: np.ndarray) -> np.ndarray:
    out = _BY_BITS[hashes >> np.uint64(48)].astype(np.int64)
    rest = np.flatnonzero(out < 0)
    out[rest] = np.searchsorted(POISSON, as_uniform(hashes[rest]), side="right")
    return out


# ------------------------------------------------------------ one node
def histogram(bins: np.ndarray, stats: np.ndarray, columns: Columns) -> tuple[np.ndarray, np.ndarray]:
    """(cell, sums) of the cells that have rows; a cell is a (column, bin)."""
    weights = [s.astype(np.float64) for s in stats.T]
    sums = np.concatenate([np.stack([np.bincount(own, w, size) for w in weights], 1) for own, size in zip(bins, columns.sizes)])
    here = np.flatnonzero(sums[:, 0])
    return here, np.rint(sums[here]).astype(np.int64)


def best_split(cells: np.ndarray, sums: np.ndarray, total: np.ndarray, rule: Rule, tree: int, node: int, draws: np.ndarray | None = None) -> tuple[int, int, float, np.ndarray] | None:
    """(column, cut, gain, statistics of the left side) of the best split of
    a node, or None.  Of equal gains the first cell wins.  ``draws`` has the
    node's draw of every cell's feature, where they were made before."""
    base, ordered = rule.columns.base, np.array(rule.columns.ordered)
    column = rule.columns.of_cell[cells]
    running = np.cumsum(sums, 0)
    first = np.searchsorted(column, column)
    before = np.where((first > 0)[:, None], running[first - 1], 0)
    left = np.where(ordered[column][:, None], running - before, sums)
    ok = (left[:, 0] >= rule.min_leaf) & (total[0] - left[:, 0] >= rule.min_leaf)
    if not ok.any():
        return None
    cells, column, left = cells[ok], column[ok], left[ok]

    def gains(left: np.ndarray) -> np.ndarray:
        right = total - left
        if rule.kind == "gini":
            weight = rule.weights[tree]

            def impurity(counts):
                """Weight of the rows times their Gini impurity."""
                w = counts[..., 1:] * weight
                mass = w.sum(-1)
                return mass - (w * w).sum(-1) / np.maximum(mass, 1e-300)
            gain = impurity(total[None])[0] - impurity(left) - impurity(right)
        else:
            n, m = left[:, 0].astype(np.float64), right[:, 0].astype(np.float64)
            gain = n * m / (n + m) * (left[:, 1] / n - right[:, 1] / m) ** 2 / FIXED ** 2
        gain[gain < 1e-12] = 0.0
        return gain

    def best(own: np.ndarray, gain: np.ndarray) -> tuple[int, int, float, np.ndarray]:
        at = int(np.argmax(gain))
        here = int(own[at])
        return int(column[here]), int(cells[here] - base[column[here]]), float(gain[at]), left[here]

    own = np.arange(len(cells))
    if rule.share < 1.0:
        feature = rule.columns.feature[cells]
        draw = uniform(rule.seed, tree, node, feature) if draws is None else draws[cells]
        within = np.flatnonzero(draw < rule.share)
        gain = gains(left[within])
        if (gain > 0).any():
            return best(within, gain)
        gain = gains(left)
        useful = gain > 0
        if not useful.any():
            return None
        own = np.flatnonzero(draw == draw[useful].min())      # go on until one feature splits the node
        return best(own, gain[own])
    gain = gains(left)
    return best(own, gain) if gain.max() > 0 else None


def _pure(total: np.ndarray, rule: Rule) -> bool:
    return rule.kind == "gini" and np.count_nonzero(total[1:]) <= 1 or total[0] < 2 * rule.min_leaf


def subtree(bins: np.ndarray, stats: np.ndarray, rule: Rule, tree: int, root: int) -> Iterator[tuple]:
    """All nodes under ``root``, grown from its rows."""
    todo = [(root, np.arange(bins.shape[1]))]
    while todo:
        node, rows = todo.pop()
        there = stats[rows]
        total = there.sum(0)
        split = None
        if node.bit_length() <= rule.depth and not _pure(total, rule):
            here = bins[:, rows]
            split = best_split(*histogram(here, there, rule.columns), total, rule, tree, node)
        if split is None:
            yield tree, node, -1, 0, total.tobytes(), 0.0, 0, 0
            continue
        column, cut, gain, left = split
        yield tree, node, column, cut, total.tobytes(), gain, int(left[0]), int(total[0] - left[0])
        goes = here[column] <= cut if rule.columns.ordered[column] else here[column] == cut
        todo += [(2 * node, rows[goes]), (2 * node + 1, rows[~goes])]


# ------------------------------------------------------------ whole trees
class Held:
    """All rows, held by a task that grows many trees from them.

    Columns of few values are counted together, and of the two sides of a
    split only the one with fewer rows; the sums of the other and of each
    column follow from integers that are exact."""

    def __init__(self, bins: np.ndarray, columns: Columns, label: np.ndarray | None = None, classes: int = 1):
        """``label`` counts the rows of each of ``classes`` apart."""
        self.columns, self.classes = columns, classes
        self.bins = [np.ascontiguousarray(own, np.uint8 if size <= 256 else np.uint16 if size <= 1 << 16 else np.int32) for own, size in zip(bins, columns.sizes)]
        label = np.zeros(bins.shape[1], np.int64) if label is None else label
        self.cell = np.empty(bins.shape, np.uint16 if columns.base[-1] * classes <= 1 << 16 else np.int32)
        for own, c, b in zip(self.cell, self.bins, columns.base):
            own[:] = (c.astype(np.int64) + b) * classes + label
        self.joint = []
        for group in columns.joint:
            at = np.zeros(bins.shape[1], np.intp)
            for c in group:
                at = at * columns.sizes[c] + self.bins[c]
            self.joint.append(at * classes + label)

    def sums(self, weights: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Sums of whole weights by cell and class, of all or some rows."""
        sizes, base, k = self.columns.sizes, self.columns.base, self.classes
        if rows is not None:
            weights = weights.take(rows)
            if len(rows) <= FEW_ROWS:
                return np.bincount(self.cell.take(rows, 1).ravel(), np.tile(weights, len(sizes)), base[-1] * k).reshape(-1, k)
        out = np.empty((base[-1], k))
        for group, at in zip(self.columns.joint, self.joint):
            shape = [sizes[c] for c in group] + [k]
            table = np.bincount(at if rows is None else at.take(rows), weights, int(np.prod(shape))).reshape(shape)
            for i, c in enumerate(group):
                out[base[c]:base[c + 1]] = table.sum(tuple(j for j in range(len(group)) if j != i))
        return out

    def sides(self, rows: np.ndarray | None, column: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        value = self.bins[column] if rows is None else self.bins[column].take(rows)
        goes = value <= cut if self.columns.ordered[column] else value == cut
        if rows is None:
            return np.flatnonzero(goes), np.flatnonzero(~goes)
        return rows[goes], rows[~goes]


@dataclass
class Grown:
    """A tree by heap index, and the rows of its leaves."""
    column: np.ndarray
    cut: np.ndarray
    stats: np.ndarray
    gain: np.ndarray
    leaves: list[tuple[int, np.ndarray | None]]

    def payload(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.column, self.cut, self.stats, self.gain))


def held_tree(held: Held, rule: Rule, tree: int, at_root: np.ndarray, sums_of: Callable, n_stats: int) -> Grown:
    """The tree that ``subtree`` grows from the rows that count, with all rows
    placed in its leaves.  ``at_root`` has the statistics of the cells, and
    ``sums_of`` those of some rows; the last one of (rows, residuals,
    curvature) is of no use for splits and is left to the caller."""
    size, base = 1 << rule.depth + 1, rule.columns.base
    out = Grown(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros((size, n_stats), np.int64), np.zeros(size), [])
    draws = uniform(rule.seed, tree, np.arange(size // 2)[:, None], rule.columns.feature) if rule.share < 1.0 else None
    used = at_root.shape[1]
    out.stats[1, :used] = at_root[:base[1]].sum(0)           # every row is in one cell of each column
    todo = [(1, None, None if not rule.depth or _pure(out.stats[1, :used], rule) else at_root)]
    while todo:
        node, rows, sums = todo.pop()
        total = out.stats[node, :used]
        split = None
        if sums is not None:
            cells = np.flatnonzero(sums[:, 0])
            split = best_split(cells, sums[cells], total, rule, tree, node, None if draws is None else draws[node])
        if split is None:
            out.leaves.append((node, rows))
            continue
        column, cut, gain, left = split
        out.column[node], out.cut[node], out.gain[node] = column, cut, gain
        children = (2 * node, 2 * node + 1)
        for child, stats in zip(children, (left, total - left)):
            out.stats[child, :used] = stats
        sides = held.sides(rows, column, cut)
        grows = [child.bit_length() <= rule.depth and not _pure(out.stats[child, :used], rule) for child in children]
        few = int(len(sides[1]) < len(sides[0]))
        own: list = [None, None]
        if any(grows):
            own[few] = sums_of(sides[few])
            own[1 - few] = sums - own[few]
        todo += [(child, side, s if g else None) for child, side, s, g in zip(children, sides, own, grows)]
    return out


# ------------------------------------------------------------ passes
def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), schema)], names=[n for n, _ in schema])


_SENT = [("slot", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("whole", pa.bool_()), ("payload", pa.binary())]
_NODES = [("tree", pa.int32()), ("node", pa.int32()), ("column", pa.int32()), ("cut", pa.int32()), ("stats", pa.binary()), ("gain", pa.float64()), ("left", pa.int64()), ("right", pa.int64())]


def packed(bins: np.ndarray, stats: np.ndarray) -> bytes:
    """Bins (columns x rows) and statistics (rows x statistics) of rows, each
    in the narrowest integers that hold all of them."""
    out = [np.uint32(bins.shape[1]).tobytes()]
    for x, kinds in ((bins, ("u1", "<u2", "<u4")), (stats, ("i1", "<i2", "<i4", "<i8"))):
        low, high = (x.min(), x.max()) if x.size else (0, 0)
        kind = next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        out += [kind.rjust(3).encode(), np.ascontiguousarray(x, kind).tobytes()]
    return b"".join(out)


def unpacked(payload: bytes, n_columns: int, n_stats: int) -> tuple[np.ndarray, np.ndarray]:
    n, at, out = int(np.frombuffer(payload, "<u4", 1)[0]), 4, []
    for shape in ((n_columns, n), (n, n_stats)):
        kind = np.dtype(payload[at:at + 3].decode().strip())
        out.append(np.frombuffer(payload, kind, shape[0] * shape[1], at + 3).reshape(shape).astype(np.int64))
        at += 3 + shape[0] * shape[1] * kind.itemsize
    return out[0], out[1]


def _sender(members: Callable, trees: Trees, open_nodes: dict[tuple[int, int], tuple[bool, int]], rule: Rule):
    """Statistics or rows of the open nodes, given as (whether rows are sent,
    slot), in a batch of rows.  ``members`` turns a record batch into (bins, iterator of (tree, rows, statistics))."""
    by_tree: dict[int, list[int]] = {}
    for t, node in open_nodes:
        by_tree.setdefault(t, []).append(node)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, each = members(batch)
            out, held = [], 0
            for t, rows, stats in each:
                if t not in by_tree or not len(rows):
                    continue
                own = bins[:, rows]
                nodes = by_tree[t]
                at = np.ones(len(rows), np.int32) if nodes == [1] else trees.positions(own, np.array([t]))[0]
                for node in nodes:
                    here = np.flatnonzero(at == node)
                    if not len(here):
                        continue
                    whole, slot = open_nodes[t, node]
                    if whole:
                        payload = packed(own[:, here], stats[here])
                    else:
                        cells, sums = histogram(own[:, here], stats[here], rule.columns)
                        payload = cells.astype("<i4").tobytes() + sums.astype("<i8").tobytes()
                    out.append((slot, t, node, whole, payload))
                    held += len(payload)
                if held > 8 << 20:
                    yield _batch(out, _SENT)
                    out, held = [], 0
            if out:
                yield _batch(out, _SENT)
    return run


def _grower(rule: Rule, n_stats: int):
    """Splits of open nodes from what all partitions sent, sorted by node."""
    n_columns = len(rule.columns.sizes)

    def arrays(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(payload) // (4 + 8 * n_stats)
        return np.frombuffer(payload, "<i4", n), np.frombuffer(payload, "<i8", n * n_stats, 4 * n).reshape(n, n_stats)

    def node_rows(head: tuple, payloads: list[bytes]) -> Iterator[tuple]:
        tree, node, whole = head
        if whole:
            parts = [unpacked(p, n_columns, n_stats) for p in payloads]
            bins = np.concatenate([b for b, _ in parts], 1)
            yield from subtree(bins, np.concatenate([s for _, s in parts]), rule, tree, node)
            return
        total_cells = np.zeros((int(rule.columns.base[-1]), n_stats), np.int64)
        for p in payloads:
            cells, sums = arrays(p)
            total_cells[cells] += sums
        cells = np.flatnonzero(total_cells[:, 0])
        sums = total_cells[cells]
        total = sums[cells < rule.columns.sizes[0]].sum(0)      # every row is in one cell of each column
        split = None if node.bit_length() > rule.depth or _pure(total, rule) else best_split(cells, sums, total, rule, tree, node)
        if split is None:
            yield tree, node, -1, 0, total.tobytes(), 0.0, 0, 0
            return
        column, cut, gain, left = split
        yield tree, node, column, cut, total.tobytes(), gain, int(left[0]), int(total[0] - left[0])
        if node.bit_length() == rule.depth:
            yield tree, 2 * node, -1, 0, left.tobytes(), 0.0, 0, 0
            yield tree, 2 * node + 1, -1, 0, (total - left).tobytes(), 0.0, 0, 0

    def run(batches) -> Iterator[pa.RecordBatch]:
        head, payloads, out = None, [], []
        for batch in batches:
            for *key, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if key != head:
                    if payloads:
                        out += node_rows(head, payloads)
                    head, payloads = key, []
                payloads.append(payload)
                if len(out) > 5000:
                    yield _batch(out, _NODES)
                    out = []
        if payloads:
            out += node_rows(head, payloads)
        if out:
            yield _batch(out, _NODES)
    return run


def grow(rows: DataFrame, members: Callable, sizes: dict[int, int], rule: Rule, n_stats: int, tasks: int) -> Trees:
    """Trees 0 to n - 1 over ``rows``.  ``sizes`` bounds the rows of each
    tree; a tree without rows stays a leaf of zeros."""
    n = len(sizes)
    shape = (n, 1 << rule.depth + 1)
    trees = Trees(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros((*shape, n_stats), np.int64), np.zeros(shape), np.array(rule.columns.ordered))
    sizes = {(t, 1): size for t, size in sizes.items()}
    row_bytes = len(rule.columns.sizes) + 4 * n_stats
    while sizes:
        sent_bytes = row_bytes * sum(size for size in sizes.values() if size <= rule.task_rows)
        parts = max(1, min(max(tasks, sent_bytes // SENT_BYTES), len(sizes)))
        # nodes are dealt out in turn, the largest first, so that tasks have equal work
        dealt = sorted(sizes, key=lambda node: (-sizes[node], node))
        open_nodes = {node: (sizes[node] <= rule.task_rows, i % parts) for i, node in enumerate(dealt)}
        sent = rows.mapInArrow(_sender(members, trees, open_nodes, rule), "slot int, tree int, node int, whole boolean, payload binary")
        sent = sent.repartitionById(parts, F.col("slot")).drop("slot").sortWithinPartitions("tree", "node")
        made = sent.mapInArrow(_grower(rule, n_stats), NODES).toArrow()
        tree, node, column, cut = (made[c].to_numpy() for c in ("tree", "node", "column", "cut"))
        trees.column[tree, node], trees.cut[tree, node], trees.gain[tree, node] = column, cut, made["gain"].to_numpy()
        if len(tree):
            trees.stats[tree, node] = np.frombuffer(b"".join(made["stats"].to_pylist()), np.int64).reshape(-1, n_stats)
        # what a pass has split and not finished goes on
        done = set(zip(tree.tolist(), node.tolist()))
        left, right = made["left"].to_pylist(), made["right"].to_pylist()
        sizes = {(t, child): size
                 for t, i, c, a, b in zip(tree.tolist(), node.tolist(), column.tolist(), left, right) if c >= 0
                 for child, size in ((2 * i, a), (2 * i + 1, b)) if (t, child) not in done}
    return trees
