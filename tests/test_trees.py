"""Ensembles against a plain version: one tree at a time, one split after the
other, no passes, no histograms."""

import numpy as np
import pytest

from marquee.operators import ensembles as E
from marquee.operators import trees as T

COLUMNS = T.Columns((6, 3, 12, 5), (False, False, True, True))
FOLDS, CLASSES = 2, 3


def table(n=160, seed=1):
    rng = np.random.default_rng(seed)
    bins = np.stack([rng.integers(0, s, n) for s in COLUMNS.sizes], 1).astype(np.int32)
    label = (bins[:, 2] // 4 + (bins[:, 0] == 2) + (rng.random(n) < 0.2)) % 3
    label[rng.random(n) < 0.1] = -1
    fold = np.where(label < 0, -1, rng.integers(0, FOLDS, n))
    key = rng.integers(-(1 << 62), 1 << 62, n)
    return key, label, fold, bins


def frame(spark, data, parts):
    key, label, fold, bins = data
    rows = [(int(k), int(y), int(f), b.astype("<i4").tobytes()) for k, y, f, b in zip(key, label, fold, bins)]
    return spark.createDataFrame(rows, "key long, label int, fold int, bins binary").repartition(parts)


def sample(data):
    _, label, fold, _ = data
    return E.Sample(tuple(tuple(int(((label == c) & (fold == f)).sum()) for c in range(CLASSES)) for f in range(FOLDS)))


def plain_tree(bins, stats, rule, tree, gain_of):
    """node -> (column, cut) of all inner nodes, and node -> statistics."""
    inner, sums = {}, {}

    def grow(node, rows):
        total = stats[rows].sum(0)
        sums[node] = total.tolist()
        if node.bit_length() > rule.depth or T._pure(total, rule):
            return
        found = []
        for c, (size, ordered) in enumerate(zip(COLUMNS.sizes, COLUMNS.ordered)):
            for v in range(size):
                goes = bins[rows, c] <= v if ordered else bins[rows, c] == v
                a, b = rows[goes], rows[~goes]
                if min(stats[a, 0].sum(), stats[b, 0].sum()) >= rule.min_leaf and (bins[rows, c] == v).any():
                    feature = sum(COLUMNS.sizes[:c]) + (0 if ordered else v)
                    found.append((gain_of(stats[a].sum(0), stats[b].sum(0), total), T.uniform(rule.seed, tree, node, feature), c, v, a, b))
        found = [x for x in found if x[0] >= 1e-12]
        if not found:
            return
        if rule.share < 1:
            within = [x for x in found if x[1] < rule.share]
            found = within or [x for x in found if x[1] == min(y[1] for y in found)]
        best = max(x[0] for x in found)
        _, _, c, v, a, b = next(x for x in found if x[0] == best)
        inner[node] = (c, v)
        grow(2 * node, a)
        grow(2 * node + 1, b)
    grow(1, np.arange(len(bins)))
    return inner, sums


def same(trees, t, plain):
    inner, sums = plain
    got = {int(i): (int(trees.column[t, i]), int(trees.cut[t, i])) for i in np.flatnonzero(trees.column[t] >= 0)}
    assert got == inner
    assert all(trees.stats[t, i].tolist() == s for i, s in sums.items())


@pytest.mark.parametrize("parts, task_rows", [(1, 4096), (16, 4096), (5, 30), (3, 0)])
def test_forest(spark, parts, task_rows):
    data = table()
    key, label, fold, bins = data
    s = sample(data)
    forest = E.train_forest(frame(spark, data, parts), s, COLUMNS, 4, 4, 3, 42, task_rows=task_rows)
    features = 6 + 3 + 1 + 1
    for fit in range(FOLDS + 1):
        size = s.of_fit(fit)
        weight = size.sum() / (CLASSES * size)

        def gini(x):
            w = x[1:] * weight
            return w.sum() - (w * w).sum() / w.sum()
        for t in range(fit * 4, fit * 4 + 4):
            drawn = T.poisson(42, key, t)
            own = np.flatnonzero((label >= 0) & (fold != fit) & (drawn > 0))
            stats = np.concatenate([np.ones((len(own), 1), int), np.eye(CLASSES, dtype=int)[label[own]] * drawn[own, None]], 1)
            rule = T.Rule("gini", COLUMNS, 4, 3, share=int(features ** 0.5) / features, seed=42)
            same(forest.trees, t, plain_tree(bins[own], stats, rule, t, lambda a, b, x: gini(x) - gini(a) - gini(b)))
    shares = {r["key"]: np.frombuffer(r["scores"]).reshape(FOLDS + 1, CLASSES) for r in E.forest_scores(frame(spark, data, parts), forest, 4).collect()}
    assert len(shares) == len(set(key.tolist())) and all(np.allclose(x.sum(1), 1) for x in shares.values())
    assert abs(forest.importances(FOLDS).sum() - 1) < 1e-9


@pytest.mark.parametrize("parts, task_rows, keep", [(1, 4096, 10), (9, 25, 2), (4, 0, 3)])
def test_boosting(spark, parts, task_rows, keep):
    data = table(120, 5)
    key, label, fold, bins = data
    s = sample(data)
    rounds, rate = 5, 0.3
    model, scored = E.train_boosting(frame(spark, data, parts), s, COLUMNS, rounds, 3, rate, 0.8, 7, keep=keep, task_rows=task_rows)
    rule = T.Rule("friedman", COLUMNS, 3, 1, seed=7)

    def friedman(a, b, _):
        return a[0] * b[0] / (a[0] + b[0]) * (a[1] / a[0] - b[1] / b[0]) ** 2 / T.FIXED ** 2
    got = {r["key"]: np.frombuffer(r["scores"]).reshape(FOLDS + 1, CLASSES) for r in scored.collect()}
    for fit in range(FOLDS + 1):
        size = s.of_fit(fit)
        raw = np.tile(np.log(size / size.sum()), (len(key), 1))
        train = (label >= 0) & (fold != fit)
        for number in range(rounds):
            own = np.flatnonzero(train & (T.uniform(7, key, number, fit) < 0.8))
            residual = np.eye(CLASSES)[label[own]] - E.softmax(raw[own])
            new = raw.copy()
            for c in range(CLASSES):
                r = residual[:, c]
                stats = np.stack([np.ones(len(own), int), np.rint(r * T.FIXED).astype(int), np.rint(abs(r) * (1 - abs(r)) * T.FIXED).astype(int)], 1)
                inner, sums = plain = plain_tree(bins[own], stats, rule, fit * CLASSES + c, friedman)
                same(model.rounds[number], fit * CLASSES + c, plain)
                for i in range(len(key)):
                    node = 1
                    while node in inner:
                        col, cut = inner[node]
                        right = bins[i, col] > cut if COLUMNS.ordered[col] else bins[i, col] != cut
                        node = 2 * node + right
                    _, a, b = sums[node]
                    new[i, c] = raw[i, c] + rate * ((CLASSES - 1) / CLASSES * a / b if b > 0 else 0.0)
            raw = new
        assert all(np.allclose(got[int(k)][fit], raw[i], rtol=0, atol=1e-12) for i, k in enumerate(key))
    counts = E.fold_counts(scored, FOLDS, CLASSES)
    assert sum(n for (_, test), rows in counts.items() if test for *_, n in rows) == (label >= 0).sum()


def test_poisson_has_mean_one():
    drawn = T.poisson(3, np.arange(200_000), 5)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02


def test_no_rows(spark):
    data = tuple(x[:0] for x in table())
    forest = E.train_forest(frame(spark, data, 2), E.Sample(((0,) * 3,) * 2), COLUMNS, 2, 3, 1, 1)
    assert (forest.trees.column == -1).all()


def test_trees_of_some_rows_take_one_pass(spark, monkeypatch):
    """Every pass is a job, and boosting makes hundreds of rounds: trees whose
    rows one task holds are grown in a single pass, whatever their depth."""
    data = table(6000, 3)
    passes, sender = [], T._sender
    monkeypatch.setattr(T, "_sender", lambda members, trees, nodes, rule: passes.append(nodes) or sender(members, trees, nodes, rule))
    E.train_boosting(frame(spark, data, 3), sample(data), COLUMNS, 2, 4, 0.1, 0.9, 7)
    assert len(passes) == 2
    slots = [slot for _, slot in passes[0].values()]
    assert max(map(slots.count, slots)) - min(map(slots.count, slots)) <= 1


def test_many_rounds_of_bounded_fits_take_no_pass_each(spark, monkeypatch):
    """A job a round is hundreds of jobs: the rows of a fit that one task
    holds are sent once, for all rounds, and give the same model."""
    data = table(400, 9)
    passes, sender = [], T._sender
    monkeypatch.setattr(T, "_sender", lambda members, trees, nodes, rule: passes.append(nodes) or sender(members, trees, nodes, rule))
    train = lambda keep: E.train_boosting(frame(spark, data, 3), sample(data), COLUMNS, 6, 3, 0.3, 0.8, 7, keep=keep)
    by_round, scored = train(6)
    assert len(passes) == 6
    by_fit, scored_by_fit = train(5)
    assert len(passes) == 6
    for a, b in zip(by_round.rounds, by_fit.rounds, strict=True):
        assert all((x == y).all() for x, y in ((a.column, b.column), (a.cut, b.cut), (a.stats, b.stats), (a.gain, b.gain)))
    scores = [{r["key"]: bytes(r["scores"]) for r in df.collect()} for df in (scored, scored_by_fit)]
    assert len(scores[0]) == 400 and scores[0] == scores[1]


@pytest.mark.parametrize("high, bins_high", [(1, 3), (12, 300), (1 << 30, 70_000), (1 << 40, 2)])
def test_packed_rows_come_back(high, bins_high):
    rng = np.random.default_rng(4)
    bins, stats = rng.integers(0, bins_high, (4, 50)), rng.integers(-high, high + 1, (50, 3))
    got = T.unpacked(T.packed(bins, stats), 4, 3)
    assert (got[0] == bins).all() and (got[1] == stats).all()
    assert [x.shape for x in T.unpacked(T.packed(bins[:, :0], stats[:0]), 4, 3)] == [(4, 0), (0, 3)]


def test_a_held_table_takes_no_pass(spark, monkeypatch):
    """Passes over all rows send statistics for every tree, a level each: a
    table that a task can hold is sent whole instead, also where a tree has
    more rows than are sent at once, and gives the same trees and scores."""
    data = table(700, 11)
    passes, sender = [], T._sender
    monkeypatch.setattr(T, "_sender", lambda members, trees, nodes, rule: passes.append(nodes) or sender(members, trees, nodes, rule))
    rows, s = frame(spark, data, 3), sample(data)

    def trained(task_rows):
        forest, shares = E.scored_forest(rows, s, COLUMNS, 5, 4, 2, 42, task_rows=task_rows)
        model, scores = E.train_boosting(rows, s, COLUMNS, 4, 3, 0.3, 0.8, 7, keep=2, task_rows=task_rows)
        return [forest.trees, *model.rounds], [{r["key"]: (r["label"], r["fold"], bytes(r["bins"]), bytes(r["scores"])) for r in df.collect()} for df in (shares, scores)]
    held = trained(50)
    assert not passes
    passed = trained(20)
    assert len(passes) > 8
    for a, b in zip(held[0], passed[0], strict=True):
        assert all((x == y).all() for x, y in ((a.column, b.column), (a.cut, b.cut), (a.stats, b.stats), (a.gain, b.gain)))
    assert all(len(x) == 700 for x in held[1]) and held[1] == passed[1]


def test_held_sums():
    """Of all rows, of many and of few, by class and without."""
    rng = np.random.default_rng(8)
    n = 3 * T.FEW_ROWS
    columns = T.Columns((70, 3, 300, 64, 5000, 1), (True, False, False, True, False, True))
    bins = np.stack([rng.integers(0, s, n) for s in columns.sizes])
    weights, label = rng.integers(-(1 << 30), 1 << 30, n).astype(float), rng.integers(0, 3, n)
    assert sorted(c for group in columns.joint for c in group) == list(range(6)) and len(columns.joint) < 6
    for classes in (1, 3):
        held = T.Held(bins, columns, label if classes > 1 else None, classes)
        for rows in (None, np.arange(0, n, 2), np.arange(1, n, 700), np.arange(0)):
            own = np.arange(n) if rows is None else rows
            want = np.zeros((columns.base[-1], classes))
            for c in range(6):
                np.add.at(want, (columns.base[c] + bins[c, own], label[own] if classes > 1 else 0), weights[own])
            assert (held.sums(weights, rows) == want).all()


def test_poisson_by_bits():
    hashes = np.concatenate([T.hashed(1, np.arange(100_000)), (np.concatenate([T.POISSON, [0.0]]) * 2.0 ** 53).astype(np.uint64) << np.uint64(11), np.array([2 ** 64 - 1], np.uint64)])
    assert (T.as_poisson(hashes) == np.searchsorted(T.POISSON, T.as_uniform(hashes), side="right")).all()
    assert (T.rehashed(T.hashed(5, np.arange(9)), 2, 7, 3) == T.hashed(5, np.arange(9), 7, 3)).all()
