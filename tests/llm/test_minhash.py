import random
from collections import Counter, defaultdict

import numpy as np

from llm_cases import EDGES, docs_of  # noqa: F401
from marquee.llm import minhash as M
from marquee.llm import shingles as S
from marquee.llm.components import components


def multiset(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """Smallest id of each connected class, by all pairs."""
    classes = {}
    canon = defaultdict(list)
    for d, t in rows:
        if d is not None:
            canon[S.canonical(t)].append(d)
    reps = {min(ids): t for t, ids in canon.items()}
    parent = {d: d for d in reps}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d
    sets = {d: multiset(t) for d, t in reps.items()}
    for a in reps:
        for b in reps:
            if a < b and sets[a] and similarity(sets[a], sets[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for t, ids in canon.items():
        for d in ids:
            classes[d] = root(min(ids))
    return classes


def family(seed, n=80, start=1000):
    """Copies of a base at all distances, chains, repeated lines."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for d in range(n):
        words = list(base if d % 3 or not rows else rows[-1][1].split())
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((start + d, " ".join(words) + (" again and again and again" * (d % 4 * 5))))
    return rows


def test_signature_estimates_weighted_similarity():
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    for changes in (0, 5, 20):
        words = base + base[:40] * 3
        for i in rng.sample(range(300), changes):
            words[i] = f"z{i}"
        a, b = " ".join(base + base[:40] * 9), " ".join(words)
        shingle, count, doc, at = S.multisets([a, b])
        best = M.signatures(shingle, count, doc, 2, 4000)
        want = similarity(multiset(a), multiset(b))
        assert abs((best[0] == best[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4000)
        assert abs(S.overlap((shingle[at[0]:at[1]], count[at[0]:at[1]]), (shingle[at[1]:at[2]], count[at[1]:at[2]]))[1] - want) < 1e-12


def test_classes_equal_brute_force(docs_of):
    rows = family(1) + family(2, start=2000) + EDGES
    got = M.near_duplicates(docs_of(rows, 4)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert [r.class_id for r in got if r.doc_id is None] == [None]
    assert len(set(want.values())) > 5


def test_many_partners_in_runs(docs_of, monkeypatch):
    monkeypatch.setattr(M, "PAIRS_IN_RUN", 3)
    rows = family(3, 40)
    assert {r.doc_id: r.class_id for r in M.near_duplicates(docs_of(rows)).collect()} == brute(rows)


def test_texts_under_one_id(docs_of):
    """Texts that share an id and have it as their smallest share a class;
    other rows with their words follow."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    got = sorted((r.doc_id, r.rep_id, r.class_id) for r in M.near_duplicates(docs_of([(1, a), (1, b), (2, a), (3, b), (4, a + " end"), (5, "other")])).collect())
    assert got[:4] == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)] and got[5] == (5, 5, 5)


def test_empty(docs_of):
    assert M.near_duplicates(docs_of([(1, "x")]).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
