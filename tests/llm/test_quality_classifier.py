import numpy as np

from llm_cases import EDGES, docs_of  # noqa: F401
from marquee.llm import queries
from marquee.llm import quality as Q
from marquee.sources.tables import read_table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Fit on three quarters of the rated documents, judge on the others."""
    docs = read_table(spark, SF, "documents", ["doc_id", "text"])
    rated = Q.ratings_of(read_table(spark, SF, "labels")).collect()
    grades = {r.doc_id: r.grade for r in rated}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(grades, key=lambda d: hash((d, 1)))
    rows = [Q.features(texts[d]) for d in ids]
    y = np.array([grades[d] for d in ids])
    n = len(ids) * 3 // 4
    model = Q.fit(rows[:n], y[:n], Q.N_GRADES)
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(np.array([model.weights[r].sum() for r in rows[n:]]))
    kept, truth = tails[:, -1] >= Q.KEEP_TAIL, y[n:]
    assert kept[truth == 2].mean() > 0.99
    assert kept[truth == 0].mean() < 0.05
    assert kept[truth == 1].mean() < 0.5
    assert np.all(tails[:, 0] >= tails[:, 1])


def test_likelihood_gradient():
    """The fitted thresholds and weights are better than any near them."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(300)]
    y = np.array([min(2, int(3 in r) + int(5 in r) + int(rng.random() < 0.2)) for r in rows])
    model = Q.fit(rows, y, 3, penalty=0.0, rounds=3000)

    def loss(weights, theta):
        tails = Q.Model(weights, theta).tails(np.array([weights[r].sum() for r in rows]))
        p = np.concatenate([np.ones((300, 1)), tails, np.zeros((300, 1))], axis=1)
        return -np.log(p[np.arange(300), y] - p[np.arange(300), y + 1]).mean()
    best = loss(model.weights, model.thresholds)
    for k in range(30):
        for step in (-0.02, 0.02):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.thresholds) > best - 1e-5
    for k in range(2):
        for step in (-0.02, 0.02):
            theta = model.thresholds.copy()
            theta[k] += step
            assert loss(model.weights, theta) > best - 1e-5


def test_edges(spark, docs_of):
    docs = docs_of(EDGES)
    ratings = spark.createDataFrame([(4, 2), (4, 0), (3, 2), (6, 1), (None, 1), (7, None), (77, 1)], "doc_id long, grade int")
    model = Q.train(docs, ratings, 3)
    rows = Q.score(docs, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.expected_grade <= 2 and r.spans == "y" for r in rows)
    assert len({r.expected_grade for r in rows if r.doc_id in (4, 5)}) == 1
    none = Q.score(docs, Q.train(docs, ratings.limit(0), 3)).select("expected_grade", Q.keep().alias("k")).collect()
    assert all(r.expected_grade is None and r.k for r in none)
    assert Q.score(docs.limit(0), model).count() == 0


def test_query(spark):
    rows = queries.op1_ordinal_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(abs(r.expected_grade - r.p_grade_1 - r.p_grade_2) < 1e-9 and r.keep == (r.p_grade_2 >= Q.KEEP_TAIL) for r in rows)


def plain_slots(text):
    """The feature slots of a text, word by word, nothing cached or counted
    ahead."""
    import itertools
    import zlib

    def slot(feature):
        return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % (1 << Q.BITS)

    def shape(word):
        letters = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word]
        letters = ["a" if c.islower() else x for c, x in zip(word, letters)]
        return "".join(k for k, _ in itertools.groupby(letters))

    words = (text or "").split()
    if not words:
        return {slot("\x00empty")}
    out = {slot(w.lower().strip(Q._SIGNS) or w) for w in words}
    shapes = [shape(w) for w in words]
    shares = {s: shapes.count(s) for s in set(shapes)}
    shares["\x00again"] = sum(a == b for a, b in zip(words, words[1:]))
    shares["\x00caps"] = sum("A" in s and "a" not in s for s in shapes)
    # the two counts above take part in the third
    shares["\x00signs"] = sum(len(s) > 1 and s[-1] not in "aA0.,;:?)\"'»”" for s in shapes) + shares["\x00again"] + shares["\x00caps"]
    for s, n in shares.items():
        for k, step in enumerate(Q.STEPS):
            if n >= step * len(words):
                out.add(slot(f"\x00{k}{s}"))
    return out


def test_scores_equal_a_plain_version(spark, docs_of):
    import math

    long = "Überlange" * 30 + "9" * 50 + "!"
    texts = [t for _, t in EDGES] + [long, long[:40], f"{long} {long} x", "AAA BBB ccc", "end! end! end!"]
    docs = docs_of(list(enumerate(texts)))
    ratings = spark.createDataFrame([(i, i % 3) for i in range(len(texts))], "doc_id long, grade int")
    model = Q.train(docs, ratings, 3)
    got = {r.doc_id: r for r in Q.score(docs, model).collect()}
    for i, text in enumerate(texts):
        slots = plain_slots(text)
        assert slots == set(Q.features(text).tolist()), text[:60]
        total = sum(model.weights[s] for s in slots)
        tails = [1 / (1 + math.exp(t - total)) for t in model.thresholds]
        assert np.allclose(got[i].tails, tails) and abs(got[i].expected_grade - sum(tails)) < 1e-9
    # two long words that differ behind their fortieth character differ in shape
    assert set(Q.features(long).tolist()) != set(Q.features(long[:40]).tolist())
