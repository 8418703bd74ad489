import functools
import hashlib
import random
import re

from llm_cases import EDGES, docs_of  # noqa: F401
from marquee.llm import winnowing as W
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text):
    return re.findall("[^\\s\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uac00-\ud7ff\uf900-\ufaff]+|\\S", text or "")


def passages_found(a, b):
    """Runs of tokens that a guarantee covers and both texts share."""
    n = W.GRAM + W.WINDOW - 1
    x, y = tokens(a), tokens(b)
    return {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} & {tuple(y[i:i + n]) for i in range(len(y) - n + 1)}


def fingerprints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [tuple(e) for e in r.fingerprint] for r in W.fingerprints(df).collect()}


def test_equals_plain_winnowing(spark, monkeypatch):
    """Against window by window selection over the gram hashes, with chunks
    small enough that texts span many."""
    monkeypatch.setattr(W, "_CHUNK", r"(?s).{1,60}(?!\S)|\S{1,60}|\s+")
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "dd\n", "é"]) for _ in range(rng.randrange(0, 150))) for _ in range(40)] + ["same " * 100, "漢字" * 40, "x" * 500]
    got = fingerprints(spark, texts)
    for i, text in enumerate(texts):
        pieces = [t for c in re.findall(r".{1,60}(?!\S)|\S{1,60}|\s+", text, re.S) for t in tokens(c)]
        grams = [pieces[p:p + W.GRAM] for p in range(len(pieces) - W.GRAM + 1)]
        if len(grams) < W.WINDOW:
            assert len(got[i]) == bool(pieces)
            continue
        rows = spark.createDataFrame([(p, g) for p, g in enumerate(grams)], "p int, g array<string>").select("p", F.transform("g", lambda w: F.xxhash64(w)).alias("t"))
        # every gram hashed anew, not rolled
        hashed = rows.select("p", F.shiftright(functools.reduce(Column.bitwiseXOR, [W._turned(F.col("t")[k], W.GRAM - 1 - k) for k in range(W.GRAM)]), 13).alias("h")).collect()
        h = {r.p: r.h for r in hashed}
        want = set()
        for s in range(len(grams) - W.WINDOW + 1):
            least = min(h[p] for p in range(s, s + W.WINDOW))
            want.add((max(p for p in range(s, s + W.WINDOW) if h[p] == least), least))
        assert got[i] == sorted(want)


def test_shared_passages_are_found(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    shared = prose(W.GRAM + W.WINDOW - 1)
    texts = [f"{prose(rng.randrange(900))} {shared} {prose(rng.randrange(900))}" for _ in range(20)]
    got = fingerprints(spark, texts)
    for i in range(1, 20):
        assert passages_found(texts[0], texts[i])
        assert {h for _, h in got[0]} & {h for _, h in got[i]}


def test_shared_passages_over_chunk_ends(spark):
    """Long runs and scripts without blanks, at any place in the text."""
    rng = random.Random(4)
    n = W.GRAM + W.WINDOW - 1
    thai = "".join(chr(0x0E01 + rng.randrange(46)) for _ in range(n))
    burmese = "".join(chr(0x1000 + rng.randrange(42)) for _ in range(n))
    blob = "".join(rng.choice("abcdef0123456789") for _ in range(9000))
    run = f" {blob} " + " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    for shared, letters in ((thai, "\u0e01\u0e02\u0e03"), (burmese, "\u1000\u1001\u1002"), (run, "a b c ")):
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice([10, 4080, 4095, 5000]))) + shared + "".join(rng.choice(letters) for _ in range(30)) for _ in range(8)]
        got = fingerprints(spark, texts)
        for i in range(1, 8):
            assert {h for _, h in got[0]} & {h for _, h in got[i]}, (i, letters)


def test_edited_and_next(spark, docs_of):
    rows = [r for r in EDGES if r[0] != 5] + [(90 + i, f"text {i} " * (i + 3)) for i in range(30)]
    got = {r.doc_id: r for r in W.compare_edited(docs_of(rows, 5)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 4
        edited = text[:len(text) - m] + following[:m]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert edited != text or (r.near_edited == 1 and r.fingerprint == r.edited_fingerprint)


def test_small_tables(docs_of):
    one = W.compare_edited(docs_of([(1, "a b c d e f g h")])).first()
    assert one.near_next == 1
    assert W.compare_edited(docs_of([(1, "x")]).limit(0)).count() == 0
    twice = W.compare_edited(docs_of(EDGES)).collect()
    assert len(twice) == len(EDGES) and len({r.fingerprint for r in twice if r.doc_id in (4, 5)}) == 1


def test_no_python_in_the_plan(spark):
    from marquee.llm import queries

    plan = queries.op6_winnowing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!ToRow)|MapIn", plan)
