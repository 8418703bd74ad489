import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import EDGES
from marquee.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string, phrase string, f long, w array<int>"


def brute(rows, least, top):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            counts.update((lang, *words[i:i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    often = {p: c for p, c in counts.items() if c >= least and len(p) > 2}
    longer = Counter()
    for (lang, *w), c in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, *w[i:i + k])
                longer[part] = max(longer[part], c)
    out = {}
    for (lang, *w), a in often.items():
        if 100 * longer[lang, *w] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (counts[lang, *w[:k]] + counts[lang, *w[k:]]), k, counts[lang, *w[:k]], counts[lang, *w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, [1]) for i, r in enumerate(rows)], SCHEMA).repartition(5)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c\x1cd", "é", "漢", "x y", "long" * 9, "the", "of", "new", "york"]
    gaps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "?!"]
    return [(rng.choice(["en", "en", None, "de"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for _ in range(n)] + [("en", "new york city hall ") for _ in range(40)]


@pytest.mark.parametrize("entries", [1 << 20, 100])
def test_equals_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(C.phrases, "__defaults__", (C.MIN_COUNT, 10_000, entries))
    rows = corpus(1, 300) + [("en" if i % 2 else None, t) for i, (_, t) in enumerate(EDGES)]
    got = sorted(tuple(r) for r in C.collocations(frame(spark, rows), least=4, top=50).collect())
    assert got == brute(rows, 4, 50)
    assert C.collocations(frame(spark, rows).limit(0)).count() == 0


def test_slices_and_chunks(spark, monkeypatch):
    rows = corpus(2, 200)
    want = brute(rows, 5, 2000)
    words = C.Words()
    assert "".join(C._chunks("ab cd. ef")) == "ab cd. ef"
    monkeypatch.setattr(C, "CHUNK", 5)
    text = "one two, three four. five six seven eight nine"
    chunks = list(C._chunks(text))
    assert "".join(chunks) == text and len(chunks) > 2

    def pieces(ids):
        return [p for p in "".join("|" if w == 0 else f"{w} " for w in ids).split("|") if p]
    assert pieces([w for c in chunks for w in words.encode(c).tolist()]) == pieces(words.encode(text).tolist())
    got = sorted(tuple(r) for r in C.collocations(frame(spark, rows), least=5).collect())
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80), st.integers(1, 4), st.integers(0, 4))
def test_quicksort_partitions(values, depth, least):
    words = np.array(values + [0] * 6, np.int32)
    at = np.flatnonzero(words)
    order, rank = C.quicksort(words, at, np.zeros(len(at), np.int64), depth, None if not least else np.ones(len(at), np.int64), least)

    def key(i):
        out = words[at[i]:at[i] + depth].tolist()
        return tuple(out[:out.index(0)] if 0 in out else out)
    counts = Counter(key(i) for i in range(len(at)))
    keys = [key(i) for i in order.tolist()]
    assert Counter(keys) == Counter({k: c for k, c in counts.items() if c >= least})
    assert keys == sorted(keys) or least == 0 and sorted(keys) == keys
    assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], rank.tolist(), rank.tolist()[1:]))
