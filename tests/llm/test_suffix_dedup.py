import hashlib
import random

import pytest

from llm_cases import EDGES, docs_of  # noqa: F401
from marquee.llm import suffix_dedup as S


def brute(rows):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, kept digest)} window by
    window, documents by id, nulls last."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            window = data[s:s + 100]
            if window in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc, text] = len(data), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()
    return out


def mixture(seed, n=60):
    """Documents with shared passages, near copies, copies and periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randrange(15, 60)) for _ in range(3)]
    base = prose(150)
    rows = []
    for d in range(n):
        kind = rng.randrange(6)
        words = base.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = word()
        rows.append((d * 3, [prose(40) + " " + rng.choice(passages) + " " + prose(20), rng.choice(passages) + prose(3) + rng.choice(passages), " ".join(words), base, "abc" * rng.randrange(20, 120), prose(2) * 9][kind]))
    return rows + [(None, passages[0]), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize("seed, hot", [(1, 256), (2, 256), (3, 2), (4, 0)])
def test_equals_brute_force(docs_of, monkeypatch, seed, hot):
    """With ``hot`` small, open buckets go the way of many segments."""
    monkeypatch.setattr(S, "BUCKET_IN_TASK", hot)
    rows = mixture(seed) + EDGES
    want = brute(rows)
    got = S.dedup(docs_of(rows, 4)).collect()
    assert len(got) == len(rows)
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert texts == sorted((d is None, d or 0, *want[d, t]) for d, t in rows)


def test_clean_text(docs_of):
    passage = "é" * 10 + " ".join(str(i * i) for i in range(60))
    rows = [(1, "one " + passage), (2, passage + " two"), (3, None), (4, "short")]
    got = {r.doc_id: r for r in S.dedup(docs_of(rows), clean=True).collect()}
    assert got[1].text == rows[0][1] and got[2].text == " two" and got[3].text is None and got[4].text == "short"
    assert got[2].kept == [[len(passage.encode()), len(passage.encode()) + 4]] and got[2].lang == "en"


def test_empty(docs_of):
    assert S.dedup(docs_of([(1, "x")]).limit(0)).count() == 0


def test_bucket_pointers():
    import numpy as np

    from marquee.llm.bucket_pointers import refined, same_as_before

    rng = random.Random(11)
    for trial in range(60):
        letters = rng.choice([b"a", b"ab", b"abcdefgh"])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 12))]
        strings += [rng.choice(strings) * rng.randrange(1, 5) for _ in range(3)]
        data, depth = b"".join(strings), rng.choice([8, 13, 20, 40])
        sizes = np.array(list(map(len, strings)))
        order = refined(data, sizes, depth)
        assert sorted(order.tolist()) == list(range(len(data)))
        ends = np.repeat(np.cumsum(sizes), sizes)
        full = [i for i in order.tolist() if ends[i] - i >= depth]
        seen, last = set(), None
        for i in full:                           # equal strings stand together
            if data[i:i + depth] != last:
                last = data[i:i + depth]
                assert last not in seen
                seen.add(last)
        same = same_as_before(data, np.array(full, dtype=np.int64), depth)
        assert same.tolist() == [k > 0 and data[i:i + depth] == data[full[k - 1]:full[k - 1] + depth] for k, i in enumerate(full)]
