import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from llm_cases import EDGES, docs_of  # noqa: F401
from marquee.llm import bpe as B
from marquee.llm.pieces import starts_of

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(RANKS), special_tokens={})


def random_texts(n, seed=1):
    rng = random.Random(seed)
    signs = "ab sstrevlmd'\"  \n\t\r.,12²Ⅷé漢 \x1c\x85!?#😀́ʼ 　"
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(n)] + ["'s", "''s", " 's", "\n's", "a'll b're'", "x" * 3000, "  ", ""]


def test_equals_the_library(library):
    texts = random_texts(3000)
    _, pieces = B.encoder(RANKS)
    got = [ids.tolist() for _, part in pieces.encode(texts) for ids in part]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_split_equals_the_pattern():
    import regex

    texts = random_texts(500, 2)
    joined = "".join(texts)
    at = np.cumsum([0, *map(len, texts)])
    chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    begins = starts_of(chars, at[:-1]).tolist()
    got = [joined[a:b] for a, b in zip(begins, [*begins[1:], len(joined)])]
    assert got == [p for t in texts for p in regex.findall(P.PATTERN, t)]


def test_prefix_table_appends_and_edits(library):
    bpe, _ = B.encoder(RANKS)
    rng = random.Random(3)
    letters = b"thenationingxyz"
    data = bytes(rng.choice(letters) for _ in range(400))
    table = B.PrefixTable(bpe)
    for i in range(0, 400, 37):
        table.append(data[i:i + 37])
    assert table.tokens() == B.PrefixTable(bpe, data).tokens() == library._encode_single_piece(data)
    for _ in range(30):
        a = rng.randrange(len(table.data))
        b = min(len(table.data), a + rng.randrange(5))
        new = bytes(rng.choice(letters) for _ in range(rng.randrange(5)))
        want = table.data[:a] + new + table.data[b:]
        table.replace(a, b, new)
        assert table.data == want and table.last == B.PrefixTable(bpe, want).last


def test_edit_stops_in_step():
    bpe, _ = B.encoder(RANKS)
    table = B.PrefixTable(bpe, b"thenationing" * 500)
    assert table.replace(10, 11, b"q") < 1000


def test_digests(spark, docs_of, library):
    got = {}
    for r in B.roundtrip_digests(docs_of(EDGES), RANKS).collect():
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    for doc, text in EDGES:
        ids = library.encode_ordinary(text or "")
        want = len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert set(got[doc]) == {want}
    assert len(got[5]) == 2
    assert B.roundtrip_digests(docs_of(EDGES).limit(0), RANKS).count() == 0


def test_encode_keeps_columns(docs_of, library):
    rows = B.encode(docs_of(EDGES), RANKS, out="kept").collect()
    assert len(rows) == len(EDGES) and all(list(r.kept) == library.encode_ordinary(r.text or "") and r.spans == "y" for r in rows)


def thue_morse(n):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_pieces_that_polynomial_hashes_confuse(spark, docs_of, library):
    texts = [t for n in (1024, 4096) for t in thue_morse(n)]
    _, pieces = B.encoder(RANKS)
    assert [ids.tolist() for _, part in pieces.encode(texts) for ids in part] == [library.encode_ordinary(t) for t in texts]
    rows = {r.doc_id: r.decoded_sha256 for r in B.roundtrip_digests(docs_of(list(enumerate(texts)), 1), RANKS).collect()}
    assert rows == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


def test_long_texts_are_cut_where_a_piece_begins(library, monkeypatch):
    from marquee.llm import pieces as P_

    monkeypatch.setattr(P_, "SLICE_CHARS", 7)
    for text in random_texts(400, 5) + ["x" * 100, " " * 50 + "a", "a" + "\n" * 40 + "b", "don't " * 9, "漢字かな交じり文" * 4]:
        enc = P_.PieceEncoder(lambda new: B.encode_pieces(B.encoder(RANKS)[0], new))
        if text:
            assert enc.encode_long(text).tolist() == library.encode_ordinary(text), text


def test_piece_caches_trim(library, monkeypatch):
    from marquee.llm import pieces as P_

    monkeypatch.setattr(P_, "CACHED_SHORT", 20)
    monkeypatch.setattr(P_, "CACHED_LONG", 5)
    monkeypatch.setattr(P_, "SLICE_CHARS", 60)
    texts = random_texts(300, 7) + ["internationalization of " + str(i) * 20 for i in range(30)]
    enc = P_.PieceEncoder(lambda new: B.encode_pieces(B.encoder(RANKS)[0], new))
    got = [ids.tolist() for _ in range(2) for t in texts for ids in ([enc.encode_long(t)] if len(t) > 60 else enc.encode_slice([t]))]
    assert got == [library.encode_ordinary(t) for t in texts] * 2
    assert len(enc.short.keys) <= 40 and len(enc.long.numbers) <= 40
