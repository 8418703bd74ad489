import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_cases import EDGES, docs_of  # noqa: F401
from marquee.llm.packing import END_ID, Packer, pack

FILE = P.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 4))
def test_packer_keeps_every_id_once(sizes, open_windows):
    out = []
    packer = Packer(out.append, window=16, open_windows=open_windows)
    for d, n in enumerate(sizes):
        packer.add(d, np.arange(n))
        assert len(packer.open) <= open_windows
    packer.close()
    seen = defaultdict(list)
    for sequence in out:
        total = sum(len(ids) for *_, ids in sequence)
        assert total == 16 or total & (total - 1) == 0 and total < 16
        for d, start, ids in sequence:
            assert ids[0] == start and len(ids)
            seen[d] += ids.tolist()
    assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(n)) for d, n in enumerate(sizes)}
    assert sum(sum(len(i) for *_, i in s) < 16 for s in out) <= 4


def test_pack_equals_the_library(docs_of):
    tok = Tokenizer.from_file(FILE)
    tok.encode_special_tokens = True
    rows = pack(docs_of(EDGES), FILE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        assert sum(r.length for r in pieces) <= 2048
    for doc, text in EDGES:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, END_ID]
        copies = 2 if doc == 5 else 1
        assert sum(r.length for r in by_doc[doc]) == copies * len(ids)
        for r in by_doc[doc]:
            want = np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes()
            assert bytes(r.ids) == want and zlib.crc32(bytes(r.ids)) == zlib.crc32(want) and r.doc_tokens == len(ids)
    assert pack(docs_of(EDGES).limit(0), FILE).count() == 0


def test_special_strings_are_text(docs_of):
    assert sum(r.length for r in pack(docs_of([(1, "<|endoftext|>")]), FILE).collect()) > 2


def test_ranks_of_the_file_give_the_ids_of_the_library():
    from marquee.llm import packing

    tok = Tokenizer.from_file(FILE)
    tok.encode_special_tokens = True
    ranks = packing._ranks(FILE)
    assert ranks is not None and len(ranks) == tok.get_vocab_size() - 1
    # every token encodes to itself, so merging by rank and by listed pairs agree
    words = [(b.decode(), i) for b, i in ranks.items() if b.decode("utf-8", "ignore").encode() == b and not b.isspace()]
    got = tok.encode_batch_fast([w for w, _ in words], add_special_tokens=False)
    assert all(e.ids == [i] for e, (w, i) in zip(got, words) if len(tok.pre_tokenizer.pre_tokenize_str(w)) == 1)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("aeinrst' \n.,1é漢"), 60)) for _ in range(400)]
    mine = [ids.tolist() for _, part in packing.tokenizer(FILE).encode(texts) for ids in part]
    assert mine == [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def test_other_files_go_through_the_library(tmp_path):
    import json

    from marquee.llm import packing

    spec = json.load(open(FILE))
    spec["model"]["merges"][10], spec["model"]["merges"][11] = spec["model"]["merges"][11], spec["model"]["merges"][10]
    other = tmp_path / "swapped.json"
    other.write_text(json.dumps(spec))
    assert packing._ranks(str(other)) is None
    tok = Tokenizer.from_file(str(other))
    texts = ["the other nation is in it", "", "an end"]
    mine = [ids.tolist() for _, part in packing.tokenizer(str(other)).encode(texts) for ids in part]
    assert mine == [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
