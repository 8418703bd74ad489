import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from llm_cases import EDGES, docs_of  # noqa: F401
from marquee.llm import queries
from marquee.llm import slots as S

SF = "/root/testdata/sf0.001"


def check(rows, docs, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.place)
    assert set(places) <= set(range(shards)) and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_edges(spark, docs_of, tmp_path):
    rows, m = S.shard(docs_of(EDGES), 8, str(tmp_path / "map"))
    rows = rows.collect()
    check(rows, EDGES, 8)
    assert S.load(spark, str(tmp_path / "map"), 2).entries == m.entries and S.load(spark, str(tmp_path / "map"), 1).version == 1
    assert S.shard(docs_of(EDGES).limit(0), 8)[0].count() == 0
    wide = S.with_shard(docs_of(EDGES).withColumnRenamed("lang", "slot"), m)
    assert wide.columns == ["doc_id", "text", "slot", "kept", "spans", "shard"] and wide.count() == len(EDGES)


def test_sizes_are_near_equal(spark):
    rows = queries.op11_virtual_slots(spark, SF).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(rows) == 200 and len(sizes) == 8
    largest = max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= max(0.01 * sum(sizes.values()) / 8, 2 * max(0, largest - sum(sizes.values()) / 8))


def test_a_hot_id_is_split(docs_of):
    docs = [(7, f"text {i}") for i in range(2000)] + [(None, "same") for _ in range(2000)] + [(i, "x" * 50) for i in range(2000)]
    rows, m = S.shard(docs_of(docs), 8, slots=512)
    rows = rows.collect()
    check(rows, docs, 8)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1.02 * min(sizes.values()) and any(p >= 0 for _, p in m.entries)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=120), st.integers(1, 9))
def test_rebalancing(sizes, shards):
    first = S.SlotMap(1, {(i, -1): [i % shards, 1, b] for i, b in enumerate(sizes)})
    even = S.rebalance(first, shards)
    assert even.version == 2 and {k: v[1:] for k, v in even.entries.items()} == {k: v[1:] for k, v in first.entries.items()}
    had, has = S._sizes(first, shards), S._sizes(even, shards)
    assert max(has) - min(has) <= max(max(had) - min(had), 0) and max(has) - min(has) <= max(max(sizes), 1)
    assert S.rebalance(even, shards).entries == even.entries
    grown = S.grow(even, shards)
    assert all(grown.entries[k][0] in (v[0], shards) for k, v in even.entries.items())
