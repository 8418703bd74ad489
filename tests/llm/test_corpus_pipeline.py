"""The pipeline against plain versions of its stages, on a small table."""

import re
import zlib

import pytest
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from marquee.llm import quality, secret_scan
from marquee.sources.tables import read_table
from test_minhash import brute as classes_of
from test_suffix_dedup import brute as repeats_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeats", "secrets", "packing"]
    docs = read_table(spark, SF, "documents")
    columns, frames = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], SF).cache())
        assert frames[-1].columns == columns
    start, good, single, cut, clean = ({r.doc_id: r for r in f.collect()} for f in frames)
    # quality: rated poor documents go, rated good and clean ones stay
    grades = {r.doc_id: r.grade for r in quality.ratings_of(read_table(spark, SF, "labels")).collect()}
    assert all(d in good for d, g in grades.items() if g == 2 and d in start)
    assert sum(d in good for d, g in grades.items() if g == 0) <= 0.05 * len(grades)
    # near duplicates: one of each class
    classes = classes_of([(d, r.text) for d, r in good.items()])
    assert set(single) == set(classes.values())
    # repeats: byte for byte
    want = repeats_of([(d, r.text) for d, r in single.items()])
    for d, r in single.items():
        assert len(cut[d].text.encode()) >= want[d, r.text][0] - want[d, r.text][1] - 8
        assert len(cut[d].text.encode()) <= want[d, r.text][0] - want[d, r.text][1]
        assert cut[d].n_chars == len(cut[d].text)
    # secrets: none left, the rest as it was
    for d, r in cut.items():
        assert not secret_scan.find(clean[d].text)
        assert clean[d].text.count("[secret]") <= len(secret_scan.find(r.text)) and (clean[d].text == r.text) == (not secret_scan.find(r.text))
    # packing: every id of what is left, once
    rows = corpus_pipeline.STAGES[-1][1](spark, frames[-1], SF).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
    assert set(parts) == set(clean)
    for d, r in clean.items():
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], dtype="<u4")
        assert sorted((p.start, p.length, p.ids_crc32) for p in parts[d]) == [(p.start, p.length, zlib.crc32(ids[p.start:p.start + p.length].tobytes())) for p in sorted(parts[d], key=lambda p: p.start)]
        assert sum(p.length for p in parts[d]) == len(ids)


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = read_table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    total = defaultdict(int)
    for r in docs.collect():
        total[r.doc_id] += r.length
    for r in rows:
        total[r.doc_id] -= r.length
    assert not any(total.values()) and re.fullmatch("None", str(corpus_pipeline.ORACLE_SQL))


# names that operators use themselves, or that a schema string cannot hold
CLASHING = ["doc", "tie", "gone", "opened", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "tails", "expected_grade", "spans", "carried", "__doc", "__text", "__tie", "a b", "c.d", "digest", "c0"]
SECRET = "password = hunter2hunter2"


def odd_rows():
    long = "word " * 30_000
    passage = "this passage of the text is repeated word for word in two of the documents, so that the later one loses it again; "
    texts = [(1, "plain text of its own about a town by a river"), (2, None), (3, ""), (4, "  \n "), (5, long), (6, passage * 2 + "first"), (7, "second " + passage * 2), (8, SECRET), (None, "no id here"), (None, None),
             (9, "one two three four five six seven"), (9, "one two three four five six seven"), (10, "one two three four five six seven"), (9, "another text under the same id"), (11, "漢字かな交じり文 é 😀")]
    return [(d, t, "en", None, 5 if t else None, *[f"{n}-{k}" for n in CLASHING]) for k, (d, t) in enumerate(texts)]


def odd_docs(spark, rows):
    from pyspark.sql import types as T

    names = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in names] + [T.StructField(n, T.StringType()) for n in CLASHING])
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("name", ["quality", "near_dedup", "repeats", "secrets", "packing"])
def test_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = odd_rows()
    docs = odd_docs(spark, rows)
    assert stage(spark, docs.limit(0), SF).count() == 0
    out = stage(spark, docs, SF)
    got = [tuple(r) for r in out.collect()]
    if name == "packing":
        assert sum(r[2] for r in got) > 30_000 and {r[0] for r in got} == {r[0] for r in rows}
        return
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    by_row = {r[5]: r for r in rows}             # the first clashing column tells rows apart
    for r in got:
        was = by_row[r[5]]
        assert r[0] == was[0] and r[2:4] == was[2:4] and r[5:] == was[5:]
        if name in ("repeats", "secrets"):
            assert r[4] == len(r[1] or "")
        else:
            assert r == was
    now = {r[5]: r[1] for r in got}
    if name == "near_dedup":
        ids = [r[0] for r in got]
        assert ids.count(None) == 2 and ids.count(9) == 2 and 10 not in ids and ids.count(2) + ids.count(3) + ids.count(4) == 1
    else:
        assert name == "quality" or len(got) == len(rows)
    if name == "secrets":
        assert now["doc-7"] == "[secret]" and now["doc-0"] == rows[0][1] and now["doc-1"] is None
    if name == "repeats":
        assert len(now["doc-6"]) < 20 and now["doc-9"] is None and now["doc-10"] == now["doc-11"]
