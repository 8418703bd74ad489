import os
import tempfile

from conftest import SF001
from marquee.operators import match as MT
from marquee.operators.cache import BUCKET, KeyedCache
from marquee.sources import adapter
from marquee.sources import lookups as LK
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("title", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("ident", T.LongType()), T.StructField("note", T.StringType())])


def cache_at(spark, path, buckets=8):
    return KeyedCache(spark, path, SCHEMA, ["title", "year"], ["ident"], buckets)


def content(cache):
    return sorted(map(tuple, cache.read().collect()), key=str)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache = cache_at(spark, path)
    assert content(cache) == []
    rows = [(f"t{i}", None if i % 3 == 0 else 2000 + i, i, "old") for i in range(40)]
    cache.upsert(spark.createDataFrame(rows, SCHEMA))
    assert content(cache) == sorted(rows, key=str)
    before = files(path)
    # one key again, with a NULL year, twice in the batch: one folder is rewritten, the new entry wins
    new = spark.createDataFrame([("t3", None, 99, "new"), ("t3", None, 7, "first")], SCHEMA)
    for _ in range(2):
        cache.upsert(new)
        assert content(cache) == sorted([r for r in rows if r[0] != "t3"] + [("t3", None, 7, "first")], key=str)
    folder = lambda f: os.path.dirname(f)
    assert {folder(f) for f in before - files(path)} == {next(folder(f) for f in files(path) - before)}
    cache.upsert(new.limit(0))
    hits = {tuple(r) for r in cache_at(spark, path).hits(spark.createDataFrame([("t3", None), ("t4", 2004), ("t4", 1999), (None, None)], "title string, year int"), "ident").collect()}
    assert hits == {("t3", None, 7, True), ("t4", 2004, 4, True), ("t4", 1999, None, False), (None, None, None, False)}
    assert BUCKET not in cache.read().columns


def test_full_match_searches_a_key_once(spark, monkeypatch):
    dv = adapter.driver(spark, SF001)
    wanted, catalogue = LK.wanted_titles(dv), LK.catalogue(dv)
    extra = spark.createDataFrame([(10_001, "qqqq xxxx", "qqqq xxxx", 1995, None, None), (10_002, "qqqq xxxx", "qqqq xxxx", 1995, None, None)], wanted.schema)
    wanted = wanted.unionByName(extra)
    companies = LK.candidate_companies(LK.movie_details(dv))
    cache = MT.match_cache(spark, os.path.join(tempfile.mkdtemp(prefix="marquee-cache-"), "c"), 4)
    searched = []
    real = MT.pick

    def counting(rows, *args, **kw):
        searched.append(rows.count())
        return real(rows, *args, **kw)
    monkeypatch.setattr(MT, "pick", counting)
    first = {r["row_id"]: (r["matched_id"], r["match_source"]) for r in MT.full_match(wanted, catalogue, cache, companies).collect()}
    rows = {r["row_id"]: (r["w_norm"], r["w_year"]) for r in wanted.collect()}
    assert searched[0] == len(set(rows.values())) and set(first) == set(rows)
    assert {s for _, s in first.values()} == {"primary", "secondary", "cache", "unmatched"}
    # the first row of a key is searched, the others take its entry
    for key in set(rows.values()):
        own = sorted(i for i, k in rows.items() if k == key)
        assert len({first[i][0] for i in own}) == 1 and all(first[i][1] in ("cache", "unmatched") for i in own[1:])
    assert first[10_001] == first[10_002] == (None, "unmatched")
    searched.clear()
    second = {r["row_id"]: (r["matched_id"], r["match_source"]) for r in MT.full_match(wanted.filter("row_id < 10000"), catalogue, cache, companies).collect()}
    assert searched == [] and all(s == "cache" and m == first[i][0] for i, (m, s) in second.items())
    counts = MT.source_counts(MT.full_match(wanted, catalogue, cache, companies)).first()
    assert (counts["n_cache"], counts["n_unmatched"], counts["rows"]) == (200, 2, 202) and searched == [1, 1]
