"""Fuzzy matching: winner-only threshold golden and equality with a
brute-force evaluation (no blocking shortcuts, no pruning) on sf0.001."""

import pandas as pd
import pytest

from conftest import SF001
from marquee.functions.clean import norm_text
from marquee.functions.similarity import indel_ratio_py
from marquee.operators import match as MT
from marquee.sources import adapter
from marquee.sources import lookups as LK


def test_winner_only_threshold(spark):
    cat = spark.createDataFrame(
        [(1, 0, "Dune", "2021-10-22", 100, 10.0, [18]), (2, 1, "Dune World", "2021-05-01", 200, 1.0, [18])],
        "cand_id long, cand_pos int, title string, release_date string, vote_count long, popularity double, "
        "genre_ids array<int>")
    wanted = spark.createDataFrame([(1, "Dune (2021)", "dune", 2021)], "row_id long, title string, w_norm string, "
                                                                       "w_year int")
    r = MT.pick(wanted, cat, MT.V2).first()
    assert r["match_source"] == "unmatched" and r["matched_id"] is None
    r = MT.pick(wanted, cat, MT.V1).first()  # no threshold: B wins on votes
    assert r["matched_id"] == 2


@pytest.mark.parametrize("w", [MT.V3, MT.SECONDARY])
def test_title_without_ascii_meets_its_copy(spark, w):
    cat = spark.createDataFrame(
        [(1, 0, "千と千尋の神隠し", "2001-07-20", 9, 1.0, [16]), (2, 1, "Брат 千", "2001-05-01", 99, 9.0, [18]), (3, 2, "БРАТ", "1997-05-17", 5, 1.0, [18]), (4, 3, "!!!", "2001-01-01", 1, 1.0, [18])],
        "cand_id long, cand_pos int, title string, release_date string, vote_count long, popularity double, "
        "genre_ids array<int>")
    wanted = spark.createDataFrame([(1, "千と千尋の神隠し (2001)", 2001), (2, "Брат", 1997), (3, "брат", None), (4, "千", 2001), (5, "", 2001), (6, None, 2001)],
                                   "row_id long, title string, w_year int").withColumn("w_norm", MT.norm_title("title"))
    got = {r["row_id"]: (r["matched_id"], r["sim"]) for r in MT.pick(wanted, cat, w).collect()}
    assert got == {1: (1, 1.0), 2: (3, 1.0), 3: (3, 1.0), 4: (None, None), 5: (None, None), 6: (None, None)}


def brute_force(w: pd.DataFrame, c: pd.DataFrame, comp: pd.DataFrame, wt: MT.Weights) -> dict:
    out = {}
    comp_by = comp.groupby("cand_id")["company"].apply(list).to_dict()
    for row in w.itertuples():
        toks = set(t for t in row.w_norm.split(" ") if t)
        cands = []
        for cnd in c.itertuples():
            if not toks & set(t for t in cnd.c_norm.split(" ") if t):
                continue
            if row.w_year == row.w_year and row.w_year is not None and not pd.isna(row.w_year):
                if pd.isna(cnd.c_year) or abs(cnd.c_year - row.w_year) > 1:
                    continue
                dyear = abs(cnd.c_year - row.w_year)
            else:
                dyear = 0
            sim = indel_ratio_py(row.w_norm, cnd.c_norm)
            bonus = 0.0
            if wt.date_bonus:
                d1, d2 = pd.to_datetime(row.date_hint, errors="coerce"), pd.to_datetime(cnd.release_date, errors="coerce")
                if not pd.isna(d1) and not pd.isna(d2):
                    days = abs((d2 - d1).days)
                    for lim, b in wt.date_bonus:
                        if days <= lim:
                            bonus = float(b)
                            break
            s = wt.votes * cnd.votes + wt.pop * cnd.pop + wt.sim * sim - wt.year * dyear - wt.doc * cnd.doc + bonus
            cands.append(dict(cand_id=cnd.cand_id, cand_pos=cnd.cand_pos, score=s, sim=sim, doc=cnd.doc,
                              votes=cnd.votes, pop=cnd.pop, dyear=dyear))
        if wt.doc_filter and any(not x["doc"] for x in cands):
            cands = [x for x in cands if not x["doc"]]
        if not cands:
            out[row.row_id] = None
            continue
        key = lambda x: tuple([-x["score"]] + [-float(x[t]) for t in wt.ties] + [x["cand_pos"], x["cand_id"]])
        cands.sort(key=key)
        if wt.min_score is not None and cands[0]["score"] <= wt.min_score:
            out[row.row_id] = None
            continue
        if wt.min_sim is not None and cands[0]["sim"] < wt.min_sim:
            out[row.row_id] = None
            continue
        if wt.studio:
            top = cands[:wt.top]
            hint = " ".join(str(row.studio_hint or "").lower().split())
            best, best_v = None, None
            for x in top:
                ss = 0.0
                if hint:
                    for nm in comp_by.get(x["cand_id"], []):
                        nm = " ".join(str(nm).lower().split())
                        if nm:
                            ss = max(ss, indel_ratio_py(hint, nm))
                v = x["score"] + wt.studio * ss
                if best_v is None or v > best_v:
                    best, best_v = x, v
            out[row.row_id] = best["cand_id"]
        else:
            out[row.row_id] = cands[0]["cand_id"]
    return out


@pytest.mark.parametrize("preset", ["V1", "V2", "V3", "V4", "SECONDARY"])
def test_pick_equals_brute_force(spark, preset):
    wt = getattr(MT, preset)
    dv = adapter.driver(spark, SF001)
    wanted, cat = LK.wanted_titles(dv), LK.catalogue(dv)
    comp = LK.candidate_companies(LK.movie_details(dv))
    got = {r["row_id"]: r["matched_id"] for r in MT.pick(wanted, cat, wt, comp).collect()}
    w = wanted.toPandas()
    c = MT.prepare_catalogue(cat).toPandas()
    want = brute_force(w, c, comp.toPandas(), wt)
    assert got == want
    assert sum(v is not None for v in got.values()) > 0


def titles(spark, names, year=2000):
    return spark.createDataFrame([(i, i % 7, n, f"{year}-01-01", 3, 1.0, [18]) for i, n in enumerate(names)],
                                 "cand_id long, cand_pos int, title string, release_date string, vote_count long, popularity double, "
                                 "genre_ids array<int>")


def words(n, seed):
    import random
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 14))) for _ in range(n)]


def test_common_word_verifies_few_pairs(spark):
    names = [f"common {x}" for x in words(400, 1)]
    cands = MT.prepare_catalogue(titles(spark, names))
    wanted = spark.createDataFrame([(f"common {x[:-1]}q", 2000) for x in words(400, 1)], "w_norm string, w_year int")
    pairs = MT.filtered_pairs(wanted, cands, MT.SECONDARY)
    assert pairs.count() < 400 * 400 / 10
    got = {r["w_norm"]: r["s"] for r in MT.with_similarity(pairs, "w_norm", "c_norm", "sim").groupBy("w_norm").agg(MT.F.max("sim").alias("s")).collect()}
    assert got == {r.w_norm: max(indel_ratio_py(r.w_norm, n) for n in names) for r in wanted.collect()}


def test_equal_candidates_are_reduced(spark):
    cat = titles(spark, ["the same film"] * 300 + ["the other film"] * 200)
    cands = MT.prepare_catalogue(cat)
    assert MT.distinguishable(cands, MT.SECONDARY).count() == 2
    assert MT.distinguishable(cands, MT.V3).count() == 2 * MT.V3.top
    wanted = spark.createDataFrame([(1, "the same film", "the same film", 2000)], "row_id long, title string, w_norm string, w_year int")
    r = MT.pick(wanted, cat, MT.SECONDARY).first()
    assert (r["matched_id"], r["sim"]) == (0, 1.0)


def test_bound_is_never_below_the_similarity(spark):
    a = words(60, 3) + ["", "a b c", "žluťoučký kůň", "the the the"]
    df = spark.createDataFrame([(x, y) for x in a for y in a[::3]], "x string, y string")
    df = MT.measured(MT.measured(df, "x", "w"), "y", "c").withColumn("bound", MT.similarity_bound("w", "c"))
    for r in df.select("x", "y", "bound").collect():
        assert r["bound"] >= indel_ratio_py(r["x"], r["y"]) - 1e-12


@pytest.mark.parametrize("days", [3, 300])
def test_rows_of_one_key_and_day_are_ranked_once(spark, days):
    """Many rows and candidates under one title and year, all close enough to
    be told apart by the date bonus: the ranking is made per day, not per row
    and candidate, and is what the brute force finds."""
    import datetime

    def day(i):
        return str(datetime.date(2000, 1, 1) + datetime.timedelta(i % days))
    cat = spark.createDataFrame([(i, i % 5, "the same film", day(i * 7), 3, 1.0 + i % 40 / 100, [18]) for i in range(240)],
                                "cand_id long, cand_pos int, title string, release_date string, vote_count long, popularity double, genre_ids array<int>")
    wanted = spark.createDataFrame([(i, "the same film", "the same film", 2000, day(i * 11) if i % 50 else ["", None, "soon"][i % 3], f"studio {i % 9}") for i in range(160)],
                                   "row_id long, title string, w_norm string, w_year int, date_hint string, studio_hint string")
    comp = spark.createDataFrame([(i, f"studio {i % 4}") for i in range(0, 240, 2)], "cand_id long, company string")
    got = {r["row_id"]: r["matched_id"] for r in MT.pick(wanted, cat, MT.V3, comp).collect()}
    assert got == brute_force(wanted.toPandas(), MT.prepare_catalogue(cat).toPandas(), comp.toPandas(), MT.V3)
    keyed = MT.key_scores(wanted, MT.prepare_catalogue(cat), MT.V3)
    questions = MT.asked(wanted, MT.V3).select(*MT.KEY, MT.DAY).distinct()
    assert keyed.count() > 200
    assert MT.score(questions, keyed, MT.V3).count() == MT.V3.top * questions.count() <= MT.V3.top * (days + 1)
