"""Fuzzy title matching.

Pipeline: wanted rows -> blocked candidates -> score -> documentary rule ->
top-1 (threshold on the winner only) -> optional studio re-rank of the top
``w.top`` -> matched id + match source.

Blocking [decision]: a candidate qualifies when it shares at least one
normalised title token with the wanted title and its release year is within
±``year_tol`` (any year when the wanted year is NULL).  A title without
normalised tokens (no ``[a-z0-9]``) is its own block key, lower-cased, without
a trailing year: it meets candidates with exactly that title.

Exact pruning (no cap, no sampling): inside one block every candidate has a
guaranteed score ``LB`` (similarity 0, worst year gap, no bonus) and a best
possible score ``UB``.  A candidate whose ``UB`` is below the ``k``-th largest
``LB`` of a block it belongs to can never reach the top ``k`` of any wanted
row that reaches that block, so it is dropped before the pair join.  The
k-th largest ``LB`` comes from (block, value) counts and a per-block rank
filter that Spark applies before the shuffle, so a hot block is not sent
whole to one task.
Documentaries are dropped from blocks that contain a non-documentary, which
is exactly the reference's row-level rule restricted to one block.

Candidates are generated and scored once per distinct wanted (title, year)
key; only the date bonus depends on the row, and it is given once per distinct
(key, day of the hint).  Candidates that no score, tie
or bonus tells apart are reduced to the first ones of the final order.

The similarity search filters before it verifies.  Every title carries its
length and its character counts, which bound the longest common subsequence
and so the score from above, in built-in expressions.  A probe of each key's
rarest block verifies only the candidates with the best bounds and so gives
the key a floor that its best candidates reach.  All blocks are then joined on
(token, year, length class), with the length classes that can still reach the
floor, so a hot block is dealt by length and pairs that are too unlike are
never formed; of the pairs, those whose bound is below the floor are dropped,
and the rest are verified by the Arrow UDF of ``functions.similarity``, once
per distinct pair of titles.  A last exact prune keeps per key only candidates
whose key score plus the largest bonus can still reach the key's k-th score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.clean import TITLE_YEAR_SUFFIX, day_distance, norm_text, norm_title, parse_date, prefix_year
from marquee.functions.similarity import indel_ratio
from marquee.operators.cache import KeyedCache
from marquee.operators.keys import keep_first


@dataclass(frozen=True)
class Weights:
    votes: float
    pop: float
    sim: float
    year: float
    doc: float
    date_bonus: tuple = ()          # ((max_days, bonus), ...) first hit wins
    min_sim: float | None = None    # tested on the winner only
    doc_filter: bool = True         # drop documentaries when a non-doc exists
    studio: float = 0.0             # re-rank weight among the top `top`
    top: int = 3
    ties: tuple = ("sim",)          # descending tie-breaks after the score
    min_score: float | None = None  # the winner's score must exceed this


# --- fixed values: the four scorer presets of the reference --------------
V1 = Weights(10, 1, 5, 2, 5, ties=("votes", "pop", "sim", "dyear", "doc"))
V2 = Weights(12, 2, 8, 2, 20, min_sim=0.60)
V3 = Weights(12, 2, 8, 2, 20, date_bonus=((7, 15), (30, 8), (60, 4)), min_sim=0.60, studio=20)
V4 = Weights(10, 2, 15, 3, 0, min_sim=0.60, doc_filter=False)
# K8: secondary title/year search — 5·sim − Δyear, first strict maximum, must exceed −1
SECONDARY = Weights(0, 0, 5, 1, 0, doc_filter=False, ties=(), min_score=-1.0)
DOC_GENRE = 99
EPS = 1e-6


def title_tokens(norm: Column) -> Column:
    whole = (norm != "") & ~norm.rlike("[a-z0-9]")  # a raw title is one token
    return F.when(whole, F.array(norm)).otherwise(F.array_distinct(F.filter(F.split(norm, " "), lambda x: x != "")))


def or_raw_title(norm: Column, title: Column) -> Column:
    """The normalised title, or the lower-cased raw one when nothing is left."""
    raw = F.regexp_replace(norm_text(title), "(?U)" + TITLE_YEAR_SUFFIX, "")
    return F.when(norm == "", F.trim(raw)).otherwise(norm)


def prepare_catalogue(cat: DataFrame) -> DataFrame:
    """cand_id, cand_pos, title, release_date, vote_count, popularity, genre_ids
    -> normalised candidate rows."""
    return cat.select(
        "cand_id", "cand_pos", or_raw_title(norm_title("title"), F.col("title")).alias("c_norm"),
        prefix_year("release_date").alias("c_year"), "release_date",
        F.coalesce(F.col("vote_count"), F.lit(0)).cast("double").alias("votes"),
        F.coalesce(F.col("popularity"), F.lit(0.0)).cast("double").alias("pop"),
        F.coalesce(F.array_contains("genre_ids", DOC_GENRE), F.lit(False)).alias("doc"))


# characters that are counted one by one; all others count together
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "
LENGTH_STEP = 1.15               # ratio of the lengths of neighbouring classes
LENGTH_CLASSES = 48              # the last one has all longer titles


def char_counts(s: Column) -> Column:
    """How often each counted character occurs, and how many others there are."""
    counts = [F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit(""))) for ch in COUNTED]
    return F.array(*counts, F.length(F.translate(s, COUNTED, "")))


def length_class(n: Column) -> Column:
    return F.least(F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(LENGTH_STEP)), F.lit(LENGTH_CLASSES)).cast("int")


def similarity_bound(a: str, b: str) -> Column:
    """No smaller than the indel similarity of titles ``a`` and ``b``: a
    common subsequence has each character at most as often as both."""
    shared = F.aggregate(F.zip_with(f"{a}_chars", f"{b}_chars", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    total = F.col(f"{a}_len") + F.col(f"{b}_len")
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)


def measured(df: DataFrame, title: str, name: str) -> DataFrame:
    return df.withColumns({f"{name}_len": F.length(title), f"{name}_chars": char_counts(F.col(title))})


def _kept(w: Weights) -> int:
    return w.top if w.studio else 1


def distinguishable(cands: DataFrame, w: Weights) -> DataFrame:
    """Of candidates that are equal in all that scores, ties and bonuses look
    at, the first ``k`` of the final order; others can never be chosen."""
    seen = ["c_norm", "c_year", "doc"] + [c for c, weight in (("votes", w.votes), ("pop", w.pop)) if weight or c in w.ties]
    if w.date_bonus:
        seen.append("release_date")
    order = Window.partitionBy(*seen).orderBy("cand_pos", "cand_id")
    return cands.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= _kept(w)).drop("_nth")


def _bounds(df: DataFrame, w: Weights, year_gap: int) -> DataFrame:
    base = w.votes * F.col("votes") + w.pop * F.col("pop") - w.doc * F.col("doc").cast("double")
    best_bonus = max([b for _, b in w.date_bonus], default=0)
    return df.withColumns({"lb": base - w.year * year_gap, "ub": base + w.sim + best_bonus})


def kth_largest(df: DataFrame, keys: list[str], col: str, k: int) -> DataFrame:
    """Per group, the k-th largest value of ``col`` counting duplicates
    (NULL when the group has fewer than k rows).

    (group, value) counts are a partial aggregate; the top-k distinct values
    per group come from a rank filter that Spark applies before the shuffle
    (WindowGroupLimit), so a hot group sends at most k rows per partition."""
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.desc(col))
    top = counts.withColumn("_rk", F.row_number().over(order)).filter(F.col("_rk") <= k)
    cum = top.withColumn("_cum", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cum.groupBy(*keys).agg(F.max(F.when(F.col("_cum") >= k, F.col(col))).alias("kth"))


def pruned_blocks(cands: DataFrame, w: Weights, by_year: bool, year_gap: int) -> DataFrame:
    keys = ["token", "c_year"] if by_year else ["token"]
    tok = cands.select("*", F.explode(title_tokens(F.col("c_norm"))).alias("token"))
    if by_year:
        tok = tok.filter(F.col("c_year").isNotNull())
    tok = _bounds(tok, w, year_gap)
    if w.doc_filter:
        nd = tok.groupBy(*keys).agg(F.max((~F.col("doc")).cast("int")).alias("_any_nondoc"))
        tok = tok.join(nd, keys).filter(~(F.col("doc") & (F.col("_any_nondoc") == 1))).drop("_any_nondoc")
    th = kth_largest(tok, keys, "lb", _kept(w))
    return tok.join(th, keys, "left").filter(F.col("kth").isNull() | (F.col("ub") >= F.col("kth") - EPS))


CANDIDATE = ["cand_id", "cand_pos", "c_norm", "c_year", "release_date", "votes", "pop", "doc", "c_len", "c_chars"]


def blocks(cands: DataFrame, w: Weights, year_tol: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pruned blocks by (token, year) and, for wanted titles without a year,
    by token; with the length class of the candidate."""
    dealt = cands.withColumn("length_class", length_class(F.col("c_len")))
    return pruned_blocks(dealt, w, True, year_tol), pruned_blocks(dealt, w, False, 0)


def _wanted_blocks(keys: DataFrame, year_tol: int) -> tuple[DataFrame, DataFrame]:
    """Keys by (token, year) of the blocks they meet, and those without a
    year by token."""
    wt = keys.withColumn("token", F.explode(title_tokens(F.col("w_norm"))))
    known = wt.filter(F.col("w_year").isNotNull()).withColumn("c_year", F.explode(F.sequence(F.col("w_year") - year_tol, F.col("w_year") + year_tol)))
    return known, wt.filter(F.col("w_year").isNull())


def candidates(keys: DataFrame, block: tuple[DataFrame, DataFrame], w: Weights, year_tol: int = 1) -> DataFrame:
    """Distinct (key, candidate) pairs of the blocking rule, after
    exact pruning.  ``keys`` holds w_norm, w_year, w_len, w_chars and a floor
    (or null); candidates whose length keeps them below the floor are left
    out before a pair is formed."""
    base = keys.columns
    out = []
    for wanted, cands, on in zip(_wanted_blocks(keys, year_tol), block, (["token", "c_year"], ["token"])):
        most = cands.groupBy(*on).agg(F.max("ub").alias("_most"))
        rows = wanted.join(most, on)
        # similarity that a candidate of the block needs, and the length ratio that allows it
        need = (F.col("floor") - EPS - (F.col("_most") - w.sim)) / w.sim if w.sim else F.when(F.col("floor").isNotNull(), F.lit(0.0))
        need = F.greatest(F.coalesce(need, F.lit(0.0)), F.lit(0.0))
        ratio = need / (2.0 - F.least(need, F.lit(1.0)))
        low = length_class(F.floor(F.col("w_len") * ratio - EPS))
        high = F.when(ratio > 0, length_class(F.ceil(F.col("w_len") / F.greatest(ratio, F.lit(1e-9)) + EPS))).otherwise(LENGTH_CLASSES)
        rows = rows.filter(need <= 1.0 + EPS).withColumn("length_class", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, low))))
        out.append(rows.join(cands.select(*dict.fromkeys([*on, "length_class", *CANDIDATE])), [*on, "length_class"]).select(*base, *CANDIDATE))
    return out[0].unionByName(out[1]).dropDuplicates(["w_norm", "w_year", "cand_id"])


def with_similarity(pairs: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Attach indel similarity, computed once per distinct string pair."""
    d = pairs.select(F.col(left).alias("_a"), F.col(right).alias("_b")).distinct()
    d = d.withColumn(name, indel_ratio("_a", "_b"))
    return pairs.join(d, (pairs[left] == d["_a"]) & (pairs[right] == d["_b"])).drop("_a", "_b")


NO_YEAR = -99999  # join stand-in for a NULL wanted year (not a valid year)


def _base(w: Weights, sim: str) -> Column:
    dyear = F.coalesce(F.abs(F.col("c_year") - F.col("w_year")), F.lit(0)).cast("double")
    return (w.votes * F.col("votes") + w.pop * F.col("pop") + w.sim * F.col(sim) - w.year * dyear
            - w.doc * F.col("doc").cast("double"))


def probed(keys: DataFrame, block: tuple[DataFrame, DataFrame], w: Weights, year_tol: int) -> DataFrame:
    """The floor of each key: the k-th best score among the candidates with
    the best bounds in its rarest block; null where there are fewer.  Where
    documentaries may be dropped only other candidates count."""
    out = []
    for wanted, cands, on in zip(_wanted_blocks(keys, year_tol), block, (["token", "c_year"], ["token"])):
        size = cands.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
        rare = wanted.join(size, "token").groupBy("w_norm", "w_year").agg(F.min_by("token", F.struct("_n", "token")).alias("_rare"))
        same = (F.col("w_norm") == F.col("_k")) & F.col("w_year").eqNullSafe(F.col("_y"))
        at = wanted.join(rare.select(F.col("w_norm").alias("_k"), F.col("w_year").alias("_y"), "_rare"), same).filter(F.col("token") == F.col("_rare"))
        near = at.withColumn("length_class", F.explode(F.sequence(length_class(F.col("w_len")) - 1, length_class(F.col("w_len")) + 1)))
        pairs = near.drop("floor").join(cands.select(*dict.fromkeys([*on, "length_class", *CANDIDATE])), [*on, "length_class"])
        out.append(pairs.select("w_norm", "w_year", "w_len", "w_chars", *CANDIDATE))
    pairs = out[0].unionByName(out[1])
    if w.doc_filter:
        pairs = pairs.filter(~F.col("doc"))
    k = _kept(w)
    best = Window.partitionBy("w_norm", "w_year").orderBy(F.desc("_ub"), "cand_id")
    pairs = pairs.withColumn("_bound", similarity_bound("w", "c")).withColumn("_ub", _base(w, "_bound"))
    top = pairs.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= k)
    exact = with_similarity(top.select("w_norm", "w_year", *CANDIDATE), "w_norm", "c_norm", "sim").withColumn("base", _base(w, "sim"))
    return exact.groupBy("w_norm", "w_year").agg(F.when(F.count(F.lit(1)) >= k, F.min("base")).alias("floor"))


def filtered_pairs(wanted: DataFrame, cands: DataFrame, w: Weights, year_tol: int = 1) -> DataFrame:
    """Pairs (key, candidate) to be verified: all that can be among the first
    k of a key, and few others."""
    from marquee.session import materialize

    catalogue = materialize(measured(distinguishable(cands, w), "c_norm", "c"), "match-catalogue")
    block = tuple(materialize(x, "match-blocks") for x in blocks(catalogue, w, year_tol))
    keys = materialize(measured(wanted.select("w_norm", "w_year").distinct(), "w_norm", "w"), "match-keys")
    floor = materialize(probed(keys, block, w, year_tol).select(F.col("w_norm").alias("_k"), F.col("w_year").alias("_y"), "floor"), "match-floor")
    same = (F.col("w_norm") == F.col("_k")) & F.col("w_year").eqNullSafe(F.col("_y"))
    pairs = candidates(keys.join(floor, same, "left").drop("_k", "_y"), block, w, year_tol)
    best_bonus = max([b for _, b in w.date_bonus], default=0)
    pairs = pairs.withColumn("_bound", similarity_bound("w", "c"))
    pairs = pairs.filter(F.col("floor").isNull() | (_base(w, "_bound") + best_bonus >= F.col("floor") - EPS))
    if w.doc_filter:                 # a floor comes from a candidate that is no documentary
        pairs = pairs.filter(F.col("floor").isNull() | ~F.col("doc"))
    return materialize(pairs.drop("w_len", "w_chars", "c_len", "c_chars"), "match-pairs")


def key_scores(wanted: DataFrame, cands: DataFrame, w: Weights, year_tol: int = 1) -> DataFrame:
    """Candidates and their row-independent score (everything but the date
    bonus) once per distinct (title, year) key — the candidate set depends
    only on that key.  Documentary rule applied per key (exact: a row's
    candidate set is its key's).  Then a second exact prune: a candidate
    whose key score plus the largest possible bonus is below the key's k-th
    score cannot enter the top k of any row of that key."""
    kp = with_similarity(filtered_pairs(wanted, cands, w, year_tol), "w_norm", "c_norm", "sim")
    dyear = F.coalesce(F.abs(F.col("c_year") - F.col("w_year")), F.lit(0)).cast("double")
    kp = kp.withColumns({"dyear": dyear, "base": _base(w, "sim"),
                         "_wy": F.coalesce(F.col("w_year"), F.lit(NO_YEAR))})
    kk = ["w_norm", "_wy"]
    if w.doc_filter:
        nd = kp.groupBy(*kk).agg(F.max((~F.col("doc")).cast("int")).alias("_nd"))
        kp = kp.join(nd, kk).filter(~(F.col("doc") & (F.col("_nd") == 1))).drop("_nd")
    best_bonus = max([b for _, b in w.date_bonus], default=0)
    kth = kth_largest(kp, kk, "base", _kept(w))
    return kp.join(kth, kk, "left").filter(
        F.col("kth").isNull() | (F.col("base") + best_bonus >= F.col("kth") - EPS))


def final_order(w: Weights, score: Column) -> list[Column]:
    """Candidates from the best on: score, the ties of ``w``, position, id."""
    tie_cols = {"sim": F.col("sim"), "votes": F.col("votes"), "pop": F.col("pop"),
                "dyear": F.col("dyear"), "doc": F.col("doc").cast("int")}
    return [score.desc()] + [tie_cols[t].desc() for t in w.ties] + [F.asc("cand_pos"), F.asc("cand_id")]


def first_of(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; a rank filter that Spark applies
    before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= k).drop("_nth")


KEY, DAY = ["w_norm", "_wy"], "_day"
NO_DAY = -(1 << 30)  # join stand-in for a missing or unreadable day


def day_number(date: Column) -> Column:
    return F.coalesce(F.datediff(parse_date(date), F.lit("1900-01-01").cast("date")), F.lit(NO_DAY))


def asked(wanted: DataFrame, w: Weights) -> DataFrame:
    """Rows with what their ranking depends on: the key and, where dates give
    a bonus, the day of the row's hint."""
    day = day_number(F.col("date_hint")) if w.date_bonus and "date_hint" in wanted.columns else F.lit(NO_DAY)
    return wanted.withColumns({"_wy": F.coalesce(F.col("w_year"), F.lit(NO_YEAR)), DAY: day})


def score(questions: DataFrame, keyed: DataFrame, w: Weights) -> DataFrame:
    """The first k candidates of every question (key, day) with
    score = key score + date bonus of the day.

    Without a date bonus they are the key's first k.  With one they are among
    (a) the key's first k: a candidate without a bonus has all that are before
    it in the key before it here too; (b) candidates released within the bonus
    window of the day, found by a band join: buckets of the window width,
    equi-join on (key, bucket ± 1), then the exact day test.  Candidates of
    one key and release day get the same bonus from any question, so of these
    only the first k for each size of the bonus can be chosen, and (b) pairs
    days with days: its size does not grow with the rows or candidates of a
    key and day."""
    k = _kept(w)
    keyed = keyed.drop("w_year")
    top = first_of(keyed, KEY, final_order(w, F.col("base")), k)
    if not w.date_bonus:
        return questions.join(top, KEY).withColumn("score", F.col("base"))
    keyed, top = (x.withColumn("_cd", day_number(F.col("release_date"))) for x in (keyed, top))
    width = max(lim for lim, _ in w.date_bonus) + 1
    dated = keyed.filter(F.col("_cd") != NO_DAY)
    near = None
    for b in sorted({0.0, *(float(b) for _, b in w.date_bonus)}):
        best = first_of(dated, [*KEY, "_cd"], final_order(w, F.col("base") + F.lit(b)), k)
        near = best if near is None else near.unionByName(best)
    near = near.dropDuplicates([*KEY, "cand_id"])
    bucket = lambda d: F.floor(F.col(d) / width).cast("int")
    near = near.withColumn("_b", F.explode(F.sequence(bucket("_cd") - 1, bucket("_cd") + 1)))
    known = questions.filter(F.col(DAY) != NO_DAY).withColumn("_b", bucket(DAY))
    days = F.when((F.col(DAY) != NO_DAY) & (F.col("_cd") != NO_DAY), F.abs(F.col(DAY) - F.col("_cd")))
    band = known.join(near, [*KEY, "_b"]).drop("_b").filter(days <= width - 1)
    pairs = questions.join(top, KEY).unionByName(band).dropDuplicates([*KEY, DAY, "cand_id"])
    expr = None
    for lim, b in w.date_bonus:
        expr = F.when(days <= lim, F.lit(float(b))) if expr is None else expr.when(days <= lim, F.lit(float(b)))
    out = pairs.withColumn("score", F.col("base") + F.coalesce(expr, F.lit(0.0)))
    return first_of(out, [*KEY, DAY], final_order(w, F.col("score")), k)


def pick(wanted: DataFrame, catalogue: DataFrame, w: Weights = V3, companies: DataFrame | None = None,
         year_tol: int = 1) -> DataFrame:
    """One output row per wanted row: matched cand_id (or NULL), its
    base score and similarity, and ``match_source`` matched/unmatched."""
    from marquee.session import materialize

    cands = prepare_catalogue(catalogue)
    if "title" in wanted.columns:
        wanted = wanted.withColumn("w_norm", or_raw_title(F.col("w_norm"), F.col("title")))
    # stage boundary: key-level candidates (UDF run once per distinct title pair)
    keyed = materialize(key_scores(wanted, cands, w, year_tol), "match-keyed")
    rows = asked(wanted, w)
    found = score(rows.select(*KEY, DAY).distinct(), keyed, w).drop("release_date")
    pairs = rows.join(found, [*KEY, DAY])
    if w.date_bonus:
        pairs = pairs.dropDuplicates(["row_id", "cand_id"])
    own = Window.partitionBy("row_id")
    ranked = pairs.withColumn("rank", F.row_number().over(own.orderBy(*final_order(w, F.col("score")))))
    ranked = ranked.filter(F.col("rank") <= _kept(w))  # WindowGroupLimit before the shuffle
    ok = F.lit(True) if w.min_sim is None else (F.col("sim") >= F.lit(w.min_sim) - 1e-12)
    if w.min_score is not None:
        ok = ok & (F.col("score") > F.lit(w.min_score))
    chosen = ranked.withColumn("_ok", F.max(F.when(F.col("rank") == 1, ok)).over(own)).filter("_ok")
    chosen = chosen.select("row_id", "cand_id", "score", "sim", "rank", *[c for c in ("studio_hint",) if c in wanted.columns])
    if w.studio and companies is not None and "studio_hint" in wanted.columns:
        chosen = materialize(chosen, "match-chosen")      # read by the re-rank and by its similarities
        cc = chosen.select("row_id", "cand_id", "studio_hint").join(companies, "cand_id")
        cc = cc.select("row_id", "cand_id", norm_text("studio_hint").alias("_h"), norm_text("company").alias("_c"))
        cc = cc.filter(F.col("_c") != "")
        cc = with_similarity(cc, "_h", "_c", "_ss")
        ss = cc.groupBy("row_id", "cand_id").agg(F.max("_ss").alias("studio_sim"))
        chosen = chosen.join(ss, ["row_id", "cand_id"], "left").withColumn(
            "studio_sim", F.when(F.length(F.trim(F.coalesce("studio_hint", F.lit("")))) > 0,
                                 F.coalesce("studio_sim", F.lit(0.0))).otherwise(F.lit(0.0)))
        chosen = chosen.withColumn("final", F.col("score") + w.studio * F.col("studio_sim"))
        best = chosen.groupBy("row_id").agg(F.min_by(F.struct("cand_id", "score", "sim"),
                                                     F.struct(-F.col("final"), F.col("rank"))).alias("b"))
    else:
        best = chosen.filter(F.col("rank") == 1).select("row_id", F.struct("cand_id", "score", "sim").alias("b"))
    out = wanted.select("row_id").join(best, "row_id", "left")
    return out.select("row_id", F.col("b.cand_id").alias("matched_id"), F.col("b.score").alias("score"),
                      F.col("b.sim").alias("sim"),
                      F.when(F.col("b.cand_id").isNotNull(), F.lit("matched")).otherwise(F.lit("unmatched"))
                      .alias("match_source"))


MATCHES = T.StructType([T.StructField("w_norm", T.StringType()), T.StructField("w_year", T.IntegerType()), T.StructField("matched_id", T.LongType()), T.StructField("found_by", T.StringType())])
MATCH_KEYS = ["w_norm", "w_year"]
CACHE, PRIMARY, FALLBACK, UNMATCHED = "cache", "primary", "secondary", "unmatched"


def match_cache(spark, path: str, buckets: int = 64) -> KeyedCache:
    return KeyedCache(spark, path, MATCHES, MATCH_KEYS, ["matched_id"], buckets)


def full_match(wanted: DataFrame, catalogue: DataFrame, cache: KeyedCache, companies: DataFrame | None = None,
               primary: Weights = V3, secondary: Weights = SECONDARY) -> DataFrame:
    """K10 with A7 and C16: (row_id, matched_id, match_source).

    A title and year in the cache is not searched.  Of the rows of any other
    key the first is searched, with its hints, by ``primary``, and if that
    finds nothing by ``secondary``; what is found goes into the cache, and the
    other rows of the key take it from there.  Keys that nothing is found for
    are not cached and will be searched again.  ``match_source`` is cache,
    primary, secondary or unmatched."""
    from marquee.session import materialize

    rows = wanted
    if "title" in wanted.columns:
        rows = wanted.withColumn("w_norm", or_raw_title(F.col("w_norm"), F.col("title")))
    rows = rows.withColumn("w_year", F.col("w_year").cast("int"))
    looked = materialize(cache.hits(rows, "matched_id"), "match-looked")
    known = looked.filter("cache_hit").select("row_id", F.col("cached_matched_id").alias("matched_id"), F.lit(CACHE).alias("match_source"))
    missing = looked.filter("not cache_hit").drop("cached_matched_id", "cache_hit")
    first = materialize(keep_first(missing, MATCH_KEYS, [F.col("row_id")]), "match-first")
    if first.isEmpty():
        return known
    tried = materialize(pick(first, catalogue, primary, companies), "match-primary")
    rest = first.join(tried.filter(F.col("matched_id").isNull()).select("row_id"), "row_id", "left_semi")
    fallback = pick(rest, catalogue, secondary)
    found = tried.select("row_id", "matched_id", F.lit(PRIMARY).alias("found_by")).unionByName(fallback.select("row_id", "matched_id", F.lit(FALLBACK).alias("found_by")))
    found = materialize(first.select("row_id", *MATCH_KEYS).join(found.filter(F.col("matched_id").isNotNull()), "row_id"), "match-found")
    cache.upsert(found)
    f = found.select(F.col("row_id").alias("_rep"), *[F.col(k).alias(f"_{k}") for k in MATCH_KEYS], "matched_id", "found_by")
    same = F.col("w_norm").eqNullSafe(F.col("_w_norm")) & F.col("w_year").eqNullSafe(F.col("_w_year"))
    source = F.when(F.col("matched_id").isNull(), UNMATCHED).when(F.col("row_id") == F.col("_rep"), F.col("found_by")).otherwise(CACHE)
    return known.unionByName(missing.join(f, same, "left").select("row_id", "matched_id", source.alias("match_source")))


def source_counts(matches: DataFrame) -> DataFrame:
    """Rows by the way their match was found, all four in one row."""
    return matches.agg(*[F.count_if(F.col("match_source") == s).alias(f"n_{s}") for s in (CACHE, PRIMARY, FALLBACK, UNMATCHED)], F.count(F.lit(1)).alias("rows"))


def match_stats(matches: DataFrame) -> DataFrame:
    """Matched / unmatched counters."""
    return matches.agg(F.count_if(F.col("match_source") == "matched").alias("matched"),
                       F.count_if(F.col("match_source") == "unmatched").alias("unmatched"),
                       F.count(F.lit(1)).alias("rows"))
