"""Oracle SQL of fuzzy matching: every pair of the blocking rule, scored, no
pruning.  The similarity is the recurrence of the longest common subsequence,
one row a step: entry j is the largest of what came before it, of the old
entry, and, where the characters agree, of the old entry at j - 1 plus one.
"""

from __future__ import annotations

from marquee.operators import match as MT
from sqloracle.queries import ENRICH, NORM_TITLE, PAD, reg

_p = "p.p_partkey"
WANTED = ("wanted", f"""SELECT {_p} AS row_id, {NORM_TITLE('substr(p.p_name, 1, length(p.p_name) - 1)')} AS w_norm,
  CASE WHEN {_p} % 37 <> 0 THEN year(fs.d0) END AS w_year, fs.d0 + cast({_p} % 40 AS integer) AS date_hint,
  {PAD('Supplier#', f'{_p} % cnt.n_sup')} AS studio_hint
FROM part p LEFT JOIN first_ship fs ON {_p} = fs.l_partkey CROSS JOIN cnt""")
CANDS = ("cands", f"""SELECT {_p} AS cand_id, cast({_p} % 20 AS integer) AS cand_pos, {NORM_TITLE('p.p_name')} AS c_norm, fs.d0 AS release_date,
  year(fs.d0) AS c_year, coalesce(cast(p.p_size AS double), 0) AS votes, coalesce(cast(p.p_retailprice AS double) / 100, 0) AS pop, {_p} % 17 = 0 AS doc
FROM part p LEFT JOIN first_ship fs ON {_p} = fs.l_partkey""")
KEY_PAIRS = ("key_pairs", """SELECT DISTINCT k.w_norm, k.w_year, c.*
  FROM (SELECT DISTINCT w_norm, w_year, unnest(list_filter(string_split(w_norm, ' '), lambda x: x <> '')) AS token FROM wanted) k
  JOIN (SELECT *, unnest(list_distinct(list_filter(string_split(c_norm, ' '), lambda x: x <> ''))) AS token FROM cands) c
    ON k.token = c.token AND (k.w_year IS NULL OR abs(c.c_year - k.w_year) <= 1)""")


def similarity(name: str, pairs: str) -> tuple[str, str]:
    """(a, b, sim) of the distinct pairs (a, b)."""
    agree = "list_transform(range(0, length(a) + 1), lambda j: CASE WHEN j > 0 AND substr(a, j, 1) = substr(b, i + 1, 1) THEN line[j] + 1 ELSE line[j + 1] END)"
    return (name, f"""SELECT * FROM (
  WITH RECURSIVE r(a, b, i, line) AS (
    SELECT a, b, 0, list_transform(range(0, length(a) + 1), lambda x: 0) FROM (SELECT DISTINCT a, b FROM ({pairs}) q) d
    UNION ALL
    SELECT a, b, i + 1, list_transform(range(1, length(a) + 2), lambda j: list_max(t[1:j])) FROM (SELECT a, b, i, {agree} AS t FROM r WHERE i < length(b)) s)
  SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN cast(1 AS double) ELSE cast(2 AS double) * line[-1] / (length(a) + length(b)) END AS sim
    FROM r WHERE i = length(b)) z""")


def _num(x: float) -> str:
    return f"cast({x!r} AS double)"


PAIRED = [WANTED, CANDS, KEY_PAIRS]


def best_of(w: MT.Weights, p: str = "", wanted: str = "wanted") -> list[tuple[str, str]]:
    """CTEs up to ``{p}best`` (row_id, b) of the rows of ``wanted``."""
    days = "abs(datediff('day', date_hint, release_date))"
    bonus = "CASE " + " ".join(f"WHEN {days} <= {lim} THEN {b}" for lim, b in w.date_bonus) + " ELSE 0 END" if w.date_bonus else "0"
    ties = {"sim": "sim", "votes": "votes", "pop": "pop", "dyear": "dyear", "doc": "cast(doc AS integer)"}
    order = ", ".join(["score DESC", *[f"{ties[t]} DESC" for t in w.ties], "cand_pos", "cand_id"])
    docs = "WHERE NOT (doc AND other)" if w.doc_filter else ""
    ctes = [(f"{p}keyed", f"""SELECT *, {_num(w.votes)} * votes + {_num(w.pop)} * pop + {_num(w.sim)} * sim - {_num(w.year)} * dyear - {_num(w.doc)} * cast(cast(doc AS integer) AS double) AS base
  FROM (SELECT k.*, s.sim, cast(coalesce(abs(c_year - w_year), 0) AS double) AS dyear, max(CASE WHEN doc THEN 0 ELSE 1 END) OVER (PARTITION BY w_norm, w_year) = 1 AS other
          FROM key_pairs k JOIN title_sims s ON k.w_norm = s.a AND k.c_norm = s.b) x {docs}"""),
            (f"{p}ranked", f"""SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {order}) AS rank
  FROM (SELECT w.row_id, w.studio_hint, k.cand_id, k.cand_pos, k.votes, k.pop, k.doc, k.sim, k.dyear, k.base + cast({bonus} AS double) AS score
          FROM {wanted} w JOIN {p}keyed k ON w.w_norm = k.w_norm AND w.w_year IS NOT DISTINCT FROM k.w_year) x""")]
    passes = ["rank = 1"]
    if w.min_sim is not None:
        passes.append(f"sim >= {_num(w.min_sim)} - 1e-12")
    if w.min_score is not None:
        passes.append(f"score > {_num(w.min_score)}")
    ok = f"(SELECT row_id FROM {p}ranked WHERE {' AND '.join(passes)})"
    if w.studio:
        ctes += [(f"{p}hints", f"""SELECT r.row_id, r.cand_id, lower(trim(r.studio_hint)) AS a, lower(trim(u.c.name)) AS b
  FROM {p}ranked r JOIN (SELECT movie_id, unnest(production_companies) AS c FROM movie_details) u ON r.cand_id = u.movie_id
 WHERE r.rank <= {w.top} AND trim(u.c.name) <> ''"""), similarity(f"{p}studio_sims", f"SELECT a, b FROM {p}hints"),
                 (f"{p}best", f"""SELECT row_id, arg_min({{'cand_id': cand_id, 'score': score, 'sim': sim}}, (-(score + {_num(w.studio)} * studio_sim), rank)) AS b
  FROM (SELECT r.*, coalesce(h.s, 0) AS studio_sim FROM {p}ranked r
          LEFT JOIN (SELECT row_id, cand_id, max(sim) AS s FROM {p}hints JOIN {p}studio_sims USING (a, b) GROUP BY ALL) h USING (row_id, cand_id)
         WHERE r.rank <= {w.top} AND r.row_id IN {ok}) x GROUP BY row_id""")]
    else:
        ctes.append((f"{p}best", f"SELECT row_id, {{'cand_id': cand_id, 'score': score, 'sim': sim}} AS b FROM {p}ranked WHERE rank = 1 AND row_id IN {ok}"))
    return ctes


SIMS = similarity("title_sims", "SELECT w_norm AS a, c_norm AS b FROM key_pairs")


def picked(w: MT.Weights) -> tuple[str, list[tuple[str, str]]]:
    return """SELECT w.row_id, b.b.cand_id AS matched_id, b.b.score AS score, b.b.sim AS sim,
       CASE WHEN b.row_id IS NULL THEN 'unmatched' ELSE 'matched' END AS match_source
  FROM wanted w LEFT JOIN best b ON w.row_id = b.row_id""", ENRICH[:1] + PAIRED + [SIMS] + best_of(w)


for _key, _w in (("k10_match", MT.V3), ("k10_match_v1", MT.V1), ("k10_match_v2", MT.V2), ("k10_match_v4", MT.V4), ("k8_secondary_search", MT.SECONDARY)):
    reg(_key, *picked(_w))
_body, _ctes = picked(MT.V3)
reg("d18_match_stats", f"""SELECT count(*) FILTER (match_source = 'matched') AS matched, count(*) FILTER (match_source = 'unmatched') AS unmatched, count(*) AS rows
  FROM ({_body}) m""", _ctes)
reg("k1_ratio", "SELECT w.row_id, w.w_norm, c.c_norm, s.sim AS ratio FROM wanted w JOIN cands c ON w.row_id = c.cand_id JOIN title_sims s ON w.w_norm = s.a AND c.c_norm = s.b",
    [WANTED, CANDS, similarity("title_sims", "SELECT w_norm AS a, c_norm AS b FROM wanted JOIN cands ON row_id = cand_id")])

# ------------------------------------------------------------------ the full match, from an empty cache
_same = "{a}.w_norm = {b}.w_norm AND {a}.w_year IS NOT DISTINCT FROM {b}.w_year"
FULL = ENRICH[:1] + PAIRED + [SIMS, ("firsts", "SELECT * FROM wanted QUALIFY row_number() OVER (PARTITION BY w_norm, w_year ORDER BY row_id) = 1"),
                              *best_of(MT.V3, "a_", "firsts"), ("rests", "SELECT * FROM firsts WHERE row_id NOT IN (SELECT row_id FROM a_best)"), *best_of(MT.SECONDARY, "b_", "rests"),
                              ("found", """SELECT f.row_id AS rep, f.w_norm, f.w_year, x.b.cand_id AS matched_id, x.by AS found_by
  FROM firsts f JOIN (SELECT *, 'primary' AS by FROM a_best UNION ALL SELECT *, 'secondary' FROM b_best) x ON f.row_id = x.row_id"""),
                              ("matches", f"""SELECT w.row_id, f.matched_id, CASE WHEN f.rep IS NULL THEN 'unmatched' WHEN f.rep = w.row_id THEN f.found_by ELSE 'cache' END AS match_source
  FROM wanted w LEFT JOIN found f ON {_same.format(a='w', b='f')}""")]
reg("k10_match_cached", "SELECT * FROM matches", FULL)
_n = ", ".join(f"count(*) FILTER (s = '{x}') AS n_{x}" for x in ("cache", "primary", "secondary", "unmatched"))
reg("d18_source_counts", f"""SELECT run, {_n}, count(*) AS rows
  FROM (SELECT 1 AS run, match_source AS s FROM matches UNION ALL SELECT 2, CASE WHEN matched_id IS NULL THEN 'unmatched' ELSE 'cache' END FROM matches) x GROUP BY run""", FULL)
