"""Oracle SQL bodies, one per query key (DuckDB dialect, same column names
as the Spark side)."""

from __future__ import annotations

from marquee.plans import questions as Q
from sqloracle.adapter import q, with_ctes

ORACLE: dict[str, str] = {}
DIRTY: set[str] = set()


def R(num: str, den: str) -> str:
    """sum / count as one double division; NULL on an empty group."""
    return f"cast({num} AS double) / nullif(cast({den} AS double), 0)"


def D(x: str) -> str:
    return f"cast({x} AS double)"


def bracket(c: str, edges, top: str, unknown: str = "Unknown") -> str:
    whens = " ".join(f"WHEN {c} < {u} THEN {q(lbl)}" for u, lbl in edges)
    return f"CASE WHEN {c} IS NULL THEN {q(unknown)} {whens} ELSE {q(top)} END"


COMMON = [
    ("fr", """SELECT fk_film, sum(gross_revenue_per_day) AS rev, count(*) AS n_days
  FROM fact_daily_box_office GROUP BY fk_film"""),
    ("fwr", "SELECT * FROM fr JOIN dim_film df ON fr.fk_film = df.sk_film"),
    ("top_films", f"SELECT * FROM fwr ORDER BY rev DESC, sk_film ASC LIMIT {Q.TOP_FILMS}"),
]


def reg(key: str, body: str, extra=None, dirty: bool = False) -> None:
    ORACLE[key] = with_ctes(body, dirty=dirty, extra=COMMON + (extra or []))
    if dirty:
        DIRTY.add(key)


# ------------------------------------------------------------------ BQ
reg("bq1", f"""SELECT a.bk_actor, a.first_name_actor, a.surname_actor,
       count(DISTINCT fa.fk_film) AS n_top_films, {D('sum(fa.rev)')} AS top_films_revenue
  FROM fa JOIN top_films t ON fa.fk_film = t.sk_film JOIN dim_actor a ON fa.fk_actor = a.sk_actor
 GROUP BY a.bk_actor, a.first_name_actor, a.surname_actor""",
    [("fa", """SELECT fk_film, fk_actor, sum(gross_revenue_per_day) AS rev
  FROM fact_daily_box_office GROUP BY 1, 2""")])

AWARDED = "CASE WHEN film_awards_won > 0 THEN 'Yes' ELSE 'No' END"
reg("bq2", f"""SELECT {AWARDED} AS awarded, count(*) AS n_films,
       {R('sum(rev)', 'count(*)')} AS avg_film_revenue,
       {R('sum(imdb_rating)', 'count(imdb_rating)')} AS avg_imdb_rating,
       {R('sum(rt_rating)', 'count(rt_rating)')} AS avg_rt_rating
  FROM fwr GROUP BY 1""")

reg("bq2_genre", f"""SELECT film_genre, {AWARDED} AS awarded, count(*) AS n_films,
       {R('sum(rev)', 'count(*)')} AS avg_film_revenue
  FROM fwr WHERE film_genre IS NOT NULL GROUP BY 1, 2""")

reg("bq3", f"""SELECT {bracket('film_runtime_min', Q.RUNTIME_BRACKETS, Q.RUNTIME_TOP)} AS runtime_bracket,
       count(*) AS n_films, {R('sum(rev)', 'count(*)')} AS avg_film_revenue,
       {R('sum(rev)', 'sum(n_days)')} AS avg_daily_revenue,
       {R('sum(imdb_rating)', 'count(imdb_rating)')} AS avg_imdb_rating
  FROM fwr GROUP BY 1""")

WEEK = f"cast(floor(datediff('day', DATE '{Q.WEEK_ORIGIN}', d.proper_date) / 7) AS integer)"
reg("bq4", f"""SELECT w.film_genre, {R('sum(w.rev - p.rev)', 'count(w.rev - p.rev)')} AS avg_weekly_change,
       count(w.rev - p.rev) AS n_changes
  FROM gw w LEFT JOIN gw p ON p.film_genre = w.film_genre AND p.week_no = w.week_no - 1
 GROUP BY w.film_genre""",
    [("gw", f"""SELECT df.film_genre, {WEEK} AS week_no, sum(f.gross_revenue_per_day) AS rev
  FROM fact_daily_box_office f JOIN dim_film df ON f.fk_film = df.sk_film
  JOIN dim_date d ON f.fk_date = d.sk_date
 WHERE df.film_genre IS NOT NULL GROUP BY 1, 2""")])

reg("bq5", f"""SELECT df.main_filming_country, c.country_production_company,
       count(DISTINCT fc.fk_film) AS n_films, {D('sum(fc.rev)')} AS total_revenue,
       df.main_filming_country = c.country_production_company AS same_country
  FROM fc JOIN dim_film df ON fc.fk_film = df.sk_film
  JOIN dim_production_company c ON fc.fk_production_company = c.sk_production_company
 GROUP BY 1, 2""",
    [("fc", """SELECT fk_film, fk_production_company, sum(gross_revenue_per_day) AS rev
  FROM fact_daily_box_office GROUP BY 1, 2""")])

reg("bq6", f"""SELECT d.bk_director, d.first_name_director, d.surname_director, count(*) AS n_films,
       {R('sum(x.rev)', 'count(*)')} AS avg_film_revenue,
       {R('sum(x.film_runtime_min)', 'count(x.film_runtime_min)')} AS avg_runtime_min,
       {R('sum(x.imdb_rating)', 'count(x.imdb_rating)')} AS avg_imdb_rating,
       {R('sum(x.rt_rating)', 'count(x.rt_rating)')} AS avg_rt_rating
  FROM (SELECT fd.fk_director, fd.rev, df.* FROM fd JOIN dim_film df ON fd.fk_film = df.sk_film) x
  JOIN dim_director d ON x.fk_director = d.sk_director
 GROUP BY 1, 2, 3""",
    [("fd", """SELECT fk_film, fk_director, sum(gross_revenue_per_day) AS rev
  FROM fact_daily_box_office GROUP BY 1, 2""")])

reg("bq7", f"""SELECT g.film_genre, g.total_revenue, fl.n_films, fl.avg_imdb_rating, fl.avg_runtime_min,
       g.best_season, g.best_season_revenue
  FROM (SELECT film_genre, {D('sum(rev)')} AS total_revenue,
               arg_min(calendar_season, (-rev, calendar_season)) AS best_season,
               {D('max(rev)')} AS best_season_revenue
          FROM gs GROUP BY 1) g
  JOIN (SELECT film_genre, count(*) AS n_films,
               {R('sum(imdb_rating)', 'count(imdb_rating)')} AS avg_imdb_rating,
               {R('sum(film_runtime_min)', 'count(film_runtime_min)')} AS avg_runtime_min
          FROM fwr WHERE film_genre IS NOT NULL GROUP BY 1) fl ON g.film_genre = fl.film_genre""",
    [("gs", """SELECT df.film_genre, d.calendar_season, sum(f.gross_revenue_per_day) AS rev
  FROM fact_daily_box_office f JOIN dim_date d ON f.fk_date = d.sk_date
  JOIN dim_film df ON f.fk_film = df.sk_film
 WHERE df.film_genre IS NOT NULL GROUP BY 1, 2""")])

reg("bq8", f"""SELECT {bracket('imdb_rating', Q.IMDB_BRACKETS, Q.IMDB_TOP)} AS imdb_bracket,
       {bracket('rt_rating', Q.RT_BRACKETS, Q.RT_TOP)} AS rt_bracket,
       count(*) AS n_films, {D('sum(rev)')} AS total_revenue,
       {R('sum(rev)', 'count(*)')} AS avg_film_revenue
  FROM fwr GROUP BY 1, 2""")

reg("bq9", f"""SELECT coalesce(df.film_age_classification, 'Unknown') AS film_age_classification,
       d.calendar_season, coalesce(df.film_genre, 'Unknown') AS film_genre,
       {D('sum(f.gross_revenue_per_day)')} AS total_revenue,
       {R('sum(f.gross_revenue_per_day)', 'count(*)')} AS avg_daily_revenue
  FROM fact_daily_box_office f JOIN dim_date d ON f.fk_date = d.sk_date
  JOIN dim_film df ON f.fk_film = df.sk_film
 GROUP BY 1, 2, 3""")

reg("bq10", f"""SELECT d.weekday_number, d.weekday_name, count(*) AS n_days,
       {R('sum(pd.rev)', 'count(*)')} AS avg_daily_revenue
  FROM pd JOIN dim_date d ON pd.fk_date = d.sk_date GROUP BY 1, 2""",
    [("pd", "SELECT fk_date, sum(gross_revenue_per_day) AS rev FROM fact_daily_box_office GROUP BY 1")])

reg("bq11", """SELECT language, count(*) AS n_films, cast(sum(p) AS bigint) AS n_primary,
       cast(sum(s) AS bigint) AS n_secondary
  FROM (SELECT primary_language_film AS language, 1 AS p, 0 AS s FROM top_films
        UNION ALL SELECT secondary_language_film, 0, 1 FROM top_films) x
 WHERE language IS NOT NULL GROUP BY 1""")

reg("bq12", f"""SELECT budget_class, cast(rank_in_class AS integer) AS rank_in_class, bk_film, film_title,
       {D('imdb_rating')} AS imdb_rating, {D('rt_rating')} AS rt_rating,
       {D('film_budget_usd')} AS film_budget_usd
  FROM (SELECT *, row_number() OVER (PARTITION BY budget_class
                 ORDER BY imdb_rating DESC NULLS LAST, rt_rating DESC NULLS LAST, bk_film ASC) AS rank_in_class
          FROM (SELECT *, CASE WHEN cast(film_budget_usd AS double) >=
                         (SELECT median(cast(film_budget_usd AS double)) FROM fwr) THEN 'High' ELSE 'Low' END
                         AS budget_class FROM fwr) b) r
 WHERE rank_in_class <= {Q.TOP_RATED}""")

reg("bq13", f"""SELECT dy.calendar_year, dy.best_date, dy.best_date_revenue, s.best_season,
       s.best_season_revenue, m.best_marketing_season, m.best_marketing_revenue
  FROM (SELECT calendar_year, arg_min(proper_date, (-rev, proper_date)) AS best_date,
               {D('max(rev)')} AS best_date_revenue FROM j GROUP BY 1) dy
  JOIN (SELECT calendar_year, arg_min(calendar_season, (-rev, calendar_season)) AS best_season,
               {D('max(rev)')} AS best_season_revenue
          FROM (SELECT calendar_year, calendar_season, sum(rev) AS rev FROM j GROUP BY 1, 2) GROUP BY 1) s
    ON dy.calendar_year = s.calendar_year
  JOIN (SELECT calendar_year, arg_min(marketing_season, (-rev, marketing_season)) AS best_marketing_season,
               {D('max(rev)')} AS best_marketing_revenue
          FROM (SELECT calendar_year, marketing_season, sum(rev) AS rev FROM j GROUP BY 1, 2) GROUP BY 1) m
    ON dy.calendar_year = m.calendar_year""",
    [("pd", "SELECT fk_date, sum(gross_revenue_per_day) AS rev FROM fact_daily_box_office GROUP BY 1"),
     ("j", "SELECT pd.rev, d.* FROM pd JOIN dim_date d ON pd.fk_date = d.sk_date")])

GENRE_YEAR = ("gy", """SELECT df.film_genre, d.calendar_year AS box_year,
       sum(f.gross_revenue_per_day) AS annual_revenue
  FROM fact_daily_box_office f JOIN dim_film df ON f.fk_film = df.sk_film
  JOIN dim_date d ON f.fk_date = d.sk_date
 WHERE df.film_genre IS NOT NULL GROUP BY 1, 2""")
TREND = ("trend", f"""SELECT film_genre,
       CASE WHEN n < 2 THEN 'Stable' WHEN slope > mean * {Q.TREND_THRESHOLD} THEN 'Growing'
            WHEN slope < -(mean * {Q.TREND_THRESHOLD}) THEN 'Declining' ELSE 'Stable' END AS genre_trend,
       CASE WHEN n < 2 THEN mean
            ELSE greatest((syd - slope * sxd) / cast(n AS double) + slope * nx, 0.0) END
         AS genre_projected_revenue
  FROM (SELECT film_genre, n, cast(sy AS double) / cast(n AS double) AS mean,
               cast(n * sxy - sx * sy AS double) / nullif(cast(n * sxx - sx * sx AS double), 0) AS slope,
               cast(sx AS double) AS sxd, cast(sy AS double) AS syd,
               cast((SELECT max(box_year) + 1 FROM gy) AS double) AS nx
          FROM (SELECT film_genre, count(*) AS n, sum(cast(box_year AS bigint)) AS sx,
                       sum(annual_revenue) AS sy, sum(cast(box_year AS bigint) * cast(box_year AS bigint)) AS sxx,
                       sum(annual_revenue * cast(box_year AS bigint)) AS sxy
                  FROM gy GROUP BY 1) m) t""")
reg("bqp1_genre_trend", "SELECT * FROM trend", [GENRE_YEAR, TREND])


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# ------------------------------------------------------------------ DQ
from marquee.operators import quality as QC  # noqa: E402
from marquee.sources import schemas as SC  # noqa: E402

_STG_COLS = {n: [f.name for f in s.fields] for n, s in SC.STAGING.items()}


def _log(rule: int, table: str, check: str, msg: str, n_sql: str) -> str:
    return (f"SELECT cast({rule} AS integer) AS id_check, {q(QC.PHASE)} AS etl_phase, "
            f"{q(table)} AS etl_table, {q(check)} AS etl_checktype, "
            f"concat({q(msg)}, lpad(cast(n AS varchar), 10, ' ')) AS description_result, "
            f"CASE WHEN n > 0 THEN 'FAIL' ELSE 'OK' END AS etl_result FROM ({n_sql}) x")


def dq_log_sql() -> str:
    parts = []
    for tb, bk, _ in QC.DIMENSIONS:
        parts.append(_log(1, tb, QC.CHECK_BK, QC.MSG_BK,
                          f"SELECT count(*) FILTER (WHERE c > 1) AS n FROM "
                          f"(SELECT {bk}, count(*) AS c FROM {tb} GROUP BY {bk}) g"))
    for tb, bk, attrs in QC.DIMENSIONS:
        cols = ", ".join(attrs or [c for c in _STG_COLS[tb] if c != bk])
        parts.append(_log(2, tb, QC.CHECK_ATTR, QC.MSG_ATTR,
                          f"SELECT cast(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS bigint) AS n FROM "
                          f"(SELECT {cols}, count(*) AS c FROM {tb} GROUP BY ALL) g"))
    keys = ", ".join(QC.FACT_KEYS)
    parts.append(_log(3, QC.FACT, QC.CHECK_PK, QC.MSG_PK,
                      f"SELECT count(*) FILTER (WHERE c > 1) AS n FROM "
                      f"(SELECT {keys}, count(*) AS c FROM {QC.FACT} GROUP BY ALL) g"))
    for label, fk, dim, key in QC.PARENTS:
        parts.append(_log(4, QC.FACT, QC.CHECK_FK.format(label), QC.MSG_FK,
                          f"SELECT count(*) AS n FROM {QC.FACT} f LEFT JOIN {dim} d ON f.{fk} = d.{key} "
                          f"WHERE d.{key} IS NULL"))
    for rid, cond, check, msg in [
        (5, "gross_revenue_per_day < 0", QC.CHECK_REV, QC.MSG_REV),
        (6, "days_since_release < 0", QC.CHECK_DAYS, QC.MSG_DAYS),
        (7, "gross_revenue_per_day IS NOT NULL AND days_since_release IS NULL", QC.CHECK_REV_DAYS,
         QC.MSG_REV_DAYS)]:
        parts.append(_log(rid, QC.FACT, check, msg, f"SELECT count(*) AS n FROM {QC.FACT} WHERE {cond}"))
    return "\nUNION ALL\n".join(parts)


reg("dq_log", dq_log_sql())
reg("dq_log_dirty", dq_log_sql(), dirty=True)

_R2 = " AND ".join(f"f.{a} IS NOT DISTINCT FROM d.{a}" for a in QC.FILM_ATTRS)
_R2_BODY = f"""SELECT f.* FROM stg_dim_film f
 WHERE EXISTS (SELECT 1 FROM (SELECT {', '.join(QC.FILM_ATTRS)} FROM stg_dim_film
                               GROUP BY ALL HAVING count(*) > 1) d WHERE {_R2})"""


def _film_out(alias: str = "") -> str:
    """Film columns with decimals presented as double."""
    cols = []
    for f in SC.STG_DIM_FILM.fields:
        c = f"{alias}{f.name}"
        cols.append(f"cast({c} AS double) AS {f.name}" if "Decimal" in type(f.dataType).__name__ else c)
    return ", ".join(cols)


reg("dq_r2_detail", f"SELECT {_film_out()} FROM ({_R2_BODY}) r")
reg("dq_r2_detail_dirty", f"SELECT {_film_out()} FROM ({_R2_BODY}) r", dirty=True)
reg("dq_r7_detail_dirty", """SELECT d.film_title, f.fk_date, cast(f.gross_revenue_per_day AS double) AS gross_revenue_per_day,
       f.days_since_release
  FROM stg_fact_daily_box_office f JOIN stg_dim_film d ON f.fk_film = d.bk_film
 WHERE f.gross_revenue_per_day IS NOT NULL AND f.days_since_release IS NULL""", dirty=True)
reg("dw_fk_check", """SELECT f.fk_date, d.proper_date, cast(f.gross_revenue_per_day AS double) AS gross_revenue_per_day,
       f.days_since_release, film.film_title
  FROM fact_daily_box_office f JOIN dim_date d ON f.fk_date = d.sk_date
  JOIN dim_film film ON f.fk_film = film.sk_film
 ORDER BY f.fk_date, f.fk_film LIMIT 10""")

# ------------------------------------------------------------------ warehouse tables
reg("dim_date", "SELECT * FROM dim_date")
reg("dim_film_sk", f"SELECT sk_film, {_film_out()} FROM dim_film")
reg("dim_actor_sk", "SELECT * FROM dim_actor")
reg("dim_director_sk", "SELECT * FROM dim_director")
reg("dim_company_sk", "SELECT * FROM dim_production_company")
reg("fact_sk", """SELECT fk_date, fk_film, fk_production_company, fk_director, fk_actor,
       cast(gross_revenue_per_day AS double) AS gross_revenue_per_day, days_since_release
  FROM fact_daily_box_office""")
reg("stg_fact", """SELECT fk_date, fk_film, fk_production_company, fk_director, fk_actor,
       cast(gross_revenue_per_day AS double) AS gross_revenue_per_day, days_since_release
  FROM stg_fact_daily_box_office""")


# ------------------------------------------------------------------ measures
STAR = [("star", """SELECT f.*, df.*, d.* FROM fact_daily_box_office f
  JOIN dim_film df ON f.fk_film = df.sk_film JOIN dim_date d ON f.fk_date = d.sk_date"""),
        ("star_a", "SELECT s.*, a.* FROM star s JOIN dim_actor a ON s.fk_actor = a.sk_actor"),
        ("star_d", """SELECT f.*, x.* FROM fact_daily_box_office f
  JOIN dim_director x ON f.fk_director = x.sk_director"""),
        ("star_c", """SELECT f.*, x.* FROM fact_daily_box_office f
  JOIN dim_production_company x ON f.fk_production_company = x.sk_production_company"""),
        ("star_t", "SELECT f.*, d.* FROM fact_daily_box_office f JOIN dim_date d ON f.fk_date = d.sk_date")]
G = "gross_revenue_per_day"


def regm(key, body, extra=None):
    reg(key, body, STAR + (extra or []))


regm("m_total_revenue", f"SELECT calendar_year, {D(f'sum({G})')} AS total_revenue FROM star GROUP BY 1")
regm("m_total_films", "SELECT calendar_year, count(DISTINCT fk_film) AS total_films FROM star GROUP BY 1")
regm("m_avg_daily", f"SELECT calendar_year, {R(f'sum({G})', 'count(*)')} AS avg_daily_revenue FROM star GROUP BY 1")
regm("m_avg_days", f"""SELECT film_genre, {R('sum(days_since_release)', 'count(days_since_release)')}
       AS avg_days_since_release FROM star GROUP BY 1""")
for _k, _a in [("m_avg_imdb", "imdb_rating"), ("m_avg_rt", "rt_rating")]:
    regm(_k, f"""SELECT calendar_year, {R('sum(v)', 'count(v)')} AS avg_{_a}
  FROM (SELECT calendar_year, fk_film, any_value({_a}) AS v FROM star GROUP BY 1, 2) x GROUP BY 1""")
regm("m_avg_actor_rev", f"""SELECT nationality_actor, {R('sum(r)', 'count(*)')} AS avg_actor_revenue
  FROM (SELECT nationality_actor, fk_actor, sum({G}) AS r FROM star_a GROUP BY 1, 2) x GROUP BY 1""")
regm("m_avg_genre_rev", f"""SELECT calendar_year, {R('sum(r)', 'count(*)')} AS avg_genre_revenue
  FROM (SELECT calendar_year, film_genre, sum({G}) AS r FROM star WHERE film_genre IS NOT NULL
        GROUP BY 1, 2) x GROUP BY 1""")
regm("m_avg_rev_per_film", f"""SELECT film_genre, {R('sum(r)', 'count(*)')} AS avg_revenue_per_film
  FROM (SELECT film_genre, fk_film, sum({G}) AS r FROM star GROUP BY 1, 2) x GROUP BY 1""")
FILM_DAYS = ("fdays", f"""SELECT fk_film, film_genre, max(days_since_release) AS film_days,
       sum({G}) AS film_revenue FROM star GROUP BY 1, 2""")
regm("m_avg_genre_days", f"""SELECT film_genre, {R('sum(film_days)', 'count(film_days)')} AS avg_genre_days
  FROM fdays WHERE film_genre IS NOT NULL GROUP BY 1""", [FILM_DAYS])
_WK = f"cast(floor(datediff('day', DATE '{Q.WEEK_ORIGIN}', proper_date) / 7) AS integer)"


def _weekly(by: str) -> list:
    return [("wk", f"SELECT {by}, {_WK} AS week_no, sum({G}) AS rev FROM star GROUP BY 1, 2"),
            ("wd", f"""SELECT w.{by}, w.week_no, w.rev, w.rev - p.rev AS delta FROM wk w
  LEFT JOIN wk p ON p.{by} IS NOT DISTINCT FROM w.{by} AND p.week_no = w.week_no - 1""")]


regm("m_avg_weekly_change", f"""SELECT film_age_classification, {R('sum(delta)', 'count(delta)')} AS avg_weekly_change
  FROM wd GROUP BY 1""", _weekly("film_age_classification"))
regm("m_weekly_change", """SELECT film_genre, week_no, cast(rev AS double) AS weekly_revenue,
       cast(delta AS double) AS weekly_revenue_change FROM wd""", _weekly("film_genre"))
regm("m_last_week", f"""SELECT film_genre, {D(f'sum({G})')} AS revenue_last_week FROM star
 WHERE proper_date > (SELECT max(proper_date) FROM star) - INTERVAL 7 DAY GROUP BY 1""")
regm("m_rev_per_budget", f"""SELECT calendar_year, {R('sum(r)', 'sum(b)')} AS revenue_per_budget_dollar
  FROM (SELECT calendar_year, fk_film, sum({G}) AS r, any_value(film_budget_usd) AS b FROM star GROUP BY 1, 2) x
 GROUP BY 1""")


def _vs(per: str, key: str, value: str, grp: str, kpi: str, cols: str) -> str:
    return f"""SELECT {cols}, a.{grp}, cast(p.{value} AS double) - a.{grp} AS {kpi}
  FROM {per} p JOIN (SELECT {key}, {R(f'sum({value})', f'count({value})')} AS {grp} FROM {per} GROUP BY 1) a
    ON p.{key} = a.{key}"""


regm("m_kpi_days", _vs("(SELECT * FROM fdays WHERE film_genre IS NOT NULL)", "film_genre", "film_days",
                       "genre_avg_days", "kpi_days_vs_genre", "p.fk_film, p.film_genre, p.film_days"),
     [FILM_DAYS])
regm("m_kpi_genre", _vs("(SELECT * FROM fdays WHERE film_genre IS NOT NULL)", "film_genre", "film_revenue",
                        "genre_avg_revenue", "kpi_revenue_vs_genre",
                        "p.fk_film, p.film_genre, cast(p.film_revenue AS double) AS film_revenue"), [FILM_DAYS])
regm("m_kpi_actor", _vs("fa", "fk_actor", "film_revenue", "actor_avg_revenue", "kpi_revenue_vs_actor",
                        "p.fk_actor, p.fk_film, cast(p.film_revenue AS double) AS film_revenue"),
     [("fa", f"SELECT fk_actor, fk_film, sum({G}) AS film_revenue FROM star GROUP BY 1, 2")])
regm("m_roi", f"""SELECT fk_film, cast(rev AS double) AS film_revenue, cast(b AS double) AS film_budget_usd,
       CASE WHEN b > 0 THEN {R('rev', 'b')} END AS roi
  FROM (SELECT fk_film, sum({G}) AS rev, any_value(film_budget_usd) AS b FROM star GROUP BY 1) x""")

# ------------------------------------------------------------------ hierarchies
for _k, _levels, _src in [
    ("h_calendar", ["calendar_year", "calendar_season", "month_number"], "star_t"),
    ("h_marketing", ["calendar_year", "marketing_season", "is_holiday", "holiday_name"], "star_t"),
    ("h_weekday", ["weekday_type", "weekday_name"], "star_t"),
    ("h_actor", ["nationality_actor", "surname_actor", "first_name_actor"], "star_a"),
    ("h_director", ["nationality_director", "surname_director", "first_name_director"], "star_d"),
    ("h_company", ["continent_production_company", "country_production_company",
                   "city_production_company", "production_company"], "star_c"),
]:
    _lv = ", ".join(_levels)
    regm(_k, f"""SELECT {_lv}, {D(f'sum({G})')} AS total_revenue, count(DISTINCT fk_film) AS n_films,
       grouping_id({_lv}) AS level_id
  FROM {_src} GROUP BY ROLLUP ({_lv})""")


# ------------------------------------------------------------------ cleaners
from sqloracle.adapter import _case_mod  # noqa: E402
from marquee.sources.adapter import LANGUAGES  # noqa: E402


def _cs(x: str, branches) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {i} THEN {b}" for i, b in enumerate(branches)) + " END"


def S(x: str) -> str:
    return f"cast({x} AS varchar)"


_p = "p.p_partkey"
_budget = S(f"cast(cast(p.p_retailprice AS decimal(18,2)) * 1000 AS bigint)")
_tail = f"concat({S(f'greatest({_p} % 7 - 3, 0)')}, ' wins & ', {S(f'{_p} % 11')}, ' nominations total')"
_osc = f"(CASE WHEN {_p} % 97 = 0 THEN 1 ELSE 0 END)"
_primary = _case_mod(f"{_p} % 4", LANGUAGES)
FILM_TEXTS = ("film_texts", f"""SELECT {_p} AS p_partkey,
  {_cs(f'{_p} % 4', [f"concat(p.p_name, ' (', {S('year(fs.d0)')}, ')')", "concat(upper(p.p_name), '!')",
                      f"concat('  ', p.p_name, ': Part ', {S('p.p_size')}, ' ')", 'p.p_name'])} AS title_raw,
  {_cs(f'{_p} % 3', [f"substr({S('fs.d0')}, 3, 8)", S('fs.d0'), S('fs.d0')])} AS release_text,
  {_cs(f'{_p} % 3', [f"concat({S('60 + 2 * p.p_size')}, ' min')", "'N/A'", f"concat({S('p.p_size')}, ' h')"])}
    AS runtime_text,
  {_cs(f'{_p} % 3', [f"concat({_primary}, ', Italian, ')", _primary, "''"])} AS languages_text,
  {_cs(f'{_p} % 3', [f"concat('$', substr({_budget}, 1, 3), ',', substr({_budget}, 4, 3))", "'N/A'",
                      f"concat('$', {S('p.p_size')}, '.5M')"])} AS budget_text,
  CASE WHEN {_p} % 7 = 0 THEN 'N/A'
       WHEN {_osc} > 0 THEN concat('Won ', {S(_osc)}, ' Oscars. ', {_tail})
       WHEN {_p} % 13 > 0 THEN concat('Nominated for ', {S(f'{_p} % 13')}, ' Oscar. ', {_tail})
       ELSE {_tail} END AS awards_text,
  concat(upper(substr(p.p_type, 1, 1)), lower(substr(p.p_type, 2, 100)), ', Drama',
         CASE WHEN {_p} % 2 = 0 THEN ', Comedy' ELSE '' END) AS genre_text,
  CASE WHEN {_p} % 2 = 0 THEN concat(n1.n_name, ' , ', n2.n_name) ELSE n1.n_name END AS countries_text,
  concat({S(f'({_p} * 37) % 101')}, '%') AS rt_text,
  CASE WHEN {_p} % 29 <> 0 THEN cast(60 + 2 * p.p_size AS integer) END AS runtime_min
FROM part p LEFT JOIN first_ship fs ON p.p_partkey = fs.l_partkey
LEFT JOIN nation n1 ON n1.n_nationkey = {_p} % 25 LEFT JOIN nation n2 ON n2.n_nationkey = ({_p} * 7) % 25""")

_c = "c.c_custkey"
_y = f"(1950 + {_c} % 40)"
_cy = f"(CASE WHEN {_c} % 6 < 4 THEN {_y} ELSE {_y} + 1 END)"
PERSON_TEXTS = ("person_texts", f"""SELECT {_c} AS c_custkey,
  concat('  ', upper(c.c_name), '   Studios ') AS studio_text,
  {_cs(f'{_c} % 5', [f"concat('  First', {S(f'{_c} % 17')}, '   Last', {S(f'{_c} % 23')}, ' Jr ')",
                      f"concat('Mono', {S(f'{_c} % 9')})",
                      f"concat('Ann', {S(f'{_c} % 13')}, ' Lee', {S(f'{_c} % 29')})",
                      f"concat('Ann', {S(f'{_c} % 13')}, ' Lee', {S(f'{_c} % 29')})", "'   '"])} AS name_text,
  CASE WHEN {_c} % 7 = 0 THEN ' , '
       ELSE concat('Town', {S(f'{_c} % 11')}, ', Region', {S(f'{_c} % 3')}, ', ', n.n_name) END AS birthplace,
  CASE WHEN {_c} % 6 = 0 THEN '' WHEN {_c} % 6 = 1 THEN concat('City', {S(f'{_c} % 7')})
       ELSE concat('City', {S(f'{_c} % 7')}, ', ', n.n_name) END AS hq_text,
  {_cs(f'{_c} % 4', ['cast(NULL AS varchar)', S(_y),
                      f"concat({S(_y)}, '-0', {S(f'1 + {_c} % 9')}, '-1', {S(f'{_c} % 9')})", "''"])}
    AS birth_existing,
  {_cs(f'{_c} % 5', [f"concat({S(_cy)}, '-0', {S(f'1 + {_c} % 9')}, '-2', {S(f'{_c} % 9')})", S(_cy), "'bad'",
                      'cast(NULL AS varchar)',
                      f"concat({S(_cy)}, '-1', {S(f'{_c} % 3')}, '-0', {S(f'1 + {_c} % 8')})"])} AS birth_candidate,
  CASE WHEN {_c} % 9 <> 0 THEN concat('+', {S(f'1900 + {_c} % 100')}, '-04-04T00:00:00Z') END AS inception_text,
  {S(f"DATE '1995-01-01' + cast({_c} % 400 AS integer)")} AS hint_date
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")


def regt(key: str, src: str, cols: str) -> None:
    k = "p_partkey" if src == "film_texts" else "c_custkey"
    reg(key, f"SELECT {k}, {cols} FROM {src}", [FILM_TEXTS, PERSON_TEXTS])


def NORM_TITLE(c: str) -> str:
    s = f"trim(lower(coalesce({c}, '')))"
    s = f"regexp_replace({s}, '\\s*\\(\\d{{4}}\\)$', '')"
    s = f"regexp_replace({s}, '[^a-z0-9 ]+', ' ', 'g')"
    s = f"regexp_replace({s}, ' +', ' ', 'g')"
    return f"trim({s})"


def PARSE_YEAR(c: str) -> str:
    return f"year(try_strptime(trim({c}), ['%Y-%m-%d', '%Y']))"


def BLANK(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


regt("b1_norm_title", "film_texts", f"title_raw, {NORM_TITLE('title_raw')} AS title_norm")
regt("b2_norm_text", "person_texts",
     "studio_text, regexp_replace(trim(lower(coalesce(studio_text, ''))), '\\s+', ' ', 'g') AS studio_norm")
_yt = "CASE WHEN p_partkey % 4 = 0 THEN 'N/A' WHEN p_partkey % 4 = 1 THEN '' ELSE substr(release_text, 1, 4) END"
_dt = "CASE WHEN p_partkey % 3 <> 0 THEN release_text ELSE 'N/A' END"
regt("b3_row_year", "film_texts", f"""{_yt} AS year_text, {_dt} AS date_text,
  coalesce(TRY_CAST(trim({_yt}) AS INTEGER), {PARSE_YEAR(_dt)}) AS row_year""")
regt("b4_prefix_year", "film_texts",
     "release_text, TRY_CAST(regexp_extract(release_text, '^(\\d{4})', 1) AS INTEGER) AS release_year")
regt("b5_minutes", "film_texts", """runtime_text,
  CASE WHEN contains(runtime_text, 'min') THEN TRY_CAST(split_part(runtime_text, ' ', 1) AS INTEGER) END
    AS runtime_parsed""")
regt("b6_token_count", "film_texts", """languages_text,
  CASE WHEN languages_text IS NULL OR languages_text = '' THEN NULL
       ELSE cast(len(list_filter(string_split(languages_text, ','), lambda x: trim(x) <> '')) AS integer) END
    AS n_languages""")
regt("b7_money", "film_texts",
     "budget_text, TRY_CAST(regexp_replace(budget_text, '[$,]', '', 'g') AS BIGINT) AS budget_usd")
regt("b8_city", "person_texts", "hq_text, nullif(trim(split_part(hq_text, ',', 1)), '') AS city")
regt("b9_nationality", "person_texts", """birthplace,
  list_filter(list_transform(string_split(birthplace, ','), lambda x: trim(x)), lambda x: x <> '')[-1]
    AS nationality""")
regt("b12_runtime_segment", "film_texts",
     f"runtime_min, {bracket('runtime_min', [(90, 'Short'), (121, 'Standard')], 'Long')} AS segment")
_nm = "regexp_replace(trim(name_text), '\\s+', ' ', 'g')"
regt("b15_name_split", "person_texts", f"""name_text,
  CASE WHEN {_nm} <> '' THEN split_part({_nm}, ' ', 1) END AS first_name,
  nullif(regexp_extract({_nm}, '^\\S+ (.+)$', 1), '') AS surname""")


def _award(pat: str, name: str) -> str:
    v = "nullif(trim(awards_text), 'N/A')"
    n = f"regexp_extract({v}, '{pat}', 1)"
    return f"CASE WHEN {v} IS NOT NULL THEN coalesce(TRY_CAST(nullif({n}, '') AS INTEGER), 0) END AS {name}"


regt("b16_awards", "film_texts", ", ".join(["awards_text", _award("(\\d+) wins?\\b", "wins"),
                                            _award("(\\d+) nominations?\\b", "nominations"),
                                            _award("Won (\\d+) Oscars?\\b", "oscars_won"),
                                            _award("Nominated for (\\d+) Oscars?\\b", "oscar_nominations")]))
regt("b17_genre_blend", "film_texts", """genre_text,
  array_to_string(list_filter(list_transform(string_split(genre_text, ','), lambda x: trim(x)),
                              lambda x: x <> ''), '') AS genre_blend""")
regt("b18_countries", "film_texts", """countries_text,
  string_split_regex(trim(countries_text), '\\s*,\\s*')[1] AS main_country,
  string_split_regex(trim(countries_text), '\\s*,\\s*')[2] AS secondary_country,
  string_split_regex(trim(countries_text), '\\s*,\\s*')[3] AS tertiary_country""")
regt("b19_percent", "film_texts",
     "rt_text, cast(TRY_CAST(regexp_replace(trim(rt_text), '%$', '') AS DECIMAL(4,1)) AS double) AS rt_rating")
_e, _cd = "birth_existing", "birth_candidate"
regt("b27_birthdate", "person_texts", f"""{_e}, {_cd},
  CASE WHEN {BLANK(_cd)} THEN {_e} WHEN {BLANK(_e)} THEN {_cd}
       WHEN {PARSE_YEAR(_cd)} IS NULL THEN {_e}
       WHEN {PARSE_YEAR(_e)} IS NOT NULL AND {PARSE_YEAR(_e)} <> {PARSE_YEAR(_cd)} THEN {_e}
       WHEN length({_cd}) > length({_e}) THEN {_cd} ELSE {_e} END AS birth_date""")
regt("b29_inception", "person_texts",
     "inception_text, TRY_CAST(regexp_extract(inception_text, '^.(\\d{4})', 1) AS INTEGER) AS founded_year")
regt("b35_day_distance", "person_texts", """hint_date,
  cast(abs(datediff('day', cast(try_strptime(trim(hint_date), ['%Y-%m-%d', '%Y']) AS date), DATE '1995-06-30'))
       AS integer) AS days_apart""")


# ------------------------------------------------------------------ reports
from marquee.plans import reports as RP  # noqa: E402

TIERS = ("tiers", f"""SELECT *, CASE WHEN cast(film_budget_usd AS double) >= q[2] THEN 'High'
                 WHEN cast(film_budget_usd AS double) >= q[1] THEN 'Mid' ELSE 'Low' END AS budget_tier
  FROM fwr, (SELECT quantile_cont(cast(film_budget_usd AS double), [{RP.TIERS[0]}, {RP.TIERS[1]}]) AS q
               FROM fwr WHERE film_budget_usd > 0) qq
 WHERE film_budget_usd > 0""")
reg("p1_budget_tier_roi", f"""SELECT budget_tier, count(*) AS n_films, {D('sum(rev)')} AS total_revenue,
       {D('sum(film_budget_usd)')} AS total_budget, {R('sum(rev)', 'sum(film_budget_usd)')} AS revenue_per_budget_dollar
  FROM tiers GROUP BY 1""", [TIERS])
reg("p1_low_budget_genre_roi", f"""SELECT film_genre, count(*) AS n_films,
       {R('sum(rev)', 'sum(film_budget_usd)')} AS revenue_per_budget_dollar
  FROM tiers WHERE budget_tier = 'Low' AND film_genre IS NOT NULL GROUP BY 1""", [TIERS])
reg("p2_weekend_share", f"""SELECT weekday_type, n_days, {D('rev')} AS total_revenue,
       {R('rev', '(SELECT sum(rev) FROM g)')} AS revenue_share FROM g""",
    [("g", """SELECT d.weekday_type, sum(pd.rev) AS rev, count(*) AS n_days
  FROM (SELECT fk_date, sum(gross_revenue_per_day) AS rev FROM fact_daily_box_office GROUP BY 1) pd
  JOIN dim_date d ON pd.fk_date = d.sk_date GROUP BY 1""")])
reg("p3_decay_curve", f"""SELECT days_since_release, {D('rev')} AS revenue,
       {R('sum(rev) OVER (ORDER BY days_since_release ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)',
          'sum(rev) OVER ()')} AS cum_share
  FROM (SELECT days_since_release, sum(gross_revenue_per_day) AS rev FROM fact_daily_box_office
         WHERE days_since_release IS NOT NULL GROUP BY 1) g""")
reg("p3_decay_70", f"""SELECT {R(f'sum(CASE WHEN days_since_release <= {RP.DECAY_WINDOW} THEN gross_revenue_per_day END)',
                            'sum(gross_revenue_per_day)')} AS share_within_window, {RP.DECAY_WINDOW} AS window_days
  FROM fact_daily_box_office""")
_ord = "rev DESC, main_filming_country ASC NULLS FIRST"
reg("p4_country_share", f"""SELECT main_filming_country,
       cast(row_number() OVER (ORDER BY {_ord}) AS integer) AS country_rank, {D('rev')} AS total_revenue,
       {R('rev', 'sum(rev) OVER ()')} AS revenue_share,
       {R(f'sum(rev) OVER (ORDER BY {_ord} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'sum(rev) OVER ()')}
         AS cum_share
  FROM (SELECT main_filming_country, sum(rev) AS rev FROM fwr GROUP BY 1) g""")
for _who in ("actor", "director"):
    reg(f"p6_top_{_who}s", f"""SELECT cast(rank AS integer) AS rank, bk_{_who}, first_name_{_who}, surname_{_who},
       nationality_{_who}, {D('rev')} AS total_revenue, n_films
  FROM (SELECT x.*, row_number() OVER (ORDER BY rev DESC, bk_{_who} ASC) AS rank
          FROM (SELECT d.*, p.rev, p.n_films
                  FROM (SELECT fk_{_who}, sum(gross_revenue_per_day) AS rev, count(DISTINCT fk_film) AS n_films
                          FROM fact_daily_box_office GROUP BY 1) p
                  JOIN dim_{_who} d ON p.fk_{_who} = d.sk_{_who}) x) r
 WHERE rank <= {RP.TOP_PEOPLE}""")


# ------------------------------------------------------------------ enrichment
from marquee.operators import enrich as ENR  # noqa: E402
from marquee.sources import lookups as LKS  # noqa: E402


def ISO2(x: str) -> str:
    return f"concat(chr(cast(65 + ({x}) % 26 AS integer)), chr(cast(65 + (({x}) * 7) % 26 AS integer)))"


def PAD(prefix: str, x: str) -> str:
    return f"concat('{prefix}', lpad(cast({x} AS varchar), 9, '0'))"


def _struct_list(items) -> str:
    return "[" + ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in it) + "}" for it in items) + "]"


_pp = "p.p_partkey"
_prim = _case_mod(f"{_pp} % 4", LANGUAGES)
_jobs = _case_mod("({x}) % 5", LKS.CREW_JOBS)
MOVIE_DETAILS = ("movie_details", f"""SELECT {_pp} AS movie_id,
  concat('tt', lpad(cast({_pp} AS varchar), 7, '0')) AS imdb_id,
  CASE WHEN {_pp} % 29 <> 0 THEN cast(60 + 2 * p.p_size AS integer) END AS runtime,
  CASE WHEN {_pp} % 19 = 0 THEN cast(0 AS bigint) ELSE cast(cast(p.p_retailprice AS decimal(18,2)) * 1000 AS bigint) END
    AS budget,
  CASE WHEN {_pp} % 11 <> 0 THEN concat('/poster', cast({_pp} AS varchar), '.jpg') END AS poster_path,
  CASE WHEN {_pp} % 4 = 0 THEN {_pp} % 97 END AS collection_id,
  CASE WHEN {_pp} % 5 <> 0 THEN cast(fs.d0 AS varchar) ELSE '' END AS release_date,
  CASE WHEN {_pp} % 3 = 0 THEN [{{'name': {_prim}}}, {{'name': 'Italian'}}] ELSE [{{'name': {_prim}}}] END
    AS spoken_languages,
  {_struct_list([[('id', f'({_pp} + {17 * k}) % cnt.n_sup'),
                  ('name', PAD('Supplier#', f'({_pp} + {17 * k}) % cnt.n_sup')),
                  ('origin_country', f"CASE WHEN ({_pp} + {k}) % 3 <> 0 THEN {ISO2(f'({_pp} + {17 * k}) % 25')} END")]
                 for k in range(LKS.N_COMPANIES)])} AS production_companies,
  {_struct_list([[('id', f'({_pp} * 7 + {11 * k}) % cnt.n_cust'),
                  ('name', PAD('Customer#', f'({_pp} * 7 + {11 * k}) % cnt.n_cust')),
                  ('order', f"CASE WHEN ({_pp} + {k}) % 6 <> 0 THEN cast(({_pp} * 3 + {5 * k}) % 7 AS integer) END")]
                 for k in range(LKS.N_CAST)])} AS "cast",
  {_struct_list([[('id', f'({_pp} * 13 + {k}) % cnt.n_sup'),
                  ('name', PAD('Supplier#', f'({_pp} * 13 + {k}) % cnt.n_sup')),
                  ('job', _jobs.format(x=f'{_pp} + {k}'))]
                 for k in range(LKS.N_CREW)])} AS crew
FROM part p LEFT JOIN first_ship fs ON p.p_partkey = fs.l_partkey CROSS JOIN cnt""")
_rk = "s.s_suppkey"
COMPANIES = ("companies", f"""SELECT {_rk} AS company_id, s.s_name AS name,
  CASE WHEN {_rk} % 4 = 0 THEN NULL WHEN {_rk} % 4 = 1 THEN ''
       ELSE concat('City', cast({_rk} % 7 AS varchar), ', ', n.n_name) END AS headquarters,
  CASE WHEN {_rk} % 3 <> 0 THEN {ISO2('s.s_nationkey')} END AS origin_country
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""")
COUNTRIES = ("countries", f"""SELECT n.n_name AS name, {ISO2('n.n_nationkey')} AS iso2,
  upper(substr(r.r_name, 1, 2)) AS continent_code, r.r_name AS continent
FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
GEO = ("company_geo", " UNION ALL ".join(f"""SELECT s.s_name AS name, {i} AS pos,
  CASE WHEN ({_rk} + {i}) % 3 = 2 THEN concat('City', cast({_rk} % 7 AS varchar)) END AS hq,
  CASE WHEN ({_rk} + {i}) % 4 = 3 THEN n.n_name END AS country,
  CASE WHEN ({_rk} + {i}) % 5 = 4 THEN {ISO2('s.s_nationkey')} END AS iso2
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""" for i in range(LKS.N_GEO)))
_pb = f"cast(cast(p.p_retailprice AS decimal(18,2)) * 1100 AS bigint)"
RATINGS = ("ratings", f"""SELECT concat('tt', lpad(cast({_pp} AS varchar), 7, '0')) AS imdb_id,
  CASE WHEN {_pp} % 2 = 0 THEN concat('$', cast({_pb} AS varchar)) ELSE 'N/A' END AS budget,
  [{{'Source': 'Internet Movie Database', 'Value': concat(cast(10 + {_pp} % 91 AS varchar), '/100')}},
   {{'Source': CASE WHEN {_pp} % 4 <> 0 THEN 'Rotten Tomatoes' ELSE 'Metacritic' END,
     'Value': concat(cast(({_pp} * 37) % 101 AS varchar), '%')}}] AS ratings
FROM part p""")
_c2 = "c.c_custkey"
PEOPLE = ("people", f"""SELECT {_c2} AS person_id, concat('Ann', cast({_c2} % 13 AS varchar), ' Lee', cast({_c2} % 29 AS varchar)) AS name,
  CASE WHEN {_c2} % 10 <> 0 THEN (({_c2} * 31) % 1000) / 10.0 END AS popularity,
  CASE WHEN {_c2} % 4 <> 0 THEN concat(cast(1940 + {_c2} % 50 AS varchar), '-0', cast(1 + {_c2} % 9 AS varchar), '-1',
                                         cast({_c2} % 9 AS varchar)) END AS birthday,
  CASE WHEN {_c2} % 7 <> 0 THEN concat('Town', cast({_c2} % 11 AS varchar), ', ', n.n_name) END AS place_of_birth
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
RAW_DAILY = ("raw_daily", f"""SELECT f.*, fi.*, a.*, di.*, co.*,
  CASE WHEN f.fk_date % 5 = 0 THEN {PAD('Supplier#', '(cast(substr(f.fk_film, 2, 8) AS bigint) + 1) % cnt.n_sup')}
       ELSE co.production_company END AS studio
FROM stg_fact_daily_box_office f JOIN stg_dim_film fi ON f.fk_film = fi.bk_film
JOIN stg_dim_actor a ON f.fk_actor = a.bk_actor JOIN stg_dim_director di ON f.fk_director = di.bk_director
JOIN stg_dim_production_company co ON f.fk_production_company = co.bk_production_company CROSS JOIN cnt""")
ENRICH = [MOVIE_DETAILS, COMPANIES, COUNTRIES, GEO, RATINGS, PEOPLE, RAW_DAILY, FILM_TEXTS]


def rege(key: str, body: str, extra=None) -> None:
    reg(key, body, ENRICH + (extra or []))


rege("e5_lead_actor", """SELECT movie_id, la.id AS lead_actor_id, la.name AS lead_actor_name
  FROM (SELECT movie_id, list_sort(list_transform("cast", lambda x, i: {'o': coalesce(x."order", 9999), 'pos': i,
                                                   'id': x.id, 'name': x.name}))[1] AS la FROM movie_details) t""")
rege("e6_lead_director", """SELECT movie_id, ld.id AS director_id, ld.name AS director_name
  FROM (SELECT movie_id, list_filter(crew, lambda x: x.job = 'Director')[1] AS ld FROM movie_details) t""")
_prio = "CASE " + " ".join(f"WHEN lower(trim(x.job)) = '{r}' THEN {i}" for i, r in enumerate(ENR.PRODUCER_ROLES)) + " END"
rege("e7_lead_producer", f"""SELECT movie_id, lp.id AS producer_id, lp.name AS producer_name
  FROM (SELECT movie_id, list_sort(list_filter(list_transform(crew, lambda x, i: {{'p': {_prio}, 'pos': i,
                 'id': x.id, 'name': x.name}}), lambda y: y.p IS NOT NULL))[1] AS lp FROM movie_details) t""")
rege("e4_franchise", f"""SELECT m.movie_id, cast(fp.franchise_position AS integer) AS franchise_position,
       fp.franchise_total,
       CASE WHEN fp.franchise_position > 1 THEN 'Yes' ELSE 'No' END AS is_sequel,
       CASE WHEN fp.franchise_position = 1 AND fp.franchise_total > 1 THEN 'Yes' ELSE 'No' END AS is_prequel
  FROM movie_details m LEFT JOIN (
    SELECT movie_id,
           row_number() OVER (PARTITION BY collection_id ORDER BY
             coalesce(nullif(trim(release_date), ''), '{ENR.MISSING_DATE}'), movie_id % 10, movie_id) AS franchise_position,
           count(*) OVER (PARTITION BY collection_id) AS franchise_total
      FROM movie_details WHERE collection_id IS NOT NULL) fp ON m.movie_id = fp.movie_id""")
_rt = """from_json(to_json(production_companies), '[{"id":"BIGINT","name":"VARCHAR","origin_country":"VARCHAR"}]')"""
rege("h1_json_roundtrip", f"""SELECT movie_id, cast(len({_rt}) AS integer) AS n_companies,
       ({_rt})[1].name AS first_company, ({_rt})[3].origin_country AS third_origin FROM movie_details""")
rege("h2_languages", """SELECT movie_id, spoken_languages[1].name AS primary_language,
       cast(len(spoken_languages) AS integer) AS n_languages FROM movie_details""")
rege("h3_company_names", """SELECT movie_id, array_to_string(list_transform(list_filter(production_companies,
       lambda c: c.origin_country IS NOT NULL), lambda c: c.name), '|') AS companies_with_country FROM movie_details""")
rege("h4_rating_source", """SELECT imdb_id, v AS rt_value,
       cast(TRY_CAST(regexp_replace(trim(v), '%$', '') AS DECIMAL(4,1)) AS double) AS rt_rating
  FROM (SELECT imdb_id, list_filter(ratings, lambda r: r.Source = 'Rotten Tomatoes')[1].Value AS v FROM ratings) t""")
rege("c13_fallback", """SELECT m.movie_id, coalesce(m.b, r.v, f.v) AS budget_usd,
       CASE WHEN m.b IS NOT NULL THEN 'existing' WHEN r.v IS NOT NULL THEN 'source_1'
            WHEN f.v IS NOT NULL THEN 'source_2' END AS budget_usd_source
  FROM (SELECT movie_id, CASE WHEN budget > 0 THEN budget END AS b FROM movie_details) m
  LEFT JOIN (SELECT cast(substr(imdb_id, 3, 7) AS bigint) AS movie_id,
                    TRY_CAST(regexp_replace(budget, '[$,]', '', 'g') AS BIGINT) AS v FROM ratings) r
    ON m.movie_id = r.movie_id
  LEFT JOIN (SELECT cast(substr(bk_film, 2, 8) AS bigint) AS movie_id,
                    CASE WHEN film_budget_usd > 0 THEN cast(film_budget_usd AS bigint) END AS v FROM stg_dim_film) f
    ON m.movie_id = f.movie_id""")
C14 = """SELECT b.movie_id, b.company_id, b.company_name, b.city, b.iso2, ct.continent
  FROM (SELECT movie_id, unnest(bb) FROM (SELECT movie_id, arg_min({'company_id': id, 'company_name': name,
                                  'city': city, 'iso2': iso},
                                  (NOT (city IS NOT NULL OR iso IS NOT NULL), pos)) AS bb
          FROM (SELECT e.movie_id, e.u.pos AS pos, e.u.id AS id, e.u.name AS name,
                       nullif(trim(split_part(c.headquarters, ',', 1)), '') AS city,
                       coalesce(c.origin_country, e.u.origin_country) AS iso
                  FROM (SELECT movie_id, unnest(list_transform(production_companies, lambda c, i:
                          {'pos': i - 1, 'id': c.id, 'name': c.name, 'origin_country': c.origin_country})) AS u
                          FROM movie_details) e
                  LEFT JOIN companies c ON e.u.id = c.company_id) x
         GROUP BY movie_id) y) b
  LEFT JOIN countries ct ON length(b.iso2) = 2 AND upper(b.iso2) = upper(ct.iso2)"""
rege("c14_company_choice", C14)
rege("c15_geo_binding", """SELECT name, unnest(b) FROM (
  SELECT name, arg_min({'pos': pos, 'hq': hq, 'country': country, 'iso2': iso2}, pos) AS b
    FROM company_geo WHERE hq IS NOT NULL OR country IS NOT NULL OR iso2 IS NOT NULL GROUP BY name) t""")
rege("d12_most_frequent_studio", """SELECT bk_film, arg_min(studio, (-n, studio)) AS main_studio, max(n) AS main_studio_days
  FROM (SELECT bk_film, studio, count(*) AS n FROM raw_daily WHERE studio IS NOT NULL GROUP BY 1, 2) g
 GROUP BY bk_film""")
rege("d14_best_person", """SELECT name, person_id, popularity, birthday, place_of_birth,
       list_filter(list_transform(string_split(place_of_birth, ','), lambda x: trim(x)), lambda x: x <> '')[-1]
         AS nationality,
       TRY_CAST(regexp_extract(birthday, '^(\\d{4})', 1) AS INTEGER) AS birth_year
  FROM (SELECT name, unnest(bb) FROM (SELECT name, arg_max({'person_id': person_id, 'popularity': popularity,
                               'birthday': birthday, 'place_of_birth': place_of_birth},
                               (coalesce(popularity, 0.0), -person_id)) AS bb
          FROM people GROUP BY name) y) b""")
MOVIE_CACHE = ("movie_cache", f"""SELECT {NORM_TITLE('f.film_title')} AS title_norm, f.film_release_year AS year,
       m.movie_id AS tmdb_id, m.imdb_id, m.runtime, cast(len(m.spoken_languages) AS integer) AS num_langs
  FROM movie_details m JOIN stg_dim_film f ON cast(substr(f.bk_film, 2, 8) AS bigint) = m.movie_id""")
_CACHE_COLS = "tmdb_id, imdb_id, runtime, num_langs"
rege("a7_cache_upsert", f"""SELECT title_norm, year, unnest(b) FROM (
SELECT title_norm, year, arg_min({{'tmdb_id': tmdb_id, 'imdb_id': imdb_id,
         'runtime': runtime, 'num_langs': num_langs}}, (-is_new, tmdb_id)) AS b
  FROM (SELECT *, 0 AS is_new FROM movie_cache
        UNION ALL SELECT title_norm, year + 1, tmdb_id, imdb_id, runtime + 1, num_langs, 1 FROM movie_cache) u
 GROUP BY title_norm, year) t""", [MOVIE_CACHE])
rege("c16_cache_hit", f"""SELECT r.p_partkey, r.title_norm, r.year, c.tmdb_id AS cached_tmdb_id,
       c.tmdb_id IS NOT NULL AS cache_hit
  FROM (SELECT t.p_partkey, {NORM_TITLE('t.title_raw')} AS title_norm, f.film_release_year AS year
          FROM film_texts t JOIN stg_dim_film f ON cast(substr(f.bk_film, 2, 8) AS bigint) = t.p_partkey) r
  LEFT JOIN (SELECT title_norm, year, min(tmdb_id) AS tmdb_id FROM movie_cache WHERE runtime >= 110
              GROUP BY 1, 2) c
    ON r.title_norm IS NOT DISTINCT FROM c.title_norm AND r.year IS NOT DISTINCT FROM c.year""", [MOVIE_CACHE])
rege("a10_split_entities", " UNION ALL ".join(
    f"SELECT '{n}' AS entity, count(*) AS n_rows FROM (SELECT DISTINCT {cols} FROM raw_daily) x"
    for n, cols in [("film", "bk_film, film_title, film_release_year, film_genre"),
                    ("actor", "bk_actor, first_name_actor, surname_actor, nationality_actor"),
                    ("director", "bk_director, first_name_director, surname_director, nationality_director"),
                    ("company", "bk_production_company, production_company, country_production_company"),
                    ("daily", "fk_date, bk_film, bk_actor, bk_director, bk_production_company, "
                              "gross_revenue_per_day, days_since_release")]))
ORACLE["i1_incremental_append"] = ORACLE["stg_fact"]


# ------------------------------------------------------------------ tier labels / features
from marquee.plans import ml as MLP  # noqa: E402

TIER_BASE = ("tier_base", f"""SELECT * FROM (
  SELECT df.sk_film, df.bk_film, df.film_genre, df.film_age_classification, d.calendar_season AS release_season,
         {', '.join(f'cast(df.{c} AS double) AS {c}' for c in MLP.NUM_COLS)},
         cast(coalesce(p.rev, 0) AS double) AS total_revenue,
         row_number() OVER (PARTITION BY df.bk_film ORDER BY df.sk_film) AS rn
    FROM dim_film df
    LEFT JOIN (SELECT fk_film, min(fk_date) AS first_date_key, sum(gross_revenue_per_day) AS rev
                 FROM fact_daily_box_office GROUP BY 1) p ON df.sk_film = p.fk_film
    LEFT JOIN dim_date d ON p.first_date_key = d.sk_date) x WHERE rn = 1""")
TIER_LAB = ("tier_lab", f"""SELECT t.*,
  {bracket('t.film_runtime_min', [(90, 'Short'), (121, 'Standard')], 'Long')} AS runtime_segment,
  CASE WHEN t.total_revenue <= 0 THEN NULL WHEN t.total_revenue >= q.q[2] THEN 'High'
       WHEN t.total_revenue >= q.q[1] THEN 'Mid' ELSE 'Low' END AS tier
  FROM tier_base t, (SELECT quantile_cont(total_revenue, [{MLP.TIER_CUTS[0]}, {MLP.TIER_CUTS[1]}]) AS q
                       FROM tier_base WHERE total_revenue > 0) q""")
reg("n_tier_labels", "SELECT bk_film, total_revenue, release_season, runtime_segment, tier FROM tier_lab",
    [TIER_BASE, TIER_LAB])
_med = ", ".join(f"median({c}) AS m_{c}" for c in MLP.NUM_COLS)
reg("n_tier_features", f"""SELECT bk_film, {', '.join(f"coalesce({c}, 'Unknown') AS {c}" for c in MLP.CAT_COLS)},
       {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in MLP.NUM_COLS)}
  FROM tier_lab, (SELECT {_med} FROM tier_lab) m""", [TIER_BASE, TIER_LAB])


# ------------------------------------------------------------------ remaining lookups / SQL text
rege("b26_country_iso2", """SELECT f.bk_film, f.main_filming_country, c.iso2, c.continent
  FROM stg_dim_film f LEFT JOIN countries c ON trim(f.main_filming_country) = trim(c.name)""")
_NT = lambda c: f"regexp_replace(trim(lower(coalesce({c}, ''))), '\\s+', ' ', 'g')"
regt("b30_business_key", "film_texts", f"concat_ws('|', {_NT('title_raw')}, {_NT('genre_text')}) AS bk")
_k = "s.s_suppkey"
reg("h5_company_founded", f"""SELECT {_k} AS company_id,
  TRY_CAST(regexp_extract(json_extract_string(
    CASE WHEN {_k} % 5 <> 0 THEN concat('{{"P571":[{{"mainsnak":{{"datavalue":{{"value":{{"time":"+',
         cast(1900 + {_k} % 100 AS varchar), '-01-01T00:00:00Z"}}}}}}}}]}}') ELSE '{{"P17":[]}}' END,
    '$.P571[0].mainsnak.datavalue.value.time'), '^.(\\d{{4}})', 1) AS INTEGER) AS founded_year
  FROM supplier s""")
reg("a3_read_sql", """SELECT d.calendar_season, count(f.fk_date) AS film_days, count(DISTINCT f.fk_film) AS films,
       cast(max(f.gross_revenue_per_day) AS double) AS best_day
  FROM dim_date d INNER JOIN fact_daily_box_office f ON d.sk_date = f.fk_date
 GROUP BY d.calendar_season HAVING count(f.fk_date) > 1""")
ORACLE["q1_pipeline_fact"] = ORACLE["fact_sk"]
