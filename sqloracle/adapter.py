"""DuckDB text of the adapter views (FIXTURES.md §1-§2) and the warehouse.

Parameter tables (holidays, seasons, fixture encodings) are imported from
the library so both sides use the same fixed values.
"""

from __future__ import annotations

from marquee.functions.dates import CALENDAR_SEASONS, HOLIDAYS, MARKETING_DEFAULT, MARKETING_SEASONS
from marquee.sources.adapter import AGE_CLASSES, LANGUAGES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def key(prefix: str, x: str) -> str:
    return f"concat('{prefix}', lpad(cast({x} AS varchar), 8, '0'))"


def datekey(d: str) -> str:
    return f"cast(strftime({d}, '%Y%m%d') AS integer)"


def _case_mod(x: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"CASE {x} {whens} END"


def _calendar_season(d: str) -> str:
    whens = " ".join(f"WHEN month({d}) IN ({', '.join(map(str, m))}) THEN {q(n)}"
                     for n, m in CALENDAR_SEASONS)
    return f"CASE {whens} END"


def _marketing(d: str) -> str:
    whens = " ".join(f"WHEN month({d}) * 100 + day({d}) BETWEEN {lo} AND {hi} THEN {q(n)}"
                     for n, lo, hi in MARKETING_SEASONS)
    return f"CASE {whens} ELSE {q(MARKETING_DEFAULT)} END"


def _holidays() -> str:
    rows = ", ".join(f"({m}, {d}, {q(n)})" for m, d, n in HOLIDAYS)
    return f"SELECT * FROM (VALUES {rows}) t(h_month, h_day, holiday_name)"


def _person(prefix, role, src, idc, namec, natc, base, mod) -> str:
    return f"""SELECT {key(prefix, 'x.' + idc)} AS bk_{role},
       split_part(x.{namec}, '#', 1) AS first_name_{role},
       split_part(x.{namec}, '#', 2) AS surname_{role},
       n.n_name AS nationality_{role},
       CASE WHEN x.{idc} % 13 <> 0 THEN cast({base} + x.{idc} % {mod} AS integer) END AS age_{role}
  FROM {src} x LEFT JOIN nation n ON x.{natc} = n.n_nationkey"""


def _fact_keys(p: str) -> str:
    return (f"{key('F', p)} AS fk_film, "
            f"{key('C', f'{p} % cnt.n_sup')} AS fk_production_company, "
            f"{key('D', f'({p} * 13) % cnt.n_sup')} AS fk_director, "
            f"{key('A', f'({p} * 7) % cnt.n_cust')} AS fk_actor")


def staging_ctes(dirty: bool = False) -> list[tuple[str, str]]:
    film = f"""SELECT {key('F', 'p.p_partkey')} AS bk_film,
       p.p_name AS film_title,
       cast(year(fs.d0) AS integer) AS film_release_year,
       CASE WHEN p.p_partkey % 23 <> 0 THEN concat(p.p_type, p.p_brand) END AS film_genre,
       {_case_mod('p.p_partkey % 5', AGE_CLASSES)} AS film_age_classification,
       {_case_mod('p.p_partkey % 4', LANGUAGES)} AS primary_language_film,
       CASE WHEN p.p_partkey % 3 = 0 THEN 'Italian' END AS secondary_language_film,
       CASE WHEN p.p_partkey % 29 <> 0 THEN cast(60 + 2 * p.p_size AS integer) END AS film_runtime_min,
       cast((10 + p.p_partkey % 91) / 10.0 AS decimal(3,1)) AS imdb_rating,
       CASE WHEN p.p_partkey % 31 <> 0 THEN cast((p.p_partkey * 37) % 101 AS decimal(4,1)) END AS rt_rating,
       CASE WHEN p.p_partkey % 19 = 0 THEN cast(0 AS decimal(18,2))
            ELSE cast(cast(p.p_retailprice AS decimal(18,2)) * 1000 AS decimal(18,2)) END AS film_budget_usd,
       n1.n_name AS main_filming_country,
       CASE WHEN p.p_partkey % 2 = 0 THEN n2.n_name END AS secondary_filming_country,
       cast(NULL AS varchar) AS tertiary_filming_country,
       cast(greatest(p.p_partkey % 7 - 3, 0) AS integer) AS film_awards_won,
       cast(p.p_partkey % 11 AS integer) AS film_awards_nominations,
       cast(CASE WHEN p.p_partkey % 97 = 0 THEN 1 ELSE 0 END AS integer) AS film_oscars_won,
       cast(p.p_partkey % 13 AS integer) AS film_oscar_nominations
  FROM part p LEFT JOIN first_ship fs ON p.p_partkey = fs.l_partkey
  LEFT JOIN nation n1 ON n1.n_nationkey = p.p_partkey % 25
  LEFT JOIN nation n2 ON n2.n_nationkey = (p.p_partkey * 7) % 25"""
    company = f"""SELECT {key('C', 's.s_suppkey')} AS bk_production_company,
       s.s_name AS production_company, n.n_name AS country_production_company,
       r.r_name AS continent_production_company,
       concat('City', cast(s.s_suppkey % 7 AS varchar)) AS city_production_company
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""
    fact = f"""SELECT {datekey('dl.d')} AS fk_date, {_fact_keys('dl.l_partkey')},
       dl.gross AS gross_revenue_per_day,
       cast(datediff('day', fs.d0, dl.d) AS integer) AS days_since_release
  FROM daily dl JOIN first_ship fs ON dl.l_partkey = fs.l_partkey CROSS JOIN cnt"""
    d = "dd.d"
    date = f"""SELECT {datekey(d)} AS sk_date, {d} AS proper_date,
       strftime({d}, '%A, %B %-d, %Y') AS full_date,
       cast(day({d}) AS integer) AS monthday_number,
       cast(isodow({d}) AS integer) AS weekday_number,
       dayname({d}) AS weekday_name,
       CASE WHEN isodow({d}) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS weekday_type,
       strftime({d}, '%a') AS weekday_name_short,
       cast(month({d}) AS integer) AS month_number,
       monthname({d}) AS month_name, strftime({d}, '%b') AS month_name_short,
       {_calendar_season(d)} AS calendar_season,
       h.holiday_name IS NOT NULL AS is_holiday, h.holiday_name,
       {_marketing(d)} AS marketing_season,
       cast(year({d}) AS integer) AS calendar_year
  FROM days dd LEFT JOIN holidays h ON month({d}) = h.h_month AND day({d}) = h.h_day"""
    ctes = [
        ("daily", """SELECT l_partkey, cast(l_shipdate AS date) AS d,
       cast(sum(cast(l_extendedprice AS decimal(18,2))) AS decimal(18,2)) AS gross
  FROM lineitem GROUP BY 1, 2"""),
        ("first_ship", "SELECT l_partkey, min(d) AS d0 FROM daily GROUP BY 1"),
        ("cnt", "SELECT (SELECT count(*) FROM supplier) AS n_sup, (SELECT count(*) FROM customer) AS n_cust"),
        ("bounds", "SELECT min(d) AS lo, max(d) AS hi FROM daily"),
        ("days", "SELECT cast(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS date) AS d FROM bounds"),
        ("holidays", _holidays()),
        ("stg_dim_date", date),
        ("clean_film", film),
        ("clean_actor", _person("A", "actor", "customer", "c_custkey", "c_name", "c_nationkey", 20, 60)),
        ("stg_dim_director", _person("D", "director", "supplier", "s_suppkey", "s_name", "s_nationkey", 30, 50)),
        ("stg_dim_production_company", company),
        ("clean_fact", fact),
    ]
    if not dirty:
        ctes += [("stg_dim_film", "SELECT * FROM clean_film"),
                 ("stg_dim_actor", "SELECT * FROM clean_actor"),
                 ("stg_fact_daily_box_office", "SELECT * FROM clean_fact")]
    else:
        ship, order = "cast(l.l_shipdate AS date)", "cast(o.o_orderdate AS date)"
        ctes += [
            ("stg_dim_film", """SELECT * FROM clean_film UNION ALL
SELECT * FROM clean_film WHERE cast(substr(bk_film, 2, 8) AS bigint) % 500 = 0"""),
            ("stg_dim_actor", "SELECT * FROM clean_actor WHERE cast(substr(bk_actor, 2, 8) AS bigint) % 97 <> 0"),
            ("stg_fact_daily_box_office", f"""SELECT {datekey(ship)} AS fk_date, {_fact_keys('l.l_partkey')},
       cast(CASE WHEN l.l_linenumber = 3 AND l.l_quantity = 1 THEN -cast(l.l_extendedprice AS decimal(18,2))
                 ELSE cast(l.l_extendedprice AS decimal(18,2)) END AS decimal(18,2)) AS gross_revenue_per_day,
       CASE WHEN l.l_linenumber <> 7 THEN cast(datediff('day', {order}, {ship}) AS integer) END AS days_since_release
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey CROSS JOIN cnt"""),
        ]
    return ctes


def warehouse_ctes() -> list[tuple[str, str]]:
    def dim(name, src, bk, sk):
        return (name, f"SELECT cast(row_number() OVER (ORDER BY {bk}) AS integer) AS {sk}, * FROM {src}")
    return [
        ("dim_date", "SELECT * FROM stg_dim_date"),
        dim("dim_film", "stg_dim_film", "bk_film", "sk_film"),
        dim("dim_actor", "stg_dim_actor", "bk_actor", "sk_actor"),
        dim("dim_director", "stg_dim_director", "bk_director", "sk_director"),
        dim("dim_production_company", "stg_dim_production_company", "bk_production_company",
            "sk_production_company"),
        ("fact_daily_box_office", """SELECT f.fk_date, df.sk_film AS fk_film,
       dc.sk_production_company AS fk_production_company, dd.sk_director AS fk_director,
       da.sk_actor AS fk_actor, f.gross_revenue_per_day, f.days_since_release
  FROM stg_fact_daily_box_office f
  JOIN dim_film df ON f.fk_film = df.bk_film
  JOIN dim_production_company dc ON f.fk_production_company = dc.bk_production_company
  JOIN dim_director dd ON f.fk_director = dd.bk_director
  JOIN dim_actor da ON f.fk_actor = da.bk_actor"""),
    ]


def with_ctes(body: str, dirty: bool = False, extra: list[tuple[str, str]] | None = None) -> str:
    ctes = staging_ctes(dirty) + warehouse_ctes() + (extra or [])
    text = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {text}\n{body}"
