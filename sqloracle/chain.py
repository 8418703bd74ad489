"""Oracle SQL of the company geography and of the chain from the daily sheet
to the warehouse."""

from __future__ import annotations

from marquee.plans import ml as ML
from sqloracle.matching import FULL
from marquee.sources import lookups as LK
from sqloracle.queries import C14, ENRICH, FILM_TEXTS, ORACLE, PERSON_TEXTS, TIER_BASE, TIER_LAB, dq_log_sql, reg

LABELS = ("labels_of", "SELECT lower(trim(name)) AS label, min(upper(iso2)) AS iso2, min(continent) AS continent FROM countries GROUP BY 1")
CODES = ("codes_of", "SELECT upper(iso2) AS code, min(continent) AS continent FROM countries GROUP BY 1")
BINDINGS = ("bindings", """SELECT g.name, nullif(trim(g.b.hq), '') AS city, c.continent
  FROM (SELECT *, coalesce(upper(nullif(trim(b.iso2), '')), l.iso2) AS code
          FROM (SELECT name, arg_min({'hq': hq, 'country': country, 'iso2': iso2}, pos) AS b FROM company_geo
                 WHERE hq IS NOT NULL OR country IS NOT NULL OR iso2 IS NOT NULL GROUP BY name) x
          LEFT JOIN labels_of l ON lower(trim(b.country)) = l.label) g
  LEFT JOIN codes_of c ON g.code = c.code""")


def geography(key: str, rows: str, chosen: str) -> str:
    """The chain over ``rows`` (key, main_studio, country, city, continent)
    and ``chosen`` (key, company_name, city, continent)."""
    asked = "(c.city IS NULL OR c.continent IS NULL)"
    city, continent = "r.city, c.city, CASE WHEN {a} THEN b.city END", "r.continent, c.continent, CASE WHEN {a} THEN b.continent END, l.continent"
    return f"""SELECT r.{key}, coalesce(c.company_name, r.main_studio) AS geo_company, coalesce({city.format(a=asked)}) AS city,
       CASE WHEN r.city IS NOT NULL THEN 'known' WHEN c.city IS NOT NULL THEN 'company' WHEN {asked} AND b.city IS NOT NULL THEN 'binding' END AS city_source,
       coalesce({continent.format(a=asked)}) AS continent,
       CASE WHEN r.continent IS NOT NULL THEN 'known' WHEN c.continent IS NOT NULL THEN 'company' WHEN {asked} AND b.continent IS NOT NULL THEN 'binding'
            WHEN l.continent IS NOT NULL THEN 'country' END AS continent_source
  FROM ({rows}) r LEFT JOIN ({chosen}) c ON r.{key} = c.{key} LEFT JOIN bindings b ON coalesce(c.company_name, r.main_studio) = b.name
  LEFT JOIN labels_of l ON lower(trim(r.country)) = l.label"""


GEO = ENRICH + [LABELS, CODES, BINDINGS]
_number = "cast(substr({}, 2, 8) AS bigint)"
reg("c15_company_geography", geography("movie_id", f"""SELECT {_number.format('bk_film')} AS movie_id, arg_min(studio, (-n, studio)) AS main_studio, min(country) AS country,
         cast(NULL AS varchar) AS city, cast(NULL AS varchar) AS continent
    FROM (SELECT bk_film, studio, count(*) AS n, min(country_production_company) AS country FROM raw_daily GROUP BY 1, 2) x GROUP BY bk_film""",
                                      C14.replace("movie_details", "dated_details")), GEO + [("dated_details", "SELECT * FROM movie_details WHERE release_date <> ''")])

# ------------------------------------------------------------------ from the sheet to the warehouse
_id = "m.matched_id"
FOUND = ("film_found", f"""SELECT concat('F', lpad(cast(m.row_id AS varchar), 8, '0')) AS bk_film, m.match_source,
       coalesce(d.runtime, CASE WHEN {_id} % 3 <> 2 THEN cast(62 + 2 * p.p_size AS integer) END) AS runtime,
       cast(coalesce(CASE WHEN d.budget > 0 THEN d.budget END, TRY_CAST(regexp_replace(r.budget, '[$,]', '', 'g') AS bigint)) AS decimal(18,2)) AS film_budget_usd,
       cast((10 + {_id} % 91) / 10.0 AS decimal(3,1)) AS imdb_rating, CASE WHEN {_id} % 4 <> 0 THEN cast(({_id} * 37) % 101 AS decimal(4,1)) END AS rt_rating,
       d.spoken_languages[1].name AS primary_language_film, d.spoken_languages[2].name AS secondary_language_film
  FROM matches m LEFT JOIN movie_details d ON {_id} = d.movie_id LEFT JOIN part p ON {_id} = p.p_partkey LEFT JOIN ratings r ON d.imdb_id = r.imdb_id""")
SHEET_FILMS = ("sheet_films", f"""SELECT f.* EXCLUDE (film_runtime_min, film_budget_usd, imdb_rating, rt_rating, primary_language_film, secondary_language_film),
       coalesce(CASE WHEN {_number.format('f.bk_film')} % 3 = 0 THEN f.film_runtime_min END, a.runtime) AS film_runtime_min, a.* EXCLUDE (bk_film, runtime)
  FROM stg_dim_film f JOIN film_found a ON f.bk_film = a.bk_film WHERE f.bk_film IN (SELECT fk_film FROM stg_fact_daily_box_office)""")
CHAIN = [c for c in FULL if c[0] != "movie_details"] + [FOUND, SHEET_FILMS]


def _double(alias: str, *cols: str) -> str:
    return ", ".join(f"cast({alias}.{c} AS double) AS {c}" for c in cols)


_dec = ("film_budget_usd", "imdb_rating", "rt_rating")
reg("a9_enriched_sheet", f"""SELECT s.bk_film, s.match_source, s.film_runtime_min, {_double('s', *_dec)}, s.primary_language_film, s.secondary_language_film,
       count(*) AS n_days, cast(sum(f.gross_revenue_per_day) AS double) AS total_revenue
  FROM stg_fact_daily_box_office f JOIN sheet_films s ON f.fk_film = s.bk_film GROUP BY ALL""", GEO + CHAIN)
reg("q1_sheet_films", f"""SELECT cast(row_number() OVER (ORDER BY bk_film) AS integer) AS sk_film, s.* EXCLUDE (match_source, {', '.join(_dec)}), {_double('s', *_dec)}
  FROM sheet_films s""", GEO + CHAIN)
_own = _number.format("bk_production_company")
reg("q1_sheet_companies", f"""SELECT cast(row_number() OVER (ORDER BY g.bk_production_company) AS integer) AS sk_production_company, g.bk_production_company, c.production_company,
       c.country_production_company, g.continent AS continent_production_company, g.city AS city_production_company
  FROM ({geography('bk_production_company', f'''SELECT bk_production_company, production_company AS main_studio, country_production_company AS country,
          CASE WHEN {_own} % 2 = 0 THEN city_production_company END AS city, cast(NULL AS varchar) AS continent
          FROM stg_dim_production_company WHERE bk_production_company IN (SELECT fk_production_company FROM stg_fact_daily_box_office)''',
                    '''SELECT s.bk_production_company, min(s.production_company) AS company_name, min(nullif(trim(split_part(k.headquarters, ',', 1)), '')) AS city, min(o.continent) AS continent
          FROM stg_dim_production_company s JOIN companies k ON s.production_company = k.name LEFT JOIN codes_of o ON upper(k.origin_country) = o.code GROUP BY 1''')}) g
  JOIN stg_dim_production_company c ON g.bk_production_company = c.bk_production_company""", GEO)
reg("q1_sheet_fact", f"""SELECT fk_date, {', '.join(f'cast(dense_rank() OVER (ORDER BY {c}) AS integer) AS {c}' for c in ('fk_film', 'fk_production_company', 'fk_director', 'fk_actor'))},
       cast(gross_revenue_per_day AS double) AS gross_revenue_per_day, days_since_release FROM stg_fact_daily_box_office""")

# ------------------------------------------------------------------ result tables of the models
ORACLE["a5_ml_genre_trends"] = ORACLE["bqp1_genre_trend"]
reg("n10_ml_tier_predictions", f"""SELECT bk_film, film_title, {', '.join(f"coalesce({c}, 'Unknown') AS {c}" for c in ML.CAT_COLS)}, runtime_segment, true AS sound
  FROM tier_lab JOIN (SELECT bk_film AS b, any_value(film_title) AS film_title FROM dim_film GROUP BY 1) t ON b = bk_film""", [TIER_BASE, TIER_LAB])

# ------------------------------------------------------------------ readers, log, gate and small cleaners
reg("a1_csv_sheet", f"""SELECT f.* EXCLUDE (film_runtime_min, film_budget_usd, imdb_rating, rt_rating), CASE WHEN {_number.format('bk_film')} % 7 <> 0 THEN film_runtime_min END AS film_runtime_min,
       cast(NULL AS double) AS film_budget_usd, {_double('f', 'imdb_rating', 'rt_rating')} FROM stg_dim_film f""")
_counts = "SELECT cast({run} AS integer) AS run_id, etl_result, count(*) AS n_checks FROM ({log}) l GROUP BY 2"
reg("a6_clean", _counts.format(run=1, log=dq_log_sql()))
reg("a6_dirty", _counts.format(run=2, log=dq_log_sql()), dirty=True)
ORACLE["a6_log_history"] = f"SELECT * FROM ({ORACLE.pop('a6_clean')}) a UNION ALL SELECT * FROM ({ORACLE.pop('a6_dirty')}) b"
reg("l20_gate", f"SELECT * FROM ({dq_log_sql()}) l WHERE etl_result = 'FAIL' AND NOT (id_check = 2 AND etl_table = 'stg_dim_film')", dirty=True)
reg("b10_poster_url", f"SELECT movie_id, '{LK.POSTER_BASE}' || poster_path AS poster_url FROM movie_details", ENRICH[:1])
reg("d10_class_weights", """SELECT tier, n_films, cast(sum(n_films) OVER () AS double) / (n_films * count(*) OVER ()) AS weight
  FROM (SELECT tier, count(*) AS n_films FROM tier_lab WHERE tier IS NOT NULL GROUP BY 1) g""", [TIER_BASE, TIER_LAB])
_texts = [FILM_TEXTS, PERSON_TEXTS]
reg("b11_to_number", "SELECT c_custkey, birth_existing, TRY_CAST(birth_existing AS double) AS as_number FROM person_texts", _texts)
reg("b28_fill_missing", """SELECT c_custkey, birth_existing, birth_candidate, coalesce(birth_existing, birth_candidate) AS filled,
       CASE WHEN birth_existing IS NULL OR trim(birth_existing) = '' THEN birth_candidate ELSE birth_existing END AS filled_blank FROM person_texts""", _texts)
reg("b13_or_unknown", "SELECT bk_film, coalesce(film_genre, 'Unknown') AS genre FROM stg_dim_film")
reg("b36_clamp_zero", "SELECT bk_film, greatest(cast(film_runtime_min - 110 AS double), 0.0) AS minutes_over FROM stg_dim_film")
reg("b38_safe_ratio", "SELECT bk_film, cast(film_awards_nominations AS double) / nullif(film_awards_won, 0) AS nominations_per_award FROM stg_dim_film")
