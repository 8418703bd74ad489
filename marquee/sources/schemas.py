"""Typed table registry (staging area, warehouse, DQ log, ML outputs).

The column lists and types are the contract of the warehouse; they are
fixed values taken from the published DDL.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DateType(), T.BooleanType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# --- fixed values: warehouse table layouts -------------------------------
DIM_DATE = _struct(
    ("sk_date", I, False), ("proper_date", D, False), ("full_date", S, False),
    ("monthday_number", I, False), ("weekday_number", I, False),
    ("weekday_name", S, False), ("weekday_type", S, False),
    ("weekday_name_short", S, False), ("month_number", I, False),
    ("month_name", S, False), ("month_name_short", S, False),
    ("calendar_season", S, False), ("is_holiday", B, False),
    ("holiday_name", S, True), ("marketing_season", S, False),
    ("calendar_year", I, False),
)

STG_DIM_FILM = _struct(
    ("bk_film", S, False), ("film_title", S, False), ("film_release_year", I, True),
    ("film_genre", S, True), ("film_age_classification", S, True),
    ("primary_language_film", S, True), ("secondary_language_film", S, True),
    ("film_runtime_min", I, True), ("imdb_rating", T.DecimalType(3, 1), True),
    ("rt_rating", T.DecimalType(4, 1), True), ("film_budget_usd", T.DecimalType(18, 2), True),
    ("main_filming_country", S, True), ("secondary_filming_country", S, True),
    ("tertiary_filming_country", S, True), ("film_awards_won", I, True),
    ("film_awards_nominations", I, True), ("film_oscars_won", I, True),
    ("film_oscar_nominations", I, True),
)

STG_DIM_ACTOR = _struct(
    ("bk_actor", S, False), ("first_name_actor", S, True), ("surname_actor", S, True),
    ("nationality_actor", S, True), ("age_actor", I, True),
)

STG_DIM_DIRECTOR = _struct(
    ("bk_director", S, False), ("first_name_director", S, True),
    ("surname_director", S, True), ("nationality_director", S, True),
    ("age_director", I, True),
)

STG_DIM_COMPANY = _struct(
    ("bk_production_company", S, False), ("production_company", S, True),
    ("country_production_company", S, True), ("continent_production_company", S, True),
    ("city_production_company", S, True),
)

STG_FACT = _struct(
    ("fk_date", I, False), ("fk_film", S, False), ("fk_production_company", S, False),
    ("fk_director", S, False), ("fk_actor", S, False),
    ("gross_revenue_per_day", T.DecimalType(18, 2), True), ("days_since_release", I, True),
)

DW_FACT = _struct(
    ("fk_date", I, False), ("fk_film", I, False), ("fk_production_company", I, False),
    ("fk_director", I, False), ("fk_actor", I, False),
    ("gross_revenue_per_day", T.DecimalType(18, 2), True), ("days_since_release", I, True),
)

LOG_QUALITY_CHECKS = _struct(
    ("id_check", I, False), ("etl_phase", S, False), ("etl_table", S, False),
    ("etl_checktype", S, False), ("description_result", S, False),
    ("etl_result", S, False),
)

ML_GENRE_TRENDS = _struct(
    ("film_genre", S, False), ("genre_trend", S, False), ("genre_projected_revenue", T.DoubleType(), True),
)

ML_TIER_PREDICTIONS = _struct(
    ("bk_film", S, False), ("film_title", S, False), ("film_genre", S, False), ("runtime_segment", S, False), ("release_season", S, False),
    ("film_age_classification", S, False), ("predicted_tier", S, False), ("tier_confidence", T.DoubleType(), False),
)

# VARCHAR(n) limits of the staging DDL (checked by conform()).
MAX_LENGTH = {
    "bk_film": 400, "film_title": 200, "film_genre": 100, "film_age_classification": 100,
    "primary_language_film": 100, "secondary_language_film": 100, "main_filming_country": 100,
    "secondary_filming_country": 100, "tertiary_filming_country": 100,
    "bk_actor": 150, "first_name_actor": 100, "surname_actor": 100, "nationality_actor": 100,
    "bk_director": 150, "first_name_director": 100, "surname_director": 100, "nationality_director": 100,
    "bk_production_company": 150, "production_company": 200, "country_production_company": 100,
    "continent_production_company": 50, "city_production_company": 100,
    "fk_film": 400, "fk_production_company": 150, "fk_director": 150, "fk_actor": 150,
    "full_date": 50, "weekday_name": 50, "weekday_type": 10, "weekday_name_short": 10, "month_name": 50,
    "month_name_short": 50, "calendar_season": 20, "holiday_name": 50, "marketing_season": 50,
    "etl_phase": 20, "etl_table": 100, "etl_checktype": 150, "description_result": 150, "etl_result": 10,
}


ML_OUTPUT = {"ml_genre_trends": ML_GENRE_TRENDS, "ml_tier_predictions": ML_TIER_PREDICTIONS}


def with_surrogate(schema: T.StructType, sk: str) -> T.StructType:
    return T.StructType([T.StructField(sk, I, False), *schema.fields])


DIM_FILM = with_surrogate(STG_DIM_FILM, "sk_film")
DIM_ACTOR = with_surrogate(STG_DIM_ACTOR, "sk_actor")
DIM_DIRECTOR = with_surrogate(STG_DIM_DIRECTOR, "sk_director")
DIM_COMPANY = with_surrogate(STG_DIM_COMPANY, "sk_production_company")

STAGING = {
    "stg_dim_date": DIM_DATE, "stg_dim_film": STG_DIM_FILM,
    "stg_dim_actor": STG_DIM_ACTOR, "stg_dim_director": STG_DIM_DIRECTOR,
    "stg_dim_production_company": STG_DIM_COMPANY,
    "stg_fact_daily_box_office": STG_FACT,
}

WAREHOUSE = {
    "dim_date": DIM_DATE, "dim_film": DIM_FILM, "dim_actor": DIM_ACTOR,
    "dim_director": DIM_DIRECTOR, "dim_production_company": DIM_COMPANY,
    "fact_daily_box_office": DW_FACT,
}
