"""A representative subset of registered queries against their DuckDB
oracle on sf0.001 (the full set runs via tools/oracle_check.py)."""

import os

import duckdb
import pytest

from conftest import SF001
import __spark_entry__ as E
from tools.oracle_check import TABLES, rows

KEYS = ["bq1", "bq4", "bq7", "bq12", "bq13", "bqp1_genre_trend", "dq_log", "dq_log_dirty", "dim_film_sk",
        "m_weekly_change", "m_kpi_days", "h_marketing", "p1_budget_tier_roi", "p4_country_share",
        "b1_norm_title", "b27_birthdate", "e4_franchise", "e7_lead_producer", "c14_company_choice",
        "a7_cache_upsert", "n_tier_labels"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF001)
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
