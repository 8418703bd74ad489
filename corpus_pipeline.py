"""Corpus pipeline: documents -> packed training sequences.

``STAGES`` lists (name, function) in order.  Every function takes (spark,
docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` applies them one after the other, writing each
stage's rows under ``spark.checkpoint.dir`` before the next one starts, so a
lost executor never leads back across a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import stages
from marquee.session import materialize
from marquee.sources.tables import read_table

STAGES = stages.STAGES
ORACLE_SQL = None    # hashing, fitting and tokenizing are not SQL; tests/llm has the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
