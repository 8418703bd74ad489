"""Properties and golden vectors of the title and text cleaners."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.functions import clean as C

ALPHABET = "aZ09 \t  ()é·!-'," + "٣"  # Arabic-Indic digit three

TITLES = {
    "  The  Lantern (1999)": "the lantern",
    "(1999)": "",
    "A (1999) B": "a 1999 b",
    "Été-9!": "t 9",
    "x (199)": "x 199",
    "Wall\tE (2008) ": "wall e",
    "": "",
}
TEXTS = {"  A\t b\n C ": "a b c", "": "", "É  x": "é x"}


def cleaned(spark, function, values):
    frame = spark.createDataFrame([(v,) for v in values], "a string")
    return [r["x"] for r in frame.select(function("a").alias("x")).collect()]


@pytest.mark.parametrize("function, table", [(C.norm_title, TITLES), (C.norm_text, TEXTS)])
def test_golden(spark, function, table):
    assert dict(zip(table, cleaned(spark, function, list(table)))) == table


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=14), min_size=1, max_size=10))
def test_properties(spark, texts):
    titles, plain = cleaned(spark, C.norm_title, texts), cleaned(spark, C.norm_text, texts)
    for t in titles:
        assert re.fullmatch(r"([a-z0-9]+( [a-z0-9]+)*)?", t)
    for t in plain:
        assert "  " not in t and t == t.strip() and t == t.lower()
    assert cleaned(spark, C.norm_text, plain) == plain
