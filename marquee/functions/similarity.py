"""Indel similarity (K1): 2·LCS(a, b) / (|a| + |b|); 1.0 for two empty
strings.  Not the Levenshtein ratio — substitutions cost 2 here.

Spark has no LCS expression, so this is the one Arrow pandas UDF of the
engine.  Callers apply it to *distinct* string pairs only.  The LCS length
uses the bit-parallel recurrence (one big-integer operation per character
of ``b``), i.e. O(|a|·|b| / word) per pair.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def indel_ratio_py(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    return 2.0 * lcs_length(a, b) / total


@F.pandas_udf(T.DoubleType())
def _indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio_py(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


# Ship this module's functions by value with the UDF, so executors need no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def indel_ratio(a, b) -> Column:
    """Column of indel similarity between two string columns."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return _indel_ratio_udf(a, b)
