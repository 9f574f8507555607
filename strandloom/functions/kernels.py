"""Arrow functions for what built-in expressions cannot say."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence (match 1, mismatch and gaps 0), one row at a time."""
    if not a or not b:
        return 0
    y = np.frombuffer(b.encode("latin-1", "replace"), np.uint8)
    row = np.zeros(len(y) + 1, np.int32)
    for c in a.encode("latin-1", "replace"):
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + (y == c))
        row = np.maximum.accumulate(step)
    return int(row[-1])


@F.pandas_udf(IntegerType())
def lcs_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Alignment score of two sequences; null counts as empty."""
    return pd.Series([lcs_length(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")


def erf_values(x: np.ndarray) -> np.ndarray:
    """The error function: a series of positive terms, so nothing cancels; 1 beyond 6. NaN stays."""
    size = np.minimum(np.abs(x), 6.0)
    term = size * np.exp(-size * size) * (2 / math.sqrt(math.pi))
    total, n = term.copy(), 0
    while n < 200 and (term > 1e-17 * total).any():
        n += 1
        term *= 2 * size * size / (2 * n + 1)
        total += term
    return np.sign(x) * np.minimum(total, 1.0)


@F.pandas_udf(DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return pd.Series(erf_values(x.to_numpy(np.float64, na_value=np.nan))).where(x.notna().to_numpy())


@F.pandas_udf(StringType())
def six_places(x: pd.Series) -> pd.Series:
    """A number as C's %f writes it: six places, by the exact binary value, ties to even. The engine's own formatter rounds the
    shortest decimal form, half up."""
    return x.map("{:.6f}".format, na_action="ignore")
