"""Dealing rows out by ranges of their id, one range to a partition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(df: DataFrame, id_col: str, n: int) -> list[int]:
    """At most n - 1 ids that cut the rows into ranges of about equal size; only they reach the driver."""
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10_000).alias("p")).first()["p"]
    return sorted(set(found or []))


def range_of(id_col: str, cuts: list[int], descending: bool = False) -> Column:
    """Number of the range that an id falls in; equal ids share one. Nulls come first, or last if descending."""
    at = np.array(cuts, dtype="int64")

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        there = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype="int32")
        out[there] = np.searchsorted(at, ids[there].to_numpy(dtype="int64"), side="right")
        if descending:
            out = len(at) - out
        return pd.Series(out)

    return place(id_col)
