"""Comparison of a Spark result with rows from elsewhere."""

import pandas as pd


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.9g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    cols = sorted(frame.columns)
    return sorted(tuple(one(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False, name=None))


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert canonical(a) == canonical(b)
