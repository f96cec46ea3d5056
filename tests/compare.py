"""Compares a query's result with its SQL's: columns, rows and values, whatever the order."""

from __future__ import annotations

import numpy as np
import pandas as pd


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return "null"
    if isinstance(value, (bool, int, float, np.number, np.bool_)):
        return repr(round(float(value), 6) + 0.0)
    return str(list(value)) if isinstance(value, (list, np.ndarray)) else str(value)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (df[columns].map(plain).sort_values(columns).reset_index(drop=True) for df in (got, want))
    assert len(a) == len(b)
    if not a.equals(b):
        differ = (a != b).any(axis=1)
        raise AssertionError(f"{differ.sum()} rows differ:\n{a[differ].head(3)}\n{b[differ].head(3)}")
