"""Rows in a form that two engines share."""

import datetime
import decimal
import math

import pandas as pd


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (float, decimal.Decimal)) or type(v).__name__ in ("float64", "float32"):
        return round(float(v), 5) + 0.0
    if isinstance(v, (datetime.date, pd.Timestamp)) or type(v).__name__ == "datetime64":
        return str(pd.Timestamp(v))
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
        return [value(x) for x in v] if isinstance(v, list) else value(v)
    return v


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return sorted(([value(v) for v in r] for r in frame.itertuples(index=False)), key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return abs(a - b) <= 2e-5 * max(1, abs(a))
    return a == b


def same(got, want):
    a, b = rows(got), rows(want)
    assert sorted(got.columns) == sorted(want.columns)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(close(p, q) for p, q in zip(x, y, strict=True))]
    assert not bad, bad[:3]
