"""Compare two results by their rows, whatever their order and number types."""

import decimal
import math

import numpy as np
import pandas as pd


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return str(v)


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(_plain, r))) for r in frame.itertuples(index=False, name=None))
