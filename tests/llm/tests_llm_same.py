import math

import pandas as pd


def plain(value):
    """Null in one form, and whole numbers as integers."""
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    return int(value) if isinstance(value, float) and math.isfinite(value) and value == int(value) else value


def same(got, want):
    """Equal rows, in any order of rows and columns."""
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(frame):
        return sorted(str([plain(v) for v in row]) for row in frame[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)
