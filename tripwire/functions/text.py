"""String helpers: previews, Python-style number formatting, compensated sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def cut(col: Column, n: int) -> Column:
    """First ``n`` code points (Python ``s[:n]``)."""
    return F.substring(col, 1, n)


def cut_ellipsis(col: Column, n: int) -> Column:
    """``s[:n] + ('…' if len(s) > n else '')``."""
    return F.concat(F.substring(col, 1, n), F.when(F.length(col) > n, F.lit(ELLIPSIS)).otherwise(F.lit("")))


def py_fixed(x: Column, dp: int, grouping: bool = True) -> Column:
    """Python ``format(x, ',.{dp}f')`` (or without ',' grouping).

    ``format_number`` rounds half-even on the exact binary value, like Python.
    NaN / infinities are spelled the Python way.
    """
    body = F.format_number(x, dp)
    if not grouping:
        body = F.regexp_replace(body, ",", "")
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == F.lit(float("inf")), F.lit("inf"))
            .when(x == F.lit(float("-inf")), F.lit("-inf"))
            .otherwise(body))


def py_round(x: Column, dp: int) -> Column:
    """Python ``round(x, dp)``: half-even on the exact binary value."""
    return py_fixed(x, dp, grouping=False).cast("double")


def py_percent(ratio: Column, dp: int) -> Column:
    """Python ``format(ratio, '.{dp}%')`` without the trailing '%'."""
    return py_fixed(ratio * F.lit(100.0), dp, grouping=False)


def money(x: Column) -> Column:
    """Python ``f"${x:,.2f}"``."""
    return F.concat(F.lit("$"), py_fixed(x, 2))


def fsum(arr: Column) -> Column:
    """Sum of an array<double> with Neumaier compensation (Python 3.12+ ``sum``)."""
    init = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def merge(acc, x):
        t = acc["s"] + x
        comp = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + comp).alias("c"))

    return F.aggregate(arr, init, merge, lambda acc: acc["s"] + acc["c"])
