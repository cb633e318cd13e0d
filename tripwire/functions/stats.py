"""Letter statistics: chi-squared fit to English and Shannon entropy.

Letter counts are taken once; the 25 Caesar rotations only permute the count vector
(``chi2(r) = sum_k (c[(k - r) mod 26] - E_k)^2 / E_k``) instead of rotating
and re-counting the text 25 times.
"""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tripwire.constants import ENGLISH_FREQ
from tripwire.functions.text import fsum

_FREQ = [ENGLISH_FREQ[chr(97 + k)] for k in range(26)]


FEW = 128       # distinct code points up to which each is counted by a pass over the text


def shannon_entropy(blob: Column, least: float = 0.0) -> Column:
    """Bits per code point; NULL where the number of distinct code points rules out ``least``.

    A blob of few distinct code points is walked once for each (a native pass,
    far cheaper than a lambda a code point); any other in one pass over its
    sorted code points, where the places at which a run of equal ones ends give
    the counts.  Both give the terms in the order of the code points.
    """
    chars = F.regexp_extract_all(blob, F.lit("(?s)."), 0)
    n = F.length(blob)

    def run_ends(s: Column) -> Column:
        following = F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.lit("")))
        return F.filter(F.transform(F.arrays_zip(s.alias("a"), following.alias("b")),
                                    lambda x, i: F.when(x["a"] != x["b"], i + 1)), lambda x: x.isNotNull())

    def terms(ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        return F.transform(F.arrays_zip(ends.alias("e"), starts.alias("s")), lambda x: (x["e"] - x["s"]) / n * F.log2((x["e"] - x["s"]) / n))

    def bound(value: Column, fn) -> Column:
        return F.element_at(F.transform(F.array(value), fn), 1)

    def counted(c: Column) -> Column:
        return bound((n - F.length(F.replace(blob, c, F.lit("")))) / n, lambda share: share * F.log2(share))

    few = lambda distinct: -fsum(F.transform(F.array_sort(distinct), counted))
    many = bound(F.array_sort(chars), lambda s: bound(run_ends(s), lambda e: -fsum(terms(e))))
    # an ill-formed text's code points are not found in its bytes
    valid = F.call_function("is_valid_utf8", blob)
    return F.when(n > 0, bound(F.array_distinct(chars), lambda d: F.when(F.log2(F.size(d)) + 0.001 < least, F.lit(None).cast("double"))
                                    .when(valid & (F.size(d) <= FEW), few(d)).otherwise(many))).otherwise(F.lit(0.0))


# --------------------------------------------------------------------------- vectorised form
def _make_chis_numpy(freq_values: tuple):
    """Build the batch function as a closure over plain values, so Python workers
    unpickle it without importing this package."""
    def chis_numpy(letters):
        """chi2 for rotations 0..25 of each letters-only lower-case string (None stays None).

        A ``bincount`` of each row's bytes gives its 26 counts; the 26 rotations are
        then column permutations.  Operations and their
        order match the column-expression form (and Python): E_k = f_k * n / 100,
        term = (c - E_k)^2 / E_k, summed a..z with Neumaier compensation.
        """
        import numpy as np

        freq = np.array(freq_values, dtype=np.float64)
        valid = letters.notna().to_numpy()
        vals = letters[valid]
        out = [None] * len(letters)
        if len(vals) == 0:
            return out
        # one row's letters at a time: memory beyond the batch is 26 numbers a row
        counts = np.empty((len(vals), 26))
        for i, text in enumerate(vals):
            counts[i] = np.bincount(np.frombuffer(text.encode("ascii"), dtype=np.uint8), minlength=123)[97:123]
        n = counts.sum(axis=1)
        expected = (freq[None, :] * n[:, None]) / 100.0            # rows x 26
        s = np.zeros((len(vals), 26))
        c = np.zeros((len(vals), 26))
        for k in range(26):
            obs = counts[:, (k - np.arange(26)) % 26]               # rows x rotations
            d = obs - expected[:, k:k + 1]
            x = (d * d) / expected[:, k:k + 1]
            t = s + x
            c += np.where(np.abs(s) >= np.abs(x), (s - t) + x, (x - t) + s)
            s = t
        chis = s + c
        for j, i in enumerate(np.flatnonzero(valid)):
            out[i] = chis[j].tolist()
        return out
    return chis_numpy


def chi_squared_all(letters: Column) -> Column:
    """array<double>(26): chi2 of rotations 0..25, from a letters-only lower-case column.

    Arrow-batched pandas UDF: the Python side sees whole batches, never rows."""
    from pyspark.sql.functions import pandas_udf

    fn = _make_chis_numpy(tuple(_FREQ))

    @pandas_udf("array<double>")
    def _chis(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s))

    return _chis(letters)
