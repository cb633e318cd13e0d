"""A bitmap of fixed size that screens rows by the hash of their keys.

It is built with ``bitmap_construct_agg`` and may be broadcast at any input
size, as its size is a constant.  Rows it stops are certain not to hold one of
the keys; rows it lets through are to be decided exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIEVE_BITS = 1 << 23    # 1 MB


def _slot(bits: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def sieve(groups: DataFrame, keys: Sequence[str], bits: int = SIEVE_BITS) -> DataFrame:
    """Bitmap rows (``_bucket``, ``_bits``) of the hashes of ``keys``: at most ``bits`` / 8 bytes in all."""
    slot = _slot(bits, *keys)
    return (groups.select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_position"))
            .groupBy("_bucket").agg(F.bitmap_construct_agg("_position").alias("_bits")))


def passes(rows: DataFrame, screen: DataFrame, keys: Sequence[str], flag: str, bits: int = SIEVE_BITS) -> DataFrame:
    """``rows`` with a boolean ``flag``: whether the hash of ``keys`` is set in the sieve."""
    slot = _slot(bits, *keys)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.bitmap_bit_position(slot) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.pmod(F.bitmap_bit_position(slot), F.lit(8)).cast("int"))
    return (rows.join(F.broadcast(screen), F.bitmap_bucket_number(slot) == F.col("_bucket"), "left")
            .select(*rows.columns, F.coalesce(bit == 1, F.lit(False)).alias(flag)))
