"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Every level looks only at rows whose group had company on the level before.
Which groups those are is kept in a *sieve*: a bitmap of a fixed number of bits
built with ``bitmap_construct_agg`` over the hashes of the group keys that
occur more than once.  Its size is a constant, so it may be broadcast at any
input size; a false positive only makes a row go on to the next level, never
changes the result.  The full content is hashed only for rows that both
sieves let through, and texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import text_or_empty
from tripwire.llm.sieve import SIEVE_BITS, passes, sieve

PREFIX_CHARS = 256
SALTS = 16      # tasks that a group of copies is dealt to in the last join


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[Column] = (),
                prefix_chars: int = PREFIX_CHARS, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and the ``carry`` columns.

    Texts are equal when they are the same string; a null text counts as ''.
    Of equal texts the row with the largest id stays.  Rows that repeat an id
    together with its text are all counted and share the answer (all kept or
    all dropped); a null id is smaller than any other.  An empty table gives
    no rows; other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"),
                       *[c.alias(f"_carry{i}") for i, c in enumerate(carry)])
    names = [docs.select(c).columns[0] for c in carry]
    carried = [f"_carry{i}" for i in range(len(names))]

    rows = rows.withColumn("_length", F.octet_length("_text"))
    lengths = rows.groupBy("_length").count().filter("count > 1")
    rows = passes(rows, sieve(lengths, ["_length"], sieve_bits), ["_length"], "_shared_length", sieve_bits)

    rows = rows.withColumn("_prefix", F.when(F.col("_shared_length"), F.xxhash64(F.substring("_text", 1, prefix_chars))))
    keys = ["_length", "_prefix"]
    prefixes = rows.filter("_shared_length").groupBy(*keys).count().filter("count > 1")
    rows = passes(rows, sieve(prefixes, keys, sieve_bits), keys, "_shared_prefix", sieve_bits)

    # 33 bytes for rows without company: spread out, and never equal to a 32-byte digest
    alone = F.concat(F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), F.lit(b"\0" * 17))
    rows = rows.select("doc_id", *carried, "_shared_prefix", F.when(F.col("_shared_length") & F.col("_shared_prefix"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
                       .otherwise(alone).alias("_content"))
    groups = (rows.filter("_shared_prefix AND octet_length(_content) = 32").groupBy("_content")
              .agg(F.max("doc_id").alias("_largest"), F.count(F.lit(1)).alias("_size")).filter("_size > 1"))
    # a group has one row here, a copy for each salt; its members, however many, are dealt to SALTS tasks
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(groups, ["_content", "_salt"], "left")
    keep = F.when(F.col("_size").isNotNull(), F.col("_largest")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), *[F.col(c).alias(n) for c, n in zip(carried, names)])


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from tripwire.llm.common import table
    digest = F.sha2(text_or_empty("text").cast("binary"), 256).alias("text_sha256")
    return exact_dedup(table(spark, sf_dir, "documents"), carry=[digest])


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
