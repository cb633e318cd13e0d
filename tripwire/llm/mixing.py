"""Mixing sources to target weights: temperature, then budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is bisected: as near to 1 as a target entropy asks, and never so
small that a source is repeated beyond a limit.  The weights times the token
budget give each source a quota: whole copies of the source, then part of one
more, every copy in a permutation of its own.  Each source's stream of copies
is cut evenly over the blocks, so every block holds the sources by weight; the
documents of a block are permuted together.

Prefix sums run in two levels (buckets of the permuted order, then rows of a
bucket), so a source that holds a third of all rows is spread over many tasks.
Sources stay in a table; only sums over them reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripwire.llm.common import salted_join, settled, table, written

MAX_REPEATS = 2.0
BLOCK_TOKENS = 200_000
SEED = 17
LEVELS = 28             # bisection steps, four a job
BUCKET_ROWS = 100_000   # rows of a source in a bucket of its permutation, at most about
MIN_DIGITS = 3          # buckets are leading hexadecimal digits of the order


def _bisected(fits, evaluate) -> float:
    """The smallest exponent of [0, 1] that fits, to 2**-LEVELS and then up to six decimals; 1 always fits."""
    low, high = 0.0, 1.0
    if fits(0.0, *evaluate([0.0])[0]):
        return 0.0
    for _ in range(LEVELS // 4):        # four bisections at once: the fifteen points that they can meet
        points = [low + (high - low) * k / 16 for k in range(1, 16)]
        for point, sums in zip(points, evaluate(points)):
            if fits(point, *sums):
                high = point
                break
            low = point
    return min(1.0, math.ceil(high * 1e6) / 1e6)


def exponent_for(sources: DataFrame, most: int, least: int, max_repeats: float | None, target_entropy: float | None, budget: int | None) -> float:
    """The exponent nearest to 1 whose weights have the target entropy (in nats), if the repetition limit allows it.

    With a limit alone: the smallest exponent within it.  An entropy above what
    the limit or the number of sources allows is met as far as possible.
    """
    share = F.col("tokens") / F.lit(float(most))

    def evaluate(points: list[float]) -> list[tuple[float, float]]:
        if budget is None and target_entropy is None:
            return [(0.0, 0.0)] * len(points)       # the sums aren't needed
        sums = sources.agg(*[x for p in points for x in (F.sum(F.pow(share, F.lit(p))), F.sum(F.pow(share, F.lit(p)) * F.ln(share)))]).first()
        return [(sums[2 * i], sums[2 * i + 1]) for i in range(len(points))]

    def repeats(point: float, total: float, _: float) -> bool:
        scale = 1.0 if budget is None else budget / (most * total)
        return max_repeats is None or scale * (least / most) ** (point - 1) <= max_repeats

    def flat_enough(point: float, total: float, logs: float) -> bool:
        return math.log(total) - point * logs / total <= target_entropy

    limit = _bisected(repeats, evaluate)
    return limit if target_entropy is None else max(limit, _bisected(flat_enough, evaluate))


def mixture(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None,
            block_tokens: int = BLOCK_TOKENS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The plan: a row for each copy of a document: ``doc_id``, ``text_key``, ``nth``, ``source``, ``tokens``, ``copy``, ``block``, ``position``.

    Without a ``budget`` the most used source appears once, and no document is
    left out; a smaller budget leaves documents of a source out by its order.
    A document's tokens are its words, one at least.  A null source is the
    source ''; null texts are empty.  Rows that repeat an id and text are
    numbered (``nth``).  An empty table gives no rows; other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("text_key"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
                       F.greatest(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(1)).cast("long").alias("tokens"))
    again = Window.partitionBy("doc_id", "text_key").orderBy("source")
    rows = written(slim.withColumn("nth", F.row_number().over(again)), "mixing-rows")
    sources = written(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "mixing-sources")
    bounds = sources.agg(F.max("tokens"), F.min("tokens"), F.max("documents")).first()
    most, least, rows_of_one = (x or 1 for x in bounds)
    exponent = exponent_for(sources, most, least, max_repeats, target_entropy, budget)
    share = F.col("tokens") / F.lit(float(most))
    scale = 1.0 if budget is None else budget / (most * (sources.agg(F.sum(F.pow(share, F.lit(exponent)))).first()[0] or 1.0))
    times = F.round(F.lit(scale) * F.pow(share, F.lit(exponent - 1)), 6).cast("decimal(18,6)")
    quotas = sources.select("source", F.col("tokens").alias("whole"), F.floor(times * F.col("tokens").cast("decimal(18,0)")).cast("long").alias("quota"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    blocks = max(1, math.ceil(total / block_tokens))
    digits = max(MIN_DIGITS, math.ceil(math.log(max(2, rows_of_one / BUCKET_ROWS), 16)))

    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "source", F.col("copy").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              "text_key", F.col("nth").cast("string")).cast("binary"))
    copies = (salted_join(rows, quotas, "source", ["doc_id", "text_key"]).filter("quota > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("whole")).cast("long") - 1)))
              .withColumn("order", order).withColumn("bucket", F.substring("order", 1, digits)))
    buckets = copies.groupBy("source", "copy", "bucket").agg(F.sum("tokens").alias("size"))
    earlier = Window.partitionBy("source", "copy").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.select("source", "copy", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "copy", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    placed = (copies.join(bases, ["source", "copy", "bucket"])
              .withColumn("before", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("copy") * F.col("whole"))
              .filter("before < quota")
              .withColumn("block", F.floor(F.col("before").cast("decimal(20,0)") * blocks / F.col("quota")).cast("long")))
    in_block = Window.partitionBy("block").orderBy("order")      # a block holds block_tokens tokens, about
    return placed.select("doc_id", "text_key", "nth", "source", "tokens", F.col("copy").cast("int").alias("copy"), "block",
                         F.row_number().over(in_block).alias("position"))


PART_TOKENS = 2_000_000     # tokens of a written part of the mixture, about


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, **target) -> DataFrame:
    """The documents of the mixture, one row a copy, as struct ``row`` with all columns of ``docs``, in ascending order of block and position.

    A row meets the plan by id, text and source, so each gets the copies of its
    own source.  Rows that are equal in all three share the copies of all of
    them, dealt out by the rest of the row.  Null ids, texts and sources, empty
    tables and long texts are as in ``mixture``; ``row`` holds all columns, so
    none can clash.

    Texts are shuffled twice: to meet the plan, and to the part of their block.
    """
    spark = docs.sparkSession
    key = ["_id", "_key", "_source"]

    def keyed(id_: str, text_key, source: str) -> list:
        return [F.coalesce(F.col(id_).cast("string"), F.lit("none")).alias("_id"), text_key.alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_source")]

    plan = settled(lambda: mixture(docs, id_col=id_col, text_col=text_col, source_col=source_col, block_tokens=block_tokens, **target).select(
        *keyed("doc_id", F.unhex("text_key"), "source"), "nth", "block", "position"), spark, "mixture")
    blocks = (plan.agg(F.max("block")).first()[0] or 0) + 1
    parts = max(1, math.ceil(blocks * block_tokens / PART_TOKENS))
    copies = plan.groupBy(*key, "nth").agg(F.collect_list(F.struct("block", "position")).alias("copies"))
    copies = copies.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "copies"))), lambda x: x["copies"]).alias("_copies"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *keyed(id_col, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))), source_col))
    both = rows.join(copies, key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row")))      # in the join's own partitions
    own = both.select("row", F.get("_copies", nth - 1).alias("_own")).select("row", F.inline("_own"))
    part = F.floor(F.col("block") * parts / F.lit(blocks)).cast("int")
    return own.repartitionById(parts, part).sortWithinPartitions("block", "position")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "source", "tokens", "copy", "block", "position")


ORACLE = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, md5(coalesce(text, '')) AS text_key, coalesce(source, '') AS source,
         greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')), 1) AS tokens,
         row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, '')) ORDER BY coalesce(source, '')) AS nth
  FROM documents),
sources AS (SELECT source, sum(tokens)::BIGINT AS whole FROM rows_ GROUP BY source),
bounds AS (SELECT max(whole)::DOUBLE AS most, min(whole)::DOUBLE AS least FROM sources),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN pow(least / most, -1.0) <= {MAX_REPEATS} THEN 0.0 ELSE 1.0 END::DOUBLE FROM bounds
  UNION ALL
  SELECT step + 1, CASE WHEN pow(least / most, (low + high) / 2 - 1) <= {MAX_REPEATS} THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(least / most, (low + high) / 2 - 1) <= {MAX_REPEATS} THEN (low + high) / 2 ELSE high END
  FROM bisect, bounds WHERE step < {LEVELS}),
exponent AS (SELECT least(1.0, ceil(high * 1e6) / 1e6) AS a FROM bisect WHERE step = {LEVELS}),
quotas AS (SELECT source, whole, floor(round(pow(whole / most, a - 1), 6)::DECIMAL(18,6) * whole::DECIMAL(18,0))::BIGINT AS quota FROM sources, bounds, exponent),
blocks AS (SELECT greatest(1, ceil(sum(quota) / {BLOCK_TOKENS}.0))::BIGINT AS n FROM quotas),
copies AS (SELECT r.*, whole, quota, unnest(range(ceil(quota / whole::DOUBLE)::BIGINT)) AS copy FROM rows_ r JOIN quotas q USING (source) WHERE quota > 0),
ordered AS (SELECT *, md5(concat_ws('|', '{SEED}', source, copy::VARCHAR, coalesce(doc_id::VARCHAR, ''), text_key, nth::VARCHAR)) AS order_ FROM copies),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, copy ORDER BY order_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + copy * whole AS before FROM ordered),
cut AS (SELECT *, ((before::HUGEINT * n) // quota)::BIGINT AS block FROM placed, blocks WHERE before < quota)
SELECT doc_id, source, tokens, copy::INT AS copy, block, (row_number() OVER (PARTITION BY block ORDER BY order_))::INT AS position FROM cut
"""
