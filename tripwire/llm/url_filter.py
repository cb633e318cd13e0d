"""URL filter: host and path rules first, then a Bloom filter cascade.

The cascade answers, without a join and without error, whether a URL's key
(host and path) is listed.  Its key universe is complete: every distinct key
of the table.  Level 0 is a Bloom filter of the listed keys; level 1 encodes
the unlisted keys that level 0 takes for listed; level 2 the listed keys that
level 1 takes for unlisted; and so on until a level errs on no key of the
universe.  The first level that doesn't hold a key decides.

Keys are dealt to shards of a bounded number of keys, each with a cascade of
its own, built in one task.  Filters are broadcast; when all together exceed
``broadcast_bytes`` the table is judged in several passes, each with the
filters of some of the shards.  A pass is written, and its filters given up on
the driver and the executors, before the next collects its own.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm.common import arrow_batch, table, written

KEYS_PER_SHARD = 50_000
BROADCAST_BYTES = 64 << 20
LATER_RATE = 0.5        # false positive rate of the levels after the first
#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A host is listed, unless the caller gives a list, if one of its labels is words joined by hyphens, as spam hosts often are.
HYPHENATED = r"(^|\.)[a-z0-9]+(-[a-z0-9]+)+(\.|$)"

JUDGED = T.StructType([T.StructField(c, t) for c, t in (("page_id", T.LongType()), ("host", T.StringType()), ("path", T.StringType()),
                                                         ("rule", T.StringType()), ("verdict", T.StringType()), ("listed", T.BooleanType()))])


class BloomLevel:
    """Bits for ``keys`` at false positive rate ``rate``; ``seed`` makes the levels independent."""

    def __init__(self, keys: Sequence[bytes], rate: float, seed: int):
        self.seed = seed
        self.bits = max(8, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / len(keys) * math.log(2)))
        marks = np.zeros(self.bits, bool)
        marks[self.places(keys).ravel()] = True
        self.packed = np.packbits(marks)

    def places(self, keys: Sequence[bytes]) -> np.ndarray:
        both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, self.seed) for k in keys), "<u8").reshape(-1, 2)
        with np.errstate(over="ignore"):
            return (both[:, :1] + np.arange(self.hashes, dtype=np.uint64) * (both[:, 1:] | np.uint64(1))) % np.uint64(self.bits)

    def holds(self, keys: Sequence[bytes]) -> np.ndarray:
        at = self.places(keys)
        return ((self.packed[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def build_cascade(listed: list[bytes], others: list[bytes]) -> list[BloomLevel]:
    """Levels over disjoint key sets; no listed key means no level."""
    levels: list[BloomLevel] = []
    inside, outside = listed, others
    while inside:
        rate = min(0.5, max(1e-6, len(inside) * math.sqrt(0.5) / max(1, len(outside)))) if not levels else LATER_RATE
        level = BloomLevel(inside, rate, len(levels))
        levels.append(level)
        wrong = [k for k, held in zip(outside, level.holds(outside)) if held] if outside else []
        inside, outside = wrong, inside
    return levels


def is_listed(levels: list[BloomLevel], keys: list[bytes]) -> np.ndarray:
    """The parity of the first level that doesn't hold a key: exact for every key of the universe."""
    answer, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
    for depth, level in enumerate(levels):
        if not len(open_):
            break
        held = level.holds([keys[i] for i in open_])
        answer[open_] = held if depth % 2 == 0 else ~held
        open_ = open_[held]
    return answer


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``; a null url, or one without ``://``, has both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    lower = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), lower.alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def rule_columns(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as its text, and its verdict; both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    # the last that fits wins: the longest, of equal ones the first in the alphabet
    for host, path, decision in sorted(sorted(rules, key=lambda r: r[0] + r[1], reverse=True), key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def hyphenated_keys(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The list that ``pages`` themselves give: ``host`` and ``path`` of those with a hyphenated host."""
    return parsed(pages, id_col, url_col).filter(F.col("host").rlike(HYPHENATED)).select("host", "path").distinct()


def url_filter(pages: DataFrame, listed: Column | DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES,
               id_col: str = "page_id", url_col: str = "url", keys_per_shard: int = KEYS_PER_SHARD,
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``listed``.

    ``listed`` says which keys of the universe are on the list: a table of
    ``host`` and ``path``, or a condition on both; without it, the table of
    ``hyphenated_keys``.  The longest fitting rule's verdict holds, of rules of
    equal length the first in the alphabet; elsewhere listed keys are blocked.
    Equal urls get equal verdicts, each repeated row its own; null urls have the
    empty key, long ones are taken whole; an empty table gives no rows; other
    columns are not read.
    """
    spark = pages.sparkSession
    listed = hyphenated_keys(pages, id_col, url_col) if listed is None else listed
    rows = parsed(pages, id_col, url_col)
    key = F.concat("host", "path")
    distinct = rows.select("host", "path").distinct()
    if isinstance(listed, DataFrame):
        on_list = listed.select("host", "path").distinct().withColumn("_listed", F.lit(True))
        distinct, listed = distinct.join(on_list, ["host", "path"], "left"), F.col("_listed")
    universe = written(distinct.select(key.alias("key"), F.coalesce(listed, F.lit(False)).alias("listed")), "url-keys")
    shards = max(1, math.ceil(universe.count() / keys_per_shard))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")

    def build(group: pa.Table) -> pa.Table:
        keys, flags = [k.encode() for k in group["key"].to_pylist()], group["listed"].to_pylist()
        levels = build_cascade([k for k, f in zip(keys, flags) if f], [k for k, f in zip(keys, flags) if not f])
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "filters": [pickle.dumps(levels)]})

    filters = written(universe.select("key", "listed", shard).groupBy("shard").applyInArrow(build, "shard int, filters binary"), "url-filters")
    size = filters.agg(F.sum(F.octet_length("filters"))).first()[0] or 0
    passes = max(1, math.ceil(size / broadcast_bytes))
    rule, verdict = rule_columns(rules)
    keyed = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), key.alias("key"))
    keyed = keyed.select("*", shard)
    judged = []
    for turn in range(passes):
        mine = F.col("shard") % passes == turn
        held = spark.sparkContext.broadcast({r.shard: r.filters for r in filters.filter(mine).collect()})

        def judge(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            cascades = {s: pickle.loads(b) for s, b in held.value.items()}
            for batch in batches:
                keys, of = [k.encode() for k in batch.column(5).to_pylist()], batch.column(6).to_numpy()
                on_list = np.zeros(len(keys), bool)
                for s in np.unique(of):
                    at = np.flatnonzero(of == s)
                    on_list[at] = is_listed(cascades.get(int(s), []), [keys[i] for i in at])
                verdicts = [v or ("block" if x else "allow") for v, x in zip(batch.column(4).to_pylist(), on_list)]
                yield arrow_batch(JUDGED, [*batch.columns[:4], verdicts, on_list.tolist()])

        result = (keyed.filter(mine) if passes > 1 else keyed).mapInArrow(judge, JUDGED)
        if passes == 1:
            return result
        judged.append(written(result, "url-verdicts"))
        held.destroy()
    result = judged[0]
    for more in judged[1:]:
        result = result.unionByName(more)
    return result


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_LONGEST_FIRST = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
ORACLE = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE {' '.join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for h, p, _ in _LONGEST_FIRST)} END AS rule,
         CASE {' '.join(f"WHEN {_FITS.format(h, p)} THEN '{v}'" for h, p, v in _LONGEST_FIRST)} END AS by_rule,
         regexp_matches(host, '{HYPHENATED}') AS listed
  FROM parts)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM ruled
"""
