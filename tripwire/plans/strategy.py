"""Join and window strategies that hold up at scale.

* ``running_sum``: per-key running total that does not put a hot key into one
  task: rows are cut into time chunks, chunk totals are pre-aggregated
  (map-side combine), prefix-summed over the small chunk table, then added to a
  within-chunk window.  The result equals the plain window.
* ``asof_changes``: attach to each row the state that a log of changes has left
  at its time (latest values, running sums), linear in rows and changes.
* ``asof_joint``: the same for state of no key and of the row's key at once, in one pass.
* ``neighbors``: the next and the previous row of a key, by chunks.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def materialized(df: DataFrame, name: str) -> DataFrame:
    """A slim derived table, written once to the shared checkpoint folder and read back,
    where a plan would otherwise compute it several times.  This also cuts the lineage."""
    from tripwire.session import scratch_path
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _chunk(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000))


def running_sum(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, value: str, out: str,
                exclusive: bool = True, chunk_seconds: int = 60) -> DataFrame:
    """Add ``out`` = sum of ``value`` over earlier rows of the same ``keys`` in
    ``(ts, tiebreak)`` order (``exclusive``: the row itself not included; 0 when none).

    Skew-safe: partitions by ``keys + chunk`` rather than ``keys`` alone.
    """
    rows = df.select("*", _chunk(ts, chunk_seconds).alias("_chunk"))
    k = [F.col(c) for c in keys]
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_ctot"))
    w_chunks = Window.partitionBy(*k).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_ctot").over(w_chunks), F.lit(0))
                            .cast(totals.schema["_ctot"].dataType).alias("_off"))
    joined = rows.join(offsets, on=[*keys, "_chunk"], how="inner")
    end = -1 if exclusive else 0
    w_in = (Window.partitionBy(*k, F.col("_chunk")).orderBy(F.col(ts), F.col(tiebreak))
            .rowsBetween(Window.unboundedPreceding, end))
    inside = F.coalesce(F.sum(value).over(w_in), F.lit(0))
    return joined.select(*df.columns, (F.col("_off") + inside).alias(out))


def asof_changes(rows: DataFrame, changes: DataFrame, ts: str, order: str, keys: Sequence[tuple[str, str]] = (),
                 last: Sequence[str] = (), sums: Sequence[str] = (), chunk_seconds: int = 600, salts: int = 8) -> DataFrame:
    """Add to each row the state left by the ``changes`` of its keys at or before its time.

    ``last``: the latest non-null value of each of these columns of ``changes``
    (in ``(ts, order)`` order; NULL when there is none).  ``sums``: the sum of
    each of these columns (0 when there is none).  ``keys``: pairs of a column
    of ``rows`` and a column of ``changes``.

    Time is cut into chunks.  A chunk's opening state is a prefix over the
    per-chunk summary in two levels (chunks of a day, then days), so no window
    runs over the rows or the changes of a key; it enters the chunk as one more
    change.  A chunk's rows are dealt to ``salts`` tasks, each with the chunk's
    changes.  Nothing is broadcast and no interval is expanded.
    """
    changes = materialized(changes, "changes")
    k = [f"_k{i}" for i in range(len(keys))]
    values = [*last, *sums]
    ch = changes.select(*[F.col(c).alias(n) for n, (_, c) in zip(k, keys)], F.col(ts).alias("_ts"),
                        F.col(order).alias("_order"), *values, _chunk(ts, chunk_seconds).alias("_chunk"))
    at = F.struct("_ts", "_order")
    summary = ch.groupBy(*k, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last], *[F.sum(c).alias(c) for c in sums])
    types = dict(summary.dtypes)
    r = rows.select(F.struct("*").alias("_row"), *[F.col(c).alias(n) for n, (c, _) in zip(k, keys)],
                    F.col(ts).alias("_ts"), _chunk(ts, chunk_seconds).alias("_chunk"))
    empty = [F.lit(None).cast(types[c]).alias(c) for c in values]
    slots = (r.select(*k, "_chunk").distinct().select(*k, "_chunk", *empty).unionByName(summary)
             .groupBy(*k, "_chunk").agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])
             .withColumn("_day", F.floor(F.col("_chunk") * chunk_seconds / DAY_SECONDS)))
    # level 1: days of a key (one row per key and day); level 2: chunks of a day
    days = slots.groupBy(*k, "_day").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_chunk"))).alias(c) for c in last],
        *[F.sum(c).alias(c) for c in sums])
    by_day = Window.partitionBy(*k).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    in_day = Window.partitionBy(*k, "_day").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    def before(w):
        return [*[F.last(c, ignorenulls=True).over(w).alias(c) for c in last], *[F.sum(c).over(w).alias(c) for c in sums]]

    day_open = days.select(*k, "_day", *before(by_day)).select(
        *[F.col(n).alias(f"_d{n}") for n in [*k, "_day"]], *[F.col(c).alias(f"_d_{c}") for c in values])
    chunk_open = slots.select(*k, "_day", "_chunk", *before(in_day))
    same_day = [F.col(n).eqNullSafe(F.col(f"_d{n}")) for n in [*k, "_day"]]
    opening = chunk_open.join(day_open, same_day).select(
        *k, "_chunk", *[F.coalesce(c, f"_d_{c}").alias(c) for c in last],
        *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_d_{c}", F.lit(0))).cast(types[c]).alias(c) for c in sums])

    cols = [*k, "_chunk", "_salt", "_ts", "_side", "_order", "_row", *values]
    each_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    no_row = F.lit(None).cast(r.schema["_row"].dataType).alias("_row")
    no_order = F.lit(None).cast(ch.schema["_order"].dataType).alias("_order")
    events = r.select(*k, "_chunk", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("_salt"), "_ts",
                      F.lit(2).alias("_side"), no_order, "_row", *empty).select(*cols)
    events = events.unionByName(ch.select("*", F.lit(1).alias("_side"), no_row, each_salt).select(
        *[c for c in cols if c not in sums], *[F.col(c).cast(types[c]).alias(c) for c in sums]))
    events = events.unionByName(opening.select("*", F.lit(None).cast("timestamp").alias("_ts"), F.lit(0).alias("_side"),
                                               no_order, no_row, each_salt).select(*cols))
    w = (Window.partitionBy(*k, "_chunk", "_salt").orderBy(F.col("_ts").asc_nulls_first(), "_side", "_order")
         .rowsBetween(Window.unboundedPreceding, 0))
    out = events.select("_row", "_side", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in last],
                        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums])
    return out.where("_side = 2").select("_row.*", *values)


def _opening(slots: DataFrame, keys: Sequence[str], last: Sequence[str], sums: Sequence[str], chunk_seconds: int) -> DataFrame:
    """``keys``, ``_chunk`` and the state before each chunk, from slots (one row a key and chunk) with the chunk's own changes.

    A prefix in two levels: the days of a key, then the chunks of a day.
    """
    values = [*last, *sums]
    types = dict(slots.dtypes)
    slots = slots.withColumn("_day", F.floor(F.col("_chunk") * chunk_seconds / DAY_SECONDS))
    days = slots.groupBy(*keys, "_day").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_chunk"))).alias(c) for c in last], *[F.sum(c).cast(types[c]).alias(c) for c in sums])

    def before(w):
        return [*[F.last(c, ignorenulls=True).over(w).alias(c) for c in last], *[F.sum(c).over(w).cast(types[c]).alias(c) for c in sums]]

    by_day = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    in_day = Window.partitionBy(*keys, "_day").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    named = days.select(*keys, "_day", *before(by_day)).select(*[F.col(n).alias(f"_d{n}") for n in [*keys, "_day"]], *[F.col(c).alias(f"_d_{c}") for c in values])
    chunks = slots.select(*keys, "_day", "_chunk", *before(in_day))
    return chunks.join(named, [F.col(n).eqNullSafe(F.col(f"_d{n}")) for n in [*keys, "_day"]]).select(
        *keys, "_chunk", *[F.coalesce(c, f"_d_{c}").alias(c) for c in last],
        *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_d_{c}", F.lit(0))).cast(types[c]).alias(c) for c in sums])


def asof_joint(rows: DataFrame, changes: DataFrame, ts: str, order: str, last: Sequence[str], sums: Sequence[str],
               key: tuple[str, str], keyed: Sequence[str], chunk_seconds: int = 600, key_salts: int = 8, row_salts: int = 4) -> DataFrame:
    """Add to each row the state left by all ``changes`` at or before its time: of no key and of the row's own key, in one pass.

    ``last`` and ``sums`` are as in ``asof_changes``, over all changes; ``keyed``
    are the latest non-null values among the changes whose ``key[1]`` equals
    the row's ``key[0]``.  ``changes`` is read several times, so it should be a
    written table; ``rows`` are read for their keys and for themselves.

    Rows and changes of a time chunk are dealt to ``key_salts`` x ``row_salts``
    tasks, by the key and by the row: a change of no key goes to all of them, a
    keyed one to those of its key.  So one shuffle serves both states: a window
    over a task's chunk, and one over each key in it.  A key or a chunk that
    holds most rows is dealt out all the same.
    """
    values = [*last, *sums]
    ch = changes.select(F.col(key[1]).alias("_key"), F.col(ts).alias("_ts"), F.col(order).alias("_order"), *values, *keyed, _chunk(ts, chunk_seconds).alias("_chunk"))
    at = F.struct("_ts", "_order")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    summary = ch.groupBy("_chunk").agg(*[latest(c) for c in last], *[F.sum(c).alias(c) for c in sums])
    types = dict(summary.dtypes) | {c: t for c, t in changes.dtypes if c in keyed}
    of_key = ch.filter("_key IS NOT NULL")
    key_summary = of_key.groupBy("_key", "_chunk").agg(*[latest(c) for c in keyed])
    r = rows.select(F.struct("*").alias("_row"), F.col(key[0]).alias("_key"), F.col(ts).alias("_ts"), _chunk(ts, chunk_seconds).alias("_chunk"))
    none = lambda names: [F.lit(None).cast(types[c]).alias(c) for c in names]

    def slots(own: DataFrame, keys: list[str], names: Sequence[str]) -> DataFrame:
        asked = r.filter(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, "_chunk"])).select(*keys, "_chunk").distinct()
        return asked.select("*", *none(names)).unionByName(own).groupBy(*keys, "_chunk").agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])

    opening = _opening(slots(summary, [], values), [], last, sums, chunk_seconds)
    key_opening = _opening(slots(key_summary, ["_key"], keyed), ["_key"], keyed, [], chunk_seconds)
    cols = ["_key", "_chunk", "_ks", "_rs", "_ts", "_side", "_order", "_row", *values, *keyed]
    key_salt = F.pmod(F.xxhash64("_key"), F.lit(key_salts)).cast("int")
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    filler = {"_key": F.lit(None).cast(dict(ch.dtypes)["_key"]), "_row": F.lit(None).cast(r.schema["_row"].dataType),
              "_order": F.lit(None).cast(dict(ch.dtypes)["_order"]), "_ts": F.lit(None).cast("timestamp"), **{c: F.lit(None).cast(types[c]) for c in [*values, *keyed]}}

    def event(df: DataFrame, side: int) -> DataFrame:
        have = df.columns
        return df.select(*[F.lit(side).alias(c) if c == "_side" else F.col(c).cast(types[c]).alias(c) if c in have and c in types else F.col(c) if c in have else filler[c].alias(c)
                           for c in cols])

    def everywhere(df: DataFrame) -> DataFrame:
        return df.select("*", each(key_salts, "_ks")).select("*", each(row_salts, "_rs"))

    some = F.coalesce(*[F.col(c).cast("string") for c in values]).isNotNull()
    events = event(r.select("*", key_salt.alias("_ks"), F.pmod(F.xxhash64("_row"), F.lit(row_salts)).cast("int").alias("_rs")), 2)
    for df in (event(everywhere(ch.filter(some).drop("_key", *keyed)), 1), event(everywhere(opening), 0),
               event(of_key.drop(*values).select("*", key_salt.alias("_ks"), each(row_salts, "_rs")), 1),
               event(key_opening.select("*", key_salt.alias("_ks"), each(row_salts, "_rs")), 0)):
        events = events.unionByName(df)
    in_order = [F.col("_ts").asc_nulls_first(), F.col("_side"), F.col("_order")]
    whole = Window.partitionBy("_chunk", "_ks", "_rs").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)
    by_key = Window.partitionBy("_chunk", "_ks", "_rs", "_key").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.select("_chunk", "_ks", "_rs", "_key", "_ts", "_side", "_order", "_row", *keyed, *[F.last(c, ignorenulls=True).over(whole).alias(c) for c in last],
                        *[F.coalesce(F.sum(c).over(whole), F.lit(0)).cast(types[c]).alias(c) for c in sums])
    out = out.select("_row", "_side", *values, *[F.last(c, ignorenulls=True).over(by_key).alias(c) for c in keyed])
    return out.where("_side = 2").select("_row.*", *values, *keyed)


def pushdown_barrier(df: DataFrame) -> DataFrame:
    """Re-emit the columns through a one-row ``inline`` generator.

    Filters written on top of a deep staged projection (the scan) would
    otherwise be pushed down through every stage, and each push substitutes the
    column aliases with no cost check, so a condition that refers to a staged
    column several times grows multiplicatively.  A filter cannot move below a
    generator for columns the generator produces; the extra operator is a
    one-element array per row inside the same codegen stage.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def neighbors(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], cols: Sequence[str],
              chunk_seconds: int = 60, write: bool = True) -> DataFrame:
    """Add ``_next`` / ``_prev``: struct of ``cols`` of the following / preceding row of
    the same ``keys`` in ``order`` (whose first column is ``ts``); NULL at the ends.

    Equals ``lead``/``lag`` over ``partitionBy(keys)``, but the window runs per
    (keys, time chunk), so one hot key is spread over many tasks.  Chunk
    boundaries are stitched from a per-chunk first/last summary (one row per
    chunk), so only that small table is windowed per key.  The (slim) input is
    written once, as both sides read it (``write=False``: it is cheap to read twice).
    """
    df = materialized(df, "events") if write else df
    rows = df.select("*", _chunk(ts, chunk_seconds).alias("_chunk"), F.struct(*[F.col(c) for c in cols]).alias("_v"),
                     F.struct(*[F.col(c) for c in order]).alias("_o"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    rows = rows.select("*", F.lead("_v").over(w).alias("_in_next"), F.lag("_v").over(w).alias("_in_prev"))
    summary = rows.groupBy(*keys, "_chunk").agg(F.min_by("_v", "_o").alias("_first"),
                                                F.max_by("_v", "_o").alias("_last"))
    wc = Window.partitionBy(*keys).orderBy("_chunk")
    summary = summary.select(*keys, "_chunk", F.lead("_first").over(wc).alias("_chunk_next"),
                             F.lag("_last").over(wc).alias("_chunk_prev"))
    j = rows.join(summary, on=[*keys, "_chunk"], how="inner")
    return j.select(*df.columns,
                    F.coalesce(F.col("_in_next"), F.col("_chunk_next")).alias("_next"),
                    F.coalesce(F.col("_in_prev"), F.col("_chunk_prev")).alias("_prev"))


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread a CPU-heavy narrow job over all task slots when its input arrives in
    fewer partitions than the cluster can run at once (e.g. one large row group).

    Only the already-projected columns are redistributed (round-robin).  With a
    large input (thousands of splits) this is a no-op, so no shuffle is added at
    scale.  Streaming inputs are left alone.
    """
    if df.isStreaming:
        return df
    try:
        plan = df._jdf.queryExecution().executedPlan()
        # a shuffled input already has its parallelism; asking an adaptive plan for
        # its partitions would execute its shuffle stages early, so leave it alone
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or "Exchange" in plan.toString():
            return df
        parts = df.rdd.getNumPartitions()
    except Exception:  # pragma: no cover - plan or partition count unavailable
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if parts < slots else df
