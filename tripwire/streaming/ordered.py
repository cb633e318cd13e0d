"""Event-time order on Spark's keyed state.

``in_order`` holds the rows of a key in its state until the watermark has passed
them, then applies them in event-time order.  Spark keeps the state, drops rows
that are older than the watermark, wakes a state by an event-time timeout when
its next row is due, and restores all of it from the checkpoint after a failure.

Keys are dealt to ``LANES`` lanes by their hash, and a lane's keys share one
state: a call into Python costs milliseconds, so one a key and micro-batch would
cost far more than the rows.  Each micro-batch touches only the lanes with new
or due rows.  A lane's state has the rows of the watermark's delay and what
``step`` carries a key; a key leaves it when none of its rows is held and
``step`` says that it isn't needed, or that no row can come.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = T.StructType([T.StructField("held", T.BinaryType()), T.StructField("carried", T.BinaryType())])
LANES = 1024


def frames(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(schema)})


def _lane(keys: list[str], lanes: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(lanes)).cast("int").alias("_lane")


def _whole_numbers(rows: DataFrame, names: list[str]) -> list[str]:
    """The columns that pandas would make doubles for a null beside them."""
    return [f.name for f in rows.schema if f.name in names and isinstance(f.dataType, T.IntegralType)]


def _exact(names: list[str], numbers: list[str]) -> list[Column]:
    """``names`` with 0 for nulls of the whole numbers, and a column that marks these nulls beside each."""
    return [*[F.coalesce(c, F.lit(0)).alias(c) if c in numbers else F.col(c) for c in names], *[F.col(c).isNull().alias(f"_no_{c}") for c in numbers]]


def _values(batch: pd.DataFrame, name: str) -> list:
    """A column's values, None for nulls."""
    no = batch[f"_no_{name}"] if f"_no_{name}" in batch else batch[name].isna()
    values = batch[name].tolist()
    return [None if n else v for v, n in zip(values, no.tolist())] if no.any() else values


def in_order(rows: DataFrame, keys: list[str], ts: str, order: list[str], columns: list[str], output: T.StructType,
             step: Callable[[object, tuple, tuple], tuple[object, list[tuple]]], last_micros: Callable[[tuple], int | None] = lambda key: None,
             lanes: int = LANES) -> DataFrame:
    """``step(carried, key, row)`` for each row of a key in order of ``ts`` and ``order``; it gives what to carry on, and output rows.

    A ``row`` is (time in microseconds, *order, *columns); ``order`` are whole numbers.  ``carried`` begins as
    None and is dropped when it is None.  ``last_micros(key)`` is a time after
    which no row of the key is expected: its state goes when the watermark has
    passed that.  Rows with a null time or a null in ``order`` only move the
    watermark.  ``rows`` must have a watermark on ``ts``.
    """
    names = [*order, *columns]
    first = 1 + len(order)      # a held row is (time, *order, key, *columns)

    def run(lane: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # carried: key -> (what step carries, the key's last time)
        held, carried = (pickle.loads(x) for x in state.get) if state.exists else ([], {})
        same: dict[tuple, tuple] = {}       # one object a key, which pickle writes once
        for batch in batches:
            if batch.empty:         # the lane is woken by its timeout
                continue
            whole = batch[batch["_whole"]]
            of_key = [same.setdefault(k, k) for k in zip(*(_values(whole, f"_key_{c}") for c in keys))]
            held += zip(whole["_micros"].tolist(), *(whole[c].tolist() for c in order), of_key, *(_values(whole, c) for c in columns))
        passed = state.getCurrentWatermarkMs() * 1000
        held.sort(key=lambda r: r[:first])
        ready = 0
        out: list[tuple] = []
        while ready < len(held) and held[ready][0] <= passed:
            row = held[ready]
            key = row[first]
            before = carried.get(key)
            now, made = step(before and before[0], key, (*row[:first], *row[first + 1:]))
            if now is None:
                carried.pop(key, None)
            else:
                carried[key] = (now, before[1] if before else last_micros(key))
            out += made
            ready += 1
        held = held[ready:]
        waiting = {r[first] for r in held}
        carried = {k: c for k, c in carried.items() if c[1] is None or c[1] > passed or k in waiting}
        due = min([r[0] for r in held[:1]] + [last for k, (_, last) in carried.items() if last is not None and k not in waiting], default=None)
        if not held and not carried:
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(held), pickle.dumps(carried)))
            if due is not None:
                state.setTimeoutTimestamp(max(int(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield frames(out, output)

    # keys under names of their own: a column may be a key and a value
    named = rows.select("*", *[F.col(c).alias(f"_key_{c}") for c in keys], F.unix_micros(ts).alias("_micros"))
    sent = [*[f"_key_{c}" for c in keys], "_micros", *names]
    whole = F.lit(True)
    for c in ("_micros", *order):
        whole = whole & F.col(c).isNotNull()
    slim = named.select(_lane([f"_key_{c}" for c in keys], lanes), ts, whole.alias("_whole"), *_exact(sent, _whole_numbers(named, sent)))
    return slim.groupBy("_lane").applyInPandasWithState(run, output, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(rows: DataFrame, keys: list[str], ts: str, columns: list[str], lanes: int = LANES) -> DataFrame:
    """The rows that ``in_order`` over the same stream doesn't get, as they are older than the watermark when they arrive.

    No state is kept and nothing waits: a row is compared with the watermark of
    its own micro-batch.
    """
    wanted = rows.select(*keys, *columns)
    names = wanted.columns
    numbers = _whole_numbers(wanted, names)
    slim = rows.select(_lane(keys, lanes), ts, F.unix_micros(ts).alias("_micros"), *_exact([c for c in names if c != ts], numbers))
    output = T.StructType([f for f in slim.schema if f.name not in ("_lane", "_micros") and (f.name != ts or ts in names)])
    sent = output.names

    def run(lane: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            late = batch[batch["_micros"] <= passed] if passed > 0 else batch[:0]
            if len(late):
                yield late[sent]

    found = slim.groupBy("_lane").applyInPandasWithState(run, output, STATE, "append", GroupStateTimeout.NoTimeout)
    return found.select(*[F.when(~F.col(f"_no_{c}"), F.col(c)).alias(c) if c in numbers else c for c in names])
