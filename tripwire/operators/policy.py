"""Spend policy on tables of payments.

* ``violations``: SINGLE_TX_LIMIT, DAILY_LIMIT, ALLOWLIST_VIOLATION (that order,
  all that apply) for an amount, a running daily total and a recipient.
* ``daily_running_spend``: daily total before each payment = all earlier
  attempts of the same account and UTC day (skew-safe running sum).
* ``daily_accepted_spend``: daily total counting only payments that passed,
  an order-dependent fold streamed through key-sorted partitions.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.functions.text import cut_ellipsis, money
from tripwire.params import PolicyParams
from tripwire.plans.strategy import running_sum

COMMAND_PREFIX = "/guard"

VIOLATION = T.StructType([T.StructField("rule", T.StringType()), T.StructField("detail", T.StringType())])


def violations(amount: Column, daily_total: Column, to_address: Column, single_limit: Column,
               daily_limit: Column, allowlist_active: Column | None = None, in_allowlist: Column | None = None
               ) -> Column:
    """array<struct<rule, detail>>.

    Strict ``>``: an amount exactly at a limit passes.  A NaN amount is reported
    as INVALID_AMOUNT (deviation: Python's ``nan > x`` is False, which would pass it).
    ``allowlist_active``: the list is non-empty; ``in_allowlist``: lower(to) is in it.
    """
    amt = amount.cast("double")
    projected = daily_total.cast("double") + amt
    nan = F.isnan(amt)
    single = F.when(~nan & (amt > single_limit), F.struct(
        F.lit("SINGLE_TX_LIMIT").alias("rule"),
        F.concat(money(amt), F.lit(" exceeds the single-transaction limit of "), money(single_limit),
                 F.lit(".")).alias("detail")))
    daily = F.when(~nan & (projected > daily_limit), F.struct(
        F.lit("DAILY_LIMIT").alias("rule"),
        F.concat(F.lit("This transaction would bring the daily total to "), money(projected),
                 F.lit(", exceeding the daily limit of "), money(daily_limit), F.lit(".")).alias("detail")))
    invalid = F.when(nan, F.struct(F.lit("INVALID_AMOUNT").alias("rule"),
                                   F.lit("Amount is not a number.").alias("detail")))
    items = [invalid, single, daily]
    if allowlist_active is not None:
        to = F.coalesce(to_address, F.lit(""))
        allow = F.when(allowlist_active & (to != "") & ~F.coalesce(in_allowlist, F.lit(False)), F.struct(
            F.lit("ALLOWLIST_VIOLATION").alias("rule"),
            F.concat(F.lit("Recipient "), cut_ellipsis(to, 10),
                     F.lit(" is not in the approved allowlist. Add with: " + COMMAND_PREFIX + " allowlist add "),
                     to).alias("detail")))
        items.append(allow)
    return F.array_compact(F.array(*items))


def with_day(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("day", F.to_date(F.col(ts)))


def daily_running_spend(tx: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Per payment: spend_before (earlier attempts same account/day), projected, violations."""
    d = running_sum(with_day(tx), ["account", "day"], "ts", "tx_id", "amount_usd", "spend_before")
    v = violations(F.col("amount_usd"), F.col("spend_before"), F.col("to_addr"),
                   F.lit(params.single_limit), F.lit(params.daily_limit))
    return d.select("tx_id", "account", "day", "ts", "amount_usd", "spend_before",
                    (F.col("spend_before") + F.col("amount_usd")).alias("projected"), v.alias("violations"))


FOLDED = T.StructType([T.StructField("tx_id", T.LongType()), T.StructField("account", T.LongType()), T.StructField("day", T.DateType()),
                       T.StructField("before", T.LongType()), T.StructField("accepted", T.BooleanType()), T.StructField("after", T.LongType())])


def _accepted_fold(single: float, daily: float):
    """Totals in cents; a row with a ``carry`` only sets its key's total."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, 0
        for b in batches:
            cents = b["cents"].to_numpy(dtype="float64", na_value=float("nan"))
            carry = b["carry"].to_numpy(dtype="float64", na_value=float("nan"))
            before, accepted, after = [], [], []
            for account, day, c, set_to in zip(b["account"].tolist(), b["day"].tolist(), cents.tolist(), carry.tolist()):
                if (account, day) != key:
                    key, total = (account, day), 0
                if set_to == set_to:
                    total = int(set_to)
                before.append(total)
                ok = c == c and c / 100 <= single and (total + c) / 100 <= daily
                accepted.append(ok)
                if ok:
                    total += int(c)
                after.append(total)
            out = pd.DataFrame({"tx_id": b["tx_id"], "account": b["account"], "day": b["day"], "before": before,
                                "accepted": accepted, "after": after})
            yield out[(carry != carry)]
    return run


def fold_accepted(tx: DataFrame, carried: DataFrame | None = None, params: PolicyParams = PolicyParams(),
                  partitions: int | None = None) -> DataFrame:
    """``tx_id, account, day, before, accepted, after`` (cents) of payments in (ts, tx_id) order per account and day.

    ``carried`` (``account, day, carry``) opens a key at an earlier total.  Rows
    are hash-partitioned by (account, day) and sorted inside each partition; a
    streaming ``mapInPandas`` carries the total across Arrow batches, so a large
    group is never held whole: memory stays at one batch.  The fold depends on
    its order, so one account's day is one task.
    """
    rows = tx.select("tx_id", "account", "day", "ts", (F.col("amount_usd") * 100).cast("bigint").alias("cents"), F.lit(None).cast("bigint").alias("carry"))
    if carried is not None:
        none = F.lit(None)
        rows = rows.unionByName(carried.select(none.cast("bigint").alias("tx_id"), "account", "day", none.cast("timestamp").alias("ts"),
                                               none.cast("bigint").alias("cents"), "carry"))
    rows = rows.repartition(partitions, "account", "day") if partitions else rows.repartition("account", "day")
    rows = rows.sortWithinPartitions("account", "day", F.col("ts").asc_nulls_first(), "tx_id")
    return rows.mapInPandas(_accepted_fold(params.single_limit, params.daily_limit), FOLDED)


def dollars(cents: str) -> Column:
    return (F.col(cents).cast("decimal(20,0)") / 100).cast("decimal(18,2)")


def daily_accepted_spend(tx: DataFrame, params: PolicyParams = PolicyParams(), partitions: int | None = None
                         ) -> DataFrame:
    """Running daily total of *accepted* payments only (order-dependent fold)."""
    d = fold_accepted(with_day(tx), None, params, partitions)
    return d.select("tx_id", "account", "day", dollars("before").alias("accepted_before"), "accepted")
