"""Operator command log replay.

The reference keeps process-lifetime state changed by chat commands.  Here the
commands are a table; the state at any time is what its changes have left:

* ``parse_commands``: typed events (prefix optional, case-insensitive).
* ``policy_changes``, ``reset_changes``, ``allowlist_changes``: the changes of each
  piece of state; ``state_changes``: all of them, written once.
* ``with_state``: rows under all that is in force at their time; ``payment_replay``
  and ``policy_snapshot`` on top of it.
* ``policy_checks``: answers to the ``check-policy`` commands.
* ``allowlist_state`` / ``allowlist_show``: the final list, and as it is shown.
* ``gate_outcomes``: one-slot confirmation gate per session.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripwire.operators.policy import COMMAND_PREFIX, violations
from tripwire.params import PolicyParams
from tripwire.plans.strategy import asof_changes, asof_joint, materialized, neighbors, pushdown_barrier, running_sum
from tripwire.regex import WS

ADDRESS_FULL = r"(?i)^0x[0-9a-f]{40}\z"


def _tokens(command: Column) -> Column:
    s = F.regexp_replace(command, "^" + WS + "+|" + WS + "+$", "")
    s = F.when(F.lower(s).startswith(COMMAND_PREFIX),
               F.regexp_replace(s, "(?is)^" + COMMAND_PREFIX + WS + "*", "")
               ).otherwise(s)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS + "+"))


#: all decimal digits of Unicode, and the ASCII digit of each
DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None]
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)
DIGITS = "".join(DIGITS)
NUMBER = r"[+-]?(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?"


def amount_text(tok: Column) -> Column:
    """``float(tok.replace(',', '').replace('$', ''))`` (NULL when not a number): the
    digits of any script, underscores between digits, no type suffixes, no hex."""
    plain = F.translate(F.translate(tok, ",$", ""), DIGITS, ASCII_DIGITS)
    lower = F.lower(plain)
    return (F.when(plain.rlike("^" + NUMBER + r"\z"), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
            .when(lower.rlike(r"^[+-]?nan\z"), F.lit(float("nan")))
            .when(lower.rlike(r"^\+?inf(?:inity)?\z"), F.lit(float("inf")))
            .when(lower.rlike(r"^-inf(?:inity)?\z"), F.lit(float("-inf"))))


def parse_commands(log: DataFrame) -> DataFrame:
    """Adds sub, args, kind, value, address, valid."""
    d = log.select("*", _tokens(F.col("command")).alias("_tok"))
    tok = F.col("_tok")
    sub = F.lower(F.call_function("try_element_at", tok, F.lit(1)))
    a1 = F.call_function("try_element_at", tok, F.lit(2))
    a2 = F.call_function("try_element_at", tok, F.lit(3))
    d = d.select("*", sub.alias("sub"), F.when(F.size(tok) > 1, F.slice(tok, F.lit(2), F.size(tok))).otherwise(F.array().cast("array<string>")).alias("args"),
                 F.lower(a1).alias("_a1"), a1.alias("_a1raw"), a2.alias("_a2"))
    s, a1l, a2 = F.col("sub"), F.col("_a1"), F.col("_a2")
    setv = amount_text(a2)
    kind = (F.when(s.isNull(), F.lit("help"))
            .when(s == "set", F.when(a1l == "daily", F.lit("set_daily")).when(a1l == "limit", F.lit("set_limit"))
                  .otherwise(F.lit("set_invalid")))
            .when(s == "reset", F.when(a1l == "daily", F.lit("reset_daily")).otherwise(F.lit("reset_invalid")))
            .when(s == "allowlist", F.when(a1l == "add", F.lit("allowlist_add"))
                  .when(a1l == "remove", F.lit("allowlist_remove"))
                  .when(a1l == "show", F.lit("allowlist_show")).otherwise(F.lit("allowlist_invalid")))
            .when(s.isin("confirm", "cancel", "scan", "decode", "check-policy", "policy", "status", "help",
                         "version", "dry-run"), F.regexp_replace(s, "-", "_"))
            .otherwise(F.lit("unknown")))
    d = d.select("*", kind.alias("kind"), setv.alias("_setv"))
    kind, setv = F.col("kind"), F.col("_setv")
    value = (F.when(s == "set", setv).when(s == "check-policy", amount_text(F.col("_a1raw"))))
    # NaN limits are rejected (deviation: the reference accepts NaN and disables the check)
    valid = (F.when(kind.isin("set_daily", "set_limit"), F.coalesce(setv > 0, F.lit(False)) & ~F.isnan(setv))
             .when(kind.isin("allowlist_add", "allowlist_remove"), F.coalesce(a2.rlike(ADDRESS_FULL), F.lit(False)))
             .when(kind == "check_policy", value.isNotNull() & ~F.isnan(value))
             .when(kind.isin("unknown", "set_invalid", "reset_invalid", "allowlist_invalid"), F.lit(False))
             .otherwise(F.lit(True)))
    address = F.when(kind.isin("allowlist_add", "allowlist_remove"), F.lower(a2)) \
        .when(kind == "check_policy", F.call_function("try_element_at", tok, F.lit(3)))
    out = d.select(*log.columns, "sub", F.array_join(F.col("args"), " ").alias("args"), "kind",
                   value.alias("value"), address.alias("address"), valid.alias("valid"))
    return pushdown_barrier(out)


def _order(*cols: str) -> list[Column]:
    return [F.col(c) for c in cols]


def policy_changes(parsed: DataFrame) -> DataFrame:
    """(ts, seq, single_limit, daily_limit) of the valid ``set`` commands; the limit that a
    command leaves alone is NULL.  A change applies to payments at or after its time."""
    return parsed.where(F.col("kind").isin("set_daily", "set_limit") & F.col("valid")).select(
        "ts", "seq", F.when(F.col("kind") == "set_limit", F.col("value")).alias("single_limit"),
        F.when(F.col("kind") == "set_daily", F.col("value")).alias("daily_limit"))


def policy_state(parsed: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """One row: the limits in force at the end."""
    at = F.struct("ts", "seq")
    return policy_changes(parsed).agg(*[
        F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), at)), F.lit(d)).alias(c)
        for c, d in (("single_limit", params.single_limit), ("daily_limit", params.daily_limit))])


def with_limits(rows: DataFrame, parsed: DataFrame, ts: str = "ts", params: PolicyParams = PolicyParams()) -> DataFrame:
    """Rows with the limits in force at their time."""
    d = asof_changes(rows, policy_changes(parsed), ts, "seq", last=["single_limit", "daily_limit"])
    return d.withColumns({"single_limit": F.coalesce("single_limit", F.lit(params.single_limit)),
                          "daily_limit": F.coalesce("daily_limit", F.lit(params.daily_limit))})


def allowlist_changes(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("kind").isin("allowlist_add", "allowlist_remove") & F.col("valid")) \
        .select("ts", "seq", "address", (F.col("kind") == "allowlist_add").alias("present"))


STATE_KINDS = ("set_daily", "set_limit", "reset_daily", "allowlist_add", "allowlist_remove")


def state_changes(parsed: DataFrame) -> DataFrame:
    """Every valid change of the operator's state, written once: ``ts, seq, single_limit, daily_limit, segment, address, present, list_size``.

    One row a command: a limit that it sets, a counter segment that it opens, an
    address that it lists or takes off, and by how much it changes the number
    of listed addresses.
    """
    ch = parsed.where(F.col("kind").isin(*STATE_KINDS) & F.col("valid"))
    kind = F.col("kind")
    none = F.lit(None)
    keyless = ch.where(~kind.startswith("allowlist")).select(
        "ts", "seq", F.when(kind == "set_limit", F.col("value")).alias("single_limit"), F.when(kind == "set_daily", F.col("value")).alias("daily_limit"),
        F.when(kind == "reset_daily", F.lit(1).cast("bigint")).alias("segment"), none.cast("string").alias("address"), none.cast("boolean").alias("present"),
        none.cast("bigint").alias("list_size"))
    listed = neighbors(allowlist_changes(parsed), ["address"], "ts", ["ts", "seq"], ["present"], write=False)
    was = F.coalesce(F.col("_prev")["present"], F.lit(False))
    delta = F.when(F.col("present") & ~was, 1).when(~F.col("present") & was, -1).otherwise(0).cast("bigint")
    return materialized(keyless.unionByName(listed.select("ts", "seq", "address", "present", delta.alias("list_size")), True), "state-changes")


def with_state(rows: DataFrame, parsed: DataFrame, address: str, ts: str = "ts", params: PolicyParams = PolicyParams()) -> DataFrame:
    """Rows with everything that is in force at their time: limits, counter ``segment``, ``list_size``, and whether their ``address`` is ``listed``."""
    return with_changes(rows, state_changes(parsed), address, ts, params)


def with_changes(rows: DataFrame, changes: DataFrame, address: str, ts: str = "ts", params: PolicyParams = PolicyParams()) -> DataFrame:
    d = asof_joint(rows.withColumn("_address", F.lower(address)), changes, ts, "seq", last=["single_limit", "daily_limit"], sums=["segment", "list_size"],
                   key=("_address", "address"), keyed=["present"])
    return d.withColumns({"single_limit": F.coalesce("single_limit", F.lit(params.single_limit)),
                          "daily_limit": F.coalesce("daily_limit", F.lit(params.daily_limit)),
                          "listed": F.coalesce("present", F.lit(False))}).drop("_address", "present")


def with_allowlist(rows: DataFrame, parsed: DataFrame, address: str, ts: str = "ts") -> DataFrame:
    """Rows with ``list_size`` and whether their ``address`` is ``listed`` at their time."""
    return with_state(rows, parsed, address, ts).drop("single_limit", "daily_limit", "segment")


def payment_replay(tx: DataFrame, parsed: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Payments judged under all that is in force at their time: ``spend_before`` since the day's last reset, and ``violations``."""
    d = with_state(tx.withColumn("day", F.to_date("ts")), parsed, "to_addr", "ts", params)
    d = running_sum(d, ["account", "day", "segment"], "ts", "tx_id", "amount_usd", "spend_before")
    return d.withColumn("violations", violations(F.col("amount_usd"), F.col("spend_before"), F.col("to_addr"), F.col("single_limit"), F.col("daily_limit"),
                                                 F.col("list_size") > 0, F.col("listed")))


def policy_snapshot(tx: DataFrame, parsed: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Per account: the limits and the list's size at the end, and what its last active day has spent since the last reset."""
    limits = policy_state(parsed, params)
    listed = allowlist_state(parsed).select(F.count("*")).scalar()
    reset = reset_changes(parsed).select(F.max("ts")).scalar()
    counted = F.when(reset.isNull() | (F.col("ts") >= reset), F.col("amount_usd")).otherwise(F.lit(0)).cast("decimal(18,2)")
    days = tx.groupBy("account", F.to_date("ts").alias("day")).agg(F.sum(counted).alias("spend"))
    spend = days.groupBy("account").agg(F.max("day").alias("last_day"), F.max_by("spend", "day").alias("spend_last_day"))
    return spend.select("account", "last_day", "spend_last_day", limits.select("single_limit").scalar().alias("single_limit"),
                        limits.select("daily_limit").scalar().alias("daily_limit"), listed.cast("bigint").alias("allowlist_size"))


def allowlist_state(parsed: DataFrame) -> DataFrame:
    """Final allowlist: addresses whose last action is ``add`` (max_by over (ts, seq))."""
    ev = allowlist_changes(parsed)
    last = ev.groupBy("address").agg(F.max_by("present", F.struct("ts", "seq")).alias("present"))
    return last.where("present").select("address")


def allowlist_show(parsed: DataFrame) -> DataFrame:
    """The final allowlist in ascending order, one line an address, numbered from 1.

    The sort is Spark's; places are offsets of its range partitions, so the list
    is in no single task.
    """
    listed = allowlist_state(parsed).repartitionByRange(F.col("address")).sortWithinPartitions("address").select(
        "address", F.spark_partition_id().alias("_part"))
    sizes = listed.groupBy("_part").agg(F.count("*").alias("_size"), F.min("address").alias("_least"))
    before = Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("address")
    return listed.join(offsets, "_part").select((F.col("_before") + F.row_number().over(inside)).cast("bigint").alias("place"),
                                                "address", F.concat(F.lit("  • "), "address").alias("line"))


def reset_changes(parsed: DataFrame) -> DataFrame:
    """(ts, seq, segment): each ``reset daily`` opens the next segment of the counter."""
    return parsed.where(F.col("kind") == "reset_daily").select("ts", "seq", F.lit(1).cast("bigint").alias("segment"))


def policy_checks(parsed: DataFrame, tx: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Answers to the ``check-policy <usd> [address]`` commands.

    A check is held against the limits and the allowlist at its time and the
    spend so far: the payments of its UTC day since the last reset, up to and
    including its time.  A command whose amount isn't a number gets no check.
    """
    asked = parsed.where((F.col("kind") == "check_policy") & F.col("valid")).select(
        "session_id", "seq", "ts", F.col("value").alias("amount"), F.coalesce("address", F.lit("")).alias("to_address"))
    resets = reset_changes(parsed)
    d = with_state(asked, parsed, "to_address", "ts", params).withColumn("day", F.to_date("ts"))
    d = materialized(d, "checks")
    spent = asof_changes(tx.select("tx_id", "ts", "amount_usd"), resets, "ts", "seq", sums=["segment"]).select(
        "ts", F.col("tx_id"), F.to_date("ts").alias("_tx_day"), F.col("segment").alias("_tx_segment"), F.col("amount_usd").alias("spend_so_far"))
    d = asof_changes(d, spent, "ts", "tx_id", keys=[("day", "_tx_day"), ("segment", "_tx_segment")], sums=["spend_so_far"])
    v = violations(F.col("amount"), F.col("spend_so_far"), F.col("to_address"), F.col("single_limit"), F.col("daily_limit"),
                   F.col("list_size") > 0, F.col("listed"))
    return d.select("session_id", "seq", "amount", "to_address", "spend_so_far", v.alias("violations"))


def gate_outcomes(verdicts: DataFrame, parsed: DataFrame) -> DataFrame:
    """One-slot confirmation gate per session.

    Events: MALICIOUS scans (kind 0) and confirm/cancel commands (kind 1) ordered by
    (ts, seq, kind).  A scan is CONFIRMED / CANCELLED by the next event when that is a
    confirm / cancel, SUPERSEDED when it is another malicious scan, else PENDING.
    A confirm/cancel resolves the previous event when that is a scan, else it finds
    nothing pending.  (Non-malicious scans neither set nor clear the slot.)
    """
    return gate_decisions(gate_events(verdicts, parsed))


def gate_events(verdicts: DataFrame, parsed: DataFrame) -> DataFrame:
    """The gate's events: ``session_id, seq, ts, kind`` (0 scan, 1 command), ``msg_id, cmd``."""
    scans = verdicts.where("requires_confirmation").select(
        "session_id", "seq", "ts", F.lit(0).alias("kind"), F.col("msg_id"), F.lit(None).cast("string").alias("cmd"))
    return scans.unionByName(parsed.where(F.col("kind").isin("confirm", "cancel")).select(
        "session_id", "seq", "ts", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("msg_id"),
        F.col("kind").alias("cmd")))


def gate_decisions(ev: DataFrame) -> DataFrame:
    """The outcome of every event of ``gate_events``."""
    # lead/lag per session without a session-wide window (skew-safe, see plans.strategy.neighbors)
    e = neighbors(ev, ["session_id"], "ts", ["ts", "seq", "kind"], ["kind", "cmd", "ts", "msg_id"])
    e = e.select("*", F.col("_next")["kind"].alias("nk"), F.col("_next")["cmd"].alias("nc"),
                 F.col("_next")["ts"].alias("nts"), F.col("_prev")["kind"].alias("pk"),
                 F.col("_prev")["msg_id"].alias("pm"))
    is_scan = F.col("kind") == 0
    scan_outcome = (F.when(F.col("nk").isNull(), "PENDING").when(F.col("nk") == 0, "SUPERSEDED")
                    .when(F.col("nc") == "confirm", "CONFIRMED").otherwise("CANCELLED"))
    cmd_outcome = (F.when(F.col("pk").isNull() | (F.col("pk") != 0), F.lit("NOTHING_PENDING"))
                   .when(F.col("cmd") == "confirm", F.lit("CONFIRMED")).otherwise(F.lit("CANCELLED")))
    # one pass over the events: both outcome kinds come from the same row set
    return e.select(
        "session_id",
        F.when(is_scan, F.col("msg_id")).when(F.col("pk") == 0, F.col("pm")).alias("msg_id"),
        "seq", "ts",
        F.when(is_scan, scan_outcome).otherwise(cmd_outcome).alias("outcome"),
        F.when(is_scan, F.when(F.col("nk") == 1, F.col("nts"))).otherwise(F.col("ts")).alias("decided_ts"),
        F.when(is_scan, F.lit("scan")).otherwise(F.lit("command")).alias("event"))
