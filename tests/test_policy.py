"""Spend policy, precheck, command replay, gate."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripwire.operators import commands as C
from tripwire.operators.policy import daily_accepted_spend, violations
from tripwire.operators.precheck import precheck
from tripwire.plans.strategy import running_sum
from tripwire.sources import tables

from paths import SF0001


def test_policy_cases(spark):
    cases = [(100.0, 0.0, []), (600.0, 0.0, ["SINGLE_TX_LIMIT"]), (100.0, 1950.0, ["DAILY_LIMIT"]),
             (800.0, 1800.0, ["SINGLE_TX_LIMIT", "DAILY_LIMIT"]), (500.0, 0.0, []), (0.0, 0.0, []),
             (float("nan"), 0.0, ["INVALID_AMOUNT"]), (-5.0, 0.0, [])]
    df = spark.createDataFrame([(a, d) for a, d, _ in cases], "a double, d double")
    v = df.select(violations(F.col("a"), F.col("d"), F.lit(""), F.lit(500.0), F.lit(2000.0)).alias("v")).collect()
    assert [[x.rule for x in r.v] for r in v] == [c[2] for c in cases]
    d = df.limit(1).select(violations(F.lit(600.0), F.lit(0.0), F.lit(""), F.lit(500.0), F.lit(2000.0)).alias("v"))
    assert d.first().v[0].detail == "$600.00 exceeds the single-transaction limit of $500.00."


def test_allowlist_rule(spark):
    df = spark.createDataFrame([("0xAbC0000000000000000000000000000000000001",), ("",)], "to string")
    v = df.select(violations(F.lit(1.0), F.lit(0.0), F.col("to"), F.lit(500.0), F.lit(2000.0),
                             F.lit(True), F.lit(False)).alias("v")).collect()
    assert v[0].v[0].detail.startswith("Recipient 0xAbC00000… is not in the approved allowlist.")
    assert v[1].v == []


def test_precheck(spark):
    a, b = "0x" + "a" * 40, "0x" + "b" * 40
    erc = "0xa9059cbb" + "0" * 24 + "c" * 40 + "0" * 63 + "5"
    rows = [(1, a, b, Decimal(10 ** 18), "0x", 1), (2, a, b, Decimal(0), erc, 1), (3, "0xA", b, Decimal(0), "0x", 1),
            (4, a, None, Decimal(0), "0x", 1), (5, "0x000000000000000000000000000000000000dEaD", a, Decimal(0), "0x", 1),
            (6, a, "0x" + "f" * 64, Decimal(0), "0xa9059cbb" + "0" * 64 + "f" * 64, 1)]
    df = spark.createDataFrame(rows, "tx_id long, to_addr string, from_addr string, value_wei decimal(38,0), "
                                     "data string, chain_id long")
    r = {x.tx_id: x for x in precheck(df).collect()}
    assert r[1].value_usd_est == 3000.0 and [f.split(" — ")[0] for f in r[1].policy_flags] == [
        "POLICY:SINGLE_TX_LIMIT", "POLICY:DAILY_LIMIT"]
    assert r[1].gas_estimate == 21000
    assert r[2].gas_estimate == 22104 and r[2].token_transfers[0].to == "0x" + "c" * 40
    assert r[2].token_transfers[0].amount == Decimal(5)
    assert r[3].error == "Invalid recipient address: '0xA'"
    assert r[4].error == "Missing required fields: from_"
    assert r[5].warnings == ["Sending to the burn/null address is irreversible."]
    assert r[6].error.startswith("Invalid sender address")


def test_uint256_limbs(spark):
    from tripwire.operators.precheck import uint256_decimal
    vals = [0, 1, 2 ** 64, 10 ** 38 - 1, 10 ** 38, 2 ** 128, 2 ** 256 - 1]
    df = spark.createDataFrame([(format(v, "064x"),) for v in vals], "h string")
    got = [r[0] for r in df.select(uint256_decimal(F.col("h"))).collect()]
    assert got == [Decimal(v) if v < 10 ** 38 else None for v in vals]


def test_running_sum_equals_window(spark):
    tx = tables.transactions(spark, SF0001).withColumn("day", F.to_date("ts"))
    a = running_sum(tx, ["account", "day"], "ts", "tx_id", "amount_usd", "s")
    w = Window.partitionBy("account", "day").orderBy("ts", "tx_id").rowsBetween(Window.unboundedPreceding, -1)
    b = tx.select("tx_id", F.coalesce(F.sum("amount_usd").over(w), F.lit(0)).alias("s"))
    assert sorted(a.select("tx_id", "s").collect()) == sorted(b.collect())


def test_accepted_fold(spark):
    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [(i, 7, t0 + dt.timedelta(minutes=i), Decimal(x)) for i, x in enumerate(["400", "600", "450", "450", "450",
                                                                                      "300", "100"])]
    df = spark.createDataFrame(rows, "tx_id long, account long, ts timestamp, amount_usd decimal(18,2)")
    got = sorted((r.tx_id, r.accepted) for r in daily_accepted_spend(df).collect())
    assert [a for _, a in got] == [True, False, True, True, True, False, True]


def test_command_parse_and_state(spark):
    t = dt.datetime(2024, 1, 1)
    cmds = ["/guard set daily $3,000", "SET limit 800", "/GUARD allowlist add 0x" + "a" * 40, "/guard set daily 0",
            "/guard allowlist add nope", "/guard allowlist remove 0x" + "b" * 40, "/guardconfirm", "frobnicate",
            "/guard set limit nan"]
    df = spark.createDataFrame([(-1, i, t + dt.timedelta(seconds=i), c) for i, c in enumerate(cmds)],
                               "session_id long, seq long, ts timestamp, command string")
    p = {r.seq: r for r in C.parse_commands(df).collect()}
    assert (p[0].kind, p[0].value, p[0].valid) == ("set_daily", 3000.0, True)
    assert (p[1].kind, p[1].value) == ("set_limit", 800.0)
    assert (p[2].kind, p[2].address, p[2].valid) == ("allowlist_add", "0x" + "a" * 40, True)
    assert (p[3].valid, p[4].valid) == (False, False)
    assert p[6].kind == "confirm" and p[7].kind == "unknown" and p[8].valid is False
    state = [r.address for r in C.allowlist_state(C.parse_commands(df)).collect()]
    assert state == ["0x" + "a" * 40]


def test_gate_outcomes(spark):
    t = dt.datetime(2024, 1, 1)
    v = spark.createDataFrame([(1, 5, 1, t + dt.timedelta(seconds=1), True), (2, 5, 3, t + dt.timedelta(seconds=3), True),
                               (3, 5, 6, t + dt.timedelta(seconds=6), True)],
                              "msg_id long, session_id long, seq long, ts timestamp, requires_confirmation boolean")
    log = spark.createDataFrame([(5, 4, t + dt.timedelta(seconds=4), "/guard confirm"),
                                 (5, 5, t + dt.timedelta(seconds=5), "cancel")],
                                "session_id long, seq long, ts timestamp, command string")
    g = {(r.event, r.seq): r.outcome for r in C.gate_outcomes(v, C.parse_commands(log)).collect()}
    assert g == {("scan", 1): "SUPERSEDED", ("scan", 3): "CONFIRMED", ("command", 4): "CONFIRMED",
                 ("command", 5): "NOTHING_PENDING", ("scan", 6): "PENDING"}


def test_neighbors_equals_lead_lag(spark):
    import random
    from tripwire.plans.strategy import neighbors
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rnd.randint(0, 3), i, t0 + dt.timedelta(seconds=rnd.randint(0, 400)), rnd.randint(0, 1))
            for i in range(600)]
    df = spark.createDataFrame(rows, "k long, seq long, ts timestamp, kind int")
    a = neighbors(df, ["k"], "ts", ["ts", "seq", "kind"], ["seq", "kind"], chunk_seconds=7)
    w = Window.partitionBy("k").orderBy("ts", "seq", "kind")
    v = F.struct("seq", "kind")
    b = df.select("*", F.lead(v).over(w).alias("_next"), F.lag(v).over(w).alias("_prev"))
    norm = lambda d: sorted((r.seq, tuple(r._next) if r._next else None, tuple(r._prev) if r._prev else None)  # noqa
                            for r in d.collect())
    assert norm(a) == norm(b)
