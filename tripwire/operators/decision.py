"""Request gate: scan -> spend policy -> local precheck -> allow (first block wins).

A request is a payment together with the latest chat message of the paying
account's session at or before it (as-of join on session = account).  It is
judged under the limits, the allowlist and the counter resets that are in force
at its time, in the policy step and in the precheck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwire.operators.commands import payment_replay
from tripwire.operators.precheck import precheck
from tripwire.params import PolicyParams
from tripwire.plans.strategy import asof_changes


def gate_decision(tx: DataFrame, verdicts: DataFrame, parsed: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """``tx_id``, ``msg_id`` (of the message that it is judged by) and ``decision`` of every payment."""
    messages = verdicts.select("session_id", "ts", "seq", F.struct("msg_id", "requires_confirmation").alias("message"))
    d = asof_changes(payment_replay(tx, parsed, params), messages, "ts", "seq", keys=[("account", "session_id")], last=["message"])
    d = d.select("*", "message.msg_id", "message.requires_confirmation", F.size("violations").alias("n_violations")).drop("message", "violations")
    p = precheck(d, params, single_limit=F.col("single_limit"), daily_limit=F.col("daily_limit"),
                 allowlist_active=F.col("list_size") > 0, in_allowlist=F.col("listed"))
    has_flags = F.coalesce(F.size("policy_flags"), F.lit(0)) > 0
    decision = (F.when(F.coalesce(F.col("requires_confirmation"), F.lit(False)), F.lit("BLOCK_CONFIRM"))
                .when(F.col("n_violations") > 0, F.lit("BLOCK_POLICY"))
                .when(has_flags, F.lit("BLOCK_DRYRUN"))
                .otherwise(F.lit("ALLOW")))
    return p.select("tx_id", "msg_id", decision.alias("decision"))
