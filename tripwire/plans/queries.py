"""Registered queries: one per operator of the inventory.

Every query reads the supplied tables (or views Spark derives from them) in
full; outputs are flat, aliased columns so they compare 1:1 with the SQL oracle.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.operators import commands as C
from tripwire.operators import detectors as D
from tripwire.operators import reports as R
from tripwire.operators.decode import auto_decode
from tripwire.operators.policy import daily_accepted_spend, daily_running_spend, violations, with_day
from tripwire.operators.precheck import precheck
from tripwire.operators.scan import findings_table, scan_messages, score_of, verdict_of
from tripwire.params import PolicyParams, ScanParams
from tripwire.plans.strategy import asof_changes, pushdown_barrier, running_sum
from tripwire.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _msgs(spark, sf):
    return S.messages(spark, sf)


def _base(spark, sf):
    m = _msgs(spark, sf)
    return m.select("msg_id", F.col("text").alias("_text"), F.col("user_initiated_transfer").alias("_uit"))


def _explode_findings(d: DataFrame, col: str) -> DataFrame:
    d = pushdown_barrier(d.select("msg_id", col))
    return d.select("msg_id", F.posexplode(col).alias("idx", "f")).select(
        "msg_id", "idx", F.col("f")["severity"].alias("severity"), F.col("f")["code"].alias("code"),
        F.col("f")["detail"].alias("detail"), F.col("f")["decoded"].alias("decoded"))


def _single_findings(d: DataFrame, col: str) -> DataFrame:
    d = pushdown_barrier(d.select("msg_id", col))
    f = F.col(col)
    return d.where(f.isNotNull()).select("msg_id", f["severity"].alias("severity"), f["code"].alias("code"),
                                         f["detail"].alias("detail"), f["decoded"].alias("decoded"))


def _long(d: DataFrame) -> DataFrame:
    """Detectors only run on inputs of at least the minimum length."""
    return d.where(F.length("_text") >= ScanParams().min_scan_length)


# ------------------------------------------------------------------ full scan
def _verdicts(spark, sf, with_text=False):
    m = _msgs(spark, sf)
    return scan_messages(m, keep=("msg_id", "session_id", "seq", "ts", "source"), with_text=with_text)


@query
def scan_verdicts(spark, sf):
    v = _verdicts(spark, sf)
    return v.select("msg_id", F.col("risk_score").cast("bigint").alias("risk_score"), "verdict",
                    "requires_confirmation", "decoded_payload", F.col("n_findings").cast("bigint").alias("n_findings"),
                    F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


@query
def scan_findings(spark, sf):
    t = findings_table(_verdicts(spark, sf))
    return t.select("msg_id", F.col("ord").cast("bigint").alias("ord"), "severity", "code", "detail", "decoded",
                    F.col("sev_rank").cast("bigint").alias("sev_rank"), F.col("weight").cast("bigint").alias("weight"))


@query
def document_verdicts(spark, sf):
    """Full scan of the raw ``documents`` corpus (the heavy text job)."""
    v = scan_messages(S.documents_as_messages(spark, sf), keep=("msg_id", "source"))
    return v.select(F.col("msg_id").alias("doc_id"), F.col("risk_score").cast("bigint").alias("risk_score"),
                    "verdict", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


@query
def risk_score(spark, sf):
    """Relational form: findings grouped per message, capped sum of weights."""
    t = findings_table(_verdicts(spark, sf))
    s = t.groupBy("msg_id").agg(F.least(F.lit(100), F.sum("weight")).cast("bigint").alias("risk_score"))
    return s.select("msg_id", "risk_score", verdict_of(F.col("risk_score")).alias("verdict"))


@query
def short_gate(spark, sf):
    m = _msgs(spark, sf)
    return m.where(F.length("text") < ScanParams().min_scan_length).select(
        "msg_id", F.length("text").cast("bigint").alias("n_chars"))


@query
def threat_rollup(spark, sf):
    v = _verdicts(spark, sf)
    return v.rollup("source", "verdict").agg(F.count("*").alias("n"), F.sum("risk_score").cast("bigint")
                                             .alias("total_score"))


@query
def threat_codes(spark, sf):
    t = findings_table(_verdicts(spark, sf))
    return t.groupBy("code", "severity").agg(F.count("*").alias("n_findings"),
                                             F.countDistinct("msg_id").alias("n_messages"))


@query
def threat_hourly(spark, sf):
    v = _verdicts(spark, sf)
    # UTC wall-clock timestamps (NTZ) so results do not depend on the client's time zone
    return v.groupBy(F.window("ts", "1 hour").start.cast("timestamp_ntz").alias("hour"), "verdict") \
        .agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ single detectors
@query
def detect_invisible(spark, sf):
    return _single_findings(D.add_invisible(_long(_base(spark, sf))), "_inv")


@query
def detect_zalgo(spark, sf):
    return _single_findings(D.add_zalgo(_long(_base(spark, sf))), "_zal")


@query
def detect_base64(spark, sf):
    return _explode_findings(D.add_base64(_long(_base(spark, sf))), "_b64")


@query
def base64_candidates(spark, sf):
    d = _base(spark, sf).select("msg_id", F.posexplode(D.base64_candidates(F.col("_text"))).alias("idx", "blob"))
    return d


@query
def decode_base64(spark, sf):
    d = D._stage(_base(spark, sf).select("msg_id", F.posexplode(D.base64_candidates(F.col("_text")))
                                         .alias("idx", "blob")), )
    from tripwire.functions import codecs
    return d.select("msg_id", "idx", "blob", codecs.b64_decode_printable(F.col("blob")).alias("decoded"))


@query
def detect_hex(spark, sf):
    """Both kinds from one pass: ``idx`` counts within a kind."""
    d = pushdown_barrier(D.add_hex(_long(_base(spark, sf))).select("msg_id", "_hx0", "_hxb"))
    both = F.concat(*[F.transform(c, lambda f, i: F.struct(i.alias("idx"), f["severity"].alias("severity"), f["code"].alias("code"),
                                                          f["detail"].alias("detail"), f["decoded"].alias("decoded"))) for c in ("_hx0", "_hxb")])
    return d.select("msg_id", F.inline(both))


@query
def hex_candidates(spark, sf):
    d = D._stage(_base(spark, sf), _c0=D.hex0x_candidates(F.col("_text")), _br=D.hex_bare_raw(F.col("_text")))
    d = D._stage(d, _cb=D.hex_bare_candidates(F.col("_br"), F.col("_c0")))

    def numbered(col, kind):
        return F.transform(col, lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"), h.alias("hex")))

    return d.select("msg_id", F.inline(F.concat(numbered("_c0", "0x"), numbered("_cb", "bare"))))


@query
def decode_hex(spark, sf):
    from tripwire.functions import codecs
    h = hex_candidates(spark, sf)
    return h.select("msg_id", "kind", "idx", "hex", codecs.hex_decode_printable(F.col("hex"), 3).alias("decoded"))


@query
def detect_morse(spark, sf):
    return _single_findings(D.add_morse(_long(_base(spark, sf))), "_mor")


@query
def detect_rot(spark, sf):
    return _single_findings(D.add_caesar(_long(_base(spark, sf))), "_cae")


@query
def rot_scores(spark, sf):
    d = pushdown_barrier(D.add_rot_profile(_base(spark, sf)).select("msg_id", "_rot_chis"))
    return d.where(F.col("_rot_chis").isNotNull()).select(
        "msg_id", F.posexplode("_rot_chis").alias("rot", "chi2")).select(
        "msg_id", F.col("rot").cast("bigint").alias("rot"), F.round("chi2", 6).alias("chi2"))


@query
def rot_decode(spark, sf):
    from tripwire.functions import codecs
    d = pushdown_barrier(D.add_caesar(_long(_base(spark, sf))).select("msg_id", "_cae_r", "_cae_cand"))
    return d.where(F.col("_cae_r").isNotNull()).select(
        "msg_id", F.col("_cae_r").cast("bigint").alias("rot"),
        codecs.rot_n(F.col("_cae_cand"), F.col("_cae_r")).alias("plaintext"),
        codecs.rot_n(codecs.rot_n(F.col("_cae_cand"), F.col("_cae_r")), 26 - F.col("_cae_r")).alias("roundtrip"))


@query
def detect_entropy(spark, sf):
    return _single_findings(D.add_entropy(_long(_base(spark, sf))), "_ent")


@query
def blob_entropy(spark, sf):
    from tripwire.functions import stats
    d = _base(spark, sf).select("msg_id", F.posexplode(D.entropy_blobs(F.col("_text"))).alias("idx", "blob"))
    return d.select("msg_id", "idx", F.round(stats.shannon_entropy(F.col("blob")), 6).alias("entropy"))


@query
def detect_keywords(spark, sf):
    return _single_findings(D.add_keywords(_long(_base(spark, sf))), "_kw")


@query
def keyword_hits(spark, sf):
    d = pushdown_barrier(D.add_keywords(_base(spark, sf)).select("msg_id", "_kw_h"))
    h = F.col("h")
    return d.select("msg_id", F.explode("_kw_h").alias("h")).select(
        "msg_id", h["pos"].cast("bigint").alias("pos"), h["label"].alias("label"), h["severity"].alias("severity"))


@query
def keyword_severity(spark, sf):
    d = pushdown_barrier(D.add_keywords(_base(spark, sf)).select("msg_id", "_kw", "_kw_h"))
    return d.where(F.size("_kw_h") > 0).select(
        "msg_id", F.col("_kw")["severity"].alias("top_severity"),
        F.size("_kw_h").cast("bigint").alias("n_patterns"))


@query
def detect_intent(spark, sf):
    return _single_findings(D.add_intent(_long(_base(spark, sf))), "_itn")


@query
def intent_signals(spark, sf):
    t = F.col("_text")
    return _base(spark, sf).select(
        "msg_id", t.rlike(D.FIN_JAVA).alias("has_action"), t.rlike(D.AMOUNT_JAVA).alias("has_amount"),
        t.rlike(D.URGENCY_JAVA).alias("has_urgency"), t.rlike(D.ADDR_JAVA).alias("has_address"))


@query
def first_payload(spark, sf):
    v = _verdicts(spark, sf)
    src = F.filter("findings", lambda f: f["decoded"] != "")
    return v.where(F.col("decoded_payload") != "").select(
        "msg_id", "decoded_payload", F.element_at(src, 1)["code"].alias("source_code"))


@query
def deep_rescan(spark, sf):
    """Keyword finding raised on the first decoded payload (when it differs from the text)."""
    v = _verdicts(spark, sf, with_text=True).select("msg_id", "text", "decoded_payload")
    p = F.col("decoded_payload")
    d = D.add_keywords(v, t="decoded_payload", out="_kw2", when=(p != "") & (p != F.col("text")))
    return _single_findings(d, "_kw2").select("msg_id", "severity", "detail")


@query
def auto_decode_q(spark, sf):
    return pushdown_barrier(auto_decode(_msgs(spark, sf))).where(F.col("encoding").isNotNull())


@query
def confirm_queue(spark, sf):
    return R.confirm_queue(_verdicts(spark, sf, with_text=True))


@query
def report_json(spark, sf):
    return R.report_json(_verdicts(spark, sf, with_text=True))


@query
def report_markdown(spark, sf):
    return R.report_markdown(_verdicts(spark, sf, with_text=True))


@query
def report_text(spark, sf):
    return R.report_text(_verdicts(spark, sf, with_text=True))


@query
def audit_events(spark, sf):
    return R.audit_events(_verdicts(spark, sf, with_text=True))


@query
def custom_pattern(spark, sf):
    """Registry extension: a registered keyword pattern joins the built-in list of the full scan."""
    from tripwire.operators.scan import register_pattern, unregister_pattern
    pattern = r"\bsend\s+me\s+your\b|\bstake\s+it\b"
    register_pattern(pattern, "custom exfiltration probe", "HIGH")
    try:
        t = findings_table(_verdicts(spark, sf))
    finally:
        unregister_pattern(pattern)
    return t.where((F.col("code") == "INJECTION_KEYWORD") & F.col("detail").contains("custom exfiltration probe")).select("msg_id", "severity", "detail")


def _pattern_table(spark, rows):
    from tripwire.operators.patterns import PATTERNS
    return spark.createDataFrame(rows, PATTERNS)


@query
def pattern_table_hits(spark, sf):
    """The built-in patterns as a table, through the index of the literals that they need."""
    from tripwire.constants import INJECTION_PATTERNS
    from tripwire.operators.patterns import pattern_table_hits as run
    patterns = _pattern_table(spark, [(i, *p) for i, p in enumerate(INJECTION_PATTERNS)])
    return run(_base(spark, sf), patterns, text_col="_text").where("error IS NULL").select("msg_id", "pos", "label", "severity")


@query
def pattern_table_documents(spark, sf):
    """A pattern of the first three words of each benchmark item, in all documents."""
    from tripwire.operators.patterns import pattern_table_hits as run
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    items = S.table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), words.alias("w")).where(F.size("w") >= 3)
    patterns = items.select("pos", F.concat(F.lit(r"\b"), F.array_join(F.slice("w", 1, 3), r"\W+"), F.lit(r"\b")).alias("pattern"),
                            F.concat(F.lit("item "), F.col("pos").cast("string")).alias("label"), F.lit("MEDIUM").alias("severity"))
    return run(S.table(spark, sf, "documents"), patterns, id_col="doc_id").where("error IS NULL").select("doc_id", "pos", "label")


# ------------------------------------------------------------------ transactions
def _tx(spark, sf):
    return S.transactions(spark, sf)


def _pre(spark, sf):
    return precheck(_tx(spark, sf))


@query
def tx_validate(spark, sf):
    return _pre(spark, sf).select("tx_id", "success", "error")


@query
def tx_value_usd(spark, sf):
    return _pre(spark, sf).where("success").select("tx_id", "value_eth", "value_usd_est")


@query
def tx_gas(spark, sf):
    return _pre(spark, sf).where("success").select("tx_id", "is_contract_call", "gas_estimate")


@query
def tx_flags(spark, sf):
    return _pre(spark, sf).where("success").select(
        "tx_id", F.array_join("policy_flags", " | ").alias("policy_flags"),
        F.array_join("warnings", " | ").alias("warnings"))


@query
def erc20_transfers(spark, sf):
    d = _pre(spark, sf).where("success").select("tx_id", F.explode("token_transfers").alias("t"))
    return d.select("tx_id", F.col("t")["to"].alias("erc20_to"), F.col("t")["amount_hex"].alias("amount_hex"),
                    F.col("t")["amount"].cast("string").alias("amount"))


@query
def tx_precheck(spark, sf):
    p = _pre(spark, sf)
    return p.select("tx_id", "success", "error", "value_eth", "value_usd_est", "gas_estimate", "is_contract_call",
                    F.size("token_transfers").cast("bigint").alias("n_transfers"),
                    F.array_join("policy_flags", " | ").alias("policy_flags"),
                    F.array_join("warnings", " | ").alias("warnings"))


@query
def policy_single(spark, sf):
    t = _tx(spark, sf)
    p = PolicyParams()
    v = violations(F.col("amount_usd"), F.lit(0.0), F.col("to_addr"), F.lit(p.single_limit), F.lit(p.daily_limit))
    return t.select("tx_id", v.alias("v")).select(
        "tx_id", F.array_join(F.transform("v", lambda x: x["rule"]), ",").alias("rules"),
        F.array_join(F.transform("v", lambda x: x["detail"]), " ").alias("details"))


@query
def daily_running_spend_q(spark, sf):
    d = daily_running_spend(_tx(spark, sf))
    return d.select("tx_id", "account", "day", "spend_before", "projected")


@query
def policy_daily(spark, sf):
    d = daily_running_spend(_tx(spark, sf))
    return d.select("tx_id", F.array_join(F.transform("violations", lambda x: x["rule"]), ",").alias("rules"),
                    F.array_join(F.transform("violations", lambda x: x["detail"]), " ").alias("details"))


@query
def daily_accepted_spend_q(spark, sf):
    return daily_accepted_spend(_tx(spark, sf)).select("tx_id", "account", "day", "accepted_before", "accepted")


def _parsed(spark, sf):
    return C.parse_commands(S.command_log(spark, sf))


@query
def command_parse(spark, sf):
    return _parsed(spark, sf).select("session_id", "seq", "kind", "value", "address", "valid")


@query
def spend_with_reset(spark, sf):
    tx = asof_changes(with_day(_tx(spark, sf)), C.reset_changes(_parsed(spark, sf)), "ts", "seq", sums=["segment"])
    d = running_sum(tx, ["account", "day", "segment"], "ts", "tx_id", "amount_usd", "spend_before")
    return d.select("tx_id", F.col("segment").cast("bigint").alias("segment"), "spend_before")


@query
def policy_asof(spark, sf):
    tx = C.with_limits(with_day(_tx(spark, sf)), _parsed(spark, sf))
    d = running_sum(tx, ["account", "day"], "ts", "tx_id", "amount_usd", "spend_before")
    v = violations(F.col("amount_usd"), F.col("spend_before"), F.col("to_addr"), F.col("single_limit"),
                   F.col("daily_limit"))
    return d.select("tx_id", "single_limit", "daily_limit",
                    F.array_join(F.transform(v, lambda x: x["rule"]), ",").alias("rules"))


@query
def allowlist_asof(spark, sf):
    d = C.with_allowlist(_tx(spark, sf).select("tx_id", "ts", "to_addr"), _parsed(spark, sf), "to_addr")
    p = PolicyParams()
    v = violations(F.lit(0.0), F.lit(0.0), F.col("to_addr"), F.lit(p.single_limit), F.lit(p.daily_limit),
                   F.col("list_size") > 0, F.col("listed"))
    return d.select("tx_id", F.col("list_size").cast("bigint").alias("list_size"), "listed",
                    F.array_join(F.transform(v, lambda x: x["detail"]), " ").alias("details"))


@query
def command_policy_check(spark, sf):
    """Answers to the operator's check-policy commands."""
    d = C.policy_checks(_parsed(spark, sf), _tx(spark, sf))
    return d.select("seq", "amount", "to_address", "spend_so_far",
                    F.array_join(F.transform("violations", lambda x: x["rule"]), ",").alias("rules"),
                    F.array_join(F.transform("violations", lambda x: x["detail"]), " ").alias("details"))


@query
def command_scan(spark, sf):
    """Scan commands of the log: their words, single-spaced, through the full scan."""
    asked = _parsed(spark, sf).where((F.col("kind") == "scan") & (F.col("args") != "")).select(
        F.col("seq").alias("msg_id"), F.col("args").alias("text"), F.lit(False).alias("user_initiated_transfer"))
    v = scan_messages(asked, keep=("msg_id",), with_text=True)
    return v.select(F.col("msg_id").alias("seq"), "text", F.col("risk_score").cast("bigint").alias("risk_score"), "verdict")


@query
def allowlist_show(spark, sf):
    """The final allowlist in ascending order, as it is shown."""
    return C.allowlist_show(_parsed(spark, sf))


@query
def allowlist_state(spark, sf):
    return C.allowlist_state(_parsed(spark, sf))


@query
def allowlist_violation(spark, sf):
    """Payments whose recipient is not on the final allowlist (anti-join), when it is non-empty."""
    tx = _tx(spark, sf).where(F.coalesce(F.col("to_addr"), F.lit("")) != "")
    al = C.allowlist_state(_parsed(spark, sf))
    bad = tx.join(al, F.lower(tx["to_addr"]) == al["address"], "left_anti")
    nonempty = al.select(F.count("*")).scalar() > 0
    return bad.where(nonempty).select("tx_id", "to_addr")


@query
def policy_snapshot(spark, sf):
    """Per account: limits in force at the end, spend of its last active day since the last reset, allowlist size."""
    return C.policy_snapshot(_tx(spark, sf), _parsed(spark, sf))


def _rules_and_details(d: DataFrame, *columns: str) -> DataFrame:
    return d.select(*columns, F.array_join(F.transform("violations", lambda x: x["rule"]), ",").alias("rules"),
                    F.array_join(F.transform("violations", lambda x: x["detail"]), " ").alias("details"))


@query
def payment_replay(spark, sf):
    """Every payment under the limits, the allowlist and the counter resets in force at its time, together."""
    d = C.payment_replay(_tx(spark, sf), _parsed(spark, sf))
    return _rules_and_details(d, "tx_id", "single_limit", "daily_limit", "list_size", "listed", "segment", "spend_before")


@query
def tx_precheck_replay(spark, sf):
    """The dry run of every payment under the limits and the allowlist in force at its time (its daily total is 0)."""
    d = C.with_state(_tx(spark, sf), _parsed(spark, sf), "to_addr")
    p = precheck(d, single_limit=F.col("single_limit"), daily_limit=F.col("daily_limit"), allowlist_active=F.col("list_size") > 0, in_allowlist=F.col("listed"))
    return p.select("tx_id", "success", F.array_join("policy_flags", " | ").alias("policy_flags"), F.array_join("warnings", " | ").alias("warnings"))


@query
def gate_outcomes(spark, sf):
    v = _verdicts(spark, sf)
    g = C.gate_outcomes(v, _parsed(spark, sf))
    return g.select("session_id", "msg_id", "seq", "event", "outcome",
                    F.col("decided_ts").cast("timestamp_ntz").alias("decided_ts"))


# registry names without the helper suffix
for _old, _new in [("daily_running_spend_q", "daily_running_spend"), ("daily_accepted_spend_q", "daily_accepted_spend"),
                   ("auto_decode_q", "auto_decode")]:
    QUERIES[_new] = QUERIES.pop(_old)


# ------------------------------------------------------------------ streaming
@query
def stream_scan(spark, sf):
    """File stream of conversation turns through the scan (append sink), read back."""
    from tripwire.streaming.jobs import stream_scan as run
    return run(spark, sf)


@query
def stream_daily_spend(spark, sf):
    """Payments stream in event-time order; equals the batch accepted-spend fold of the payments that weren't late."""
    from tripwire.streaming.jobs import stream_daily_spend as run
    return run(spark, sf)


@query
def stream_late(spark, sf):
    """Late side table of the payments stream."""
    from tripwire.streaming.jobs import stream_late as run
    return run(spark, sf)


@query
def stream_gate(spark, sf):
    """Confirmation gate over the message stream (final decisions only)."""
    from tripwire.streaming.jobs import stream_gate as run
    g = run(spark, sf)
    return g.select(*[c for c in g.columns if c != "decided_ts"],
                    F.col("decided_ts").cast("timestamp_ntz").alias("decided_ts"))


@query
def stream_threat_hourly(spark, sf):
    """Threat roll-up of the message stream in one-hour windows, each emitted when the watermark has passed it."""
    from tripwire.streaming.jobs import stream_threat_hourly as run
    h = run(spark, sf)
    return h.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "verdict", "n")


@query
def stream_policy(spark, sf):
    """Payments stream with the limits and the allowlist in force at each payment; the command log is a second stream."""
    from tripwire.streaming.jobs import stream_policy as run
    return run(spark, sf)


@query
def gate_decision(spark, sf):
    """Scan -> policy -> precheck -> allow, one decision per payment request, under all that is in force at its time."""
    from tripwire.operators.decision import gate_decision as run
    return run(_tx(spark, sf), _verdicts(spark, sf), _parsed(spark, sf))


@query
def custom_detector(spark, sf):
    """Full scan with a user detector (pandas UDF) plugged in after the built-in ones."""
    from tripwire.operators.custom import custom_detector as det
    v = scan_messages(_msgs(spark, sf), keep=("msg_id",), extra_detectors=[det])
    return v.select("msg_id", F.col("risk_score").cast("bigint").alias("risk_score"), "verdict",
                    "requires_confirmation", "decoded_payload", F.col("n_findings").cast("bigint").alias("n_findings"),
                    F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


def _audit_log(spark, sf, v: DataFrame) -> DataFrame:
    lit_null = F.lit(None).cast("string")
    scan = R.audit_events(v).select(
        F.col("msg_id").alias("ref_id"), F.lit("scan").alias("source"), "event", "code", "level", "severity")
    parsed = _parsed(spark, sf)
    allow = parsed.where(F.col("kind").isin("allowlist_add", "allowlist_remove") & F.col("valid")).select(
        F.col("seq").alias("ref_id"), F.lit("command").alias("source"), F.lit("allowlist").alias("event"),
        F.when(F.col("kind") == "allowlist_add", "ALLOWLIST_ADD").otherwise("ALLOWLIST_REMOVE").alias("code"),
        F.lit("INFO").alias("level"), lit_null.alias("severity"))
    g = C.gate_outcomes(v, parsed)
    gate = g.where((F.col("event") == "command") & F.col("outcome").isin("CONFIRMED", "CANCELLED")).select(
        F.col("seq").alias("ref_id"), F.lit("command").alias("source"), F.lit("gate").alias("event"),
        F.when(F.col("outcome") == "CONFIRMED", "HUMAN_CONFIRMED").otherwise("HUMAN_CANCELLED").alias("code"),
        F.when(F.col("outcome") == "CONFIRMED", "WARNING").otherwise("INFO").alias("level"), lit_null.alias("severity"))
    flagged = F.size("policy_flags") > 0
    dry = _pre(spark, sf).where("success").select(
        F.col("tx_id").alias("ref_id"), F.lit("payment").alias("source"), F.lit("dry_run").alias("event"),
        F.when(flagged, "DRY_RUN_FLAGS").otherwise("DRY_RUN").alias("code"),
        F.when(flagged, "WARNING").otherwise("INFO").alias("level"), lit_null.alias("severity"))
    return scan.unionByName(allow).unionByName(gate).unionByName(dry)


@query
def audit_log(spark, sf):
    """Operator audit: scan events, allowlist changes, human confirm/cancel, dry-run results."""
    from tripwire.plans.strategy import materialized
    # the scan's events and the gate both need the verdicts: they are written once, without texts and details, which no event holds
    codes = F.transform("findings", lambda f: F.struct(f["severity"].alias("severity"), f["code"].alias("code")))
    v = _verdicts(spark, sf).select("msg_id", "session_id", "seq", "ts", "risk_score", "verdict", "requires_confirmation", codes.alias("findings"))
    return _audit_log(spark, sf, materialized(v, "verdicts").withColumn("text", F.lit(None).cast("string")))


def _twice(spark, name: str, write):
    """What is read back of a sink after a run was written twice, and another one between."""
    from uuid import uuid4

    from tripwire.operators.sinks import read_runs
    from tripwire.session import scratch_path
    path = scratch_path(spark, f"{name}-{uuid4().hex}")
    write(path, "today", True)
    write(path, "yesterday", False)
    schema = write(path, "today", True)
    back = read_runs(spark, path, schema, "json" if name == "reports" else "parquet")
    return back.where("run_id = 'today'").drop("run_id")


def _written_verdicts(spark, sf) -> DataFrame:
    from tripwire.plans.strategy import materialized
    return materialized(_verdicts(spark, sf, with_text=True), "verdicts")


@query
def sink_findings(spark, sf):
    """The findings sink, a run written twice beside another, read back."""
    from tripwire.operators.sinks import findings_run
    v = _written_verdicts(spark, sf)
    t = _twice(spark, "findings", lambda path, run, whole: findings_run(v if whole else v.where("risk_score >= 60"), path, run))
    return t.select("msg_id", F.col("ord").cast("bigint").alias("ord"), "severity", "code", "detail", "decoded",
                    F.col("sev_rank").cast("bigint").alias("sev_rank"), F.col("weight").cast("bigint").alias("weight"))


@query
def sink_verdicts(spark, sf):
    """The verdicts sink, a run written twice beside another, read back."""
    from tripwire.operators.sinks import verdicts_run
    v = _written_verdicts(spark, sf)
    t = _twice(spark, "verdicts", lambda path, run, whole: verdicts_run(v if whole else v.where("risk_score >= 60"), path, run))
    return t.select("msg_id", F.col("risk_score").cast("bigint").alias("risk_score"), "verdict", "requires_confirmation", "decoded_payload",
                    F.col("n_findings").cast("bigint").alias("n_findings"))


@query
def sink_audit(spark, sf):
    """The append-only audit log, a run written twice beside another, read back."""
    from tripwire.operators.sinks import audit_run
    from tripwire.plans.strategy import materialized
    events = materialized(_audit_log(spark, sf, _written_verdicts(spark, sf)), "audit")
    return _twice(spark, "audit", lambda path, run, whole: audit_run(events if whole else events.where("level = 'WARNING'"), path, run))


@query
def sink_reports(spark, sf):
    """The JSON report files, a run written twice beside another, read back as they are reported."""
    from tripwire.operators.sinks import reports_run
    v = _written_verdicts(spark, sf)
    t = _twice(spark, "reports", lambda path, run, whole: reports_run(v if whole else v.where("risk_score >= 60"), path, run))
    return t.select("msg_id", F.to_json(F.struct("input_preview", "risk_score", "verdict", "decoded_payload", "findings")).alias("report_json"))


@query
def policy_check(spark, sf):
    """Full policy rule per payment: single limit, daily total (earlier attempts that day),
    and the allowlist in force at payment time - all violations, in that order."""
    tx = with_day(_tx(spark, sf))
    parsed = _parsed(spark, sf)
    d = running_sum(C.with_allowlist(tx, parsed, "to_addr"), ["account", "day"], "ts", "tx_id", "amount_usd", "spend_before")
    p = PolicyParams()
    v = violations(F.col("amount_usd"), F.col("spend_before"), F.col("to_addr"), F.lit(p.single_limit),
                   F.lit(p.daily_limit), F.col("list_size") > 0, F.col("listed"))
    return d.select("tx_id", F.array_join(F.transform(v, lambda x: x["rule"]), ",").alias("rules"),
                    F.array_join(F.transform(v, lambda x: x["detail"]), " ").alias("details"))


@query
def scan_errors(spark, sf):
    """INFO findings: inputs that were not fully scanned (too short, or NULL text)."""
    t = findings_table(_verdicts(spark, sf))
    return t.where(F.col("severity") == "INFO").select("msg_id", "code", "detail")
