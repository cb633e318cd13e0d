"""Report sinks over the verdicts table: JSON, Markdown, plain text, the
confirmation queue and the audit log.  All are per-row string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.functions.text import cut, cut_ellipsis
from tripwire.operators.policy import COMMAND_PREFIX
from tripwire.operators.scan import severity_rank

VERSION = "1.0.0"

# ---------------------------------------------------------------------------
# Report symbols
# ---------------------------------------------------------------------------
SEV_EMOJI = {"CRITICAL": "🚨", "HIGH": "🔴", "MEDIUM": "🟡", "LOW": "🟢", "INFO": "ℹ️ "}
VERDICT_EMOJI = {"CLEAN": "✅", "SUSPICIOUS": "⚠️ ", "MALICIOUS": "🚫"}
ADVICE = {"MALICIOUS": "⛔ Do NOT execute this input. Malicious content confirmed.",
          "SUSPICIOUS": "⚠️  Review findings carefully before proceeding.",
          "CLEAN": "✅ Input appears safe to process."}
SEP = "━" * 44
RULE = "─" * 44

# audit level per finding code / decision (log pipelines filter on it)
AUDIT_LEVEL = {"INVISIBLE_UNICODE": "WARNING", "ZALGO_COMBINING": "WARNING", "INJECTION_KEYWORD": "WARNING",
               "UNVERIFIED_INTENT": "WARNING", "BASE64_PAYLOAD": "INFO", "HEX_PAYLOAD": "INFO", "HEX_BLOB": "INFO",
               "MORSE_ENCODING": "INFO", "ROT13_OBFUSCATION": "INFO", "CAESAR_CIPHER": "INFO",
               "HIGH_ENTROPY_BLOB": "INFO", "TOO_SHORT": "DEBUG", "SCAN_ERROR": "ERROR"}


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _shown() -> Column:
    """The scanned text as reports show it: nothing for a NULL text."""
    return F.coalesce(F.col("text"), F.lit(""))


def report_json(v: DataFrame, keep=("msg_id",)) -> DataFrame:
    """``to_json`` of (input_preview[:200], risk_score, verdict, decoded_payload, findings)."""
    fs = F.transform("findings", lambda f: F.struct(f["severity"].alias("severity"), f["code"].alias("code"),
                                                    f["detail"].alias("detail"), f["decoded"].alias("decoded")))
    body = F.struct(cut(_shown(), 200).alias("input_preview"), "risk_score", "verdict", "decoded_payload",
                    fs.alias("findings"))
    return v.select(*keep, F.to_json(body).alias("report_json"))


def report_markdown(v: DataFrame, keep=("msg_id",)) -> DataFrame:
    rows = F.transform("findings", lambda f: F.concat(
        F.lit("| "), f["severity"], F.lit(" | `"), f["code"], F.lit("` | "),
        cut(F.replace(f["detail"], F.lit("|"), F.lit("\\|")), 120), F.lit(" |")))
    findings = F.when(F.size("findings") > 0, F.concat(
        F.array(F.lit("### Findings"), F.lit(""), F.lit("| Severity | Code | Detail |"), F.lit("|---|---|---|")),
        rows)).otherwise(F.array(F.lit("_No threats detected._")))
    payload = F.when(F.col("decoded_payload") != "", F.array(
        F.lit(""), F.lit("### Decoded Payload"),
        F.concat(F.lit("```\n"), cut(F.col("decoded_payload"), 500), F.lit("\n```")))
    ).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit("## 🛡️ Tripwire Security Scan Report"), F.lit(""),
                   F.concat(F.lit("**Risk Score:** "), F.col("risk_score").cast("string"), F.lit("/100  ")),
                   F.concat(F.lit("**Verdict:** "), F.col("verdict"), F.lit("  ")),
                   F.concat(F.lit("**Input preview:** `"), cut(_shown(), 100), F.lit("`")), F.lit(""))
    return v.select(*keep, F.array_join(F.concat(head, findings, payload), "\n").alias("report_markdown"))


def sorted_findings(findings: Column) -> Column:
    """Stable sort by severity (ties keep detection order)."""
    keyed = F.transform(findings, lambda f: F.struct(severity_rank(f["severity"]).alias("r"), f["ord"].alias("o"),
                                                     f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def report_text(v: DataFrame, keep=("msg_id",), pending_confirm: bool = False) -> DataFrame:
    text = _shown()
    preview = F.concat(F.replace(cut(text, 80), F.lit("\n"), F.lit(" ")),
                       F.when(F.length(text) > 80, F.lit("…")).otherwise(F.lit("")))
    d = v.select("*", sorted_findings(F.col("findings")).alias("_sf"))
    sf = F.col("_sf")
    sev_emoji = _map(SEV_EMOJI)
    flines = F.when(F.size(sf) > 0, F.concat(F.array(F.lit(""), F.lit("FINDINGS")), F.transform(
        sf, lambda f: F.concat(F.lit("  ["), f["severity"], F.lit("] "),
                               F.coalesce(F.element_at(sev_emoji, f["severity"]), F.lit("")), F.lit(" "),
                               f["detail"])))).otherwise(F.array(F.lit(""), F.lit("  No threats detected.")))
    payload = F.when(F.col("decoded_payload") != "", F.array(
        F.lit(""), F.lit("DECODED PAYLOAD"), F.concat(F.lit("  "), cut_ellipsis(F.col("decoded_payload"), 200)))
    ).otherwise(F.array().cast("array<string>"))
    codes = F.array_join(F.slice(F.transform(F.filter(sf, lambda f: f["severity"].isin("CRITICAL", "HIGH")),
                                             lambda f: f["code"]), 1, 4), ", ")
    codes = F.when(codes == "", F.lit("see findings above")).otherwise(codes)
    show_confirm = F.lit(pending_confirm) | F.col("requires_confirmation")
    confirm = F.when(show_confirm, F.array(
        F.lit(""), F.lit(RULE), F.lit("🔐 HUMAN CONFIRMATION REQUIRED"), F.lit(RULE),
        F.lit("  A malicious payload has been detected."), F.lit("  No action has been taken yet."), F.lit(""),
        F.concat(F.lit("  Risk Score  : "), F.col("risk_score").cast("string"), F.lit("/100")),
        F.concat(F.lit("  Detections  : "), codes), F.lit(""),
        F.lit("  ⚠️  Proceeding means you accept full responsibility."), F.lit(""),
        F.lit(f"  ✅  {COMMAND_PREFIX} confirm   — override and proceed"),
        F.lit(f"  ❌  {COMMAND_PREFIX} cancel    — abort (recommended)"))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit(SEP), F.lit("🛡️  TRIPWIRE SECURITY SCAN  v" + VERSION), F.lit(SEP),
                   F.concat(F.lit("Input   : "), preview),
                   F.concat(F.lit("Score   : "), F.col("risk_score").cast("string"), F.lit("/100")),
                   F.concat(F.lit("Verdict : "), F.coalesce(F.element_at(_map(VERDICT_EMOJI), F.col("verdict")),
                                                            F.lit("")), F.lit(" "), F.col("verdict")))
    advice = F.array(F.lit(""), F.element_at(_map(ADVICE), F.col("verdict")))
    lines = F.concat(head, flines, payload, advice, confirm, F.array(F.lit(SEP)))
    return d.select(*keep, F.array_join(lines, "\n").alias("report_text"))


def confirm_queue(v: DataFrame, keep=("msg_id",)) -> DataFrame:
    """Pending confirmations: score, first 4 CRITICAL/HIGH codes in detection order, preview."""
    codes = F.slice(F.transform(F.filter("findings", lambda f: f["severity"].isin("CRITICAL", "HIGH")),
                                lambda f: f["code"]), 1, 4)
    return v.where("requires_confirmation").select(
        *keep, F.concat(F.lit("MALICIOUS scan — score "), F.col("risk_score").cast("string"), F.lit("/100"))
        .alias("summary"), "risk_score", F.array_join(codes, ", ").alias("codes"), cut(F.col("text"), 80).alias("input"))


def audit_events(v: DataFrame, keep=("msg_id",)) -> DataFrame:
    """Append-only audit rows: one per finding plus one per verdict; text stored as SHA-256 only."""
    def event(kind: str, code: Column, level: Column, severity: Column, score: Column) -> Column:
        return F.struct(F.lit(kind).alias("event"), code.alias("code"), level.alias("level"), severity.alias("severity"), score.alias("risk_score"))

    levels = _map(AUDIT_LEVEL)
    per_finding = F.transform("findings", lambda f: event("finding", f["code"], F.coalesce(F.element_at(levels, f["code"]), F.lit("INFO")),
                                                          f["severity"], F.lit(None).cast("int")))
    # "scan complete" is a debug event
    per_scan = event("verdict", F.col("verdict"), F.lit("DEBUG"), F.lit(None).cast("string"), F.col("risk_score"))
    return v.select(*keep, F.sha2(F.col("text"), 256).alias("text_sha256"), F.inline(F.concat(per_finding, F.array(per_scan))))
