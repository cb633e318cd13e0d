"""Full message scan: detectors in fixed order -> findings -> score -> verdict.

``scan_messages`` is a projection over the input rows; letter statistics run in
one Arrow-batched UDF, everything else in the JVM.  (Inputs with fewer splits
than task slots are dealt out first, see ``ensure_parallelism``.)  The projection is staged so each candidate array / finding
array is computed once (Catalyst's CollapseProject keeps a producer that is
referenced more than once instead of inlining it twice).
"""

from __future__ import annotations

import re
from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire import constants as K
from tripwire.operators import detectors as D
from tripwire.params import ScanParams
from tripwire.plans.strategy import ensure_parallelism, pushdown_barrier

# Registered user detectors: name -> fn(text Column) -> Column(array<finding>)
_EXTRA_DETECTORS: dict[str, Callable[[Column], Column]] = {}


def register_detector(name: str, fn: Callable[[Column], Column]) -> None:
    """Add a detector that runs after the built-in ones (in registration order).

    ``fn`` maps the text column to ``array<struct<severity,code,detail,decoded>>``
    (a pandas UDF returning that type is allowed).
    """
    _EXTRA_DETECTORS[name] = fn


def unregister_detector(name: str) -> None:
    _EXTRA_DETECTORS.pop(name, None)


# Registered keyword patterns, after the built-in ones: (regex, label, severity)
_EXTRA_PATTERNS: list[tuple[str, str, str]] = []


def register_pattern(pattern: str, label: str, severity: str = "HIGH") -> None:
    """Add a keyword pattern (Python regex, matched against the lower-cased text) to every later scan.

    A pattern that the JVM doesn't take, or that could backtrack without end, is
    matched in Python, contained: a text on which it fails gets a SCAN_ERROR
    finding after those found before; the scan goes on.
    """
    re.compile(pattern)
    if severity not in K.SEVERITY_ORDER:
        raise ValueError(f"unknown severity: {severity!r}")
    unregister_pattern(pattern)
    _EXTRA_PATTERNS.append((pattern, label, severity))


def unregister_pattern(pattern: str) -> None:
    _EXTRA_PATTERNS[:] = [p for p in _EXTRA_PATTERNS if p[0] != pattern]


def registered_patterns() -> list[tuple[str, str, str]]:
    return [*K.INJECTION_PATTERNS, *_EXTRA_PATTERNS]


def python_detector(fn: Callable[[str], Iterable[tuple[str, str, str, str]]]) -> Callable[[Column], Column]:
    """A detector from a plain function of a text that yields (severity, code, detail, decoded).

    A row for which it raises gets one INFO ``SCAN_ERROR`` finding with what it
    had yielded before; the job goes on.
    """
    template = K.DETAIL_SCAN_ERROR

    def detector(text: Column) -> Column:
        @F.pandas_udf(D.FINDINGS.simpleString())
        def run(texts: pd.Series) -> pd.Series:
            out = []
            for t in texts:
                found = []
                try:
                    if t is not None:
                        for severity, code, detail, decoded in fn(t):
                            found.append({"severity": severity, "code": code, "detail": detail, "decoded": decoded})
                except Exception as error:
                    found.append({"severity": "INFO", "code": "SCAN_ERROR", "detail": template.format(error=error), "decoded": ""})
                out.append(found)
            return pd.Series(out, dtype=object)
        return run(text)
    return detector


def _contained(parts: list[Column]) -> Column:
    """The parts' findings up to the first part that failed."""
    failed = F.lit(False)
    out = []
    for part in parts:
        out.append(F.when(failed, F.array().cast(D.FINDINGS)).otherwise(part))
        failed = failed | F.exists(part, lambda f: f["code"] == "SCAN_ERROR")
    return F.concat(*out)


def _single(col: Column) -> Column:
    """Nullable finding -> array of 0 or 1 findings."""
    return F.array_compact(F.array(col))


def severity_weight(sev: Column) -> Column:
    m = F.create_map(*[x for s, w in K.SEVERITY_WEIGHT.items() for x in (F.lit(s), F.lit(w))])
    return F.coalesce(F.element_at(m, sev), F.lit(0))


def severity_rank(sev: Column) -> Column:
    m = F.create_map(*[x for i, s in enumerate(K.SEVERITY_ORDER) for x in (F.lit(s), F.lit(i))])
    return F.coalesce(F.element_at(m, sev), F.lit(99))


def score_of(findings: Column) -> Column:
    total = F.aggregate(findings, F.lit(0), lambda a, f: a + severity_weight(f["severity"]))
    return F.least(F.lit(K.SCORE_CAP), total)


def verdict_of(score: Column) -> Column:
    return (F.when(score >= K.MALICIOUS_AT, F.lit("MALICIOUS"))
            .when(score >= K.SUSPICIOUS_AT, F.lit("SUSPICIOUS"))
            .otherwise(F.lit("CLEAN")))


def _first_decoded(arr: Column) -> Column:
    return F.call_function("try_element_at", arr, F.lit(1))["decoded"]


def scan_messages(df: DataFrame, params: ScanParams = ScanParams(), *, text_col: str = "text",
                  uit_col: str | None = "user_initiated_transfer", keep: Iterable[str] = ("msg_id",),
                  patterns=None, with_text: bool = False, extra_detectors=None) -> DataFrame:
    """One verdict row per input row.

    Output: ``keep`` columns, risk_score, verdict, requires_confirmation,
    decoded_payload, n_findings, findings (array<struct<ord,severity,code,detail,decoded>>)
    and, with ``with_text``, the scanned text.
    """
    keep = list(keep)
    patterns = registered_patterns() if patterns is None else patterns
    text = F.col(text_col)
    uit = F.col(uit_col) if uit_col and uit_col in df.columns else F.lit(False)
    d = ensure_parallelism(df.select(*keep, text.alias("_text"), uit.alias("_uit")))
    lanes = D.Lanes(d)
    D.add_invisible(lanes.lane())
    D.add_zalgo(lanes.lane(), params)
    D.add_base64(lanes.lane())
    D.add_hex(lanes.lane())
    D.add_morse(lanes.lane(), params)
    D.add_caesar(lanes.lane())
    D.add_entropy(lanes.lane(), params)
    D.add_keywords(lanes.lane(), patterns=patterns)
    D.add_intent(lanes.lane())
    d = lanes.apply()
    extra = list(_EXTRA_DETECTORS.values()) + list(extra_detectors or [])
    if extra:
        d = d.select("*", *[fn(F.col("_text")).alias(f"_x{i}") for i, fn in enumerate(extra)])
    t = F.col("_text")
    payload = F.coalesce(_first_decoded(F.col("_b64")), _first_decoded(F.col("_hx0")),
                         _first_decoded(F.col("_hxb")), F.col("_mor")["decoded"], F.col("_cae")["decoded"],
                         F.lit(""))
    d = d.select("*", payload.alias("_payload"))
    p = F.col("_payload")
    d = D.add_keywords(d, t="_payload", out="_kw2", patterns=patterns, when=(p != "") & (p != t))
    before = [_single(F.col("_inv")), _single(F.col("_zal")), F.col("_b64"), F.col("_hx0"), F.col("_hxb"),
              _single(F.col("_mor")), _single(F.col("_cae")), _single(F.col("_ent"))]
    later = [_single(F.col("_kw")), _single(F.col("_kw2")), _single(F.col("_itn"))]
    users = [F.col(f"_x{i}") for i in range(len(extra))]
    if all(map(D.on_jvm, patterns)):        # the built-in detectors can't fail
        all_findings = F.concat(*before, *later, *([_contained(users)] if users else []))
    else:
        all_findings = F.concat(*before, _contained([*later, *users]))
    too_short = F.array(D.finding("INFO", "TOO_SHORT", F.lit(K.DETAIL_TOO_SHORT)))
    scan_error = F.array(D.finding("INFO", "SCAN_ERROR",
                                   F.lit(K.DETAIL_SCAN_ERROR.format(error="text is NULL"))))
    short = F.length(t) < params.min_scan_length
    findings = F.when(t.isNull(), scan_error).when(short, too_short).otherwise(all_findings)
    numbered = F.transform(findings, lambda f, i: F.struct(
        i.alias("ord"), f["severity"].alias("severity"), f["code"].alias("code"),
        f["detail"].alias("detail"), f["decoded"].alias("decoded")))
    d = d.select(*keep, *(["_text"] if with_text else []), numbered.alias("findings"),
                 F.when(t.isNull() | short, F.lit("")).otherwise(p).alias("decoded_payload"))
    score = score_of(F.col("findings"))
    d = d.select("*", score.alias("risk_score"))
    out = d.select(
        *keep, *([F.col("_text").alias("text")] if with_text else []),
        "risk_score", verdict_of(F.col("risk_score")).alias("verdict"),
        (F.col("risk_score") >= K.MALICIOUS_AT).alias("requires_confirmation"),
        "decoded_payload", F.size("findings").alias("n_findings"), "findings")
    return pushdown_barrier(out)


def findings_table(verdicts: DataFrame, keep: Iterable[str] = ("msg_id",)) -> DataFrame:
    """Exploded findings: one row per (message, finding) with rank and weight."""
    # ``inline`` yields the struct fields as columns directly (no per-field
    # extraction on the generator output, which nested-column pruning would
    # otherwise push back into the scan expression once per field)
    return (verdicts.select(*keep, F.inline_outer("findings")).where(F.col("ord").isNotNull())
            .select(*keep, "ord", "severity", "code", "detail", "decoded",
                    severity_rank(F.col("severity")).alias("sev_rank"),
                    severity_weight(F.col("severity")).alias("weight")))
