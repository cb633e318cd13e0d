"""Detectors as column expressions.

Each detector maps the ``text`` column to either one nullable finding struct or
an array of finding structs.  The struct is ``(severity, code, detail, decoded)``;
``scan`` concatenates them in the fixed detection order and numbers them.
Nothing needs a shuffle; only the letter statistics leave the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire import constants as K
from tripwire.functions import codecs, stats
from tripwire.functions.text import cut, cut_ellipsis, py_fixed, py_percent
from tripwire.operators.patterns import HITS, runs_on_jvm
from tripwire.operators.patterns import lane as patterns_lane
from tripwire.params import ScanParams
from tripwire.regex import B_AFTER_WORD, B_BEFORE_WORD, NOT_WS, WS, _group_alternatives, literal_prefix, to_java

FINDING = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("decoded", T.StringType()),
])
FINDINGS = T.ArrayType(FINDING)

SEV_RANK = {s: i for i, s in enumerate(K.SEVERITY_ORDER)}

# Candidate extractors (Java syntax).  Possessive runs keep matching linear:
# backtracking into a run can never produce a match here.
B64_CANDIDATE = r"(?<![A-Za-z0-9+/\-_])([A-Za-z0-9+/\-_]{16,}+={0,2}+)(?![A-Za-z0-9+/\-_=])"
# hex digits and 'x' are word characters, so each \b is a one-sided test
HEX0X_CANDIDATE = B_BEFORE_WORD + r"0x([0-9a-fA-F]{8,}+)" + B_AFTER_WORD
HEX0X_DECODE_CANDIDATE = B_BEFORE_WORD + r"0x([0-9a-fA-F]{6,}+)" + B_AFTER_WORD
HEX_BARE_CANDIDATE = B_BEFORE_WORD + r"([0-9a-fA-F]{16,}+)" + B_AFTER_WORD
# runs are only tried where they start (lookbehind), which keeps the scan linear
WORDS = r"(?<![A-Za-z])[A-Za-z]{3,}+"
LONG_RUN = r"(?<!" + NOT_WS + ")" + NOT_WS + r"{24,}+"
# Base64 and bare hex candidates and blobs are runs of at least 16 characters without a space
ANY_RUN = r"(?<!" + NOT_WS + ")" + NOT_WS + r"{16,}+"
INVISIBLE_CLASS = "[" + "".join(
    (r"\x{%X}" % lo) if lo == hi else (r"\x{%X}-\x{%X}" % (lo, hi)) for lo, hi in K.INVISIBLE_RANGES) + "]"
COMBINING_CLASS = r"\p{M}"


def finding(severity, code, detail: Column, decoded: Column | None = None) -> Column:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(sev.alias("severity"), F.lit(code).alias("code"), detail.alias("detail"),
                    (decoded if decoded is not None else F.lit("")).alias("decoded"))


def _fmt(template: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a fixed template with columns."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            pieces.append(F.lit(head))
        pieces.append(parts[name])
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


# Every ``add_*`` function below appends its intermediate and result columns
# to a DataFrame in small projection stages, so a heavy value (a decode, the
# letter counts, a candidate array) is computed once and later referenced as a
# plain column instead of being copied into several expression trees.


class Lanes:
    """Independent detectors applied side by side: stage *i* of every detector is
    evaluated in one projection, so the plan has as many projections as the
    longest detector has stages (not the sum of all of them)."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.levels: list[dict[str, Column]] = []

    def lane(self) -> "_Lane":
        return _Lane(self, 0)

    def apply(self) -> DataFrame:
        df = self.df
        for cols in self.levels:
            if cols:
                df = df.select("*", *[c.alias(n) for n, c in cols.items()])
        return df


class _Lane:
    def __init__(self, lanes: Lanes, level: int):
        self.lanes, self.level = lanes, level


def _stage(df, **cols: Column):
    """Add one projection stage (to a DataFrame, or to a lane of a ``Lanes`` batch)."""
    if isinstance(df, _Lane):
        while len(df.lanes.levels) <= df.level:
            df.lanes.levels.append({})
        df.lanes.levels[df.level].update(cols)
        return _Lane(df.lanes, df.level + 1)
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def _with_runs(df, t: str):
    """Add ``{t}_runs``: the text's long runs, joined by a space, in which all candidates of the long-run detectors lie.

    Whether a candidate ends at a run's border doesn't depend on which space
    follows, so they find the same there as in the text, which is walked once.
    """
    name = t + "_runs"
    if not isinstance(df, _Lane) and name in df.columns:
        return df
    return _stage(df, **{name: F.array_join(F.regexp_extract_all(F.col(t), F.lit(ANY_RUN), 0), " ")})


# --------------------------------------------------------------------------- invisible / zalgo
def _count_beyond_ascii(text: Column, char_class: str) -> Column:
    """``regexp_count`` of a class that has no ASCII character."""
    return F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(F.regexp_count(text, F.lit(char_class)))


def add_invisible(df: DataFrame, t: str = "_text", out: str = "_inv") -> DataFrame:
    df = _stage(df, **{out + "_n": _count_beyond_ascii(F.col(t), INVISIBLE_CLASS)})
    n = F.col(out + "_n")
    total = F.greatest(F.length(F.col(t)), F.lit(1))
    detail = _fmt(K.DETAIL_INVISIBLE, n=n.cast("string"), pct=py_percent(n / total, 1))
    return _stage(df, **{out: F.when(n > 0, finding("CRITICAL", "INVISIBLE_UNICODE", detail))})


def add_zalgo(df: DataFrame, p: ScanParams = ScanParams(), t: str = "_text", out: str = "_zal") -> DataFrame:
    df = _stage(df, **{out + "_n": _count_beyond_ascii(F.col(t), COMBINING_CLASS)})
    n = F.col(out + "_n")
    ratio = n / F.greatest(F.length(F.col(t)), F.lit(1))
    detail = _fmt(K.DETAIL_ZALGO, n=n.cast("string"), pct=py_percent(ratio, 1))
    return _stage(df, **{out: F.when(ratio >= p.combining_ratio, finding("HIGH", "ZALGO_COMBINING", detail))})


# --------------------------------------------------------------------------- base64
def base64_candidates(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(B64_CANDIDATE), 1))


def base64_decoded(cands: Column) -> Column:
    """array<string>: printable decodings of the candidates, in first-seen order."""
    return F.filter(F.transform(cands, lambda b: codecs.utf8_replace(codecs.b64_bytes(b))),
                    lambda x: x.isNotNull() & codecs.printable_ok(x, 4))


def add_base64(df: DataFrame, t: str = "_text", out: str = "_b64") -> DataFrame:
    df = _with_runs(df, t)
    df = _stage(df, **{out + "_c": base64_candidates(F.col(t + "_runs"))})
    df = _stage(df, **{out + "_d": base64_decoded(F.col(out + "_c"))})
    return _stage(df, **{out: F.transform(F.col(out + "_d"), lambda x: finding(
        "HIGH", "BASE64_PAYLOAD", _fmt(K.DETAIL_BASE64, snippet=cut_ellipsis(x, 120)), x))})


# --------------------------------------------------------------------------- hex
def hex0x_candidates(text: Column) -> Column:
    """Distinct 0x-hex runs (>= 8 digits) other than 40/64-digit chain ids."""
    none = F.array().cast("array<string>")
    raw = F.when(~text.contains("0x"), none).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(HEX0X_CANDIDATE), 1)))
    return F.filter(raw, lambda h: ~F.length(h).isin(40, 64))


def hex_bare_raw(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(HEX_BARE_CANDIDATE), 1))


def hex_bare_candidates(raw: Column, seen0x: Column) -> Column:
    return F.filter(F.array_except(raw, seen0x),
                    lambda h: (F.pmod(F.length(h), F.lit(2)) == 0) & ~F.length(h).isin(40, 64))


def hex_decoded(cands: Column, min_len: int = 3) -> Column:
    return F.filter(F.transform(cands, lambda h: codecs.hex_decode(h)),
                    lambda x: x.isNotNull() & codecs.printable_ok(x, min_len))


def add_hex(df: DataFrame, t: str = "_text", out0: str = "_hx0", outb: str = "_hxb") -> DataFrame:
    df = _with_runs(df, t)
    df = _stage(df, **{out0 + "_c": hex0x_candidates(F.col(t)), outb + "_r": hex_bare_raw(F.col(t + "_runs"))})
    df = _stage(df, **{out0 + "_d": hex_decoded(F.col(out0 + "_c")),
                       outb + "_c": hex_bare_candidates(F.col(outb + "_r"), F.col(out0 + "_c"))})
    df = _stage(df, **{outb + "_d": hex_decoded(F.col(outb + "_c"))})
    return _stage(df, **{
        out0: F.transform(F.col(out0 + "_d"), lambda x: finding(
            "HIGH", "HEX_PAYLOAD", _fmt(K.DETAIL_HEX_0X, snippet=cut(x, 120)), x)),
        outb: F.transform(F.col(outb + "_d"), lambda x: finding(
            "MEDIUM", "HEX_BLOB", _fmt(K.DETAIL_HEX_BARE, snippet=cut(x, 120)), x))})


# --------------------------------------------------------------------------- morse
def ws_tokens(text: Column) -> Column:
    """``re.split(r'\\s+', text.strip())``."""
    stripped = F.regexp_replace(text, "^" + WS + "+|" + WS + "+$", "")
    return F.split(stripped, WS + "+")


def morse_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"^[.\-]+\z"))


# a token is a maximal run of non-space characters; a Morse token is one made only of '.'/'-'
MORSE_TOKEN = r"(?<!" + NOT_WS + r")[.\-]++(?!" + NOT_WS + r")"
ANY_TOKEN = NOT_WS + "++"


def add_morse(df: DataFrame, p: ScanParams = ScanParams(), t: str = "_text", out: str = "_mor") -> DataFrame:
    """Two counting passes decide whether the Morse rule can fire (tokens >= 4 and
    Morse share >= threshold); only those rows are split into tokens and decoded."""
    text = F.col(t)
    # at least one token in so many is Morse: without any, the rule can't fire and the others aren't counted
    df = _stage(df, **{out + "_nm": F.regexp_count(text, F.lit(MORSE_TOKEN))})
    tokens = F.greatest(F.regexp_count(text, F.lit(ANY_TOKEN)), F.lit(1))
    df = _stage(df, **{out + "_nt": F.when(F.col(out + "_nm") > 0, tokens).otherwise(F.lit(1)) if p.morse_token_ratio > 0 else tokens})
    nm, ntok = F.col(out + "_nm"), F.col(out + "_nt")
    ratio = nm / ntok
    fire = (ntok >= 4) & (ratio >= p.morse_token_ratio)
    df = _stage(df, **{out + "_dec": F.when(fire, codecs.morse_decode(morse_tokens(ws_tokens(text))))})
    dec = F.col(out + "_dec")
    detail = _fmt(K.DETAIL_MORSE, n=nm.cast("string"), pct=py_percent(ratio, 0), decoded=dec)
    return _stage(df, **{out: F.when(dec.isNotNull(), finding("HIGH", "MORSE_ENCODING", detail, dec))})


# --------------------------------------------------------------------------- caesar / rot
def add_rot_profile(df: DataFrame, t: str = "_text", out: str = "_rot") -> DataFrame:
    """Adds ``{out}_cand`` (words >= 3 letters joined by ' ', when >= 5 words),
    ``{out}_chis`` (chi2 for rotations 0..25),
    ``{out}_chi0`` and ``{out}_best`` = struct(chi2, rot), arg-min over 1..25 with
    ties to the smaller rotation (struct ordering = strict ``<`` scan)."""
    df = _stage(df, **{out + "_w": F.regexp_extract_all(F.col(t), F.lit(WORDS), 0)})
    w = F.col(out + "_w")
    df = _stage(df, **{out + "_cand": F.when(F.size(w) >= 5, F.array_join(w, " "))})
    cand = F.col(out + "_cand")
    # letters only, lower-cased: one Arrow-batched pass gives counts and all 26 chi2
    df = _stage(df, **{out + "_lc": F.when(F.size(w) >= 5, F.lower(F.array_join(w, "")))})
    df = _stage(df, **{out + "_chis": stats.chi_squared_all(F.col(out + "_lc"))})
    chis = F.col(out + "_chis")
    # arg-min without a lambda over ``chis``: a staged column referenced once inside a
    # lambda would be inlined into it and recomputed for every element
    pairs = F.arrays_zip(F.slice(chis, 2, 25).alias("chi2"), F.sequence(F.lit(1), F.lit(25)).alias("rot"))
    best = F.array_min(pairs)
    return _stage(df, **{out + "_chi0": F.element_at(chis, 1), out + "_best": best})


def add_caesar(df: DataFrame, t: str = "_text", out: str = "_cae") -> DataFrame:
    df = add_rot_profile(df, t, out)
    chi0, best = F.col(out + "_chi0"), F.col(out + "_best")
    fire = (chi0 >= 100) & (best["chi2"] < chi0) & (best["chi2"] < chi0 * 0.4) & (best["chi2"] < 35)
    df = _stage(df, **{out + "_r": F.when(fire, best["rot"])})
    r = F.col(out + "_r")
    df = _stage(df, **{out + "_dec": F.when(r.isNotNull(), codecs.rot_n(F.col(out + "_cand"), r))})
    dec = F.col(out + "_dec")
    is13 = r == 13
    name = F.when(is13, F.lit("ROT13")).otherwise(F.concat(F.lit("ROT"), r.cast("string"), F.lit(" (Caesar cipher)")))
    f = F.struct(F.when(is13, "HIGH").otherwise("MEDIUM").alias("severity"),
                 F.when(is13, "ROT13_OBFUSCATION").otherwise("CAESAR_CIPHER").alias("code"),
                 _fmt(K.DETAIL_ROT, name=name, snippet=cut(dec, 120)).alias("detail"), dec.alias("decoded"))
    return _stage(df, **{out: F.when(r.isNotNull(), f)})


# --------------------------------------------------------------------------- entropy
def entropy_blobs(text: Column) -> Column:
    """Non-space runs of >= 24 chars that are not purely ASCII letters."""
    runs = F.regexp_extract_all(text, F.lit(LONG_RUN), 0)
    return F.filter(runs, lambda b: ~b.rlike(r"^[A-Za-z]+\z"))


def add_entropy(df: DataFrame, p: ScanParams = ScanParams(), t: str = "_text", out: str = "_ent") -> DataFrame:
    df = _with_runs(df, t)
    df = _stage(df, **{out + "_b": entropy_blobs(F.col(t + "_runs"))})
    ents = F.transform(F.col(out + "_b"), lambda b: stats.shannon_entropy(b, p.entropy_threshold))
    df = _stage(df, **{out + "_e": F.call_function(
        "try_element_at", F.filter(ents, lambda e: e >= p.entropy_threshold), F.lit(1))})
    e = F.col(out + "_e")
    detail = _fmt(K.DETAIL_ENTROPY, ent=py_fixed(e, 2, grouping=False), thr=F.lit(repr(p.entropy_threshold)))
    return _stage(df, **{out: F.when(e.isNotNull(), finding("MEDIUM", "HIGH_ENTROPY_BLOB", detail))})


# --------------------------------------------------------------------------- keywords
def compiled_patterns(patterns=None) -> list[tuple[str, str, str, str | None]]:
    """Registry entries as (java_regex, label, severity, required_literal); None stays."""
    return [p and (to_java(p[0]), p[1], p[2], literal_prefix(p[0])) for p in (patterns or K.INJECTION_PATTERNS)]


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyword_hits(lower_col: str, patterns=None) -> Column:
    """array<struct<pos,label,severity,rank>> of matched entries (registry order) for the
    lower-cased text column ``lower_col``.

    A pattern's regex only runs on texts that contain its leading word (a plain
    substring test), which skips almost every text for almost every pattern.
    Built as one SQL expression (one call into the JVM instead of hundreds).
    """
    c = f"`{lower_col}`"
    items = []
    for i, entry in enumerate(compiled_patterns(patterns)):
        if entry is None:       # it has its place in the order, but runs elsewhere
            continue
        rx, label, sev, lit = entry
        test = f"{c} RLIKE {_sql_str(rx)}"
        if lit is not None:
            test = f"contains({c}, {_sql_str(lit)}) AND {test}"
        items.append(f"CASE WHEN {test} THEN named_struct('pos', {i}, 'label', {_sql_str(label)}, "
                     f"'severity', {_sql_str(sev)}, 'rank', {SEV_RANK[sev]}) END")
    return F.expr("array_compact(array(" + ", ".join(items) + "))") if items else F.array().cast(HITS)


def keywords_from_hits(hits: Column) -> Column:
    top = F.element_at(F.array(*[F.lit(s) for s in K.SEVERITY_ORDER]),
                       F.array_min(F.transform(hits, lambda h: h["rank"])) + 1)
    labels = F.array_join(F.transform(hits, lambda h: h["label"]), ", ")
    return F.when(F.size(hits) > 0, finding(top, "INJECTION_KEYWORD", _fmt(K.DETAIL_KEYWORDS, labels=labels)))


def add_keywords(df: DataFrame, t: str = "_text", out: str = "_kw", patterns=None, when: Column | None = None
                 ) -> DataFrame:
    """One finding of all patterns that match; patterns that the JVM can't take run in a contained lane.

    If a pattern of that lane fails on a text, its finding is SCAN_ERROR.
    """
    lc = F.lower(F.col(t))
    df = _stage(df, **{out + "_lc": lc if when is None else F.when(when, lc)})
    every = list(patterns or K.INJECTION_PATTERNS)
    apart = [(i, *p) for i, p in enumerate(every) if not on_jvm(p)]
    if not apart:
        df = _stage(df, **{out + "_h": keyword_hits(out + "_lc", every)})
        return _stage(df, **{out: keywords_from_hits(F.col(out + "_h"))})
    df = _stage(df, **{out + "_j": keyword_hits(out + "_lc", [p if on_jvm(p) else None for p in every]), out + "_p": patterns_lane(F.col(out + "_lc"), apart)})
    df = _stage(df, **{out + "_h": F.array_sort(F.concat(F.col(out + "_j"), F.coalesce(F.col(out + "_p")["hits"], F.array().cast(HITS))))})
    error = F.col(out + "_p")["error"]
    failed = finding("INFO", "SCAN_ERROR", _fmt(K.DETAIL_SCAN_ERROR, error=error))
    return _stage(df, **{out: F.when(error.isNotNull(), failed).otherwise(keywords_from_hits(F.col(out + "_h")))})


def on_jvm(pattern: tuple[str, str, str]) -> bool:
    return tuple(pattern) in BUILT_IN or runs_on_jvm(pattern[0])


BUILT_IN = {tuple(p) for p in K.INJECTION_PATTERNS}


# --------------------------------------------------------------------------- intent
FIN_JAVA = to_java(K.FINANCIAL_ACTION_RE, ignore_case=True)
AMOUNT_JAVA = to_java(K.AMOUNT_RE, ignore_case=True)
URGENCY_JAVA = to_java(K.URGENCY_RE, ignore_case=True)
ADDR_JAVA = to_java(K.ETH_ADDR_RE)


def intent_signals(text: Column) -> Column:
    return F.array_compact(F.array(
        F.when(text.rlike(AMOUNT_JAVA), F.lit(K.SIGNAL_NAMES[0])),
        F.when(text.rlike(URGENCY_JAVA), F.lit(K.SIGNAL_NAMES[1])),
        F.when(text.rlike(ADDR_JAVA), F.lit(K.SIGNAL_NAMES[2]))))


# the literal start of each alternative of the verb pattern (all are lower case)
FIN_STEMS = [re.match("[a-z]+", verb).group() for verb in _group_alternatives(re.fullmatch(r"\\b\((.*)\)\\b", K.FINANCIAL_ACTION_RE).group(1))]


def _fin_possible(text: Column) -> Column:
    """Necessary condition for the case-insensitive verb regex, as cheap substring tests.

    Besides ASCII, only 'İ' (U+0130), 'ſ' (U+017F) and 'ı' (U+0131) are
    case-equivalent to ASCII letters without ``lower`` mapping them there
    (Kelvin sign lowers to 'k'), so a text that holds one of them is possible too."""
    lc = F.lower(text)
    hit = F.lit(False)
    for c in [*map(lc.contains, FIN_STEMS), *map(text.contains, "\u0130\u017f\u0131")]:
        hit = hit | c
    return hit


def add_intent(df: DataFrame, t: str = "_text", uit: str = "_uit", out: str = "_itn") -> DataFrame:
    text = F.col(t)
    df = _stage(df, **{out + "_p": _fin_possible(text) & ~F.coalesce(F.col(uit), F.lit(False))})
    fire = F.col(out + "_p") & text.rlike(FIN_JAVA)
    df = _stage(df, **{out + "_s": F.when(fire, intent_signals(text))})
    sig = F.col(out + "_s")
    high = F.size(sig) > 0
    detail = F.when(high, _fmt(K.DETAIL_INTENT_HIGH, signals=F.array_join(sig, ", "))).otherwise(
        F.lit(K.DETAIL_INTENT_MEDIUM))
    return _stage(df, **{out: F.when(sig.isNotNull(), finding(
        F.when(high, "HIGH").otherwise("MEDIUM"), "UNVERIFIED_INTENT", detail))})
