"""Keyword patterns from a table, and patterns that the JVM's regexes can't take.

``pattern_table_hits`` matches any number of patterns against any number of
texts without trying every pattern on every text.  From each pattern come
literals of which a match must hold one; all literals go into one automaton (a
trie with failure links), a text passes through it once, and only the patterns
that it names are verified.  The index is broadcast in parts of bounded size.

``lane`` runs given patterns in Python, contained: a pattern that takes too long
on a text, or fails, is an error of that text and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _parser as parser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire import constants as K
from tripwire.plans.strategy import ensure_parallelism
from tripwire.regex import to_java

PATTERNS_AT_ONCE = 50_000
SECONDS = 1.0           # of a pattern on one text
REPEATS = (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT)
PATTERNS = "pos bigint, pattern string, label string, severity string"
HITS = "array<struct<pos:int,label:string,severity:string,rank:int>>"


# ------------------------------------------------------------------ what a pattern needs
def _needed(sequence) -> frozenset[str] | None:
    """Literals of which every match of a parsed sequence holds one; None if there are none."""
    best: frozenset[str] | None = None

    def offer(some: frozenset[str] | None) -> None:
        nonlocal best
        if some and (best is None or min(map(len, some)) > min(map(len, best))):
            best = some

    run = ""
    for op, value in [*sequence, (None, None)]:
        if op is parser.LITERAL:
            run += chr(value)
            continue
        if run:
            offer(frozenset([run]))
        run = ""
        if op is parser.SUBPATTERN:
            offer(_needed(value[3]))
        elif op is parser.ATOMIC_GROUP:
            offer(_needed(value))
        elif op is parser.BRANCH:
            ways = [_needed(way) for way in value[1]]
            if all(ways):
                offer(frozenset().union(*ways))
        elif op in REPEATS and value[0] > 0:
            offer(_needed(value[2]))
    return best


def needed_literals(pattern: str) -> frozenset[str] | None:
    """Literals of which a text must hold one for ``pattern`` to match; None if any text may match."""
    parsed = parser.parse(pattern)
    return None if parsed.state.flags & re.IGNORECASE else _needed(parsed)


def _inside(sequence) -> Iterator[tuple]:
    for op, value in sequence:
        yield op, value
        for part in ([value[3]] if op is parser.SUBPATTERN else [value] if op is parser.ATOMIC_GROUP else value[1] if op is parser.BRANCH
                     else [value[2]] if op in REPEATS else [value[1]] if op in (parser.ASSERT, parser.ASSERT_NOT) else []):
            yield from _inside(part)


def matches_safely(pattern: str) -> bool:
    """No repetition holds another repetition or alternatives, and nothing refers back: no match takes a time or a depth that explodes."""
    parsed = list(_inside(parser.parse(pattern)))
    if any(op in (parser.GROUPREF, parser.GROUPREF_EXISTS) for op, _ in parsed):
        return False
    return not any(op in REPEATS and value[1] > 1 and any(o is parser.BRANCH or o in REPEATS for o, _ in _inside(value[2])) for op, value in parsed)


@lru_cache(maxsize=4096)
def _java_compiles(pattern: str) -> bool:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return False
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(to_java(pattern))
    except Exception:       # a syntax that Java doesn't have
        return False
    return True


def runs_on_jvm(pattern: str) -> bool:
    """Whether the JVM takes the pattern and matches it safely."""
    return matches_safely(pattern) and _java_compiles(pattern)


# ------------------------------------------------------------------ contained matching
@lru_cache(maxsize=4096)
def _compiled(pattern: str):
    if matches_safely(pattern):
        return re.compile(pattern).search
    import regex        # it can be stopped
    search = regex.compile(pattern).search
    return lambda text: search(text, timeout=SECONDS)


def tried(pattern: str, text: str) -> tuple[bool, str | None]:
    """Whether ``pattern`` is in ``text``, or why that couldn't be found out."""
    try:
        return _compiled(pattern)(text) is not None, None
    except TimeoutError:
        return False, f"pattern {pattern!r} took more than {SECONDS:g} s"
    except Exception as error:
        return False, f"pattern {pattern!r}: {error}"


def lane(lower: Column, patterns: list[tuple[int, str, str, str]]) -> Column:
    """struct<hits, error> of the patterns (pos, pattern, label, severity) on a lower-cased text; the error is that of the first pattern that failed."""
    ranks = {s: i for i, s in enumerate(K.SEVERITY_ORDER)}

    @F.pandas_udf(f"hits {HITS}, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        hits, errors = [], []
        for text in texts:
            own, failed = [], None
            for pos, pattern, label, severity in patterns if text is not None else []:
                hit, error = tried(pattern, text)
                failed = failed or error
                if hit:
                    own.append({"pos": pos, "label": label, "severity": severity, "rank": ranks[severity]})
            hits.append(own)
            errors.append(failed)
        return pd.DataFrame({"hits": pd.Series(hits, dtype=object), "error": pd.Series(errors, dtype=object)})
    return run(lower)


# ------------------------------------------------------------------ patterns as a table
class PatternIndex:
    """An automaton over the literals that the patterns need, and the patterns that need none."""

    def __init__(self, patterns: list[tuple[int, str]]):
        import ahocorasick
        self.patterns = dict(patterns)
        self.always: list[int] = []
        literals: dict[str, list[int]] = {}
        for pos, pattern in patterns:
            try:
                needed = needed_literals(pattern)
            except Exception:       # no pattern at all: an error of every text
                needed = None
            for literal in needed or ():
                literals.setdefault(literal, []).append(pos)
            if not needed:
                self.always.append(pos)
        self.automaton = ahocorasick.Automaton()
        for literal, of in literals.items():
            self.automaton.add_word(literal, of)
        self.automaton.make_automaton()
        self.empty = not literals

    def hits(self, text: str) -> Iterator[tuple[int, str | None]]:
        """The patterns found in a text, ascending, and those that failed on it with the reason."""
        named = set(self.always)
        if not self.empty:
            for _, of in self.automaton.iter(text):
                named.update(of)
        for pos in sorted(named):
            hit, error = tried(self.patterns[pos], text)
            if hit or error:
                yield pos, error


def pattern_table_hits(messages: DataFrame, patterns: DataFrame, id_col: str = "msg_id", text_col: str = "text", at_once: int = PATTERNS_AT_ONCE) -> DataFrame:
    """``id_col``, ``pos``, ``label``, ``severity``, ``error``: a row for each pattern found in a text, lower-cased.

    ``patterns`` has ``pos`` (unique), ``pattern`` (Python syntax), ``label``
    and ``severity``.  A pattern that fails on a text, or isn't one, gives a row
    with the reason as ``error``.  Null texts and null patterns give no rows.
    """
    spark = messages.sparkSession
    named = patterns.select("pos", "pattern", "label", "severity").filter("pattern IS NOT NULL")
    bounds = named.agg(F.min("pos"), F.max("pos"), F.count(F.lit(1))).first()
    slim = ensure_parallelism(messages.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).filter("text IS NOT NULL"))
    schema = f"id {dict(messages.dtypes)[id_col]}, pos bigint, error string"
    out = spark.createDataFrame([], schema)
    parts = -(-(bounds[2] or 0) // at_once)
    for part in range(parts):
        mine = named.filter(F.pmod(F.xxhash64("pos"), F.lit(parts)) == part).select("pos", "pattern").collect()     # about ``at_once`` patterns
        held = spark.sparkContext.broadcast([(r.pos, r.pattern) for r in mine])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = PatternIndex(held.value)
            for batch in batches:
                ids, found, errors = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for pos, error in index.hits(text):
                        ids.append(i)
                        found.append(pos)
                        errors.append(error)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(found, pa.int64()), pa.array(errors, pa.string())], names=["id", "pos", "error"])
        out = out.unionByName(slim.mapInArrow(run, schema))
    return out.join(named.select("pos", "label", "severity"), "pos").select(F.col("id").alias(id_col), "pos", "label", "severity", "error")
