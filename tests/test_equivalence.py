"""Equivalence tests: vectorised vs column-expression forms, Java vs Python regex,
and Spark queries vs their DuckDB oracles on the smallest fixture."""

import math
import random
import re

import duckdb
from pyspark.sql import functions as F

from tripwire import constants as K
from tripwire.functions import stats
from tripwire.regex import to_java

from paths import SF0001


def _py_chi2(text):
    # Python-side brute force of the same rule (compensated float sum, Python 3.12+)
    n = len(text)
    return sum(((text.count(ch) - f * n / 100) ** 2) / (f * n / 100) for ch, f in K.ENGLISH_FREQ.items())


def test_chi2_matches_python(spark):
    texts = ["ignoreallpreviousinstructions", "thequickbrownfoxjumpsoverthelazydog", "vtaberfnyycerivbhf"]
    df = spark.createDataFrame([(t,) for t in texts], "lc string")
    got = [r[0][0] for r in df.select(stats.chi_squared_all(F.col("lc"))).collect()]
    assert got == [_py_chi2(t) for t in texts]


EDGE = ["send 5 ETH", "ſend money", "lİquidate now", "staKe it", "SEND", "ﬂash loan", "²send 5 ETH", "ésend", "send́ it", "Ｓend", "ſend money", "SEND", "x_send", "send_x",
        "发send发", "send​now", "pay  out now", "flash\tloan", "don't wait", 'don"t wait', "dont wait",
        "$1,000", "$ 5", "5 eth", "5eth", ",5 eth", "a,5 eth", "१२ eth", "0x" + "a" * 40, "x0x" + "a" * 40,
        "0x" + "a" * 41, "right now", "right now", "immediately!", "urgently", "urgentl",
        "act as user", "act as a user", "act as  user", "act as assistant now", "act as if you are a cat"]


def test_java_regexes_match_python(spark):
    pats = [(K.FINANCIAL_ACTION_RE, re.IGNORECASE), (K.AMOUNT_RE, re.IGNORECASE), (K.URGENCY_RE, re.IGNORECASE),
            (K.ETH_ADDR_RE, 0)] + [(p, 0) for p, _, _ in K.INJECTION_PATTERNS]
    df = spark.createDataFrame([(s,) for s in EDGE], "s string")
    cols = []
    for i, (p, flags) in enumerate(pats):
        target = F.col("s") if flags else F.lower(F.col("s"))
        cols.append(target.rlike(to_java(p, ignore_case=bool(flags))).alias(f"p{i}"))
    rows = df.select("s", *cols).collect()
    for r in rows:
        for i, (p, flags) in enumerate(pats):
            subject = r.s if flags else r.s.lower()
            assert bool(r[f"p{i}"]) == bool(re.search(p, subject, flags)), (p, r.s)


def _compare(spark, name):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ["events", "conversations", "documents"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF0001)
    cols = sorted(sdf.columns)

    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        try:
            from decimal import Decimal
            if isinstance(v, Decimal):
                return float(v)
        except ImportError:  # pragma: no cover
            pass
        return v

    s_rows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    d_rows = sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert s_rows == d_rows, name


def test_oracles_sf0001(spark):
    for name in ["scan_verdicts", "scan_findings", "tx_precheck", "daily_accepted_spend", "policy_asof",
                 "allowlist_asof", "gate_outcomes", "gate_decision", "report_text"]:
        _compare(spark, name)


def test_streams_equal_their_batch_oracles(spark):
    import __spark_entry__ as E
    q = E.queries()
    for name in ["stream_daily_spend", "stream_gate"]:
        _compare(spark, name)
    assert len(q["stream_late"](spark, SF0001).collect()) > 0



def test_intent_precheck_keeps_python_semantics(spark):
    from tripwire.operators import detectors as D
    df = spark.createDataFrame([(i, s, False) for i, s in enumerate(EDGE)], "msg_id long, _text string, _uit boolean")
    got = {r.msg_id: r._itn is not None for r in D.add_intent(df).select("msg_id", "_itn").collect()}
    for i, s in enumerate(EDGE):
        assert got[i] == bool(re.search(K.FINANCIAL_ACTION_RE, s, re.IGNORECASE)), s


def test_entropy_relational_equals_hof(spark):
    """Relational form (explode characters, group, sum -p log2 p) equals the HOF form."""
    from tripwire.operators import detectors as D
    from tripwire.sources import tables
    m = tables.messages(spark, SF0001)
    blobs = m.select("msg_id", F.posexplode(D.entropy_blobs(F.col("text"))).alias("idx", "blob"))
    hof = {(r.msg_id, r.idx): r.e for r in blobs.select("msg_id", "idx", stats.shannon_entropy(F.col("blob")).alias("e"))
           .collect()}
    chars = blobs.select("msg_id", "idx", F.length("blob").alias("n"),
                         F.explode(F.regexp_extract_all("blob", F.lit("(?s)."), 0)).alias("ch"))
    counts = chars.groupBy("msg_id", "idx", "n", "ch").count()
    rel = counts.groupBy("msg_id", "idx").agg(
        (-F.sum((F.col("count") / F.col("n")) * F.log2(F.col("count") / F.col("n")))).alias("e"))
    got = {(r.msg_id, r.idx): r.e for r in rel.collect()}
    assert set(got) == set(hof) and len(hof) > 0
    for k, v in hof.items():
        assert abs(got[k] - v) < 1e-12
