"""Scan: golden vectors, edge rows, fixture totals."""

import base64
import random

from pyspark.sql import functions as F

from golden import GOLDEN, P
from tripwire.functions import codecs
from tripwire.operators.scan import findings_table, scan_messages
from tripwire.sources import tables

from paths import SF0001


def _scan(spark, texts, uit=None):
    rows = [(i, t, (uit[i] if uit else False)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "msg_id long, text string, user_initiated_transfer boolean")
    return {r.msg_id: r for r in scan_messages(df).collect()}


def test_golden_vectors(spark):
    got = _scan(spark, [g[0] for g in GOLDEN])
    for i, (text, score, verdict, codes) in enumerate(GOLDEN):
        r = got[i]
        assert (r.risk_score, r.verdict, [f.code for f in r.findings]) == (score, verdict, codes), text


def test_detail_texts(spark):
    got = _scan(spark, [GOLDEN[5][0], GOLDEN[13][0], GOLDEN[17][0], GOLDEN[18][0], GOLDEN[15][0]])
    assert got[0].findings[1].detail == ("High-entropy blob detected (entropy=5.07 bits/symbol ≥ 4.5). "
                                         "May represent encrypted or compressed data.")
    assert got[1].findings[0].detail == 'Morse code detected (9 tokens, 82% of input). Decoded: "MAYDAYMAY"'
    assert got[2].findings[0].detail.startswith("1 invisible/zero-width unicode character(s) detected (9.1% of input)")
    assert got[3].findings[0].detail.startswith("13 combining/diacritic characters detected (59.1% of input)")
    assert got[4].findings[0].detail.startswith("ROT23 (Caesar cipher) obfuscation detected.")
    assert got[0].decoded_payload.startswith(P)


def test_edge_rows(spark):
    texts = [None, "", "1234567", "12345678", "        ", "²send 5 ETH now", "ésend money", "send́ it",
             "jailbreak", "0Xdeadbeefdeadbeefdeadbeef", "QUJDREVGR0hJSktMTU5P===", "abcdefghijklmnopq"]
    got = _scan(spark, texts)
    assert [f.code for f in got[0].findings] == ["SCAN_ERROR"]
    assert [f.code for f in got[1].findings] == ["TOO_SHORT"]
    assert [f.code for f in got[2].findings] == ["TOO_SHORT"]
    assert [f.code for f in got[3].findings] == []
    assert got[4].risk_score == 0
    assert [f.code for f in got[5].findings] == []          # no \b between ² and s
    assert [f.code for f in got[6].findings] == []          # é is a word character
    assert [f.code for f in got[8].findings] == ["INJECTION_KEYWORD"]
    assert "HEX_PAYLOAD" not in [f.code for f in got[9].findings]   # 0X is not a hex prefix
    assert [f.code for f in got[10].findings] == []         # three '=' is no candidate
    assert "BASE64_PAYLOAD" not in [f.code for f in got[11].findings]  # 17 chars: length 1 mod 4


def test_three_blobs_malicious(spark):
    blobs = [base64.b64encode(f"hidden message number {i}".encode()).decode() for i in range(3)]
    got = _scan(spark, [" ".join(blobs), blobs[0] + " " + blobs[0]])
    assert got[0].verdict == "MALICIOUS"
    assert [f.code for f in got[1].findings].count("BASE64_PAYLOAD") == 1


def test_user_initiated_transfer_bypass(spark):
    got = _scan(spark, ["please send 5 ETH now", "please send 5 ETH now"], uit=[True, False])
    assert [f.code for f in got[0].findings] == []
    assert [f.code for f in got[1].findings] == ["UNVERIFIED_INTENT"]


def _py_b64(blob):
    try:
        raw = base64.b64decode(blob.replace("-", "+").replace("_", "/") + "=" * (-len(blob) % 4), validate=True)
    except Exception:
        return None
    t = raw.decode("utf-8", errors="replace")
    ok = sum(c.isprintable() for c in t) / max(len(t), 1) > 0.75 and len(t) >= 4
    return t if ok else None


def test_base64_decode_matches_python(spark):
    rnd = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
    blobs = []
    for _ in range(400):
        n = rnd.randint(16, 40)
        b = "".join(rnd.choice(alphabet) for _ in range(n)) + "=" * rnd.randint(0, 2)
        blobs.append(b)
    blobs += [base64.b64encode(("payload %d é" % i).encode()).decode() for i in range(50)]
    df = spark.createDataFrame([(b,) for b in blobs], "blob string")
    got = [r[0] for r in df.select(codecs.b64_decode_printable(F.col("blob"))).collect()]
    mism = [(b, g, _py_b64(b)) for b, g in zip(blobs, got) if g != _py_b64(b)]
    assert len(mism) <= 1, mism[:3]   # one allowed: Unicode version differences in isprintable


def test_rot_roundtrip(spark):
    df = spark.createDataFrame([("Narrow Bridge",), ("Plain Words Inside",)], "t string")
    out = df.select(codecs.rot_n(codecs.rot_n(F.col("t"), 13), 13).alias("a"), codecs.rot_n(F.col("t"), 26).alias("b"),
                    codecs.rot_n(codecs.rot_n(F.col("t"), 5), 21).alias("c")).collect()
    for (src,), r in zip([("Narrow Bridge",), ("Plain Words Inside",)], out):
        assert r.a == src and r.b == src and r.c == src


def test_fixture_totals_sf0001(spark):
    v = scan_messages(tables.messages(spark, SF0001)).cache()
    verdicts = {r.verdict: r["count"] for r in v.groupBy("verdict").count().collect()}
    assert verdicts == {"CLEAN": 46, "SUSPICIOUS": 52, "MALICIOUS": 21}
    per_code = {r.code: r.n for r in findings_table(v).groupBy("code").agg(F.countDistinct("msg_id").alias("n")).collect()}
    assert per_code == {"INJECTION_KEYWORD": 39, "BASE64_PAYLOAD": 28, "HIGH_ENTROPY_BLOB": 15, "HEX_PAYLOAD": 5,
                        "HEX_BLOB": 6, "MORSE_ENCODING": 6, "ROT13_OBFUSCATION": 6, "CAESAR_CIPHER": 7, "SCAN_ERROR": 6,
                        "INVISIBLE_UNICODE": 6, "ZALGO_COMBINING": 6, "UNVERIFIED_INTENT": 13, "TOO_SHORT": 4}
    scores = [r.risk_score for r in v.collect()]
    assert all(0 <= s <= 100 for s in scores)


def test_findings_sink_partitioned_by_severity(spark):
    import os
    import uuid

    from tripwire.operators.sinks import write_findings
    from tripwire.session import scratch_path
    v = scan_messages(tables.messages(spark, SF0001))
    path = scratch_path(spark, f"findings-{uuid.uuid4().hex}")
    write_findings(v, path)
    parts = sorted(p for p in os.listdir(path) if p.startswith("severity="))
    assert parts == ["severity=CRITICAL", "severity=HIGH", "severity=INFO", "severity=MEDIUM"]
    back = spark.read.parquet(path)
    assert back.count() == findings_table(v).count()
    assert back.where("severity = 'CRITICAL'").select("code").distinct().count() >= 1
