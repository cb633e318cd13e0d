"""Seeded property tests: encoded payloads are found and decoded back; scores stay in range."""

import base64
import random
import string

from tripwire.operators.scan import scan_messages


def test_roundtrip_and_score_range(spark):
    rnd = random.Random(11)
    alphabet = string.ascii_letters + string.digits + " "
    rows, expect = [], {}
    for i in range(120):
        plain = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(12, 60))).strip() or "payload text"
        kind = i % 3
        if kind == 0:
            text = "data " + base64.b64encode(plain.encode()).decode()
        elif kind == 1:
            text = "value 0x" + plain.encode().hex()
        else:
            text = "noise " + "".join(rnd.choice(alphabet + ".,!?") for _ in range(rnd.randint(0, 80)))
        rows.append((i, text))
        expect[i] = (kind, plain)
    df = spark.createDataFrame(rows, "msg_id long, text string")
    got = {r.msg_id: r for r in scan_messages(df).collect()}
    for i, (kind, plain) in expect.items():
        r = got[i]
        assert 0 <= r.risk_score <= 100
        assert r.verdict == ("MALICIOUS" if r.risk_score >= 60 else "SUSPICIOUS" if r.risk_score >= 25 else "CLEAN")
        assert r.risk_score == min(100, sum({"CRITICAL": 40, "HIGH": 25, "MEDIUM": 12, "LOW": 5}.get(f.severity, 0)
                                            for f in r.findings))
        decoded = [f.decoded for f in r.findings]
        if kind == 0:
            assert plain in decoded and r.decoded_payload == plain
        elif kind == 1 and len(plain.encode().hex()) >= 8 and len(plain.encode().hex()) not in (40, 64):
            codes = [f.code for f in r.findings]
            assert "HEX_PAYLOAD" in codes and plain in decoded
