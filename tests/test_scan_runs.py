"""Long runs are walked once; what is found in them equals what Python finds in the whole text."""
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tripwire.functions import stats
from tripwire.operators import detectors as D


def test_candidates_come_from_the_runs_as_from_the_text(spark):
    runs = ["a1" * 8, "QUJD" * 5 + "==", "/" + "QUJD" * 4, "-" * 16, "deadbeef" * 2, "x" + "0" * 15, "0x" + "ab" * 9, "é" + "ab" * 8,
            "ab" * 8 + "é", "k" * 30, "=" * 17, "9" * 15, "​" * 20, "z" * 15 + "\U0001f600" * 10]
    spaces = [" ", "\n", "\t", " ", " ", "\x1c", "\x85", "  ", " "]
    texts = [(s + x + s + y + e,) for s in spaces for x in runs for y in ("word", runs[4], runs[1]) for e in ("", s)]
    d = spark.createDataFrame([*texts, (None,), ("",), ("short words only",)], "_text string")
    made = D.add_entropy(D.add_hex(D.add_base64(d)))
    assert "_text_runs" in made.columns
    t = F.col("_text")
    wanted = made.select("_text", "_b64_c", "_hxb_r", "_ent_b", "_hx0_c", D.base64_candidates(t).alias("b"), D.hex_bare_raw(t).alias("h"), D.entropy_blobs(t).alias("e"),
                         F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(D.HEX0X_CANDIDATE), 1)), lambda h: ~F.length(h).isin(40, 64)).alias("x")).collect()
    assert len(wanted) == len(texts) + 3
    for r in wanted:
        assert (r["_b64_c"], r["_hxb_r"], r["_ent_b"], r["_hx0_c"]) == (r["b"], r["h"], r["e"], r["x"]), repr(r["_text"])


def test_entropy_of_few_and_of_many_code_points(spark):
    rnd = random.Random(5)
    blobs = ["", "a", "ab" * 40, "".join(rnd.choices("0123456789abcdef", k=500)), "".join(map(chr, range(0x4e00, 0x4e00 + stats.FEW + 1))) * 2,
             "".join(rnd.choices([chr(c) for c in range(0x1f600, 0x1f600 + stats.FEW)], k=900)), "à\n\x00a"]
    rows = spark.createDataFrame([(b,) for b in blobs], "b string")
    got = {r[0]: r[1:] for r in rows.select("b", stats.shannon_entropy(F.col("b")), stats.shannon_entropy(F.col("b"), 4.5)).collect()}
    for b in blobs:
        n = len(b)
        want = -sum(c / n * math.log2(c / n) for _, c in sorted(Counter(b).items()))
        assert math.isclose(got[b][0], want, abs_tol=1e-12)
        assert got[b][1] == got[b][0] or got[b][1] is None and want < 4.5
    assert got[blobs[3]][1] is None       # sixteen digits can't have 4.5 bits
