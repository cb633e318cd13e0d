"""Language ID, quality, nearest neighbours: against brute force and on held-out rows."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm import ann, language_id, quality

SF = "/root/testdata/sf0.01"


STRINGS = {"▁a": 0, "a": 1, "ab": 2, "b": 3}
Small = language_id.Pieces(STRINGS, 4)


def every_cut(word, probabilities):
    total = np.zeros(probabilities.shape[1])
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(word[start:i])
                start = i
        ids = [STRINGS.get(p, Small.other if len(p) == 1 else -1) for p in parts]
        if -1 not in ids:
            total += np.prod(probabilities[ids], axis=0)
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    probabilities = rng.dirichlet(np.ones(5), 3).T
    words = ["▁a", "▁ab", "▁aabb", "▁abcab", "▁x", "▁abababab"]
    want = np.log([every_cut(w, probabilities) for w in words])
    assert np.allclose(language_id.word_scores(words, probabilities, Small), want)
    assert np.allclose(language_id._long_word("▁abcab", np.log(probabilities), Small), want[3])
    long = "▁" + "ab" * 100
    assert np.allclose(language_id.word_scores([long], probabilities, Small)[0], language_id._long_word(long, np.log(probabilities), Small))


def test_expected_counts():
    probabilities = np.array([[.2], [.3], [.1], [.25], [.15]])
    # the only ways to cut it: ▁a|b and, with the character for others, ▁|ab and ▁|a|b
    weights = {(0, 3): .2 * .25, (4, 2): .15 * .1, (4, 1, 3): .15 * .3 * .25}
    total, want = sum(weights.values()), np.zeros(5)
    for ids, w in weights.items():
        for i in ids:
            want[i] += 2 * w / total
    assert np.allclose(language_id.expected_counts(["▁ab"], np.array([2.0]), probabilities, Small), want)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(docs_of):
    train = [(i, "the cat and the dog", "en") for i in range(12)] + [(20 + i, "der hund und die katze", "de") for i in range(12)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 !!", "de"), (103, "the dog", None), (104, "x" * 30_000, None), (None, "und die", None), (103, "the dog", None)]
    docs = docs_of(train + odd, extra=["score", "held_out"])
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "en" and got[None].lang_pred == "de"
    kept = language_id.identified(docs, language_id.fitted(docs))
    assert kept.columns == docs.columns and kept.filter("doc_id in (100, 101, 102)").count() == 0 and kept.filter("doc_id = 103").count() == 2
    assert language_id.language_id(docs_of([])).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs_of([(1, "text"), (2, None)])).collect()} == {"und"}


def test_discriminant_formula():
    rng = np.random.default_rng(2)
    d = len(quality.STATISTICS)
    x = [rng.normal(size=(60, d)), rng.normal(1, 2, size=(90, d))]
    model = quality.Discriminant(np.array([60.0, 90.0]), np.array([v.sum(axis=0) for v in x]), np.array([v.T @ v for v in x]))
    spread = [np.cov(v.T, bias=True) for v in x]
    pooled = (60 * spread[0] + 90 * spread[1]) / 150
    point, logs = rng.normal(size=d), []
    for c, share in ((0, .4), (1, .6)):
        s = (1 - quality.POOLED_SHARE - quality.SPHERE_SHARE) * spread[c] + quality.POOLED_SHARE * pooled + quality.SPHERE_SHARE * np.trace(pooled) / d * np.eye(d)
        off = point - x[c].mean(axis=0)
        logs.append(math.log(share) - .5 * np.linalg.slogdet(s)[1] - .5 * off @ np.linalg.solve(s, off))
    assert np.isclose(model.score(point[None])[0], 1 / (1 + math.exp(logs[0] - logs[1])))


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = {c: np.mean([r.predicted == c for r in rows if r.quality == c]) for c in (0, 1)}
    assert min(right.values()) > 0.9


def test_quality_edges(spark, docs_of):
    labels = spark.createDataFrame([(i, int(i > 15), 0) for i in range(30)] + [(1, None, None), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of([(i, "good words in a row." if i > 15 else "BAD BAD BAD !!! ###") for i in range(30)] + [(50, None), (51, ""), (51, ""), (None, "a"), (52, "w " * 50_000)],
                   extra=["score", "quality", "letters"])
    got = quality.quality(docs, labels).collect()
    assert len(got) == 35 and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got)
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id < 16} == {0} and {r.predicted for r in got if r.doc_id in range(16, 30)} == {1}
    assert {round(r.score, 6) for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def brute(rows, modulus, nearest):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in (i for i in good if i % modulus == 0):
        scored = [(-(good[q] * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((good[q] * good[q]).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
        out[q] = [(i, -s) for s, i in sorted(scored)[:nearest]]
    return out


@pytest.mark.parametrize("shard_rows", [8192, 100])
def test_nearest_recall(spark, shard_rows):
    rows = [(r.vec_id, list(r.embedding), "x") for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, 50, 5)
    found = {}
    for r in ann.nearest_neighbours(spark.createDataFrame(rows, VECTORS), shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert found.keys() == want.keys()
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.95
    assert all(dict(w)[i] == pytest.approx(s, abs=1e-12) for q, w in want.items() for i, s in found[q] if i in dict(w))


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [0.0, 1.0], "x"), (50, [0.0, 0.0], "x"), (100, None, "x"), (4, [nan, 1.0], "x"),
            (5, [inf, 1.0], "x"), (6, [None, 1.0], "x"), (7, [], "x"), (None, [1.0, 1.0], "x"), (150, [1.0, 2.0, 3.0], "x"), *[(200 + i, [3.0, 4.0], "x") for i in range(40)]]
    got = {}
    for r in ann.nearest_neighbours(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 200, 201, 202]          # equal vectors and scores: the smaller ids
    assert got[200] == [201, 202, 203, 204, 205] and 150 not in got and 50 not in got
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert [r.vec_id for r in ann.nearest_neighbours(few).collect()] == [1]
    assert ann.nearest_neighbours(few.limit(0)).count() == 0
    assert ann.nearest_neighbours(few.filter(F.col("vec_id") == 1)).count() == 0
