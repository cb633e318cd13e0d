"""Near-dedup, mixing and the pipeline: against brute force and SQL."""
import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_same import same
from tripwire.llm import bpe, mixing, near_dedup
from tripwire.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def classes(rows, similarity=0.8):
    """Every pair compared: the class of each text as the set of its row numbers."""
    sets = [near_dedup.shingles(h) for h in near_dedup.words_of([t or "" for _, t in rows], near_dedup.word_table())]
    counts = Counter(x for s, _ in sets for x in s.tolist())
    least = max(2, math.floor(near_dedup.RARE * len(rows)) + 1)
    common = [(x, n) for x, n in counts.items() if n >= least]
    weights = near_dedup.Weights(np.array([x for x, _ in common], np.uint64), np.array([n for _, n in common], np.int64), len(rows))
    weighted = [(s, weights(s, t)) for s, t in sets]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.weighted_jaccard(weighted[i], weighted[j]) >= similarity:
                label[find(i)] = find(j)
    out = defaultdict(set)
    for i in range(len(rows)):
        out[find(i)].add(i)
    return list(out.values())


def planted(seed=8):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(500)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy) if rng.random() < .6 else " ".join(copy).upper() + ".")
    return rows


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(4)
    sampler = near_dedup.Sampler(samples=2000)
    shingle = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    a, b = (shingle[:300], rng.uniform(1, 4, 300)), (shingle[100:], rng.uniform(1, 4, 300))
    b[1][:200] = a[1][100:] * rng.choice([1, 1, 1, 1.5], 200)
    samples = sampler.sample(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 300]))
    assert abs((samples[0] == samples[1]).mean() - near_dedup.weighted_jaccard(a, b)) < 0.05


def test_classes_against_all_pairs(docs_of):
    texts = planted()
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "?! --"), (903, "three words only"), (904, "Three, words only!"), (5, texts[5]), (None, texts[7]), (905, "w " * 20_000)]
    docs = docs_of(rows, extra=["text_key", "content", "label"])
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(rows)
    ids = [i for i, _ in rows]
    want = {}
    for members in classes(rows):
        first = min(ids[m] for m in members if ids[m] is not None)
        for m in members:
            want[ids[m]] = (first, len(members))
    assert {r.doc_id: (r.class_id, r.class_size) for r in got} == want
    assert any(n > 3 for _, n in want.values()) and want[902] == (900, 3) and want[904] == (903, 2)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    rest = near_dedup.without_near_duplicates(docs).select("row.*")
    assert rest.columns == docs.columns and sorted(r.doc_id for r in rest.collect()) == sorted({c for c, _ in want.values()})
    assert near_dedup.near_dedup(docs_of([])).count() == 0
    assert near_dedup.near_dedup(docs_of([(1, None)])).first().class_id == 1


def test_common_shingles_are_counted_exactly(docs_of):
    texts = ["one two three four five six", "one two three four five", "zero one two three four five", "other words stand in this text"] * 3
    docs = docs_of(list(enumerate(texts))).repartition(5)
    shingle, documents = near_dedup.common_shingles(docs, len(texts))
    counts = Counter()
    for h in near_dedup.words_of(texts, near_dedup.word_table()):
        counts.update(near_dedup.shingles(h)[0].tolist())
    assert dict(zip(shingle.tolist(), documents.tolist())) == counts


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (10, 11), (12, 11), (7, 7), *[(100 + i, 101 + i) for i in range(60)]]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[4] == 1 and got[12] == 10 and got[7] == 7 and {got[100 + i] for i in range(61)} == {100}


def test_mixture_against_sql(spark, docs_of, sql):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = lambda d, **k: mixing.mixture(d, **k).select("doc_id", "source", "tokens", "copy", "block", "position")
    same(plan(docs).toPandas(), sql(mixing.ORACLE, documents=docs.toArrow()))
    odd = docs_of([(1, "a b c", None, "s"), (1, "a b c", None, "s"), (2, None, None, None), (3, "", None, ""), (4, "x " * 400, None, "t"), (None, "n n", None, "t")], extra=["copy", "block"])
    same(plan(odd).toPandas(), sql(mixing.ORACLE, documents=odd.toArrow()))
    assert plan(odd.limit(0)).count() == 0
    rows = mixing.mixed(odd).collect()
    assert Counter(r.row.doc_id for r in rows) == Counter(r.doc_id for r in plan(odd).collect()) and {r.row.copy for r in rows} == {"x"}


def test_mixture_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 7 == 0, "b").otherwise("c"))
    whole = {r.source: r.n for r in mixing.mixture(docs, max_repeats=1.0).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    budget = 2 * sum(whole.values())
    taken = {r.source: r.n for r in mixing.mixture(docs, max_repeats=None, target_entropy=1.05, budget=budget).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    shares = np.array([taken[s] for s in "abc"]) / sum(taken.values())
    assert abs(sum(taken.values()) / budget - 1) < 0.05 and abs(-(shares * np.log(shares)).sum() - 1.05) < 0.01
    repeats = mixing.mixture(docs, max_repeats=3.0, budget=budget).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    assert max(r.n / whole[r.source] for r in repeats) < 3.05
    # every block holds the sources by weight
    per_block = mixing.mixture(docs, block_tokens=20_000).groupBy("block").pivot("source").agg(F.sum("tokens")).toPandas().set_index("block")
    shares = per_block.div(per_block.sum(axis=1), axis=0)
    assert len(shares) > 2 and (shares.max() - shares.min()).max() < 0.35


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(5000, "12 34 !", None, "src1", 7), (5001, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        after = spark.createDataFrame(after.collect(), after.schema)
        ids = Counter(r.doc_id for r in after.select("doc_id").collect())
        was = Counter(r.doc_id for r in before.select("doc_id").collect())
        if name != "BPE":
            assert after.columns == docs.columns
        if name == "language ID":
            assert was - ids == {5000: 1, 5001: 1}
        elif name == "line dedup":
            assert was == ids
        elif name == "near dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert set(ids) == {min(rows[m][0] for m in c) for c in classes(rows)}
        elif name == "mixing":
            assert set(ids) == set(was) and max(ids.values()) <= 3 > 1
        else:
            texts = {r.doc_id: r.text for r in before.collect()}
            assert ids == was
            assert all(r.n_tokens == len(bpe.codec().encode(texts[r.doc_id])) // 4 for r in after.collect())
        before = after
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_drops_a_passage_shared_by_two_unlike_documents(spark, docs_of):
    rng = random.Random(3)
    prose = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(3)]
    passage = "one passage of more than eight words that stands in two texts"
    edited = prose[2].split()
    edited[0] = "changed"
    rows = [(1, f"{prose[0]}\n{passage}"), (2, f"{passage}\n{prose[1]}"), (3, f"{prose[2]}\nread more"), (4, f"{' '.join(edited)}\nread more")]
    got = {r.doc_id: r for r in corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_lines(spark, docs_of(rows), SF), SF).collect()}
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: prose[1], 3: rows[2][1]}
    assert all(r.n_chars == len(r.text) for r in got.values())
