"""Collocations, lexical search and resharding: against SQL, brute force and by the laws that their results keep."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_llm_same import same

from tripwire.llm import collocations, lexical_search, resharding


# ------------------------------------------------------------------ collocations
def frame_of(docs):
    return docs.select("doc_id", "text", "lang").toPandas()


def phrase_docs(docs_of, seed=5):
    rnd = random.Random(seed)
    words = ["New", "york", "city", "of", "The", "a b", "zürich", "x\x00y", "-"]
    rows = []
    for i in range(120):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", " \t ", ". ", "\n", "\x0b", ","]) for _ in range(rnd.randrange(0, 60)))
        rows.append((i, text, rnd.choice(["en", "de", None])))
    rows += [(500 + i, "red green blue red green blue yellow", "en") for i in range(9)]
    rows += [(600, None, "en"), (601, "", None), (602, "...", "de"), (603, "red green " * 3000, "fr"), (500, "red green blue red green blue yellow", "en")]
    return docs_of(rows)


@pytest.mark.parametrize("at_once", [(1 << 19, 1 << 22), (3, 4)])
def test_phrases_equal_sql(spark, docs_of, sql, at_once):
    docs = phrase_docs(docs_of)
    slim = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    every, totals = collocations.frequent_phrases(slim.repartition(3), 5, 6, *at_once)
    got = collocations.scored(every, totals).drop("n").toPandas()
    want = sql(collocations.oracle("docs", least=6, top=10**9), docs=frame_of(docs))
    same(got, want.drop(columns=["rank", "n"]))
    assert len(got) > 30


def test_phrases_of_dense_and_sparse_tiles(spark, docs_of, sql, monkeypatch):
    """Small tiles: pairs fall into dense tiles counted either way, and into sparse ones."""
    monkeypatch.setattr(collocations, "SIDE", 2)
    monkeypatch.setattr(collocations, "DENSE_IDS", 4)
    rng = np.random.default_rng(3)
    prefix, word = rng.integers(1, 9, 5000), rng.integers(1, 9, 5000)
    got = Counter()
    for tile, cells, counts in collocations.tiled(prefix, word, 3):
        cells = collocations.unpacked_cells(tile, memory(collocations.packed_cells(tile, cells)))
        cells, counts = collocations.added(tile, iter([(cells, counts), (cells, counts)]))
        side = 4 // 2
        pairs = [(tile // side * 2 + c // 2, tile % side * 2 + c % 2) for c in cells] if tile >= 0 else cells.reshape(-1, 2).tolist()
        for pair, n in zip(pairs, counts):
            got[tuple(map(int, pair))] += int(n)
    assert got == Counter({k: 2 * n for k, n in Counter(zip(prefix.tolist(), word.tolist())).items()})


class memory:
    """What a binary Arrow value offers."""
    def __init__(self, raw):
        self.raw = raw

    def as_buffer(self):
        return pa.py_buffer(self.raw)


def test_stretches_and_runs_lose_no_phrase():
    rng = np.random.default_rng(4)
    for length in (2, 3, 4):
        words = rng.integers(0, 3, 300)
        phrases = np.where(rng.random(300) < 0.6, rng.integers(1, 9, 300), 0)
        phrases[-length + 1:] = 0
        before = Counter(zip(*(x.tolist() for x in collocations.pairs_of(words, phrases, length + 1))))
        after = Counter(zip(*(x.tolist() for x in collocations.pairs_of(*collocations.stretches(words, phrases, length), length + 1))))
        for c in (before, after):
            c.pop((0, 0), None)
        assert before == after and before
        assert np.array_equal(np.concatenate(list(collocations.runs(words, 7))), words)


def test_scores_beyond_64_bits(spark):
    n = 10**17 - 1
    every = spark.createDataFrame([("en", ["a"], 4 * 10**16 + 7), ("en", ["b"], 3 * 10**16 + 5), ("en", ["a", "b"], 2 * 10**16 + 3)], "lang string, words array<string>, f long")
    row = collocations.scored(every, spark.createDataFrame([("en", n)], "lang string, n long")).collect()[0]
    assert row.score == 1000 * (2 * 10**16 + 3) * n // ((4 * 10**16 + 7) * (3 * 10**16 + 5))


def test_phrases_of_nothing(spark, docs_of):
    assert collocations.collocations(docs_of([])).count() == 0
    assert collocations.collocations(docs_of([(1, None, "en"), (2, "", None), (3, "a b", "en")], extra=["rank", "n", "phrase"])).count() == 0


# ------------------------------------------------------------------ lexical search
def searched(docs, items, top=20):
    """By the rule, one document after the other."""
    def terms(text):
        out, word = [], ""
        for c in (text or "") + " ":
            if ord(c) > 127 or c.isascii() and c.isalnum():
                word += c.lower() if c.isascii() else c
            elif word:
                out.append(word)
                word = ""
        return out
    counted = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in docs) if t]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    rows = []
    for item, text in items:
        scores = []
        for d, c, n in counted:
            m = 75 + 25 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        rows += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return rows


SEARCH = [(i, " ".join(random.Random(i).choices(["alpha", "Beta", "gamma9", "ÉTÉ", "été", "x_y", "中文", "delta"], k=i % 13))) for i in range(60)]
SEARCH += [(90, None), (91, ""), (92, "!!"), (None, "alpha alpha"), (7, SEARCH[7][1]), (93, "alpha " * 20000), (94, "beta"), (95, "beta")]
ASKED = [(1, "Alpha beta BETA x"), (2, "y été"), (3, None), (4, ""), (5, "absent"), (6, "中文, gamma9 delta"), (1, "Alpha beta BETA x"), (7, "alpha")]


@pytest.mark.parametrize("postings", [1 << 20, 4])
def test_search_equals_the_rule(spark, docs_of, postings):
    docs = docs_of(SEARCH, extra=["score", "item_id"]).repartition(5)
    items = spark.createDataFrame(ASKED, "item_id long, text string")
    got = [tuple(r) for r in lexical_search.lexical_search(docs, items, top=6, postings=postings).collect()]
    assert sorted(map(str, got)) == sorted(map(str, searched(SEARCH, ASKED, 6)))


def test_search_equals_sql(spark, docs_of, sql):
    docs, items = docs_of(SEARCH), spark.createDataFrame(ASKED, "item_id long, text string")
    same(lexical_search.lexical_search(docs, items).toPandas(), sql(lexical_search.ORACLE, documents=docs.toPandas().astype({"doc_id": "Int64"}), benchmark=items.toPandas()))


def test_search_of_nothing(spark, docs_of):
    items = spark.createDataFrame(ASKED, "item_id long, text string")
    assert lexical_search.lexical_search(docs_of([]), items).count() == 0
    assert lexical_search.lexical_search(docs_of([(1, None), (2, "")]), items).count() == 0
    assert lexical_search.lexical_search(docs_of(SEARCH), items.limit(0)).count() == 0


# ------------------------------------------------------------------ resharding
def test_flow_moves_the_fewest_bytes():
    rnd = random.Random(2)
    for _ in range(60):
        n, m = rnd.randrange(1, 9), rnd.randrange(1, 9)
        supply = {i: rnd.randrange(0, 50) for i in range(n)}
        total = sum(supply.values())
        cuts = sorted(rnd.randrange(0, total + 1) for _ in range(m - 1))
        room = dict(enumerate(b - a + rnd.randrange(0, 3) for a, b in zip([0, *cuts], [*cuts, total])))
        flows = resharding.min_cost_flow(supply, room, lambda i, j: int(i != j))
        for i in supply:
            assert sum(v for (a, _), v in flows.items() if a == i) == supply[i]
        for j in room:
            assert sum(v for (_, b), v in flows.items() if b == j) <= room[j]
        # no plan moves less: at most min(supply, room) can stay
        assert sum(v for (i, j), v in flows.items() if i != j) == total - sum(min(supply[i], room.get(i, 0)) for i in supply)


def test_levels():
    assert resharding.levelled([0, 0, 90], [1.0] * 3, 30) == [15, 15, 0]
    assert resharding.levelled([0, 0], [1.0, 3.0], 40) == [10, 30]
    assert sum(resharding.levelled([5, 1, 7], [1.0, 1.0, 2.0], 101)) == 101


def shards_of(spark, path, shards, **more):
    return resharding.reshard(spark, path, shards, **more).select("shard", "slot", "row.*").toPandas()


def balanced(got, shards, spread):
    size = got["text"].map(lambda t: len(t.encode()) if t is not None else 0) + resharding.ROW_BYTES
    sums = size.groupby(got["shard"]).sum().reindex(range(shards), fill_value=0)
    assert sums.max() - sums.min() <= spread
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_shards_are_nearly_equal_and_whole(spark, docs_of, folder):
    rnd = random.Random(8)
    rows = [(i, "é" * int(2 ** rnd.uniform(0, 11))) for i in range(3000)] + [(None, None), (1, ""), (5000, "same"), (5000, "same")]
    rows += [(6000 + i, "copied text") for i in range(1500)]
    docs_of(rows, extra=["shard", "slot", "_old", "row"]).repartition(7).write.parquet(f"{folder}/docs")
    got = resharding.reshard(spark, f"{folder}/docs", 10).select("shard", "slot", "row.doc_id", "row.text").toPandas()
    balanced(got, 10, 40)
    plain = lambda d, t: (None if d is None or d != d else int(d), t)
    assert Counter(plain(d, t) for d, t in zip(got["doc_id"], got["text"])) == Counter(rows)


def test_equal_shards_keep_their_files(spark, docs_of, folder):
    """Files that have the right sizes already stay, and only the affected ones are rewritten."""
    for k in range(4):
        docs_of([(k * 100 + i, "x" * 50) for i in range(100 if k < 2 else 100 + 20 * (2 * k - 5))]).coalesce(1).write.mode("append").parquet(f"{folder}/docs/{k}")
    path, out = f"{folder}/docs/*", f"{folder}/out"
    got = resharding.reshard(spark, path, 4, out=out).select("shard", "slot", "row.doc_id").toPandas()
    assert sorted(got.groupby("shard").size()) == [100] * 4 and sorted(got["doc_id"]) == sorted(set(got["doc_id"]))
    manifest = {r.shard: r for r in spark.read.json(f"{out}/manifest").collect()}
    assert [manifest[k].rewritten for k in range(4)] == [False, False, True, True]
    assert set(got[got["shard"] == 0]["doc_id"]) == set(range(100))
    stays = got[(got["shard"] == 3)]
    assert (stays["doc_id"] >= 300).sum() == 100       # a shard with too much gives away only that


def test_shards_of_nothing_and_of_a_giant(spark, docs_of, folder):
    docs_of([]).write.parquet(f"{folder}/none")
    assert resharding.reshard(spark, f"{folder}/none", 4).count() == 0
    docs_of([(1, "x" * 10000)] + [(2 + i, "y" * 20) for i in range(90)]).write.parquet(f"{folder}/giant")
    got = shards_of(spark, f"{folder}/giant", 4)
    rest = got[got["doc_id"] > 1].groupby("shard").size()
    assert len(got) == 91 and sorted(rest) == [30, 30, 30]


def test_capacities(spark, docs_of, folder):
    docs_of([(i, "y" * 34) for i in range(600)]).repartition(3).write.parquet(f"{folder}/docs")
    got = shards_of(spark, f"{folder}/docs", [1.0, 2.0, 3.0])
    assert got.groupby("shard").size().tolist() == [100, 200, 300]
