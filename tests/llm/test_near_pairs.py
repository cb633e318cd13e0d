"""Near-duplicates against all pairs, with shingles, weights and similarities written anew."""
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripwire.llm import near_dedup


def words(text):
    out = []
    for token in (text or "").split():
        word = token.lower()
        while word and not (word[0].isalnum() or word[0] == "_"):
            word = word[1:]
        while word and not (word[-1].isalnum() or word[-1] == "_"):
            word = word[:-1]
        if word:
            out.append(word)
    return out


def components(rows, similarity):
    """Sets of ids linked by a weighted Jaccard of at least ``similarity``."""
    sets = []
    for _, text in rows:
        w = words(text)
        k = min(5, len(w))
        sets.append(Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter())
    df, n = Counter(s for c in sets for s in c), len(rows)
    least = max(2, math.floor(1e-3 * n) + 1)
    idf = lambda s: math.log(n / max(df[s], n * 1e-3)) / math.log(1e3) if df[s] >= least else 1.0
    weights = [{s: (1 + math.log(t)) * (1 + idf(s)) for s, t in c.items()} for c in sets]
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, j in itertools.combinations(range(n), 2):
        a, b = weights[i], weights[j]
        shared = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
        if (not a and not b) or (a and b and shared / (sum(a.values()) + sum(b.values()) - shared) >= similarity):
            label[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), set()).add(doc)
    return {frozenset(g) for g in groups.values()}


def edited(rnd, base, share):
    return " ".join(rnd.choice(VOCABULARY) if rnd.random() < share else w for w in base)


VOCABULARY = [f"w{i}" for i in range(5000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_one_large_group_of_near_copies(docs_of, seed):
    """A third of the rows are copies of one text with more or fewer edits; other groups are small."""
    rnd = random.Random(seed)
    base = rnd.choices(VOCABULARY, k=220)
    rows = [(i, edited(rnd, base, rnd.choice([0, 0.004, 0.008, 0.012, 0.02, 0.05]))) for i in range(150)]
    for g in range(25):
        own = rnd.choices(VOCABULARY, k=rnd.randrange(4, 90))
        rows += [(1000 + 10 * g + k, edited(rnd, own, 0.01)) for k in range(rnd.randrange(1, 6))]
    rows += [(3000 + i, " ".join(rnd.choices(VOCABULARY, k=rnd.randrange(1, 60)))) for i in range(150)] + [(4000, None), (4001, ""), (4002, "!!! ...")]
    got = {}
    for r in near_dedup.near_dedup(docs_of(rows).repartition(4)).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(g) for g in got.values()} == components(rows, 0.8)


def test_the_pivot_of_a_group_is_its_centre(docs_of):
    """Copies with different edits are compared with the text that has none: links grow with the group, not with its square."""
    rnd = random.Random(3)
    base = rnd.choices(VOCABULARY, k=300)
    rows = [(i, edited(rnd, base, 0.012)) for i in range(400)] + [(999, " ".join(base))]
    rows += [(1000 + i, " ".join(rnd.choices(VOCABULARY, k=40))) for i in range(400)]
    compared = []
    real = near_dedup.verified

    def counted(pairs, texts, held):
        compared.append(pairs.count())
        return real(pairs, texts, held)
    near_dedup.verified = counted
    try:
        sizes = Counter(r.class_id for r in near_dedup.near_dedup(docs_of(rows)).collect())
    finally:
        near_dedup.verified = real
    print(compared, sizes.most_common(3))
    assert max(sizes.values()) > 200 and sum(compared) < 8 * 400


def test_a_pair_of_several_buckets_is_made_once(spark):
    """Every pair of different classes in reach, whichever buckets it shares, and each once."""
    rnd = random.Random(4)
    label = {m: rnd.choice("aaab") if m % 3 else f"own{m}" for m in range(40)}
    buckets = {m: sorted(rnd.sample(range(6), rnd.randrange(1, 6))) for m in label}
    rows = [(b, m, buckets[m], 9.0 if m % 7 else 1.0, 10.0, label[m]) for m in label for b in buckets[m]]
    largest = {b: max(Counter(r[5] for r in rows if r[0] == b).items(), key=lambda x: x[::-1])[0] for b in range(6)}
    named = spark.createDataFrame([(*r, largest[r[0]]) for r in rows], "bucket long, member long, buckets array<long>, shared double, total double, label string, largest string")
    got = [tuple(r) for r in near_dedup.open_pairs(named, 100, 0.8).select("pivot", "member").collect()]
    want = {(a, b) for a, b in itertools.combinations(label, 2) if label[a] != label[b] and a % 7 and b % 7 and set(buckets[a]) & set(buckets[b])}
    assert len(got) == len(set(got)) and set(got) == want


def test_words_by_whole_arrays_equal_words_one_by_one():
    """Marks at ends, white space beyond ASCII, letters that change when lowered, and words and texts longer than what is hashed at once."""
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("abΣσς İıß'.,!\n\x85\x1c\u3000_19日é²½\U0001f600-\x00 \t", k=rnd.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "...", "x" * 1000 + " " + "y" * 1000 + "x" + " ab " * 100, "y" * 1000, "x" * 1000]
    table = near_dedup.WordTable(100)
    before, near_dedup.PIECE_CHARS = near_dedup.PIECE_CHARS, 50
    try:
        got = list(near_dedup.words_of(texts, table))
    finally:
        near_dedup.PIECE_CHARS = before
    hashes, words_of_hash = {}, {}
    for text, found in zip(texts, got, strict=True):
        for word, h in zip(words(text), found.tolist(), strict=True):
            assert hashes.setdefault(word, h) == h and words_of_hash.setdefault(h, word) == word


def test_only_rows_that_may_go_are_shuffled(spark, docs_of):
    """Rows that are certain to stay aren't among those that are grouped; of repeated rows one stays."""
    rnd = random.Random(8)
    base = rnd.choices(VOCABULARY, k=80)
    rows = [(i, " ".join(rnd.choices(VOCABULARY, k=40))) for i in range(300)] + [(900 + i, edited(rnd, base, 0.005)) for i in range(5)] + [(7, None), (7, None), (None, "a b c"), (None, "a b c")]
    rows[1] = (1, rows[0][1])
    grouped = []
    real = near_dedup.passes

    def counted(rows, screen, keys, flag, *bits):
        out = real(rows, screen, keys, flag, *bits)
        grouped.append((flag, out.filter(flag).count()))
        return out
    near_dedup.passes = counted
    try:
        kept = [tuple(r) for r in near_dedup.without_near_duplicates(docs_of(rows)).select("row.doc_id", "row.text").collect()]
    finally:
        near_dedup.passes = real
    every = {}
    for r in near_dedup.near_dedup(docs_of(rows)).filter("kept").collect():
        every.setdefault((r.doc_id, bytes(r.text_key)), r)
    assert len(kept) == len(set(kept)) == len(every) and sum(i is None for i, _ in kept) == 1 and sum(i == 7 for i, _ in kept) == 2
    assert dict(grouped)["shared"] <= 12
    assert docs_of(rows).filter(F.col("doc_id") == 7).count() == 3
