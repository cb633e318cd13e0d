"""Ranked lexical search, reversed: documents stream through an index of the items.

The items are few, the documents many.  An inverted index over the items' terms
is broadcast; each document's term counts go through it once and add to the
scores of the items that share a term; each task keeps a bounded heap an item,
and the heaps of all tasks are merged.  Documents are never indexed, shuffled or
joined: what leaves a task is at most ``top`` rows an item.

Items are taken in blocks whose index has a bounded number of postings, one
block after the other, so neither the broadcast nor a task's scores grow with
the number of items.  Two scans of the texts serve a block: one for the counts
that weights need, one for the scores.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm.common import arrow_batch, slices, table, written

TOP = 20
POSTINGS = 1 << 20          # term occurrences in the items of one block, about; a longer item is a block's only one
SCORE_CELLS = 1 << 20       # scores held at once in a task: documents of a slice times items of a block
MERGES = 16                 # heaps of an item are merged in so many parts first
#: ASCII other than digits and letters parts terms; A-Z are lower-cased; all other characters belong to terms.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

COUNTED = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("documents", T.LongType()), T.StructField("terms", T.LongType())])
FOUND = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("task", T.LongType())])


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order, in UTF-8; none for a null."""
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split() if text else []


class ItemIndex:
    """Postings of the items' terms: for each term the items that hold it, and how often."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.keys = [key for key, _ in items]
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for place, (_, terms) in enumerate(items):
            for term, times in Counter(terms).items():
                postings.setdefault(term, []).append((place, times))
        self.vocabulary = {term: i for i, term in enumerate(postings)}
        sizes = np.fromiter(map(len, postings.values()), np.int64, len(postings))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = [p for group in postings.values() for p in group]
        self.items = np.fromiter((p[0] for p in flat), np.int64, len(flat))
        self.times = np.fromiter((p[1] for p in flat), np.int64, len(flat))
        self.weights = np.zeros(len(postings), np.int64)

    def scores(self, document: np.ndarray, term: np.ndarray, points: np.ndarray, documents: int) -> np.ndarray:
        """Documents x items, from the documents' matches: places of document and term, and the term's points."""
        sizes = self.starts[term + 1] - self.starts[term]
        of = np.repeat(np.arange(len(term)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[term][of]
        out = np.zeros(documents * len(self.keys), np.int64)
        np.add.at(out, document[of] * len(self.keys) + self.items[at], points[of] * self.times[at])
        return out.reshape(documents, len(self.keys))


class Heaps:
    """For each item the best documents so far: highest score, then smallest id, a null id last."""

    def __init__(self, items: int, top: int):
        self.top, self.heaps, self.least = top, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        for d, i in zip(*np.nonzero(scores >= self.least)):
            doc, heap = ids[d], self.heaps[i]
            entry = (int(scores[d, i]), doc is not None, -doc if doc is not None else 0)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for i, heap in enumerate(self.heaps):
            for score, known, minus in heap:
                yield i, -minus if known else None, score


def term_counts(docs: DataFrame, index: ItemIndex) -> tuple[int, int, dict[int, int]]:
    """How many documents have a term, how many terms they have, and the documents of each term of the index."""
    held = docs.sparkSession.sparkContext.broadcast(index.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, holding, documents, total = held.value, Counter(), 0, 0
        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                terms = terms_of(text)
                documents += bool(terms)
                total += len(terms)
                holding.update(vocabulary.keys() & set(terms))
        yield arrow_batch(COUNTED, [[-1, *[vocabulary[t] for t in holding]], [documents, *holding.values()], [total, *[0] * len(holding)]])

    sums = docs.mapInArrow(run, COUNTED).groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()   # a row a term of the index
    held.destroy()
    by_term = {r.term: r for r in sums}
    all_ = by_term.pop(-1, None)
    return (all_.documents, all_.terms, {t: r.documents for t, r in by_term.items()}) if all_ else (0, 0, {})


def search_block(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame | None:
    """``item``, ``rank``, ``doc_id``, ``score`` of the items of one block."""
    index = ItemIndex(items)
    documents, length, holding = term_counts(docs, index)
    if not documents:
        return None
    for term in range(len(index.weights)):
        index.weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(term, 0) + 1)))
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        heaps = Heaps(len(index.keys), top)
        for batch in slices(batches, rows=max(1, min(512, SCORE_CELLS // len(index.keys)))):
            document, term, times, norm = [], [], [], []
            for d, text in enumerate(batch.column(1).to_pylist()):
                terms = terms_of(text)
                own = Counter(filter(index.vocabulary.__contains__, terms))
                document += [d] * len(own)
                term += map(index.vocabulary.__getitem__, own)
                times += own.values()
                norm += [75 + 25 * len(terms) * documents // length] * len(own)
            if term:
                document, term, times, norm = (np.array(x, np.int64) for x in (document, term, times, norm))
                points = index.weights[term] * ((1_000_000_000 * times) // (1000 * times + 12 * norm))
                heaps.add(index.scores(document, term, points, batch.num_rows), batch.column(0).to_pylist())
        rows = list(heaps.rows())
        if rows:
            place, doc, score = zip(*rows)
            yield arrow_batch(FOUND, [[index.keys[p] for p in place], doc, score, [TaskContext.get().partitionId()] * len(rows)])

    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = docs.mapInArrow(run, FOUND)
    part = found.withColumn("part", F.pmod("task", F.lit(MERGES))).withColumn("_place", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best)))
    merged = part.filter(F.col("_place") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best)))
    return merged.filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                   top: int = TOP, postings: int = POSTINGS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each item's ``top`` documents of the highest scores above 0.

    Equal scores go by ascending document id, a null id last.  Null and empty
    texts, of documents or items, have no terms: they count nowhere and have no
    rows.  Whole texts count, however long.  Repeated rows of ``docs`` are
    documents of their own; a repeated item has one answer a row.  Empty tables
    give no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = written(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("text IS NOT NULL")
                    .withColumn("size", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")).filter("size > 0"), "search-items")
    blocks = max(1, math.ceil((asked.agg(F.sum("size")).first()[0] or 0) / postings))
    out = []
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").collect()      # of bounded size
        if mine:
            found = search_block(slim, [(n, terms_of(r.text)) for n, r in enumerate(mine)], top)
            if found is not None:
                names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(mine)], "item long, item_id long")
                named = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
                out.append(named if blocks == 1 else written(named, "search-block"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate({text}, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_terms('text')} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT d, doc_id, len(terms)::BIGINT AS n, terms FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS length FROM sized),
counts AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM sized) GROUP BY ALL),
holding AS (SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY term),
asked AS (SELECT i, item_id, term, count(*)::BIGINT AS times
          FROM (SELECT row_number() OVER () AS i, item_id, unnest({_terms('text')}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
weighed AS (SELECT i, item_id, term, times, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM asked JOIN holding USING (term), totals),
scored AS (
  SELECT i, item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // length))))::BIGINT AS score
  FROM weighed JOIN counts USING (term) JOIN sized USING (d), totals GROUP BY i, item_id, d, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
