"""Near-dedup: improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles.  Improved consistent
weighted sampling draws from it a fixed number of samples that two texts share
with a probability of their weighted Jaccard similarity; bands of samples that
agree make candidates, and each candidate is verified by the exact weighted
Jaccard similarity of the whole texts.

Weights: (1 + ln tf) * (1 + idf), where idf falls from 1, for shingles in at
most ``RARE`` of all documents, to 0 for those in all.  Only shingles above
that share need a count, and there are at most (mean shingles a text) / RARE of
them, so their table is bounded and broadcast.  They are found in two passes: a
sketch of fixed size over all shingles, summed over tasks in a tree, names the
cells that can hold one; then the shingles of those cells are counted exactly.

Texts are read once: the pass that makes the sketches also writes each text's
words as hashes, which all later passes read.

A bucket's members aren't paired with each other.  They are compared with the
bucket's most central member, the one with the least of its weight on rare
shingles: of a large group of near copies the one with the fewest edits, which
all others are nearer to than to each other.  Those left outside its class are
compared, as further pivots, in rounds of more and more pivots, until every
pair of a bucket is compared, known to be in one class, or out of reach: two
texts can't be more similar than the shingles that they share with any other
text of such buckets allow.  A pair that meets in several buckets is made in
the first of them alone.  Texts of equal words are one node.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm.common import arrow_batch, held_alone, salted_join, settled, slices, table, written
from tripwire.llm.components import connected_components
from tripwire.llm.sieve import passes, sieve

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_SAMPLES = 14, 4     # a pair at the threshold shares a band with probability 0.999
RARE = 1e-3
SKETCH_CELLS, SKETCH_BLOCKS = 1 << 22, 32
SLOTS = 1 << 15                 # rows of the table of random numbers
CHUNK = 48                      # members verified against one pivot in a task, about
FANIN = 64                      # sketches added in a task
FLUSH = 2_000_000
USUAL_WEIGHT = 2.0              # of a rare shingle that occurs once
PIECE_CHARS = 1 << 18           # characters whose words are hashed at once, about
WORD_BASE = 0x2545F4914F6CDD1D  # fixed value: the base of word hashes, odd
FIRST_PIVOTS, MORE_PIVOTS = 16, 16     # of a bucket in the first round, and how many times more in each further one
PRUNINGS = 2
COPY_BITS = 1 << 25             # of the bitmap of rows in classes of several, 4 MB
SPACE = re.compile(r"\s")
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))     # fixed values: multipliers of a 64-bit finalizer

SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.BinaryType()), T.StructField("content", T.BinaryType()),
                       T.StructField("rare", T.DoubleType()), T.StructField("buckets", T.ArrayType(T.LongType()))])
WORDED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.BinaryType()), T.StructField("content", T.BinaryType()),
                       T.StructField("words", T.BinaryType()), T.StructField("block", T.IntegerType()), T.StructField("task", T.LongType()), T.StructField("cells", T.BinaryType())])
SKETCHED = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("task", T.LongType()), T.StructField("cells", T.BinaryType())])
COUNTED = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("documents", T.LongType())])
WEIGHED = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingle", T.LongType()), T.StructField("weight", T.DoubleType()),
                        T.StructField("total", T.DoubleType())])
VERIFIED = T.StructType([T.StructField("pivot", T.BinaryType()), T.StructField("member", T.BinaryType()), T.StructField("similarity", T.DoubleType())])


def _mix(x: np.ndarray) -> np.ndarray:
    for m in MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


class WordTable:
    """What hashing words needs: of every code point 0 for white space, 1 for a mark, 2 for a character of words; powers of the base, and of its inverse."""

    def __init__(self, places: int):
        code_points = range(sys.maxunicode + 1)
        self.kinds = np.fromiter((0 if (c := chr(i)).isspace() else 2 if c.isalnum() or c == "_" else 1 for i in code_points), np.uint8, len(code_points))
        up, down = np.full(places, WORD_BASE, np.uint64), np.full(places, pow(WORD_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


@held_alone
def word_table(places: int = 2 * PIECE_CHARS) -> WordTable:
    """The worker's table."""
    return WordTable(places)


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """The lower-cased texts with their places, about ``PIECE_CHARS`` characters at a time; long texts are cut where white space is."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            stop = len(text)
            if stop - at > PIECE_CHARS and (space := SPACE.search(text, at + PIECE_CHARS)):
                stop = space.end()
            piece = text[at:stop].lower()
            if held and size + len(piece) > PIECE_CHARS:
                yield held
                held, size = [], 0
            held.append((i, piece))
            size += len(piece) + 1
            at = max(stop, 1)
    if held:
        yield held


def _hashes_in(text: str, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """The places and the hashes of the words of a lower-cased text: what stands between white space, without marks at its ends."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = words.kinds[code]
    inner = np.flatnonzero(kind == 2)
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    token = np.cumsum(kind == 0, dtype=np.int32)[inner]
    last = np.flatnonzero(np.append(token[1:] != token[:-1], True))
    first = inner[np.append(0, last[:-1] + 1)]
    end = inner[last] + 1
    up, down = words.up, words.down
    if len(code) < len(up):
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * up[:len(code)], out=sums[1:])
        hashes = (sums[end] - sums[first]) * down[first]
    else:       # a word longer than a piece
        hashes = np.empty(len(first), np.uint64)
        for i, (a, b) in enumerate(zip(first.tolist(), end.tolist())):
            total, factor = 0, 1
            for start in range(a, b, len(up)):
                some = code[start:min(b, start + len(up))]
                total += factor * int((some * up[:len(some)]).sum())
                factor = factor * int(up[-1]) * WORD_BASE
            hashes[i] = total % (1 << 64)
    return first, _mix(hashes + (end - first).astype(np.uint64) * MIX[1])


def words_of(texts: list[str], words: WordTable) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    parts: list[np.ndarray] = []
    of = 0
    for some in _pieces(texts):
        first, hashes = _hashes_in("\n".join(piece for _, piece in some), words)
        starts = np.cumsum([0] + [len(piece) + 1 for _, piece in some])
        cuts = np.searchsorted(first, starts).tolist()
        for (i, _), a, b in zip(some, cuts, cuts[1:]):
            if i != of:
                yield parts[0] if len(parts) == 1 else np.concatenate(parts)
                of, parts = i, []
            parts.append(hashes[a:b])
    if parts:
        yield parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingles(words: np.ndarray, length: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each occurs; a shorter text is one shingle, one without words none."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = min(length, len(words))
    out = np.full(len(words) - length + 1, length, np.uint64)
    for i in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - length + 1 + i]
    return np.unique(_mix(out), return_counts=True)


class Weights:
    """Shingle weights from the counts of the shingles that aren't rare."""

    def __init__(self, shingle: np.ndarray, documents: np.ndarray, total: int):
        order = np.argsort(shingle)
        self.shingle = shingle[order]
        self.idf = np.log(total / np.maximum(documents[order], total * RARE)) / math.log(1 / RARE)

    def _find(self, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shingles aren't rare, and their places."""
        if not len(self.shingle):
            return np.zeros(len(shingle), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
        found = self.shingle[at] == shingle
        return found, at[found]

    def __call__(self, shingle: np.ndarray, times: np.ndarray) -> np.ndarray:
        idf = np.ones(len(shingle))
        found, at = self._find(shingle)
        idf[found] = self.idf[at]
        return (1 + np.log(times)) * (1 + idf)

    def rare(self, shingle: np.ndarray) -> np.ndarray:
        return ~self._find(shingle)[0]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (ascending shingles, weights); two empty sets are equal."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


class Sampler:
    """Improved consistent weighted sampling; a shingle's random numbers come from a table row chosen by its hash, another for each sample."""

    def __init__(self, samples: int = BANDS * BAND_SAMPLES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.samples = samples
        self.r = rng.gamma(2, 1, (samples, SLOTS)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, (samples, SLOTS))).astype(np.float32)
        self.beta = rng.uniform(0, 1, (samples, SLOTS)).astype(np.float32)
        self.spread = rng.integers(1 << 62, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)
        self.shift = np.uint64(64 - int(math.log2(SLOTS)))
        # most shingles are rare and occur once: for their weight the keys are a table too
        self.usual = np.float32(math.log(USUAL_WEIGHT))
        self.usual_key = self._keys(self.usual, self.r, self.log_c, self.beta)[0]

    @staticmethod
    def _keys(log_weight, r: np.ndarray, log_c: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys, of which the smallest is drawn, and the levels of the weights."""
        level = np.floor(log_weight / r + beta)
        return log_c - r * (level - beta + 1), level

    def sample(self, shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For texts that begin at ``starts`` (none empty) one 64-bit sample for each number: rows texts, columns samples."""
        log_weight = np.log(weight).astype(np.float32)
        other = np.flatnonzero(log_weight != self.usual)
        other_weight = log_weight[other]
        lengths = np.diff(np.append(starts, len(shingle)))
        out = np.empty((len(starts), self.samples), np.uint64)
        for k in range(self.samples):
            slot = (shingle * self.spread[k]) >> self.shift
            key = self.usual_key[k][slot]
            some = slot[other]
            key[other] = self._keys(other_weight, self.r[k][some], self.log_c[k][some], self.beta[k][some])[0]
            hit = np.flatnonzero(key == np.repeat(np.minimum.reduceat(key, starts), lengths))
            first = hit[np.searchsorted(hit, starts)]
            at = slot[first]
            level = self._keys(log_weight[first], self.r[k][at], self.log_c[k][at], self.beta[k][at])[1]
            out[:, k] = _mix(shingle[first] + level.astype(np.int64).view(np.uint64) * MIX[0])
        return out


def band_keys(samples: np.ndarray, rows: int = BAND_SAMPLES) -> np.ndarray:
    """One bucket key a band."""
    keys = np.zeros((len(samples), samples.shape[1] // rows), np.uint64)
    for band in range(keys.shape[1]):
        keys[:, band] = band + 1
        for k in range(rows):
            keys[:, band] = _mix(keys[:, band] * MIX[1] + samples[:, band * rows + k])
    return keys


def words_in(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each row of a binary column."""
    for raw in column:
        yield np.frombuffer(raw.as_buffer(), np.uint64)


def _cells(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - int(math.log2(SKETCH_CELLS)))).astype(np.int64)


class Joined:
    """Shingles of many documents, joined to arrays of about ``FLUSH`` shingles."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, shingle: np.ndarray) -> Iterator[np.ndarray]:
        self.held.append(shingle)
        self.size += len(shingle)
        if self.size >= FLUSH:
            yield from self.rest()

    def rest(self) -> Iterator[np.ndarray]:
        if self.size:
            yield np.concatenate(self.held)
        self.held, self.size = [], 0


def worded(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``text_key``, ``content`` (the digest of its words) and ``words`` (their hashes) of every row, and the sketches of all tasks."""
    per_block = SKETCH_CELLS // SKETCH_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, joined, cells = word_table(), Joined(), np.zeros(SKETCH_CELLS, np.uint32)
        for batch in slices(batches):
            contents, raw, none = [], [], [None] * batch.num_rows
            for hashes in words_of([t or "" for t in batch.column(1).to_pylist()], words):
                raw.append(hashes.tobytes())
                contents.append(hashlib.md5(raw[-1]).digest())
                for shingle in joined.add(shingles(hashes)[0]):
                    cells += np.bincount(_cells(shingle), minlength=SKETCH_CELLS).astype(np.uint32)
            yield arrow_batch(WORDED, [batch.column(0), batch.column(2), contents, raw, none, none, none])
        for shingle in joined.rest():
            cells += np.bincount(_cells(shingle), minlength=SKETCH_CELLS).astype(np.uint32)
        task = TaskContext.get().partitionId()
        for block in range(SKETCH_BLOCKS):
            part = cells[block * per_block:(block + 1) * per_block]
            if part.any():
                yield arrow_batch(WORDED, [[None], [None], [None], [None], [block], [task], [part.tobytes()]])

    rows = written(docs.select("doc_id", "text", "text_key").mapInArrow(run, WORDED), "words", "zstd")
    return rows.filter("block IS NULL").select("doc_id", "text_key", "content", "words"), rows.filter("block IS NOT NULL").select("block", "task", "cells")


def common_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``counted_shingles``, of the texts of ``docs``."""
    return counted_shingles(*worded(docs.select("doc_id", "text", F.lit(None).cast("binary").alias("text_key"))), total)


def counted_shingles(rows: DataFrame, sketches: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in more than ``RARE`` of all ``total`` documents (and in two at least), with their exact document counts."""
    spark = rows.sparkSession
    least = max(2, math.floor(RARE * total) + 1)
    per_block = SKETCH_CELLS // SKETCH_BLOCKS

    def add(group: pa.Table) -> pa.Table:
        cells = np.zeros(per_block, np.uint64)
        for raw in group["cells"]:
            cells += np.frombuffer(raw.as_buffer(), np.uint32)
        cells = np.minimum(cells, np.iinfo(np.uint32).max).astype(np.uint32)
        return pa.Table.from_batches([arrow_batch(SKETCHED, [[group["block"][0].as_py()], [group["task"][0].as_py() // FANIN], [cells.tobytes()]])])

    tasks = (sketches.agg(F.max("task")).first()[0] or 0) + 1
    while True:     # a tree: each turn adds FANIN sketches of a block
        sketches = sketches.groupBy("block", F.floor(F.col("task") / FANIN).alias("_group")).applyInArrow(add, SKETCHED)
        tasks = math.ceil(tasks / FANIN)
        if tasks <= 1:
            break
    busy = np.zeros(SKETCH_CELLS, bool)
    for r in sketches.collect():        # SKETCH_CELLS numbers at most
        busy[r.block * per_block:(r.block + 1) * per_block] = np.frombuffer(r.cells, np.uint32) >= least
    held = spark.sparkContext.broadcast(np.packbits(busy))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, joined = np.unpackbits(held.value).astype(bool), Joined()

        def counts(some: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for shingle in some:
                found, times = np.unique(shingle, return_counts=True)
                yield arrow_batch(COUNTED, [found.view(np.int64), times])

        for batch in batches:
            for hashes in words_in(batch.column(0)):
                shingle = shingles(hashes)[0]
                yield from counts(joined.add(shingle[marks[_cells(shingle)]]))
        yield from counts(joined.rest())

    counted = rows.select("words").mapInArrow(count, COUNTED).groupBy("shingle").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= least)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["both"])

    parts = [np.frombuffer(r.both, np.int64).reshape(2, -1) for r in counted.mapInArrow(packed, "both binary").collect()]
    both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)
    return both[0].view(np.uint64), both[1]


def signatures(rows: DataFrame, held: Broadcast) -> DataFrame:
    """``doc_id``, ``text_key``, ``content``, ``rare`` (the share of its weight on rare shingles) and ``buckets`` of every row of ``worded``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weights = Sampler(), held.value
        for batch in slices(batches, text=3):
            sets = [shingles(hashes) for hashes in words_in(batch.column(3))]
            full = [i for i, (s, _) in enumerate(sets) if len(s)]
            buckets: list[list[int]] = [[] for _ in sets]
            rare = np.zeros(len(sets))
            if full:
                shingle, times = (np.concatenate([sets[i][c] for i in full]) for c in (0, 1))
                starts = np.concatenate([[0], np.cumsum([len(sets[i][0]) for i in full])[:-1]])
                weight = weights(shingle, times)
                rare[full] = np.add.reduceat(np.where(weights.rare(shingle), weight, 0), starts) / np.add.reduceat(weight, starts)
                keys = band_keys(sampler.sample(shingle, weight, starts))
                for i, row in zip(full, keys.view(np.int64).tolist()):
                    buckets[i] = row
            yield arrow_batch(SIGNED, [batch.column(0), batch.column(1), batch.column(2), rare, buckets])
    return rows.mapInArrow(run, SIGNED)


def verified(pairs: DataFrame, texts: DataFrame, held: Broadcast) -> DataFrame:
    """Exact similarities of ``pairs`` (``pivot``, ``member``); a pivot's members go in chunks, so it meets no unbounded group."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.join(sizes, "pivot").select("pivot", "member", F.pmod(F.xxhash64("member"), F.col("chunks")).alias("chunk"))
    asked = dealt.select("pivot", "chunk", F.col("member").alias("content")).unionByName(
        dealt.select("pivot", "chunk", F.col("pivot").alias("content")).distinct())

    def verify(group: pa.Table) -> pa.Table:
        weights = held.value
        pivot, contents = group["pivot"][0].as_py(), group["content"].to_pylist()
        sets = []
        for hashes in words_in(group["words"]):
            shingle, times = shingles(hashes)
            sets.append((shingle, weights(shingle, times)))
        own = sets[contents.index(pivot)]
        rows = [(pivot, c, weighted_jaccard(own, s)) for c, s in zip(contents, sets) if c != pivot]
        return pa.Table.from_batches([arrow_batch(VERIFIED, list(zip(*rows)) or [[], [], []])])

    return asked.join(texts, "content").groupBy("pivot", "chunk").applyInArrow(verify, VERIFIED)


def bounds(texts: DataFrame, held: Broadcast, similarity: float) -> DataFrame:
    """``node``, ``total``, ``shared``: a text's weight, and its weight on shingles that another of ``texts`` holds too.

    The similarity of two texts is at most that of the smaller shared weight to
    the rest of both, so pairs and whole texts below it need no comparison.
    Texts that can reach ``similarity`` with no other are left out, and the
    weights taken anew among the others.  ``node`` is the hash of ``content``.
    """
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for batch in slices(batches, rows=64):
            for node, hashes in zip(batch.column(0).to_pylist(), words_in(batch.column(1))):
                shingle, times = shingles(hashes)
                weight = weights(shingle, times)
                yield arrow_batch(WEIGHED, [np.full(len(shingle), node), shingle.view(np.int64), weight, np.full(len(shingle), weight.sum())])

    rows = written(texts.select(F.xxhash64("content").alias("node"), "words").mapInArrow(weigh, WEIGHED), "weights")
    alive = None
    for _ in range(PRUNINGS):
        mine = rows if alive is None else rows.join(alive.select("node"), "node", "left_semi")
        common = mine.groupBy("shingle").count().filter("count > 1").select("shingle")
        sums = mine.join(common, "shingle", "left_semi").groupBy("node").agg(F.sum("weight").alias("shared"), F.max("total").alias("total"))
        alive = written(sums.filter(F.col("shared") >= F.col("total") * (similarity - 1e-9)), "bounds")
    return alive


def open_pairs(named: DataFrame, pivots: int, similarity: float) -> DataFrame:
    """``pivot``, ``member``: of each bucket, its first ``pivots`` members outside its largest class with all members of other classes in reach.

    ``named`` has each bucket's members (``bucket``, ``member``, all its ``buckets``, ``shared``, ``total``, ``label``) and ``largest`` class.
    A pair is made once: in the first bucket of both, and of two outside members by the one that comes first.
    """
    in_order = Window.partitionBy("bucket").orderBy("member")
    outside = (named.filter("label <> largest").select(
        F.col("bucket").alias("outside_bucket"), F.col("member").alias("outsider"), F.col("label").alias("outside_label"), F.col("shared").alias("outside_shared"),
        F.col("total").alias("outside_total"), F.col("buckets").alias("outside_buckets"), F.row_number().over(in_order).alias("place")).filter(F.col("place") <= pivots))
    least = F.least("shared", "outside_shared")
    reach = least >= (similarity - 1e-9) * (F.col("total") + F.col("outside_total") - least)
    once = (F.col("label") == F.col("largest")) | (F.col("outsider") < F.col("member"))
    once = once & (F.col("bucket") == F.array_min(F.array_intersect("buckets", "outside_buckets")))
    both = named.join(outside, (F.col("bucket") == F.col("outside_bucket")) & (F.col("label") != F.col("outside_label")) & reach & once)
    return both.select(F.least("outsider", "member").alias("pivot"), F.greatest("outsider", "member").alias("member"))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``text_key`` and ``label`` of every row; rows of one label are a class.  ``docs`` has ``doc_id``, ``text``, ``text_key``."""
    spark = docs.sparkSession
    rows, sketches = worded(docs)
    total = rows.count()
    held = spark.sparkContext.broadcast(Weights(*counted_shingles(rows, sketches, total), total))
    signed = written(signatures(rows, held), "signatures")
    nodes = signed.groupBy("content").agg(F.first("rare").alias("rare"), F.first("buckets").alias("buckets"))
    members = nodes.select("content", "rare", F.explode("buckets").alias("bucket"))
    central = F.min(F.struct("rare", "content")).alias("central")
    shared = members.groupBy("bucket").agg(central, F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket", F.col("central.content").alias("pivot"))
    met = salted_join(members.drop("rare"), shared, "bucket", ["content"]).filter("pivot IS NOT NULL")
    buckets = written(met.select("bucket", "pivot", F.col("content").alias("member")), "buckets")

    # the words of the nodes that meet others, once each
    wanted = buckets.select(F.col("member").alias("content")).distinct()
    found = passes(rows.select("content", "words"), sieve(wanted, ["content"]), ["content"], "wanted").filter("wanted")
    texts = written(found.groupBy("content").agg(F.first("words").alias("words")).join(wanted, "content", "left_semi"), "texts", "zstd")

    def compared(pairs: DataFrame) -> DataFrame:
        return written(verified(pairs, texts, held), "similarities")

    def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels.select(F.col("node").alias("member"), "label"), "member", "left").withColumn("label", F.coalesce("label", "member"))

    done = compared(buckets.filter("member <> pivot").select("pivot", "member").distinct())
    labels = connected_components(done.filter(F.col("similarity") >= similarity).select(F.col("pivot").alias("a"), F.col("member").alias("b")))

    # buckets of several classes: their members that can have another link at all
    open_ = with_labels(buckets.select("bucket", "member"), labels).groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most")
    left = written(buckets.join(open_.select("bucket"), "bucket", "left_semi").select("bucket", "member"), "open-buckets")
    able = bounds(texts.join(left.select(F.col("member").alias("content")).distinct(), "content", "left_semi"), held, similarity)
    left = left.withColumn("node", F.xxhash64("member")).join(able, "node").groupBy("member").agg(
        F.collect_set("bucket").alias("buckets"), F.first("shared").alias("shared"), F.first("total").alias("total"))
    left = written(left.select("*", F.explode("buckets").alias("bucket")), "able-members")
    pivots = FIRST_PIVOTS
    while True:
        # of each bucket, the members outside its largest class, in order; the first so many become pivots
        named = with_labels(left, labels)
        sizes = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("members"))
        largest = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("members", "label")).alias("largest"))
        named = written(named.join(largest, "bucket"), "named")
        pairs = open_pairs(named, pivots, similarity)
        known = done.select(F.least("pivot", "member").alias("pivot"), F.greatest("pivot", "member").alias("member"))
        pairs = written(pairs.join(known, ["pivot", "member"], "left_anti"), "pairs")
        most = named.filter("label <> largest").groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        if pairs.limit(1).count():
            more = compared(pairs)
            done = done.unionByName(more)
            fresh = more.filter(F.col("similarity") >= similarity).select(F.col("pivot").alias("a"), F.col("member").alias("b"))
            labels = connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(fresh))
        if most <= pivots:
            break
        pivots *= MORE_PIVOTS
    named = labels.select(F.col("node").alias("content"), "label")
    return salted_join(signed.select("doc_id", "text_key", "content"), named, "content", ["text_key", "doc_id"]).select(
        "doc_id", "text_key", F.coalesce("label", "content").alias("label"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key``, ``class_id``, ``class_size``, ``kept``.

    Classes are the connected components of the links of at least
    ``similarity``.  The row of the smallest id stays (a null id only where no
    other is; of one id the smaller text digest) and names its class.  Texts of
    equal words are equal; null, empty and wordless texts are one class; texts
    of fewer than five words are one shingle.  Repeated rows share the answer.
    An empty table gives no rows; other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("text_key"))
    classes = settled(lambda: near_duplicate_classes(slim, similarity), docs.sparkSession, "classes")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    chosen = classes.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size"))
    joined = salted_join(classes, chosen, "label", ["text_key", "doc_id"])
    return joined.select("doc_id", "text_key", F.col("first.doc_id").alias("class_id"), "class_size",
                         (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all columns as a struct ``row``.

    A bitmap of fixed size tells rows that are certain to be a class of their
    own: they stay where they are, and only the others are shuffled.
    """
    keys = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("_id"), F.col("text_key").alias("_key")
    copies = settled(lambda: near_dedup(docs, id_col, text_col, similarity).filter("class_size > 1").select(*keys, "kept").distinct(), docs.sparkSession, "copies")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("none")).alias("_id"),
                       F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("_key"))
    screened = passes(rows, sieve(copies, ["_id", "_key"], COPY_BITS), ["_id", "_key"], "shared", COPY_BITS)
    asked = screened.filter("shared").select("row", "_id", "_key").join(copies, ["_id", "_key"], "left").filter("kept IS NULL OR kept")
    return screened.filter("NOT shared").select("row").unionByName(asked.groupBy("_id", "_key").agg(F.first("row").alias("row")).select("row"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
