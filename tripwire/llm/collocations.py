"""Phrase collocation mining by direct-address tiling.

Words get ids by frequency rank.  A phrase is a pair: the phrase of all its
words but the last, and the last word.  Pairs of ids address cells of tiles:
pairs of two frequent ids fall into dense tiles, counted with ``bincount``; the
others into sparse tiles, counted as sorted coordinates.  Pairs that are
frequent get ids by their own rank, and the next length is counted the same way
over these ids: phrases of two words become the left halves of those of three,
and so on.  Only phrases whose first and whose last words (all but one) are
frequent are counted at all, as no other can be.

How the steps stay whole and bounded at any size:

* Texts are read once.  A task turns them into blocks: ids of a dictionary of
  the block's own, and that dictionary.  Ranks replace these ids: the first
  ``WORDS_AT_ONCE`` of them, of short words, from a broadcast; all others by a
  join with the words of the blocks' dictionaries that the broadcast lacks.
  Tokens are never shuffled as rows.
* Counts leave a task as one packed row a tile, already summed; tiles are added
  in two levels, so a hot tile's rows are dealt out.
* Frequent pairs are marked in the blocks from a broadcast of at most
  ``PAIRS_AT_ONCE`` of them; more are marked in further passes, each written.
  Only stretches that can hold a longer frequent phrase go on to the next length.
* Scores come from joins of the phrase tables.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm.common import arrow_batch, fresh_path, slices, table, written

LENGTH = 5              # words of a phrase at most
LEAST = 100             # occurrences of a candidate at least
SHARE = 100             # percent of a phrase's occurrences that lie in a longer one, at which it is dropped
TOP = 2000              # phrases of a language in the report
BLOCK_TOKENS = 1 << 21  # tokens of a block, about; a longer text is a block
RUN_TOKENS = 1 << 18    # tokens of a row of coded words, about; a longer piece is a row
FLUSH_PAIRS = 1 << 21   # pairs that a task holds before it counts them
SIDE = 1 << 11          # ids on a side of a dense tile
DENSE_IDS = 1 << 14     # ids that have dense tiles
TILE_PAIRS = 1 << 22    # pairs of a sparse tile, about
PAIRS_AT_ONCE = 1 << 22
WORDS_AT_ONCE, WORD_BYTES = 1 << 19, 64     # words of a broadcast, and the bytes of one, at most
SPLIT = 0xFF            # a byte that UTF-8 never has, for the marks between pieces
BYTES = bytes(c + 32 if 65 <= c <= 90 else SPLIT if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))

BLOCKS = T.StructType([T.StructField("block", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())),
                       T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType())])
LACKING = T.StructType([T.StructField("block", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("word", T.StringType())])
#: ``phrases`` is null where they are the words
CODED = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("phrases", T.BinaryType())])
TILED = T.StructType([T.StructField("tile", T.LongType()), T.StructField("salt", T.LongType()), T.StructField("cells", T.BinaryType()), T.StructField("counts", T.BinaryType())])
PAIRED = T.StructType([T.StructField("prefix", T.LongType()), T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])


class Dictionary(dict):
    """Ids in order of first use, from 1; 0 is the mark between pieces."""

    def __init__(self):
        super().__init__({bytes([SPLIT]): 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a whole text in UTF-8, with a mark for each end of a piece."""
    mark = bytes([SPLIT])
    return ((text or "").encode("utf-8", "surrogatepass").translate(BYTES) + mark).replace(mark, b" " + mark + b" ").split(b" ")


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of the texts of a language: ids of the block's dictionary (0 between pieces and texts), its words and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Dictionary, list[np.ndarray]]] = defaultdict(lambda: (Dictionary(), []))

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (words, parts) in held.items():
                ids = np.concatenate(parts)
                counts = np.bincount(ids, minlength=len(words))[1:]
                names = [w.decode("utf-8", "surrogatepass") for w in list(words)[1:]]
                yield arrow_batch(BLOCKS, [[uuid.uuid4().hex], [lang], [names], [counts.tolist()], [ids.astype(np.uint32).tobytes()]])
            held.clear()

        size = 0
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, parts = held[lang]
                tokens = list(filter(None, tokens_of(text)))
                parts.append(np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)).astype(np.uint32))
                size += len(tokens)
                if size >= BLOCK_TOKENS:
                    yield from flushed()
                    size = 0
        yield from flushed()
    return docs.mapInArrow(run, BLOCKS)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``written``, compressed more: for the blocks' ids."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(counts: DataFrame, n: str, *ties: str) -> DataFrame:
    """``counts`` with ``id``, the rank by ``n`` from 1; places are offsets of the parts of a range partitioning, so no task sees all rows."""
    parts = written(counts.repartitionByRange(F.col(n).desc(), *ties).withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))   # a row a part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(n).desc(), *ties))
    return written(parts.join(F.broadcast(before), "_part").withColumn("id", (F.col("_before") + inside).cast("long")).drop("_part", "_before"), "ranked")


def coded(blocks: DataFrame, words: DataFrame, at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """The blocks with the words' ranks in place of the blocks' own ids; 0 for words that aren't frequent."""
    spark = blocks.sparkSession
    near = (F.col("id") <= at_once) & (F.octet_length("word") <= WORD_BYTES)
    top: dict[str, dict[str, int]] = defaultdict(dict)
    for r in words.filter(near).select("lang", "word", "id").toLocalIterator():     # at most ``at_once`` short words
        top[r.lang][r.word] = r.id
    held = spark.sparkContext.broadcast(dict(top))
    rest = words.filter(~near).select("lang", "word", "id")
    known = F.lit(None).cast("array<struct<place: int, id: bigint>>")
    rows = blocks.select("lang", "words", "ids", known.alias("known"))
    if rest.limit(1).count():
        def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, lang, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    there = held.value.get(lang, {})
                    some = [(i, w) for i, w in enumerate(own) if w not in there]
                    yield arrow_batch(LACKING, [[block] * len(some), [lang] * len(some), *([x[k] for x in some] for k in range(2))])
        found = blocks.select("block", "lang", "words").mapInArrow(lacking, LACKING).join(rest, ["lang", "word"])
        found = found.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("known"))
        rows = blocks.join(found, "block", "left").select("lang", "words", "ids", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own, ids, known in zip(*batch.columns):
                there, own = held.value.get(lang.as_py(), {}), own.as_py()
                ranks = np.zeros(len(own) + 1, np.int64)
                ranks[1:] = np.fromiter((there.get(w, 0) for w in own), np.int64, len(own))
                if known.is_valid:
                    ranks[known.values.field(0).to_numpy() + 1] = known.values.field(1).to_numpy()
                for run in runs(ranks[np.frombuffer(ids.as_buffer(), np.uint32)]):
                    yield arrow_batch(CODED, [[packed(run)], [None]])
    return kept(rows.mapInArrow(run, CODED), "coded")


def runs(code: np.ndarray, size: int = RUN_TOKENS) -> Iterator[np.ndarray]:
    """``code`` cut into runs of ``size`` ids or more, at zeros, which no phrase crosses."""
    zeros, start = np.flatnonzero(code == 0), 0
    while start < len(code):
        at = np.searchsorted(zeros, start + size)
        stop = int(zeros[at]) + 1 if at < len(zeros) else len(code)
        yield code[start:stop]
        start = stop


def packed(ids: np.ndarray) -> bytes:
    """Numbers from 0 up as little-endian integers of the fewest bytes that hold them all, which the first byte says."""
    width = next(w for w in (1, 2, 4, 8) if int(ids.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpacked(raw: pa.Scalar) -> np.ndarray:
    buffer = raw.as_buffer()
    return np.frombuffer(buffer, f"<u{buffer[0]}", offset=1).astype(np.int64)


def squeezed(numbers: np.ndarray) -> bytes:
    """``packed`` numbers, compressed, for the shuffle."""
    raw = packed(numbers)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expanded(raw: pa.Scalar) -> np.ndarray:
    buffer = raw.as_buffer()
    plain = pa.decompress(buffer.slice(8), int.from_bytes(buffer.slice(0, 8).to_pybytes(), "little"), codec="zstd")
    return np.frombuffer(plain, f"<u{plain[0]}", offset=1).astype(np.int64)


def packed_cells(tile: int, cells: np.ndarray) -> bytes:
    """Ascending cells by their distances; of a sparse tile the first halves of its pairs so, then the second halves."""
    if tile >= 0:
        return squeezed(np.diff(cells, prepend=0))
    first, second = cells.reshape(-1, 2).T
    return squeezed(np.concatenate([np.diff(first, prepend=0), second]))


def unpacked_cells(tile: int, raw: pa.Scalar) -> np.ndarray:
    numbers = expanded(raw)
    if tile >= 0:
        return np.cumsum(numbers)
    first, second = np.split(numbers, 2)
    return np.stack([np.cumsum(first), second], axis=1).reshape(-1)


def stretches(words: np.ndarray, phrases: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The words and phrases of the stretches where frequent phrases of ``length`` words begin at two places in a row, a 0 after each."""
    on = phrases > 0
    beside = on & (np.append(on[1:], False) | np.append(False, on[:-1]))
    cover = np.zeros(len(words) + length + 1, np.int64)
    starts = np.flatnonzero(beside)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + length, -1)
    inside = np.cumsum(cover)[:len(words)] > 0
    keep = inside | np.append(False, inside[:-1])
    return np.where(inside, words, 0)[keep], np.where(beside, phrases, 0)[keep]


def pairs_of(words: np.ndarray, phrases: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a phrase of ``length`` words can be frequent: the ids of its first ``length - 1`` words and of its last."""
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = phrases[:len(words) - length + 1], words[length - 1:]
    able = (first > 0) & (last > 0) & (phrases[1:len(words) - length + 2] > 0)
    return np.where(able, first, 0), np.where(able, last, 0)


def tiled(prefix: np.ndarray, word: np.ndarray, sparse_tiles: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The counted pairs tile by tile: the tile's number, cells, counts.

    A dense tile's number is from 0 up, its cells are places in it; a sparse
    tile's is below 0, its cells are pairs of 64 bits.  Ids are below 2**32 but
    for the words and phrases beyond, which share tiles by a hash of both.
    """
    side = DENSE_IDS // SIDE
    dense = (prefix < DENSE_IDS) & (word < DENSE_IDS)
    p, w = prefix[dense], word[dense]
    tile, cell = (p // SIDE) * side + w // SIDE, (p % SIDE) * SIDE + w % SIDE
    order = np.argsort(tile, kind="stable")
    tile, cell = tile[order], cell[order]
    starts = np.flatnonzero(np.diff(tile, prepend=-1))
    for at, cells in zip(starts, np.split(cell, starts[1:])):
        if len(cells) >= SIDE * SIDE // 32:
            counts = np.bincount(cells, minlength=SIDE * SIDE)
            yield int(tile[at]), (places := np.flatnonzero(counts)), counts[places]
        elif len(cells):
            yield int(tile[at]), *np.unique(cells, return_counts=True)
    pairs = np.stack([prefix[~dense], word[~dense]], axis=1)
    if len(pairs):
        tile = -1 - ((pairs[:, 0] * 0x9E3779B1 + pairs[:, 1] * 0x85EBCA77) >> 7) % sparse_tiles
        order = np.lexsort((pairs[:, 1], pairs[:, 0], tile))
        tile, pairs = tile[order], pairs[order]
        new = np.flatnonzero(np.any(np.diff(pairs, axis=0, prepend=-1) != 0, axis=1) | (np.diff(tile, prepend=1) != 0))
        counts = np.diff(np.append(new, len(pairs)))
        tile, pairs = tile[new], pairs[new]
        starts = np.flatnonzero(np.diff(tile, prepend=1))
        for at, cells, n in zip(starts, np.split(pairs, starts[1:]), np.split(counts, starts[1:])):
            yield int(tile[at]), cells.reshape(-1), n


def added(tile: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of one tile's counted cells: into a dense array, or by merging sorted coordinates."""
    if tile >= 0:
        total = np.zeros(SIDE * SIDE, np.int64)
        for cells, counts in parts:
            total[cells] += counts          # cells are distinct within a part
        cells = np.flatnonzero(total)
        return cells, total[cells]
    held, size = [], 0
    for cells, counts in parts:
        held.append((cells.reshape(-1, 2), counts))
        size += len(counts)
        if size > FLUSH_PAIRS:
            held = [_merged(held)]
            size = len(held[0][1])
    pairs, counts = _merged(held)
    return pairs.reshape(-1), counts


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, counts = np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, counts = pairs[order], counts[order]
    starts = np.flatnonzero(np.any(np.diff(pairs, axis=0, prepend=-1) != 0, axis=1))
    return pairs[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def pair_counts(blocks: DataFrame, length: int, least: int, sparse_tiles: int, salts: int) -> DataFrame:
    """``prefix``, ``word``, ``n`` of the pairs with at least ``least`` occurrences."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, held, size = TaskContext.get().partitionId() % salts, [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for tile, cells, counts in tiled(*(np.concatenate(x) for x in zip(*held)), sparse_tiles):
                yield arrow_batch(TILED, [[tile], [salt], [packed_cells(tile, cells)], [squeezed(counts)]])
            held.clear()

        for batch in batches:
            for words, phrases in zip(batch.column(0), batch.column(1)):
                words = unpacked(words)
                prefix, word = pairs_of(words, unpacked(phrases) if phrases.is_valid else words, length)
                able = np.flatnonzero(prefix)
                for start in range(0, len(able), FLUSH_PAIRS):
                    some = able[start:start + FLUSH_PAIRS]
                    held.append((prefix[some], word[some]))
                    size += len(some)
                    if size >= FLUSH_PAIRS:
                        yield from flushed()
                        size = 0
        if held:
            yield from flushed()

    def parts(tile: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for cells, counts in zip(batch.column(2), batch.column(3)):
                yield unpacked_cells(tile, cells), expanded(counts)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = key[0].as_py()
        cells, counts = added(tile, parts(tile, batches))
        yield arrow_batch(TILED, [[tile], [0], [packed_cells(tile, cells)], [squeezed(counts)]])

    def finish(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = key[0].as_py()
        cells, counts = added(tile, parts(tile, batches))
        side = DENSE_IDS // SIDE
        if tile >= 0:
            prefix, word = tile // side * SIDE + cells // SIDE, tile % side * SIDE + cells % SIDE
        else:
            prefix, word = cells.reshape(-1, 2).T
        often = counts >= least
        yield arrow_batch(PAIRED, [prefix[often], word[often], counts[often]])

    counted = blocks.mapInArrow(count, TILED)
    if salts > 1:
        counted = counted.groupBy("tile", "salt").applyInArrow(add, TILED)
    return counted.groupBy("tile").applyInArrow(finish, PAIRED)


def marked(blocks: DataFrame, phrases: DataFrame, length: int, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """The stretches of the blocks with, at each place, the id of the frequent phrase of ``length`` words that begins there."""
    spark, total = blocks.sparkSession, phrases.count()
    before = blocks.select("words", "phrases", F.lit(None).cast("binary").alias("next"))
    schema = T.StructType([*CODED.fields, T.StructField("next", T.BinaryType())])
    for first in range(1, total + 1, at_once):
        some = phrases.filter(F.col("id").between(first, first + at_once - 1)).select("prefix", "word", "id")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy() for c in batch.columns]).tobytes()], pa.binary())], names=["raw"])
        rows = [np.frombuffer(r.raw, np.int64).reshape(3, -1) for r in some.mapInArrow(pack, "raw binary").collect()]      # at most ``at_once`` pairs
        prefix, word, ids = np.concatenate(rows, axis=1)
        order = np.lexsort((word, prefix))
        held = spark.sparkContext.broadcast((prefix[order], word[order], ids[order]))

        def mark(batches: Iterator[pa.RecordBatch], held=held, done=first + at_once > total) -> Iterator[pa.RecordBatch]:
            prefix, word, ids = held.value
            heads, starts = np.unique(prefix, return_index=True)        # a prefix's pairs stand together, their words ascending
            ranks = np.repeat(np.arange(len(heads)), np.diff(np.append(starts, len(prefix))))
            width = int(word.max()) + 1
            keys = ranks * width + word
            for batch in batches:
                for words, phrases, following in zip(*batch.columns):
                    words = unpacked(words)
                    phrases = unpacked(phrases) if phrases.is_valid else words
                    p, w = pairs_of(words, phrases, length)
                    out = unpacked(following) if following.is_valid else np.zeros(len(words), np.int64)
                    able = np.flatnonzero((p > 0) & (w < width))
                    head = np.minimum(np.searchsorted(heads, p[able]), len(heads) - 1)
                    able, head = able[heads[head] == p[able]], head[heads[head] == p[able]]
                    key = head * width + w[able]
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = keys[at] == key
                    out[able[hit]] = ids[at[hit]]
                    if not done:
                        yield arrow_batch(schema, [[packed(words)], [packed(phrases)], [packed(out)]])
                        continue
                    words, out = stretches(words, out, length)
                    if len(words):
                        yield arrow_batch(schema, [[packed(words)], [None], [packed(out)]])
        before = kept(before.mapInArrow(mark, schema), "marked")
    return before.select("words", F.col("next").alias("phrases"))


def frequent_phrases(docs: DataFrame, length: int = LENGTH, least: int = LEAST, words_at_once: int = WORDS_AT_ONCE,
                     pairs_at_once: int = PAIRS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``words``, ``f`` of all phrases of 1 to ``length`` words with ``least`` occurrences, and ``lang``, ``n``: all word occurrences."""
    blocks = kept(blocks_of(docs), "blocks")
    counts = blocks.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("n"))
    counts = written(counts, "word-counts")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = ranked(counts.filter(F.col("n") >= least), "n", "lang", "word")
    phrases = words.select("id", "lang", F.array("word").alias("words"), F.col("n").alias("f"))
    every = phrases.drop("id")
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    salts = max(1, math.isqrt(blocks.count()) // 2)
    sparse_tiles = max(1, math.ceil(tokens / TILE_PAIRS))
    seq = coded(blocks, words, words_at_once)
    for k in range(2, length + 1):
        pairs = ranked(pair_counts(seq, k, least, sparse_tiles, salts), "n", "prefix", "word")
        one = words.select(F.col("id").alias("word"), F.col("word").alias("last"))
        phrases = written(pairs.join(phrases.select(F.col("id").alias("prefix"), "lang", "words"), "prefix").join(one, "word")
                          .select("id", "lang", F.concat("words", F.array("last")).alias("words"), F.col("n").alias("f")), "phrases")
        every = every.unionByName(phrases.drop("id"))
        if k == length or not phrases.limit(1).count():
            break
        seq = marked(seq, pairs, k, pairs_at_once)
    return every, totals


def scored(every: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the phrases of two words and more that no longer one holds."""
    named = written(every.select("lang", "words", F.array_join("words", " ").alias("phrase"), "f"), "frequent")
    longer = named.filter(F.size("words") > 1)
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")     # noqa: E731
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    of = named.select("lang", "phrase", "f")
    cuts = (cuts.join(of.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(of.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
            .join(totals, "lang"))
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    # the quotient of whole decimals of up to 38 digits, enough for 10**17 words
    score = F.call_function("div", exact["a"] * exact["n"] * F.lit(1000).cast("decimal(4,0)"), exact["l"] * exact["r"])
    cuts = cuts.withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    size = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: part(s, m))))
    inside = longer.filter(size > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    alone = best.join(inside, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (F.lit(100) * F.col("held") < F.lit(share) * F.col("a")))
    return alone.select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = LENGTH, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's ``top`` phrases.

    A null language is ``und``.  Null and empty texts have no words, whole texts
    count however long, and repeated rows count each time.  Equal scores go by
    count, then by the phrase's bytes.  An empty table, or one without a
    frequent phrase, gives no rows; other columns aren't read.
    """
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found = scored(*frequent_phrases(slim, length, least), share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return found.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents", length: int = LENGTH, least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS size, array_to_string(words[i:i + {k - 1}], ' ') AS phrase FROM places WHERE i + {k - 1} <= len(words)" for k in range(1, length + 1))
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM {documents} WHERE text IS NOT NULL),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
grams AS ({grams}),
totals AS (SELECT lang, count(*)::HUGEINT AS n FROM grams WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS words, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (SELECT lang, phrase, words, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
cut_scores AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, n, (1000 * a * n) // (h.f * t.f) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.words[1:k], ' ')
              JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.words[k + 1:], ' ') JOIN totals o ON o.lang = c.lang),
best AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
starts AS (SELECT lang, words, size, f, unnest(range(1, size)) AS s FROM f WHERE size > 2),
spans AS (SELECT lang, words, size, f, s, unnest(range(s + 1, size + 1)) AS e FROM starts),
held AS (SELECT lang, array_to_string(words[s:e], ' ') AS phrase, max(f) AS held FROM spans WHERE e - s + 1 < size GROUP BY ALL),
alone AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE held IS NULL OR 100 * held < {share} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM alone)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {top}
"""


ORACLE = oracle()
