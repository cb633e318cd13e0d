"""Byte-pair encoding and decoding with a public byte-level vocabulary.

A word's symbols form a doubly linked list.  A priority queue holds the merge
rank and place of each adjacent pair; the lowest rank is merged first, and
entries whose pair has changed since they were queued are stale and skipped.
Decoding concatenates the vocabulary's byte strings.

The vocabulary file (merges, vocabulary, added tokens) is a parameter; it is
read by each Python worker, never copied.  Texts are encoded whole.  A bounded
cache keeps the ids of frequent words and runs between spaces, so the queue
runs once for each of them and not once for each occurrence.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm.common import BoundedCache, arrow_batch, held_alone, slices, table

VOCABULARY = "byte_bpe_50k.json"
CACHE_ENTRIES = 600_000
CACHED_CHARS = 64       # longer runs are encoded without the cache
ID_BITS, PLACE_BITS = 20, 32     # of a vocabulary id; of a place in a word
ID_MASK, PLACE_MASK = (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1
# Fixed value: the pre-tokenizer pattern of the byte-level format.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _OpenEnd(Exception):
    """A run between spaces that is too long for the cache, or begins or ends with white space and can't be encoded by itself."""


def byte_symbols() -> dict[str, int]:
    """The format's characters for the 256 bytes: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BpeCodec:
    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, symbols = spec["model"]["vocab"], byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, bytes] = {i: bytes(symbols[c] for c in s) for s, i in vocabulary.items() if s not in self.added}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.string_of = np.array([self.strings.get(i, b"") for i in range(max(self.strings) + 1)], dtype=object)
        self.of_byte = [0] * 256
        for c, b in symbols.items():
            self.of_byte[b] = vocabulary[c]
        # per left symbol, right symbol -> rank and merged id in one integer
        after: dict[int, dict[int, int]] = {i: {} for i in vocabulary.values()}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            after[vocabulary[left]][vocabulary[right]] = rank << ID_BITS | vocabulary[left + right]
        self.merged = {i: pairs.get for i, pairs in after.items()}
        self.find_words = regex.compile(WORD_PATTERN).findall
        self.space = regex.compile(r"\s")
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = BoundedCache(self._word, cache_entries // 4)
        self.runs = BoundedCache(self._run, cache_entries)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the symbols of one word; ties in rank go to the leftmost pair."""
        n, merged = len(ids), self.merged
        queue = [m << PLACE_BITS | i for i in range(n - 1) if (m := merged[ids[i]](ids[i + 1])) is not None]
        if not queue:
            return ids
        heapify(queue)
        following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i, merge = entry & PLACE_MASK, entry >> PLACE_BITS
            j = following[i]
            if ids[i] < 0 or j >= n or merged[ids[i]](ids[j]) != merge:
                continue    # stale: one of the two symbols has been merged meanwhile
            new = ids[i] = merge & ID_MASK
            ids[j] = -1
            k = following[i] = following[j]
            if k < n:
                preceding[k] = i
                if (m := merged[new](ids[k])) is not None:
                    heappush(queue, m << PLACE_BITS | i)
            if (h := preceding[i]) >= 0 and (m := merged[ids[h]](new)) is not None:
                heappush(queue, m << PLACE_BITS | h)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        of_byte = self.of_byte
        ids = self.merge([of_byte[b] for b in word.encode()])
        return pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> bytes:
        words, runs, fresh = self.words, self.runs, self._word
        return b"".join([fresh(w) if len(w) > CACHED_CHARS else runs[w[1:]] if w[0] == " " and w[1:].isalpha() else words[w]
                         for w in self.find_words(text)])

    def _run(self, run: str) -> bytes:
        """The ids of a space and ``run``."""
        if run.isalpha() and len(run) <= CACHED_CHARS:
            return self._word(" " + run)
        if not run or len(run) > CACHED_CHARS or run[0].isspace() or run[-1].isspace() or self.space.match(run[-1]) or self.space.match(run[0]):
            raise _OpenEnd
        return self._words(" " + run)

    def _plain(self, text: str) -> bytes:
        """Between two characters that aren't white space, a space always begins a word; so the runs are independent."""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace() and not self.space.match(first[-1]):
            try:
                return self._words(first) + b"".join(map(self.runs.__getitem__, rest))
            except _OpenEnd:
                pass
        return self._words(text)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; an added token's string becomes its id."""
        if self.split_added is None or not any(a in text for a in self.added):
            return self._plain(text)
        return b"".join(pack("<I", self.added[p]) if p in self.added else self._plain(p) for p in self.split_added.split(text) if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(self.string_of[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


@held_alone
def codec(path: str | None = None) -> BpeCodec:
    """The worker's codec; by default of the installed public vocabulary."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    return BpeCodec(path)


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) of every row's whole text.

    A null or empty text gives no ids; repeated rows are encoded each; a null id
    stays null; an empty table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in slices(batches):
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield arrow_batch(ENCODED, [batch.column(0), [len(x) // 4 for x in ids], ids])
    return _texts(docs, id_col, text_col).mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``text`` of rows of ``encode_documents``; null ids give the empty text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in slices(batches):
            yield arrow_batch(schema, [batch.column(0), [own.decode(x or b"") for x in batch.column(1).to_pylist()]])
    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest each whole text in one narrow pass: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in slices(batches):
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                counts.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield arrow_batch(DIGESTS, [batch.column(0), counts, ids_digests, text_digests])
    return _texts(docs, id_col, text_col).mapInArrow(run, DIGESTS)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
