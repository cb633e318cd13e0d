"""Token ids in ORC files, in ascending document order.

Documents are dealt to range partitions of ``doc_id`` and sorted inside them;
each partition writes one file, with the ids as a list of integers (run-length
encoded by the format), a row index per stride and a Bloom filter on
``doc_id``.  A reader can take stripes in parallel and prune them by id.

Each row stores the ids before it in its own part; a manifest of one row per
part holds the ids before the part.  So one write gives every document's place
in the whole sequence, and no row waits for another part.

Encoding is the tokenizers library's.  A run between single spaces is encoded
by itself (this pre-tokenizer always begins a word there) and its ids are kept
in a bounded cache; the library encodes the runs of a slice that the cache
lacks, many joined to one text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm.bpe import VOCABULARY
from tripwire.llm.common import arrow_batch, fresh_path, held_alone, slices, table

END_ID = 2
CACHE_ENTRIES = 500_000
JOINED_RUNS = 200
STRIPE_BYTES = 64 << 20
ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()),
                     T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


class LibraryEncoder:
    """Whole texts to ids with the tokenizers library, each distinct run once."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import json

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one thread a task
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lengths = np.zeros(1 + max(spec["model"]["vocab"].values()), np.int64)      # bytes of each id
        for string, i in spec["model"]["vocab"].items():
            self.lengths[i] = len(string)       # one character a byte in this format
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.with_marks = not any(a.isalnum() for a in self.added)     # then letters and digits alone hold no added token
        self.cache_entries, self.runs, self.old = cache_entries, {}, {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def alone(self, run: str) -> bool:
        """Whether a run after a space is encoded alike wherever it stands."""
        return (self.with_marks and run.isalnum()) or (bool(run) and run[0].isprintable() and run[-1].isprintable() and not run[0].isspace() and not run[-1].isspace()
                                                       and not any(a in run for a in self.added))

    def _learn(self, names: list[str]) -> None:
        """Encode new runs, many as one text; a run's ids are those of its bytes."""
        for start in range(0, len(names), JOINED_RUNS):
            some = names[start:start + JOINED_RUNS]
            joined = " " + " ".join(some)
            ids = self._encode([joined])[0]
            ends = np.cumsum([1 + len(r) for r in some] if joined.isascii() else [1 + len(r.encode()) for r in some])
            cuts = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 4).tolist()
            raw = ids.tobytes()
            self.runs.update(zip(some, [raw[at:cut] for at, cut in zip([0, *cuts], cuts)]))

    def _open(self, texts: list[list[str]]) -> set[str]:
        """Make the ids of all runs of a slice known, each distinct run looked up once; the runs that can't be encoded by themselves.

        Two generations of about ``cache_entries`` runs are kept.
        """
        if len(self.runs) > self.cache_entries:
            self.old, self.runs = self.runs, {}
        lacking = set().union(*texts).difference(self.runs)
        again = self.old.keys() & lacking
        self.runs.update(zip(again, map(self.old.__getitem__, again)))
        lacking -= again
        fresh = list(filter(str.isalnum, lacking)) if self.with_marks else []       # the most, without a call each
        lacking.difference_update(fresh)
        unfit = {r for r in lacking if not self.alone(r)}
        self._learn(fresh + list(lacking - unfit))
        return unfit

    def encode(self, texts: list[str]) -> list[bytes]:
        rests = [t.split(" ") for t in texts]
        heads = [r.pop(0) for r in rests]
        unfit, find = self._open(rests), self.runs.__getitem__
        for i, rest in enumerate(rests):
            if rest and (not self.alone(heads[i][-1:]) or not unfit.isdisjoint(rest)):      # the library gets the whole text
                heads[i], rests[i] = texts[i], []
        return [h.tobytes() + b"".join(map(find, r)) for h, r in zip(self._encode(heads), rests)]


@held_alone
def encoder(path: str | None = None) -> LibraryEncoder:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    return LibraryEncoder(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, parts: int | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``path``/tokens (ORC: ``doc_id``, ``part``, ``before``, ``n_tokens``, ``ids``) and ``path``/manifest (``part``, ``base``).

    Every row is written, in ascending id order (a null id first; rows of one
    id by their text); a null text is the end id alone.  An empty table gives
    readable files without rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
               .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before, end = encoder(vocabulary), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            ids = [x + end for x in own.encode(batch.column(1).to_pylist())]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            starts = before + np.concatenate([[0], np.cumsum(counts)[:-1]])
            before += int(counts.sum())
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield arrow_batch(ROWS, [batch.column(0), [part] * len(ids), starts, counts, lists])

    (ordered.mapInArrow(run, ROWS).write.option("orc.create.index", "true").option("orc.row.index.stride", "1000")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.stripe.size", str(STRIPE_BYTES))
     .option("compression", "none").orc(f"{path}/tokens"))
    sizes = spark.read.schema(ROWS).orc(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one row per part
    sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("long").alias("base")).write.orc(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` from the files."""
    rows = spark.read.schema(ROWS).orc(f"{path}/tokens")
    manifest = spark.read.schema("part int, base long").orc(f"{path}/manifest")     # as many rows as parts
    return rows.join(F.broadcast(manifest), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of rows of ``read_tokens``."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=-1):
            lists = batch.column(3)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<i4", copy=False)      # the whole batch's ids: a view, never copied
            cuts = at.tolist()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield arrow_batch(schema, [batch.column(0), batch.column(1), np.diff(at), sums])
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, schema)


def op6_token_orc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-orc")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return checksums(read_tokens(spark, path))
