"""Shared helpers: table reading, the shared folder, bounded caches, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch handled at a time by Python operators; texts of one slice live together in a worker.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset on a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tripwire-llm-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class _Open(threading.local):
    def __init__(self):
        self.paths: list[list[str]] = []    # a list for each ``settled`` at work, the innermost last


_open = _Open()
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is ever overwritten."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _open.paths[-1:]:
        paths.append(path)
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors.

    The shuffle files of the write go with its end; else they stay until the driver collects its garbage.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """``make()`` written; the files written on the way to it go as soon as it is there.

    Only for results whose steps nobody reads any more: what ``make`` has kept of them can't be read afterwards.
    """
    _open.paths.append([])
    try:
        df = make()
    finally:
        steps = _open.paths.pop()
    result = written(df, name)
    for path in steps:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return result


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes in column ``text`` (one row at least).

    After the last one the worker returns the memory of the batches, which it would keep as long as it waits for tasks.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) if text >= 0 else None
        start = 0
        while start < batch.num_rows:
            stop = min(batch.num_rows, start + rows)
            if ends is not None:
                before = ends[start - 1] if start else 0
                stop = min(stop, max(start + 1, int(np.searchsorted(ends, before + size))))
            yield batch.slice(start, stop - start)
            start = stop
    batch = None
    pa.default_memory_pool().release_unused()


def arrow_batch(schema: T.StructType, columns: Sequence) -> pa.RecordBatch:
    """A record batch of ``columns`` in the order of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(id_column: str, folds: int = 3, fold: int = 1) -> Column:
    """True where crc32 of the id as text, modulo ``folds``, is ``fold``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


_held: dict = {}


def held_alone(make: Callable) -> Callable:
    """As ``lru_cache`` of one entry, which all such functions share.

    Workers are reused from operator to operator; one keeps the vocabulary and
    the caches of the operator at work, not those of all before.
    """
    @wraps(make)
    def get(*key):
        if (make, key) not in _held:
            _held.clear()
            gc.collect()        # caches refer to their owners
            _held[make, key] = make(*key)
        return _held[make, key]
    return get


class BoundedCache(dict):
    """A dict that computes missing values.

    It holds two generations of at most ``limit`` entries: when the young one
    is full it becomes the old one, from which entries still in use come back.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TokenTable:
    """A row of numbers for each distinct token, computed once for all new tokens of a slice; bounded in size."""

    def __init__(self, width: int, compute, limit: int = 400_000, dtype=np.float64):
        self.width, self.compute, self.limit, self.dtype = width, compute, limit, dtype
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.zeros((1024, self.width), self.dtype)

    def places(self, texts: Sequence[Sequence[str]]) -> Iterator[np.ndarray]:
        """For each list of tokens their rows in ``values``; valid until the next call."""
        if len(self.known) > self.limit:
            self.clear()
        lacking = list(set().union(*texts).difference(self.known))
        if lacking:
            first = len(self.known)
            if first + len(lacking) > len(self.values):
                grown = np.zeros((max(2 * len(self.values), first + len(lacking)), self.width), self.dtype)
                grown[:first] = self.values[:first]
                self.values = grown
            self.values[first:first + len(lacking)] = self.compute(lacking)
            self.known.update(zip(lacking, range(first, first + len(lacking))))
        for tokens in texts:
            yield np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))


def salted_join(rows: DataFrame, groups: DataFrame, key: str, by: Sequence[str], salts: int = 16) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row a ``key``): a group's rows are dealt to ``salts`` tasks by the columns ``by``."""
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).join(copies, [key, "_salt"], "left").drop("_salt")
