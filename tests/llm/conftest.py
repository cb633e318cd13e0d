import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tripwire.llm.common import shared_dir  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, lang[, source]]) rows, with an extra column for each name in ``extra``."""
    shared_dir(spark)

    def make(rows, extra=()):
        schema = T.StructType([*DOCUMENTS.fields, *[T.StructField(e, T.StringType()) for e in extra]])
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *(None, None, None, None)[len(row):])
            full.append((doc_id, text, lang, source, len(text) if text is not None else None, *["x"] * len(extra)))
        return spark.createDataFrame(full, schema)
    return make


@pytest.fixture(scope="session")
def sql():
    """Run DuckDB SQL over pandas tables."""
    def run(query, **tables):
        db = duckdb.connect()
        for name, frame in tables.items():
            db.register(name, frame)
        return db.execute(query).df()
    return run


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="tripwire-llm-test-", dir=os.environ.get("TMPDIR"))

