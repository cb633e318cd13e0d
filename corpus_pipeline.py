"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, tokens.

Each stage reads what the stage before has written and works on all of it.
The first four return the columns of ``documents``; the last returns the
token counts and digests of the texts, encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.llm import bpe, language_id, line_dedup, mixing, near_dedup
from tripwire.llm.common import settled, table

#: Languages, weighted shingles and tokens aren't expressed in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, without a language likelier than the others together, or in no language that was learned, go.

    A null or empty text has no letter and goes.  Repeated rows are judged each,
    alike; an empty table stays empty; the columns stay as they are.
    """
    return language_id.identified(docs, language_id.fitted(docs))


def with_n_chars(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in rows.columns else rows


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all texts but the first; ``n_chars`` follows, every document stays.

    Long lines that only few texts share wait for the next stage: here they
    would go from near copies, which would then no longer be similar.  Null and
    empty texts, repeated rows and empty tables are as in ``line_dedup``; other
    columns stay.
    """
    return with_n_chars(line_dedup.line_dedup(docs, long_texts=None).select("row.*"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays; then equal long lines go from all of these but the first.

    Before, the second step would take from near copies all but their edited lines, and leave these as documents.
    The document of the smallest id stays; null, empty and wordless texts are
    one class, and repeated rows another.  All columns of a row stay.
    """
    apart = near_dedup.without_near_duplicates(docs).select("row.*")
    return with_n_chars(line_dedup.passage_dedup(apart).select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to the limit; rows come in the order of the mixture's blocks.

    A null source is the source ''; null and empty texts count one token;
    repeated rows have copies each.  All columns of a row stay.
    """
    return mixing.mixed(docs).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row's whole text; a null text is empty, repeated rows have a result each."""
    return bpe.round_trip_digests(docs)


STAGES = [("language ID", identify), ("line dedup", drop_lines), ("near dedup", drop_near_duplicates), ("mixing", mix), ("BPE", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next, after which it goes."""
    def after(stages: int) -> DataFrame:
        if not stages:
            return table(spark, sf_dir, "documents")
        name, stage = STAGES[stages - 1]
        return settled(lambda: stage(spark, after(stages - 1), sf_dir), spark, name.replace(" ", "-"))
    return STAGES[-1][1](spark, after(len(STAGES) - 1), sf_dir)
