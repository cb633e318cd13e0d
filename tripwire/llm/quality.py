"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (sizes, shares of
kinds of characters and tokens, repetition).  Each class has a Gaussian whose
covariance is shrunk towards its pooled and its spherical form; the score is
the logistic function of the difference of log densities and log priors, with
Mahalanobis distances through Cholesky factors that are computed once.

The statistics are written once to the shared folder (some twenty numbers a
document), so texts are read once for learning and scoring.  Class sums and
products are summed by Spark over all labelled rows; only they reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm.common import TokenTable, arrow_batch, held_out, slices, table, written

POOLED_SHARE = 0.2      # weight of the pooled covariance in a class's
SPHERE_SHARE = 0.1      # weight of the spherical one
EDGE = 0.005            # keeps shares away from 0 and 1 before the logit
STATISTICS = ("log_tokens", "log_lines", "mean_token", "letters", "upper", "digits", "symbols", "marks_at_end", "tokens_without_letters",
              "tokens_with_symbols", "distinct", "most_frequent", "adjacent_repeats", "sentence_ends", "repeated_lines")
FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                         *[T.StructField(s, T.DoubleType()) for s in STATISTICS]])
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                       T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
USUAL_MARKS = frozenset(".,;:'’-–()\"?")


def _token_numbers(tokens: list[str]) -> np.ndarray:
    """Per token: characters, letters, upper-case letters, digits, unusual symbols, and flags of its kind."""
    out = np.zeros((len(tokens), 9))
    for row, token in zip(out, tokens):
        if token.isalpha():
            row[:3] = len(token), len(token), sum(map(str.isupper, token))
            continue
        letters = sum(map(str.isalpha, token))
        digits = sum(map(str.isdigit, token))
        symbols = sum(not c.isalnum() and c not in USUAL_MARKS for c in token)
        row[:] = (len(token), letters, sum(map(str.isupper, token)), digits, symbols,
                  not token[-1].isalnum(), letters == 0, symbols > 0, token[-1] in ".?!")
    return out


def _logit(share: float) -> float:
    share = min(1 - EDGE, max(EDGE, share))
    return float(np.log(share / (1 - share)))


def statistics(text: str, at: np.ndarray, numbers: np.ndarray) -> list[float]:
    """The transformed statistics of one text; ``at`` are its tokens' rows in ``numbers``.  An empty text has no share of anything."""
    n = max(1, len(at))
    chars, letters, upper, digits, symbols, marks, bare, symbolic, ends = numbers[at].sum(axis=0)
    times = np.unique(at, return_counts=True)[1] if len(at) else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    return [float(np.log1p(len(at))), float(np.log1p(len(lines))), float(np.log1p(chars / n)), _logit(letters / max(1, chars)),
            _logit(upper / max(1, letters)), _logit(digits / max(1, chars)), _logit(symbols / max(1, chars)), _logit(marks / n), _logit(bare / n),
            _logit(symbolic / n), _logit(len(times) / n), _logit(times.max() / n), _logit((at[1:] == at[:-1]).sum() / n), _logit(ends / n),
            _logit(1 - len(set(lines)) / max(1, len(lines)) if lines else 0)]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out`` and the statistics of its whole text (null counts as '')."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenTable(9, _token_numbers)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [statistics(t, at, tokens.values) for t, at in zip(texts, tokens.places([t.split() for t in texts]))]
            yield arrow_batch(FEATURES, [batch.column(0), batch.column(2), *[list(c) for c in zip(*rows)]])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out")).mapInArrow(run, FEATURES)


class Discriminant:
    """Class means and cached Cholesky factors of the shrunk covariances."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, products: np.ndarray):
        self.counts = counts
        if (counts < 2).any():
            return      # one class, or none: the score is the smoothed share of label 1
        means = sums / counts[:, None]
        spread = products / counts[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = (spread * counts[:, None, None]).sum(axis=0) / counts.sum()
        sphere = np.eye(len(pooled)) * max(1e-6, np.trace(pooled) / len(pooled))
        shrunk = (1 - POOLED_SHARE - SPHERE_SHARE) * spread + POOLED_SHARE * pooled + SPHERE_SHARE * sphere
        self.means = means
        factors = np.linalg.cholesky(shrunk)
        self.whiten = np.linalg.inv(factors)
        self.offset = np.log(counts / counts.sum()) - np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if (self.counts < 2).any():
            return np.full(len(x), (self.counts[1] + 1) / (self.counts.sum() + 2))
        logs = [self.offset[c] - 0.5 * (((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the labelled rows that aren't held out; labels other than 0 and 1 teach nothing.

    Class counts, sums and products are a fixed number of values; Spark sums them.
    """
    d = len(STATISTICS)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & ~held_out("doc_id"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = (features.filter("NOT held_out").join(marks, "doc_id").groupBy("label")
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)],
                 *[F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in pairs]).collect())
    counts, firsts, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in sums:
        counts[r.label] = r.n
        firsts[r.label] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            products[r.label, i, j] = products[r.label, j, i] = r[f"p{i}_{j}"]
    return Discriminant(counts, firsts, products)


def predict(features: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (higher: label 1 likelier), ``predicted`` (1 from 0.5 on)."""
    held = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.score(np.column_stack([c.to_numpy() for c in batch.columns[2:]]))
            yield arrow_batch(SCORED, [batch.column(0), batch.column(1), scores, (scores >= 0.5).astype(np.int32)])
    return features.select("doc_id", "held_out", *STATISTICS).mapInArrow(run, SCORED)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A score for every row of ``docs``; repeated rows are scored each, a null id stays null, an empty table gives no rows.

    Labels are joined by id: one that meets no document teaches nothing, one
    that meets repeated rows teaches by each.  Other columns aren't read.
    """
    features = written(document_statistics(docs), "quality-statistics")
    return predict(features, fit(features, labels))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
