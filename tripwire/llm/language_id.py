"""Language ID by unigrams over pieces, marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum over all ways to cut it into pieces, by the
forward algorithm; a text's is the product over its words (pieces don't cross
white space).  Probabilities are learned by expectation-maximisation: expected
piece counts from forward and backward sums over the distinct words of the
training texts.

The model (pieces x languages) has a fixed size, so it is collected and
broadcast.  It is fitted on about ``TRAIN_ROWS`` documents a language, chosen
by a hash of the id; every document is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm.common import TokenTable, arrow_batch, held_alone, held_out, slices, table, written

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
TRAIN_ROWS = 4000       # documents a language, about
ROUNDS = 2
LEAST_SCORE = 0.5       # a text below it is rejected
LEAST_GAIN = 0.0        # and one whose language explains its letters no better than the background
SMOOTHING = 0.1
HELD_BYTES = 2 << 20    # texts whose words are held at once beside whole rows
LATTICE_CHARS = 48      # words up to this length go through the joint lattice, longer ones alone
SCALE = 32.0            # keeps products of probabilities in range: one factor a character
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")       # marks stay with the letters that they follow
COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
EXPECTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("n", T.DoubleType())])
LABELLED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                         T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("gain", T.DoubleType())])


class Pieces:
    """The vocabulary's pieces by the hash of their characters, and one more id, ``other``, for any character that is no piece."""

    SLOT_BITS = 20
    BASE, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)     # odd multipliers

    def __init__(self, strings: dict[str, int], other: int):
        self.other, self.size = other, other + 1
        self.longest = max(map(len, strings))
        known = sorted((self._hash(s), i) for s, i in strings.items())
        self.hashes = np.array([h for h, _ in known], np.uint64)
        self.ids = np.array([i for _, i in known], np.int64)
        self.whole = self._marks(self.hashes)
        self.begun = self._marks(np.array([self._hash(s[:n]) for s in strings for n in range(1, len(s))], np.uint64))

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls({model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))},
                   model.vocab_size())

    def _hash(self, string: str) -> int:
        h = 0
        for c in string:
            h = (h * int(self.BASE) + ord(c) + 1) % (1 << 64)
        return h

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * self.SPREAD) >> np.uint64(64 - self.SLOT_BITS)

    def _marks(self, hashes: np.ndarray) -> np.ndarray:
        marks = np.zeros(1 << self.SLOT_BITS, bool)
        marks[self._slots(hashes)] = True
        return marks

    def edges(self, words: list[str]) -> np.ndarray:
        """All pieces of all words: columns word, start, end, piece id; in the order of words and starts."""
        lengths = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        firsts = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        ends = np.repeat(firsts + lengths, lengths)
        at, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found_at, found_length, found_id = [], [], []
        for length in range(1, self.longest + 1):
            inside = at + length <= ends[at]
            at, hashes = at[inside], hashes[inside] * self.BASE + codes[at[inside] + length - 1]
            if not len(at):
                break
            slots = self._slots(hashes)
            some = np.flatnonzero(self.whole[slots])
            place = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            equal = self.hashes[place] == hashes[some]
            some, ids = some[equal], self.ids[place[equal]]
            if length == 1:
                single = np.full(len(codes), self.other)
                single[at[some]] = ids
                found_at.append(at)
                found_id.append(single)
                found_length.append(np.ones(len(codes), np.int64))
            else:
                found_at.append(at[some])
                found_id.append(ids)
                found_length.append(np.full(len(some), length))
            more = self.begun[slots]
            at, hashes = at[more], hashes[more]
        at, length, ids = (np.concatenate(x) for x in (found_at, found_length, found_id))
        order = np.argsort(at, kind="stable")
        at, length, ids = at[order], length[order], ids[order]
        start = at - firsts[word[at]]
        return np.column_stack([word[at], start, start + length, ids])


@held_alone
def pieces(path: str | None = None) -> Pieces:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    return Pieces.load(path)


def _sweep(edges: np.ndarray, weight: np.ndarray, sums: np.ndarray, come: int, go: int, order: range) -> None:
    """Fill ``sums`` (word, place, language) along the lattice; ``come`` and ``go`` are edge columns."""
    by_place = edges[:, go].argsort(kind="stable")
    cuts = np.searchsorted(edges[by_place, go], np.arange(sums.shape[1] + 1))
    for place in order:
        at = by_place[cuts[place]:cuts[place + 1]]
        if len(at):
            words = edges[at, 0]
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            sums[words[first], place] += np.add.reduceat(sums[words, edges[at, come]] * weight[at], first, axis=0)


def forward(words: list[str], probabilities: np.ndarray, vocabulary: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges, their weights and the forward sums of words of at most LATTICE_CHARS characters."""
    edges = vocabulary.edges(words)
    weight = probabilities[edges[:, 3]] * SCALE ** (edges[:, 2] - edges[:, 1])[:, None]
    sums = np.zeros((len(words), max(map(len, words)) + 1, probabilities.shape[1]))
    sums[:, 0] = 1
    _sweep(edges, weight, sums, 1, 2, range(1, sums.shape[1]))
    return edges, weight, sums


def _long_word(word: str, logs: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """The same sum for one word of any length, by logarithms."""
    edges = vocabulary.edges([word])
    edges = edges[edges[:, 2].argsort(kind="stable")]
    cuts = np.searchsorted(edges[:, 2], np.arange(len(word) + 2))
    sums = np.zeros((len(word) + 1, logs.shape[1]))
    for place in range(1, len(word) + 1):
        at = edges[cuts[place]:cuts[place + 1]]
        sums[place] = np.logaddexp.reduce(sums[at[:, 1]] + logs[at[:, 3]], axis=0)
    return sums[-1]


def word_scores(words: list[str], probabilities: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    out = np.zeros((len(words), probabilities.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LATTICE_CHARS]
    for start in range(0, len(short), 4096):
        some = short[start:start + 4096]
        lengths = np.array([len(words[i]) for i in some])
        sums = forward([words[i] for i in some], probabilities, vocabulary)[2]
        out[some] = np.log(sums[np.arange(len(some)), lengths]) - (lengths * np.log(SCALE))[:, None]
    logs = np.log(probabilities)
    for i, w in enumerate(words):
        if len(w) > LATTICE_CHARS:
            out[i] = _long_word(w, logs, vocabulary)
    return out


def expected_counts(words: list[str], counts: np.ndarray, probabilities: np.ndarray, vocabulary: Pieces) -> np.ndarray:
    """Expected count of each piece over all segmentations of the words, in one language (``probabilities`` has one column)."""
    edges, weight, ahead = forward(words, probabilities, vocabulary)
    lengths = np.array([len(w) for w in words])
    behind = np.zeros_like(ahead)
    behind[np.arange(len(words)), lengths] = 1
    _sweep(edges, weight, behind, 2, 1, range(behind.shape[1] - 1, -1, -1))
    w = edges[:, 0]
    share = (ahead[w, edges[:, 1]] * weight * behind[w, edges[:, 2]])[:, 0] / ahead[w, lengths[w], 0]
    return np.bincount(edges[:, 3], share * counts[w], minlength=vocabulary.size)


def marked(token: str) -> list[str]:
    """A token's runs of letters, lower-cased; each begins a word of the lattice."""
    return ["▁" + run for run in LETTERS.findall(token.lower())]


class Model:
    """Piece probabilities of each language; the background model, which knows no language, gives every piece the same."""

    def __init__(self, languages: list[str], probabilities: np.ndarray):
        self.languages, self.probabilities = languages, probabilities

    def choose(self, total: np.ndarray) -> tuple[str, float, float]:
        """The likeliest language, its share of the likelihood, and its gain a letter over the background.

        ``total`` has the log-likelihoods of the languages and the background, then the number of letters.
        """
        if total[-1] == 0 or not self.languages:
            return UNKNOWN, 0.0, 0.0
        best = int(total[:-2].argmax())
        return self.languages[best], float(1 / np.exp(total[:-2] - total[best]).sum()), float((total[best] - total[-2]) / total[-1])

    def scorer(self, vocabulary: Pieces) -> TokenTable:
        """Per token its log-likelihoods, the background last, and its number of letters."""
        models = np.column_stack([self.probabilities, np.full(len(self.probabilities), 1 / len(self.probabilities))])
        width = len(self.languages)

        def compute(tokens: list[str]) -> np.ndarray:
            words = [marked(t) for t in tokens]
            distinct = list(dict.fromkeys(w for ws in words for w in ws))
            out = np.zeros((len(tokens), width + 2))
            out[:, -1] = [sum(map(len, ws)) - len(ws) for ws in words]
            if distinct and width:
                place = {w: i for i, w in enumerate(distinct)}
                scores = word_scores(distinct, models, vocabulary)
                of = np.array([i for i, ws in enumerate(words) for _ in ws], np.int64)
                np.add.at(out[:, :-1], of, scores[[place[w] for ws in words for w in ws]])
            return out
        return TokenTable(width + 2, compute)


def fit(train: DataFrame, vocabulary: str | None = None, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """Learn from ``lang``, ``text`` and ``doc_id`` (which only chooses the sample); null languages and texts teach nothing."""
    spark = train.sparkSession
    train = train.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = train.groupBy("lang").count()
    share = F.lit(float(rows)) / F.col("count")
    chance = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1_000_000
    sample = train.join(F.broadcast(sizes), "lang").filter(chance < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(counts):
            return arrow_batch(COUNTED, [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())])
        counts: Counter = Counter()
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for token, n in Counter(text.split()).items():
                    for word in marked(token):
                        for start in range(0, len(word), LATTICE_CHARS):    # a longer word teaches by its parts
                            counts[lang, word[start:start + LATTICE_CHARS]] += n
            if len(counts) > 200_000:
                yield rows_of(counts)
                counts = Counter()
        if counts:
            yield rows_of(counts)

    words = written(sample.mapInArrow(count, COUNTED).groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    size = pieces(vocabulary).size
    probabilities = np.full((size, max(1, len(languages))), 1 / size)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((languages, probabilities))

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            (names, current), own = held.value, pieces(vocabulary)
            totals = {}
            for batch in slices(batches, rows=4096):
                langs, ws, ns = (batch.column(i).to_pylist() for i in range(3))
                for lang in set(langs):
                    at = [i for i, x in enumerate(langs) if x == lang]
                    column = names.index(lang)
                    totals[lang] = totals.get(lang, 0) + expected_counts(
                        [ws[i] for i in at], np.array([ns[i] for i in at], float), current[:, column:column + 1], own)
            for lang, counts in totals.items():
                some = np.flatnonzero(counts)
                yield arrow_batch(EXPECTED, [[lang] * len(some), some.astype(np.int32), counts[some]])

        sums = words.mapInArrow(expect, EXPECTED).groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros_like(probabilities)
        for r in sums:
            counts[r.piece, languages.index(r.lang)] = r.n
        probabilities = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)
    return Model(languages, probabilities)


def predict(docs: DataFrame, model: Model, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``gain`` for every row's whole text.

    ``score`` is the language's share of the likelihood of all languages; ties
    go to the first in the alphabet.  ``gain`` is by how much the language
    explains a letter better than the background model, in nats: below 0 for
    gibberish and for languages that weren't learned.  A null text, one without
    a letter (category L; digits-like symbols aren't letters), or a model
    without languages gives ``und``, score 0 and gain 0.  Long texts are scored
    whole; repeated rows are scored each; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        scorer = own.scorer(pieces(vocabulary))
        for batch in slices(batches):
            chosen = [own.choose(scorer.values[at].sum(axis=0)) for at in scorer.places([(t or "").split() for t in batch.column(1).to_pylist()])]
            yield arrow_batch(LABELLED, [batch.column(0), batch.column(2), *([x[k] for x in chosen] for k in range(3))])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out")).mapInArrow(run, LABELLED)


def identified(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE, least_gain: float = LEAST_GAIN, vocabulary: str | None = None,
               text_col: str = "text") -> DataFrame:
    """The whole rows of ``docs`` whose text has a language with at least ``least_score`` and ``least_gain``; one narrow pass, no join."""
    held, schema, column = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.scorer(pieces(vocabulary))
        for batch in slices(batches, text=column, size=HELD_BYTES):
            chosen = [held.value.choose(scorer.values[at].sum(axis=0))
                      for at in scorer.places([(t or "").split() for t in batch.column(column).to_pylist()])]
            yield batch.filter(pa.array([name != UNKNOWN and score >= least_score and gain >= least_gain for name, score, gain in chosen], pa.bool_()))
    return docs.mapInArrow(run, schema)


def fitted(docs: DataFrame, vocabulary: str | None = None) -> Model:
    """Fit on the rows that aren't held out."""
    return fit(docs.filter(~held_out("doc_id")).select("doc_id", "lang", "text"), vocabulary)


def language_id(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return predict(docs, fitted(docs, vocabulary), vocabulary)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
