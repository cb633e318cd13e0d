"""Line dedup with a log-template tree.

A line's tokens are its words; short words with digits are variable fields from
the start, where the line's other words are enough and most of it.  Any other
line with digits (a table row, a date, a paragraph without spaces) is only equal
to itself.  The tree has a fixed depth: a leaf is a token count and the leading
tokens.  Inside a leaf a token that enough texts hold at its place is constant,
any other is a variable field; a line whose share of constants without digits is
high enough, and whose fields are short, has the template of its constants,
another line is its own template.  A template
that enough different texts hold is recurring, and its lines are dropped from
all texts but the one of the smallest document id.  A long line recurs as soon
as a second text has the same line, whatever its template.  Exact copies are
one text here, so copies of a document lose the same lines or none.

Texts are read twice: once to count the lines of each leaf and the equal long
lines, once for the lines that can recur at all (screened by a bitmap of fixed
size).  Between, only hashes and those lines are shuffled; the texts themselves
go through one join at the end.

``passage_dedup`` has the rule of long lines alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import salted_join, settled, table, written
from tripwire.llm.sieve import passes, sieve

DEPTH = 3               # leading tokens that choose the leaf
MIN_TEXTS = 10          # different texts that make a template recurring, and a token constant
MIN_CONSTANT = 0.7      # share of constant tokens that makes a template; fields are not constant
MIN_FIXED = 3           # constant tokens of a template at least
LONG_WORDS, LONG_CHARS = 8, 60      # a line of so many words, or so many characters, is a passage
LONG_TEXTS = 2          # different texts that make a passage recurring
COPY_TASKS = 4          # copies of a text are dealt to so many tasks in the last join, each with what the text loses
FIELD = "<*>"
#: A field has up to 64 characters; in scripts without spaces, where a word can be a paragraph, up to 8.
UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
SHORT = rf"(?:[^ {UNSPACED}]{{1,64}}|[^ ]{{1,8}})"


def spaced_lines(text: Column) -> Column:
    """The text's lines, single-spaced; their ends are still to be trimmed.  What is a single space already is left alone."""
    return F.split(F.regexp_replace(text, r"[ \t\r\f\x0B](?:(?<! )[ \t\r\f\x0B]*|[ \t\r\f\x0B]+)", " "), "\n", -1)


def n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def masked(words: Column, min_constant: float) -> Column:
    """A line's words with short words that hold a digit as variable fields; only where the others are ``MIN_FIXED`` and that share of it."""
    every = n_words(words)
    fixed = every - F.regexp_count(words, F.lit("[0-9][^ ]*"))
    fields = F.regexp_replace(words, rf"(?<![^ ])(?=[^ 0-9]*+[0-9]){SHORT}(?![^ ])", FIELD)
    # nested: most lines have no digit, and their words aren't looked at
    return F.when(words.rlike("[0-9]"), F.when((fixed >= MIN_FIXED) & (fixed / every >= min_constant), fields).otherwise(words)).otherwise(words)


def line_key(words: Column) -> Column:
    return F.unhex(F.md5(words.cast("binary")))


def lines_of(text: Column, min_constant: float) -> Column:
    """The text's lines as structs: ``spaced`` and ``words``, with fields masked."""
    # two transforms: the second uses the spaced line several times
    return F.transform(F.transform(spaced_lines(text), lambda line: F.trim(line)), lambda line: F.struct(line.alias("spaced"), masked(line, min_constant).alias("words")))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def is_long(line: Column) -> Column:
    return (n_words(line) >= LONG_WORDS) | (F.length(line) >= LONG_CHARS)


def template_lines(docs: DataFrame, depth: int, min_constant: float) -> DataFrame:
    """The lines with words: ``doc_id``, ``text_key``, ``text_hash``, ``spaced``, ``words``, ``leaf``, and ``equal``, a hash of a long line."""
    # a generator's other columns are computed once a row that it makes, so the text's hashes come before it;
    # the columns of the lines come after it, one upon the other, as code that Spark compiles
    texts = docs.filter("text IS NOT NULL").select("doc_id", text_key(F.col("text")).alias("text_key"), F.xxhash64("text").alias("text_hash"), "text")
    lines = (texts.select("doc_id", "text_key", "text_hash", F.explode(spaced_lines(F.col("text"))).alias("line"))
             .select("doc_id", "text_key", "text_hash", F.trim("line").alias("spaced")).filter("spaced <> ''")
             .select("*", masked(F.col("spaced"), min_constant).alias("words")))
    return lines.select("*", F.xxhash64(n_words(F.col("words")), F.substring_index("words", " ", depth)).alias("leaf"),
                        F.when(is_long(F.col("spaced")), F.xxhash64(F.lit("long"), "spaced")).alias("equal"))


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_texts: int = MIN_TEXTS, min_constant: float = MIN_CONSTANT, long_texts: int | None = LONG_TEXTS) -> DataFrame:
    """``text_key`` and ``drop``: the keys of the lines that the text loses; only for texts that lose any."""
    lines = template_lines(docs, depth, min_constant)
    either = F.array(F.struct(F.lit(False).alias("long"), F.col("leaf").alias("hash")), F.struct(F.lit(True).alias("long"), F.col("equal").alias("hash")))
    if long_texts is None:
        either = F.slice(either, 1, 1)
    counts = (lines.select("text_hash", F.inline(either)).filter("hash IS NOT NULL").groupBy("long", "hash")
              .agg(F.count(F.lit(1)).alias("count"), (F.min("text_hash") < F.max("text_hash")).alias("apart")))
    least = F.when(F.col("long"), F.col("apart") & (F.col("count") >= (long_texts or 0))).otherwise(F.col("count") >= min_texts)     # the lines of copies aren't apart
    busy = written(sieve(counts.filter(least), ["hash"]), "busy-lines")
    screened = passes(passes(lines.withColumn("hash", F.col("leaf")), busy, ["hash"], "busy").withColumn("hash", F.col("equal")), busy, ["hash"], "again")
    if long_texts is None:
        screened = screened.withColumn("again", F.lit(False))
    screened = screened.withColumn("again", F.col("again") & F.col("equal").isNotNull()).filter("busy OR again")
    ways = F.array(F.when(F.col("busy"), F.struct(F.lit(False).alias("long"), F.col("leaf"), F.col("words"))),
                   F.when(F.col("again"), F.struct(F.lit(True).alias("long"), F.col("equal").alias("leaf"), F.col("spaced").alias("words"))))
    both = screened.select("doc_id", "text_key", F.inline(F.array_compact(ways))).withColumn("line_key", line_key(F.col("words")))
    both = written(both.groupBy("long", "leaf", "line_key", "text_key").agg(F.min("doc_id").alias("doc_id"), F.first(F.when(~F.col("long"), F.col("words"))).alias("words")), "template-lines")
    held = both.filter("NOT long")

    distinct = held.groupBy("leaf", "line_key").agg(F.count(F.lit(1)).alias("texts"), F.first("words").alias("words"))
    tokens = distinct.select("leaf", "line_key", "texts", F.posexplode(F.split("words", " ")).alias("place", "token"))
    constant = (tokens.groupBy("leaf", "place", "token").agg(F.sum("texts").alias("support"))
                .filter(F.col("support") >= min_texts).select("leaf", "place", "token", F.lit(True).alias("constant")))
    shape = F.transform(F.sort_array(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("token")).otherwise(FIELD).alias("part")))),
                        lambda x: x["part"])
    fixed = F.count(F.when(F.col("constant") & ~F.col("token").rlike("[0-9]") & (F.col("token") != FIELD), True))
    long_field = F.max(F.col("constant").isNull() & ~F.col("token").rlike(f"^{SHORT}$"))
    templates = (tokens.join(constant, ["leaf", "place", "token"], "left").groupBy("leaf", "line_key")
                 .agg(shape.alias("shape"), fixed.alias("fixed"), (fixed / F.count(F.lit(1))).alias("share"), long_field.alias("long_field"))
                 .select("line_key", F.when((F.col("share") >= min_constant) & (F.col("fixed") >= MIN_FIXED) & ~F.col("long_field"), line_key(F.concat(F.lit("template "), F.array_join("shape", " "))))
                         .otherwise(F.col("line_key")).alias("template")))

    # lines and templates that many texts hold are dealt to several tasks
    lost = lost_lines(salted_join(held.select("line_key", "text_key", "doc_id"), templates, "line_key", ["text_key"]), min_texts)
    if long_texts is not None:
        lost = lost.unionByName(lost_passages(both.filter("long").select("line_key", "text_key", "doc_id"), long_texts))
    return lost.groupBy("text_key").agg(F.collect_set("line_key").alias("drop"))


def lost_lines(of: DataFrame, min_texts: int) -> DataFrame:
    """``text_key`` and ``line_key`` from the lines' ``template``, ``line_key``, ``text_key`` and ``doc_id``: the text of the smallest id keeps a template."""
    recurring = (of.groupBy("template").agg(F.countDistinct("text_key").alias("texts"), F.min(F.struct("doc_id", "text_key")).alias("first"))
                 .filter(F.col("texts") >= min_texts).select("template", F.col("first.text_key").alias("keeper")))
    return salted_join(of, recurring, "template", ["text_key"]).filter(F.col("text_key") != F.col("keeper")).select("text_key", "line_key")


def lost_passages(of: DataFrame, min_texts: int) -> DataFrame:
    """As ``lost_lines`` for lines that are only equal to themselves, one row a line and text."""
    recurring = (of.groupBy("line_key").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("doc_id", "text_key")).alias("first"))
                 .filter(F.col("texts") >= min_texts).select("line_key", F.col("first.text_key").alias("keeper")))
    return salted_join(of, recurring, "line_key", ["text_key"]).filter(F.col("text_key") != F.col("keeper")).select("text_key", "line_key")


def passages(docs: DataFrame, min_texts: int = LONG_TEXTS) -> DataFrame:
    """``text_key`` and ``drop``, as ``recurring_lines``, of equal long lines in at least ``min_texts`` different texts."""
    texts = docs.filter("text IS NOT NULL").select("doc_id", text_key(F.col("text")).alias("text_key"), "text")      # once a text, not once a line
    lines = texts.select("doc_id", "text_key", F.explode(spaced_lines(F.col("text"))).alias("line")).select("doc_id", "text_key", F.trim("line").alias("words"))
    held = written(lines.filter(is_long(F.col("words"))).groupBy(line_key(F.col("words")).alias("line_key"), "text_key").agg(F.min("doc_id").alias("doc_id")), "passages")
    return lost_passages(held, min_texts).groupBy("text_key").agg(F.collect_set("line_key").alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_texts: int = MIN_TEXTS,
               min_constant: float = MIN_CONSTANT, long_texts: int | None = LONG_TEXTS) -> DataFrame:
    """All rows and columns of ``docs``, the text without its recurring lines, as column ``row``, with ``lines`` and ``dropped`` counts.

    ``long_texts`` is the number of texts at which an equal long line recurs;
    None leaves this rule out.  ``row`` is a struct of the columns of ``docs``,
    so no other column can clash.  Blank lines always stay.  A null text stays
    null, an empty one empty, and a text that loses every line becomes empty.
    Long texts are taken whole, line by line.  Repeated rows and exact copies
    get the same text.  A null id counts as the smallest.  An empty table gives
    no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    drops = settled(lambda: recurring_lines(slim, depth, min_texts, min_constant, long_texts), docs.sparkSession, "lost-lines")
    return without_lines(docs, drops, lines_of(F.col("row").getField(text_col), min_constant), id_col, text_col)


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``line_dedup``, the text without the long lines that stand in a text of a smaller id too.

    A bitmap of fixed size tells texts that are certain to lose nothing: they
    stay where they are, and only the others are shuffled.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    drops = settled(lambda: passages(slim), docs.sparkSession, "lost-passages")
    text = F.col("row").getField(text_col)
    every = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), text_key(F.col(text_col)).alias("text_key"))
    screened = passes(every, sieve(drops, ["text_key"]), ["text_key"], "loses")
    lines = F.transform(F.transform(spaced_lines(text), lambda line: F.trim(line)), lambda line: F.struct(line.alias("spaced"), line.alias("words")))
    whole = screened.filter("NOT loses").select("row", F.greatest(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("lines"), F.lit(0).cast("long").alias("dropped"))
    return whole.unionByName(without_lines(screened.filter("loses").select("row.*"), drops, lines, id_col, text_col))


def without_lines(docs: DataFrame, drops: DataFrame, keys: Column, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``line_dedup`` without the lines in ``drops``; ``keys`` has the two forms of each line that its keys are taken of."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    # null texts have no lines to lose: a key of their own each keeps them apart
    own = F.coalesce(text_key(F.col(text_col)), F.unhex(F.md5(F.concat(F.lit("null "), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))))
    rows = docs.select(row.alias("row"), own.alias("text_key"), F.col(id_col).alias("_of"))
    text = F.col("row").getField(text_col)
    lines = F.split(text, "\n", -1)
    both = F.arrays_zip(lines.alias("line"), keys.alias("keys"))
    gone = lambda x: F.array_contains("drop", line_key(x["keys"]["words"])) | (is_long(x["keys"]["spaced"]) & F.array_contains("drop", line_key(x["keys"]["spaced"])))
    kept = F.when(F.col("drop").isNotNull(), F.transform(F.filter(both, lambda x: ~gone(x)), lambda x: x["line"]))
    before = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    joined = salted_join(rows, drops, "text_key", ["_of"], COPY_TASKS).select("row", F.col("drop").isNotNull().alias("touched"), before.alias("before"), kept.alias("kept"))
    return joined.select(F.col("row").withField(text_col, F.when(F.col("touched"), F.array_join("kept", "\n")).otherwise(text)).alias("row"),
                         F.col("before").cast("long").alias("lines"),
                         F.when(F.col("touched"), F.col("before") - F.size("kept")).otherwise(0).cast("long").alias("dropped"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("row.doc_id", "row.text", "lines", "dropped")


def oracle(documents: str = "documents", depth: int = DEPTH, min_texts: int = MIN_TEXTS, min_constant: float = MIN_CONSTANT, long_texts: int = LONG_TEXTS) -> str:
    short = f"(?:[^ {UNSPACED.replace('{Is', '{')}]{{1,64}}|[^ ]{{1,8}})"

    def gap(line: str) -> str:
        return f"trim(regexp_replace({line}, '[ \\t\\r\\f\\v]+', ' ', 'g'))"

    def words(line: str) -> str:
        every = f"string_split({line}, ' ')"
        fixed = f"len(list_filter({every}, lambda w: NOT regexp_matches(w, '[0-9]')))"
        field = f"regexp_matches(w, '[0-9]') AND regexp_full_match(w, '{short}')"
        return (f"CASE WHEN {fixed} >= {MIN_FIXED} AND {fixed}::DOUBLE / len({every}) >= {min_constant} THEN "
                f"array_to_string(list_transform({every}, lambda w: CASE WHEN {field} THEN '{FIELD}' ELSE w END), ' ') ELSE {line} END")

    return f"""
WITH split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM {documents} WHERE text IS NOT NULL),
spaced AS (SELECT doc_id, text, {gap('line')} AS spaced FROM split),
lines AS (SELECT doc_id, text, spaced, {words('spaced')} AS words FROM spaced),
held AS (
  SELECT text, words, string_split(words, ' ') AS tokens, len(string_split(words, ' ')) || '|' || array_to_string(string_split(words, ' ')[1:{depth}], ' ') AS leaf,
         min(doc_id) AS doc_id
  FROM lines WHERE words <> '' GROUP BY ALL),
distinct_lines AS (SELECT leaf, words, any_value(tokens) AS tokens, count(*) AS texts FROM held GROUP BY leaf, words),
tokens AS (SELECT leaf, words, texts, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM distinct_lines),
constants AS (SELECT leaf, place, token FROM tokens GROUP BY ALL HAVING sum(texts) >= {min_texts}),
marked AS (SELECT t.*, c.token IS NOT NULL AS constant, c.token IS NOT NULL AND NOT regexp_matches(t.token, '[0-9]') AND t.token <> '{FIELD}' AS fixed
  FROM tokens t LEFT JOIN constants c USING (leaf, place, token)),
templates AS (
  SELECT words, CASE WHEN avg(fixed::INT) >= {min_constant} AND sum(fixed::INT) >= {MIN_FIXED} AND NOT bool_or(NOT constant AND NOT regexp_full_match(token, '{short}'))
         THEN 'template ' || string_agg(CASE WHEN constant THEN token ELSE '{FIELD}' END, ' ' ORDER BY place) ELSE 'line ' || words END AS template
  FROM marked GROUP BY leaf, words),
held_templates AS (SELECT h.text, h.words, h.doc_id, t.template FROM held h JOIN templates t USING (words)),
recurring AS (SELECT template, arg_min(text, (doc_id, md5(text))) AS keeper FROM held_templates GROUP BY template HAVING count(DISTINCT text) >= {min_texts}),
long_lines AS (SELECT spaced, text, min(doc_id) AS doc_id FROM lines WHERE len(string_split(spaced, ' ')) >= {LONG_WORDS} OR length(spaced) >= {LONG_CHARS} GROUP BY ALL),
long_recurring AS (SELECT spaced, arg_min(text, (doc_id, md5(text))) AS keeper FROM long_lines GROUP BY spaced HAVING count(DISTINCT text) >= {long_texts}),
drops AS (SELECT text, list(DISTINCT words) AS gone FROM held_templates h JOIN recurring r USING (template) WHERE h.text <> r.keeper GROUP BY text),
long_drops AS (SELECT text, list(DISTINCT spaced) AS long_gone FROM long_lines JOIN long_recurring USING (spaced) WHERE text <> keeper GROUP BY text),
kept AS (
  SELECT d.doc_id, d.text AS old, string_split(d.text, chr(10)) AS all_lines,
         CASE WHEN gone IS NULL AND long_gone IS NULL THEN string_split(d.text, chr(10))
              ELSE list_filter(string_split(d.text, chr(10)), lambda line: NOT (list_contains(coalesce(gone, []), {words(gap('line'))})
                   OR list_contains(coalesce(long_gone, []), {gap('line')}))) END AS stay
  FROM {documents} d LEFT JOIN drops USING (text) LEFT JOIN long_drops USING (text))
SELECT doc_id, CASE WHEN old IS NULL THEN NULL ELSE coalesce(array_to_string(stay, chr(10)), '') END AS text, coalesce(len(all_lines), 0) AS lines,
       coalesce(len(all_lines) - len(stay), 0) AS dropped
FROM kept
"""
