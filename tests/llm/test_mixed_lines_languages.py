"""Mixing by source, lines of fields and passages, letters and unlearned languages, the default URL list."""
import random
from collections import Counter

from tests_llm_same import same

from tripwire.llm import language_id, line_dedup, mixing, url_filter


# ------------------------------------------------------------------ mixing
def test_a_row_gets_the_copies_of_its_own_source(docs_of):
    """One id and text in two sources: each row has the plan of its source, whatever the order of the input."""
    rows = [(1, "a b c", "en", "zsmall"), (1, "a b c", "en", "big")] + [(i, f"word {i} " * 30, "en", "big") for i in range(2, 60)]
    for order in (rows, rows[::-1]):
        docs = docs_of(order, extra=["block", "position", "_id", "nth"])
        plan = Counter((r.doc_id, r.source) for r in mixing.mixture(docs).collect())
        got = Counter((r.row.doc_id, r.row.source) for r in mixing.mixed(docs).collect())
        assert got == plan and got[1, "zsmall"] == 2 and got[1, "big"] == 1


def test_mixed_rows_are_the_plan_in_its_order(docs_of):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randrange(0, 40))), "en", rnd.choice(["x", "x", "x", "y", None])) for i in range(200)]
    rows += [(7, rows[7][1], "de", rows[7][3]), (7, rows[7][1], "en", rows[7][3]), (None, None, None, None), (None, None, None, "y"), (900, "", "en", "y")]
    docs = docs_of(rows)
    target = {"block_tokens": 150}
    plan = Counter((r.doc_id, r.source, r.block, r.position) for r in mixing.mixture(docs, **target).collect())
    got = mixing.mixed(docs, **target).collect()
    assert Counter((r.row.doc_id, r.row.source or "", r.block, r.position) for r in got) == plan
    assert [(r.block, r.position) for r in got] == sorted((r.block, r.position) for r in got)
    # rows that differ in other columns alone share the copies of all of them
    assert Counter(r.row.lang for r in got if r.row.doc_id == 7).keys() == {"en", "de"}
    assert mixing.mixed(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ lines
def test_rows_of_fields_and_long_lines_equal_sql(docs_of, sql):
    rnd = random.Random(9)
    rows = []
    for i in range(40):
        lines = [f"{rnd.randrange(99)} {rnd.randrange(99)} {rnd.randrange(99)}", f"total {i % 4}", f"page {rnd.randrange(9)} of this long report by the same two people 2024",
                 f"the server h{i} was seen in room r{i % 3} today", "第%d章の始まりは長い段落でした" % (i % 5), "short line", f"id{'x' * 70}{i % 2} is a long field in a line of words"]
        if i % 13 == 0:
            lines.append("this passage of a dozen words stands in only a few of the documents here")
        if i in (3, 30):
            lines.append("two documents   share this one passage,\tand nothing else at all")
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, rows[5][1])]
    docs = docs_of(rows)
    for long_texts in (2, 3):
        got = line_dedup.line_dedup(docs, long_texts=long_texts).select("row.doc_id", "row.text", "lines", "dropped").toPandas()
        same(got, sql(line_dedup.oracle(long_texts=long_texts), documents=docs.select("doc_id", "text").toPandas()))
    kept = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).select("row.*").collect()}
    assert sum("this passage of a dozen words" in (t or "") for t in kept.values()) == 1
    assert "share this one passage" in kept[3] and "share this one passage" not in kept[30] and kept[102] == kept[3]
    few = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, long_texts=None).select("row.*").collect()}
    assert sum("this passage of a dozen words" in (t or "") for t in few.values()) == 4


# ------------------------------------------------------------------ languages
def learned(docs_of):
    rnd = random.Random(2)
    words = {"en": ["the", "house", "stands", "under", "green", "trees", "where", "people", "walk"], "de": ["das", "haus", "steht", "unter", "grünen", "bäumen", "wo", "leute", "gehen"]}
    return language_id.fit(docs_of([(i, " ".join(rnd.choices(words[lang], k=30)), lang) for i, lang in enumerate(["en", "de"] * 30)]))


def test_symbols_and_marks_are_no_letters(docs_of):
    model = learned(docs_of)
    texts = ["½ ² ③ Ⅷ", "123 ٤٥ !!", "́̂", None, "", "the house ½", "grünen bäumen"]
    got = [r.lang_pred for r in language_id.predict(docs_of(list(enumerate(texts))).orderBy("doc_id"), model).orderBy("doc_id").collect()]
    assert got == ["und"] * 5 + ["en", "de"]
    assert language_id.marked("grünen½x") == ["▁grünen", "▁x"]


def test_unlearned_texts_are_rejected(docs_of):
    model = learned(docs_of)
    texts = ["the people walk under trees", "leute gehen unter bäumen", "kaikki ihmiset syntyvät vapaina ja tasavertaisina", "все люди рождаются свободными", "½"]
    docs = docs_of(list(enumerate(texts)))
    assert sorted(r.doc_id for r in language_id.identified(docs, model).collect()) == [0, 1]
    gains = {r.doc_id: r.gain for r in language_id.predict(docs, model).collect()}
    assert gains[0] > 0 and gains[1] > 0 and max(gains[2], gains[3]) < 0


# ------------------------------------------------------------------ urls
def test_the_pages_own_list(spark, sql):
    urls = ["http://free-bets.example.com/fr/1", "http://a.free-bets.net/x", "http://plain.net/free-bets", "http://-x.net/", "http://x--y.net/", "http://x-1.y.net/?q", None, "nothing", "http://Free-Bets.example.net"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.url_filter(pages).toPandas()
    same(got, sql(url_filter.ORACLE, pages=pages.toPandas()))
    assert got.set_index("page_id")["listed"].tolist() == [True, True, False, False, False, True, False, False, True]


def test_rules_of_equal_length(spark):
    pages = spark.createDataFrame([(1, "http://a.b/xy")], "page_id long, url string")
    for rules in ((("a.b", "/x", "block"), ("b", "/xy", "allow")), (("a.b", "/", "allow"), ("b", "/xy", "block"))):
        first = min(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
        assert url_filter.url_filter(pages, rules=rules).first().rule == first[0] + first[1]


