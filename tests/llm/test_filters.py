"""URL rules and cascade, exact dedup, line dedup: against plain versions and SQL."""
import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests_llm_same import same
from tripwire.llm import exact_dedup, line_dedup, url_filter

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType())])


def test_cascade_is_exact_over_its_universe():
    keys = [f"h{i}.example/{i * i}".encode() for i in range(4000)]
    for share in (0, 1, 40, 2000, 3999, 4000):
        levels = url_filter.build_cascade(keys[:share], keys[share:])
        assert url_filter.is_listed(levels, keys).tolist() == [True] * share + [False] * (4000 - share)


def test_url_verdicts_against_sql(spark, sql):
    urls = [None, "", "no scheme", "http://", "http://ORG", "https://a.org/x", "https://org/x?y#z", "https://x.example.org/es/", "https://Example.ORG/en/123/a?b",
            "https://xexample.org/es/1", "http://com/fr/1", "http://a.com/de/#t", "http://a.com/de", "http://a.cheap-pills.net/en/1", "http://cheap-pills.org/en/1",
            "http://cheap-pills.org/en/1", "ftp://u@h:8/p", "x://a?b://c/d", "http://m.spam-farm.de?x=/org/"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*urls, *[f"http://h{i % 50}.{'ads-track' if i % 3 else 'b'}.net/{i}" for i in range(300)]])], PAGES)
    want = sql(url_filter.ORACLE, pages=pages.select("page_id", "url").toPandas())
    same(url_filter.url_filter(pages).toPandas(), want)
    same(url_filter.url_filter(pages, keys_per_shard=20, broadcast_bytes=2000).toPandas(), want)
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_exact_dedup_against_plain(docs_of):
    random.seed(5)
    base = ["", "a", "b", "ab" * 200 + "x", "ab" * 200 + "y", "ab" * 200, "é", "é ", "same length 1", "same length 2", "z" * 100_000]
    rows = [(i, random.choice(base)) for i in range(60)] + [(60, None), (61, None), (3, "a"), (None, "a"), (None, "only null id")]
    docs = docs_of(rows, extra=["keep_id", "_text", "_salt"])
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = sorted((str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    for bits in (1 << 23, 32):      # 32: the sieve is full and lets everything pass
        got = exact_dedup.exact_dedup(docs, carry=[F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")], sieve_bits=bits, prefix_chars=8).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.sha) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_line_dedup_against_sql(docs_of, sql):
    random.seed(6)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)]
    rows = []
    for i in range(40):
        lines = [" ".join(random.choices(words, k=random.randint(1, 9))) for _ in range(4)]
        lines.append(f"user {i} logged in from host h{i % 3}")                       # fields with digits
        lines.append(f"all rights are held by {random.choice(words)} and friends")    # a field inside
        lines += ["", "  spaced   out\tline ", "read more"][:random.randint(0, 3)]
        random.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (7, rows[7][1]), (200, rows[3][1]), (103, "read more"), (104, "x " * 5000)]
    docs = docs_of(rows, extra=["words", "drop", "text_key"])
    for least in (2, 5, 30):
        got = line_dedup.line_dedup(docs, min_texts=least).select("row.doc_id", "row.text", "lines", "dropped").toPandas()
        want = sql(line_dedup.oracle(min_texts=least), documents=docs.select("doc_id", "text").toPandas())
        same(got, want)
        assert got.dropped.sum() > 0
    kept = {r.doc_id: r for r in line_dedup.line_dedup(docs, min_texts=5).select("row.*").collect()}
    assert "logged in" in kept[0].text and "logged in" not in kept[1].text       # the first text keeps its line
    assert kept[100].text is None and kept[101].text == "" and kept[0].words == "x"
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_lines_of_fields_are_only_equal_to_themselves(docs_of):
    rows = []
    for i in range(12):
        own = [f"{i} {i + 30} {i * 7}", f"2024-01-{i + 10}", f"total sum {i} {i + 1} {i + 2}", f"https://a.org/x{i}", f"第{i}段の文章はほかのどの段落ともちがう内容である",
               f"see also the note 第{i}段の文章はほかのどの段落ともちがう内容である", f"so says the {'ในวันนี้เราไปตลาด' * 2}{chr(0x0e01 + i)}", f"here is the blob {'ab9' * 30}{i}"]
        rows.append((i, "\n".join([*own, f"user {i} logged in from host h{i}", "7 8 9"])))
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs_of(rows)).select("row.doc_id", "row.text", "dropped").collect()}
    assert got[0].text == rows[0][1]
    for i in range(1, 12):      # the log line and the equal row go, all others differ
        assert got[i].text == "\n".join(rows[i][1].split("\n")[:8]) and got[i].dropped == 2


def test_long_lines_go_from_the_second_text_on(docs_of):
    passage, cjk = "one passage of more than eight words that stands in few texts", "第三段の文章は同じ内容である" * 5
    rows = [(3, f"only three\n{passage}\nread more"), (1, f"{passage}\nonly one\n\nread more"), (2, f"only two\n  {passage} \n{cjk}\nread more"),
            (4, f"{cjk}\n{passage} 4\nread more"), (5, None), (6, ""), (1, f"{passage}\nonly one\n\nread more"), (7, passage)]
    got = {r.doc_id: r for r in line_dedup.passage_dedup(docs_of(rows, extra=["words", "drop"])).select("row.doc_id", "row.text", "lines", "dropped").collect()}
    assert {i: r.text for i, r in got.items()} == {1: rows[1][1], 2: f"only two\n{cjk}\nread more", 3: "only three\nread more", 4: f"{passage} 4\nread more",
                                                   5: None, 6: "", 7: ""}
    assert [got[i].dropped for i in range(1, 8)] == [0, 1, 1, 1, 0, 0, 1] and got[5].lines == 0
    assert line_dedup.passage_dedup(docs_of([])).count() == 0


def test_url_list_from_a_table_and_one_broadcast_at_a_time(spark, sql, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.net/{i}", "mine") for i in range(300)] + [(300, None, "x"), (7, "http://h7.net/7", "x")], PAGES)
    keys = spark.createDataFrame([(f"h{i % 50}.net", f"/{i}") for i in range(0, 300, 7)] + [("h0.net", "/0"), ("h1.net", "/none"), (None, "/1")], "host string, path string")
    alive, most = set(), []
    make = type(spark.sparkContext).broadcast

    def broadcast(self, value):
        held = make(self, value)
        alive.add(held)
        most.append(len(alive))
        destroy = held.destroy
        held.destroy = lambda *a: (alive.discard(held), destroy(*a))
        return held
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    got = url_filter.url_filter(pages, listed=keys, rules=(), keys_per_shard=20, broadcast_bytes=2000).collect()
    assert len(most) > 1 and max(most) == 1 and not alive
    assert sorted((r.page_id, r.verdict) for r in got) == sorted([(i, "allow" if i % 7 else "block") for i in range(300)] + [(300, "allow"), (7, "block")])
    assert sorted(url_filter.url_filter(pages, listed=keys, rules=()).collect()) == sorted(got)
