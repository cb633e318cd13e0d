"""What a stage leaves behind: files of its steps, shuffle files, and hashes of whole texts that are taken once."""
import os
import random
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tripwire.llm import line_dedup, mixing
from tripwire.llm.common import settled, shared_dir, written


def kept(spark, before=()) -> list[str]:
    """The names of the shared folder's results that are new."""
    return sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - set(before))


def listed(spark) -> list[str]:
    return os.listdir(shared_dir(spark).removeprefix("file:"))


def corpus(n: int = 120) -> list[tuple]:
    rnd = random.Random(5)
    rows = [(i, "\n".join(" ".join(rnd.choices("abcdefghijklm", k=12)) for _ in range(4)), "en", rnd.choice("xxxy")) for i in range(n)]
    return rows + [(n + i, rows[i][1] + " end", "en", "x") for i in range(20)] + [(n + 50, None, None, None), (3, rows[3][1], "en", "x"), (None, "", "en", "y")]


def test_the_steps_of_a_settled_result_go(spark):
    before = listed(spark)

    def make():
        inner = settled(lambda: written(spark.range(9), "first").filter("id > 2"), spark, "second")
        assert kept(spark, before) == ["second"]
        return written(inner, "third").filter("id > 4")
    got = settled(make, spark, "last")
    assert sorted(r.id for r in got.collect()) == [5, 6, 7, 8] and kept(spark, before) == ["last"]
    with pytest.raises(ZeroDivisionError):
        settled(lambda: 1 / 0, spark, "none")
    written(spark.range(2), "after")
    assert kept(spark, before) == ["after", "last"]


def test_shuffle_files_go_with_the_write(spark):
    def files() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(found.size()) if (f := found.apply(i).getName()).startswith("shuffle_")}
    before, set_to = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = written(spark.range(500).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and got.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == set_to


def test_stages_leave_no_texts_behind(spark, docs_of):
    docs = docs_of(corpus())
    for stage, steps in ((corpus_pipeline.drop_lines, ["lost-lines"]), (corpus_pipeline.drop_near_duplicates, ["copies", "lost-passages"]), (corpus_pipeline.mix, ["mixture"])):
        before = listed(spark)
        rows = stage(spark, docs, "").collect()
        assert rows and kept(spark, before) == steps
    assert mixing.mixed(docs).count() == len(rows)


def test_a_text_is_hashed_once(docs_of):
    """A generator's other columns are computed for every row that it makes: hashes of the text come before it."""
    plan = line_dedup.template_lines(docs_of(corpus()), 3, 0.7).select("text_key", "text_hash", "leaf")._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Generate") < plan.index("md5(")


def test_white_space_and_digits_of_lines(docs_of):
    rows = [(1, "a \t b\n\t\tx1  22 y z w v\r\n\x0b\x0c\n  \n 7a\u00a08 b c d e f 3"), (2, ""), (3, " \t\n"), (4, "one 1 two three four\n1 2 a b c"), (5, None)]
    got = sorted((r.doc_id, r.spaced, r.words) for r in line_dedup.template_lines(docs_of(rows), 3, 0.7).collect())
    assert got == sorted([(1, "a b", "a b"), (1, "x1 22 y z w v", "x1 22 y z w v"), (1, "7a\u00a08 b c d e f 3", "<*> b c d e f <*>"),
                          (4, "one 1 two three four", "one <*> two three four"), (4, "1 2 a b c", "1 2 a b c")])
