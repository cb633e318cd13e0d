"""Streams on keyed state: event-time order, late rows, state that falls again, and a micro-batch that fails."""
import datetime as dt
import os
import uuid
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import types as T

from tripwire.session import scratch_path
from tripwire.streaming.jobs import accepted_in_order
from tripwire.streaming.ordered import in_order, late_rows

PAID = "tx_id long, account long, ts timestamp, amount_usd decimal(18,2)"


class Feed:
    """A folder that a stream reads, and the runs over it."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.base = spark, schema, scratch_path(spark, f"feed-{uuid.uuid4().hex}")

    def rows(self):
        return self.spark.readStream.schema(self.schema).parquet(self.base + "/in")

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.base + "/in")

    def run(self, made, name="out"):
        q = made.writeStream.format("parquet").option("path", f"{self.base}/{name}").option("checkpointLocation", f"{self.base}/{name}-checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress

    def out(self, schema, name="out"):
        return [tuple(r) for r in self.spark.read.schema(schema).parquet(f"{self.base}/{name}").collect()]


def at(day, hour, minute=0):
    return dt.datetime(2024, 5, day, hour, minute)


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_state_falls_again_when_a_day_is_over(spark, few_partitions):
    feed = Feed(spark, PAID)
    held = []
    for day in (1, 2, 3):
        feed.put([(day * 100 + i, i % 20, at(day, 8 + i % 10, i), Decimal(300 + i)) for i in range(40)])
        held.append(feed.run(accepted_in_order(feed.rows().withWatermark("ts", "1 hour")))["stateOperators"][0]["numRowsTotal"])
    feed.put([(None, None, at(9, 0), None)])
    held.append(feed.run(accepted_in_order(feed.rows().withWatermark("ts", "1 hour")))["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 40 and held[-1] <= 1            # a day's accounts, not those of all days; at last the row ahead alone
    got = feed.out("tx_id long, account long, day date, before long, accepted boolean")
    want = []
    for day in (1, 2, 3):
        totals = {}
        for i in sorted(range(40), key=lambda i: (at(day, 8 + i % 10, i), i)):
            before = totals.get(i % 20, 0)
            ok = 300 + i <= 500 and before + 30000 + 100 * i <= 200000
            want.append((day * 100 + i, i % 20, at(day, 0).date(), before, ok))
            totals[i % 20] = before + (30000 + 100 * i if ok else 0)
    assert sorted(got) == sorted(want)


OUT = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sum", T.LongType())])


def summed(rows, flag=""):
    def step(total, key, row):
        if flag and not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("lost")
        total = (total or 0) + row[2]
        return total, [(key[0], row[1], total)]
    return in_order(rows.withWatermark("ts", "10 minutes"), ["k"], "ts", ["n"], ["value"], OUT, step)


NUMBERS = "k long, n long, ts timestamp, value long"


def test_a_failed_micro_batch_goes_on_without_repeats(spark, few_partitions, tmp_path):
    feed, flag = Feed(spark, NUMBERS), str(tmp_path / "failed")
    feed.put([(i % 3, i, at(1, 0, i), 1) for i in range(30)])
    feed.run(summed(feed.rows()))
    feed.put([(i % 3, i, at(1, 1, i - 30), 1) for i in range(30, 60)])
    feed.put([(None, None, at(2, 0), None)])
    with pytest.raises(StreamingQueryException):
        feed.run(summed(feed.rows(), flag))
    feed.run(summed(feed.rows(), flag))
    assert sorted(feed.out(OUT)) == sorted((i % 3, i, i // 3 + 1) for i in range(60))


def test_rows_out_of_order_are_applied_in_order_and_late_ones_go_aside(spark, few_partitions):
    feed = Feed(spark, NUMBERS)

    def run():
        feed.run(summed(feed.rows()))
        feed.run(late_rows(feed.rows().withWatermark("ts", "10 minutes"), ["k"], "ts", ["n"]), "late")
    feed.put([(1, 3, at(1, 0, 30), 100), (1, 1, at(1, 0, 10), 1), (1, 2, at(1, 0, 25), 10), (2, 9, at(1, 0, 30), 5)])
    run()
    # the watermark is 0:20 now
    feed.put([(1, 4, at(1, 0, 22), 1000), (1, 5, at(1, 0, 20), 7), (1, 6, at(1, 0, 5), 8), (2, 7, at(1, 0, 21), 1), (1, None, at(1, 0, 40), 1)])
    run()
    feed.put([(3, None, at(3, 0), None)])
    run()
    assert sorted(feed.out(OUT)) == [(1, 1, 1), (1, 2, 1011), (1, 3, 1111), (1, 4, 1001), (2, 7, 1), (2, 9, 6)]
    assert sorted(feed.out("k long, n long", "late")) == [(1, 5), (1, 6)]


def test_keys_share_the_states_of_lanes_and_stay_apart(spark, few_partitions):
    feed = Feed(spark, NUMBERS)
    large = 2 ** 60 + 1         # not a double, and nulls stand beside it
    keys = [None, *range(large, large + 1499)]
    feed.put([(k, large + i, at(1, 0, 30 - i), 10 ** i) for k in keys for i in range(3)])
    held = feed.run(summed(feed.rows()))["stateOperators"][0]["numRowsTotal"]
    assert held <= 1024         # not one a key
    feed.run(late_rows(feed.rows().withWatermark("ts", "10 minutes"), ["k"], "ts", ["n"]), "late")
    feed.put([(None, None, at(3, 0), None), *((k, large + 9, at(1, 0, 1), 5) for k in keys[:2])])
    feed.run(summed(feed.rows()))
    feed.run(late_rows(feed.rows().withWatermark("ts", "10 minutes"), ["k"], "ts", ["n"]), "late")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(k, large + i, sum(10 ** j for j in range(i, 3))) for k in keys for i in range(3)]
    assert sorted(feed.out(OUT), key=key) == sorted(want, key=key)
    assert sorted(feed.out("k long, n long", "late"), key=key) == [(large, large + 9), (None, large + 9)]
