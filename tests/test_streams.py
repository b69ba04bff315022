import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chainmetrics.plans import fixtures as fx
from chainmetrics.sources import feeds, readers, tables
from chainmetrics.streaming import jobs, progress

BLOCK = "type string, number long, hash string, timestamp long"


def blocks(spark, numbers):
    return spark.createDataFrame([("block", n, f"h{n}", 100 + n) for n in numbers], BLOCK).withColumn("withdrawals", F.array(F.struct(F.col("number").alias("index"), F.col("number").alias("validator_index"), F.lit("0x").alias("address"), F.lit("1").alias("amount"))))


def given(spark, root):
    found = feeds.read_together(spark, root, "chain", ["blocks", "withdrawals"])
    numbers = [sorted(r[0] for r in df.select(c).collect()) for df, c in zip(found, ("number", "block_number"))]
    assert numbers[0] == numbers[1]
    return numbers[0]


def test_blocks_are_given_out_once_and_in_order(spark, tmp_path):
    root = str(tmp_path)
    take = lambda numbers, batch, **more: jobs.follow(spark, blocks(spark, numbers), root, batch, 2, **more)
    take([0, 1, 2, 3, 4], 0)
    assert given(spark, root) == [0, 1, 2]  # two behind the head
    take([8, 7, 6, 4, 2], 1)
    assert given(spark, root) == [0, 1, 2, 3, 4]  # 5 is missing, 2 was given out before
    assert not take([5], 1)  # a batch that comes again is known
    take([], 2)
    assert given(spark, root) == [0, 1, 2, 3, 4]
    take([5], 3)
    assert given(spark, root) == [0, 1, 2, 3, 4, 5, 6]
    take([9, 10, 11, 12], 4, most=2)
    assert given(spark, root) == list(range(9)) and feeds.last(spark, root, "chain")["cursor"] == 8


def test_a_batch_that_dies_before_its_commit_is_done_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    jobs.follow(spark, blocks(spark, range(6)), root, 0, 2)
    with monkeypatch.context() as m:
        m.setattr(feeds.Log, "commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            jobs.follow(spark, blocks(spark, range(6, 10)), root, 1, 2)
    assert given(spark, root) == [0, 1, 2, 3]
    jobs.follow(spark, blocks(spark, range(6, 10)), root, 1, 2)
    assert given(spark, root) == list(range(8))


def test_a_late_version_of_a_waiting_block_counts(spark, tmp_path):
    root = str(tmp_path)
    jobs.follow(spark, blocks(spark, range(5)), root, 0, 2)
    jobs.follow(spark, blocks(spark, [3]).withColumn("hash", F.lit("other")), root, 1, 2)
    jobs.follow(spark, blocks(spark, [5, 6]), root, 2, 2)
    assert {r["number"]: r["hash"] for r in feeds.read(spark, root, "chain", "blocks").collect()} == {0: "h0", 1: "h1", 2: "h2", 3: "other", 4: "h4"}


def ticks(spark, minutes, coin="a"):
    rows = [(coin, "A", 1.0 + m % 5, 10.0, 1.0, (datetime(2024, 1, 1) + timedelta(minutes=m)).isoformat() + "Z") for m in minutes]
    return fx.framed(spark.createDataFrame(rows, "id string, symbol string, current_price double, total_volume double, price_change_percentage_1h double, last_updated string"))


def test_late_rows_are_counted_over_restarts(spark, tmp_path):
    source, state, target = (str(tmp_path / d) for d in ("in", "state", "docs"))
    late = progress.listen(spark)
    try:
        for minutes in (range(0, 60), [60], [1, 2, 3], [61], [4, 5, 49, 62]):
            ticks(spark, minutes).write.mode("append").parquet(source)
            stream = jobs.start_trending(readers.stream(spark, "", "parquet", path=source), target, state, available_now=True)
            stream.awaitTermination()
        progress.settle(spark)
        assert late.total(str(stream.id)) == late.total() == 5 + 1
    finally:
        spark.streams.removeListener(late)


def test_a_stream_runs_by_its_clock(spark, tmp_path):
    source, state, target = (str(tmp_path / d) for d in ("in", "state", "docs"))
    ticks(spark, range(3)).write.parquet(source)
    stream = jobs.start_trending(readers.stream(spark, "", "parquet", path=source), target, state, every="1 second")
    try:
        stream.processAllAvailable()
        first = tables.read_upserted(spark, target).count()
        ticks(spark, range(10, 13)).write.mode("append").parquet(source)
        until = time.time() + 60
        while tables.read_upserted(spark, target).count() == first and time.time() < until:
            time.sleep(0.5)
        assert tables.read_upserted(spark, target).count() == 2 * first == 14
    finally:
        stream.stop()
    assert jobs.TRIGGER == "1 minute"


def test_unreadable_messages_of_every_stream_are_set_apart(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "feed")
    good = json.dumps({"type": "token_transfer", "contract_address": "0xdac17f958d2ee523a2206206994597c13d831ec7", "value": "2000000000000", "transaction_hash": "0x1", "block_timestamp": 1704067200})
    spark.createDataFrame([(b"\0\0\0\0\1" + good.encode(),), (b"{broken",), (b"",), (None,)], "value binary").write.parquet(source)
    tokens = spark.createDataFrame([("0xdac17f958d2ee523a2206206994597c13d831ec7", "USDT", 6, 1.0)], "token_address string, token_symbol string, token_decimals int, token_price double")
    messages = lambda: readers.stream(spark, "", "parquet", path=source)
    jobs.start_alerts(messages(), tokens, root, str(tmp_path / "s1"), available_now=True).awaitTermination()
    found, broken = feeds.read_together(spark, root, "alerts", ["alerts", "unreadable/alerts"])
    assert found.first()["usd_value"] == 2_000_000 and found.count() == 1 and broken.count() == 3
    jobs.start_unreadable(messages(), "tick", "trending", root, str(tmp_path / "s2"), available_now=True).awaitTermination()
    assert feeds.read(spark, root, "trending", "unreadable/trending").count() == 4 and feeds.last(spark, root, "trending")["broken"] == 4


def test_too_many_unreadable_messages_stop_the_stream(spark, tmp_path):
    source, root, state = (str(tmp_path / d) for d in ("in", "feed", "state"))

    def land(n):
        spark.createDataFrame([(b"{",)] * n, "value binary").write.mode("append").parquet(source)
        stream = jobs.start_normalising(readers.stream(spark, "", "parquet", path=source), "contract", root, state, available_now=True, most_broken=5)
        stream.awaitTermination()

    land(3)
    land(2)
    with pytest.raises(Exception, match="TooManyBroken"):
        land(1)
    assert feeds.last(spark, root, "contract")["broken"] == 5


def test_batches_are_not_kept_in_memory(spark, tmp_path, monkeypatch):
    source, root = str(tmp_path / "in"), str(tmp_path / "feed")
    receipt = {"type": "receipt", "transaction_hash": "0x1", "logs": [{"address": "0xA", "topics": ["0x2"], "log_index": 0}] * 2}
    spark.createDataFrame([(json.dumps(receipt).encode(),), (b"{",)], "value binary").write.parquet(source)
    for kind in type(spark.range(0)).__mro__:
        for name in ("persist", "cache", "localCheckpoint"):
            if name in vars(kind):
                monkeypatch.setattr(kind, name, lambda *_, **__: pytest.fail("a batch is kept"))
    jobs.start_normalising(readers.stream(spark, "", "parquet", path=source), "receipt", root, str(tmp_path / "state"), available_now=True).awaitTermination()
    assert [t.count() for t in feeds.read_together(spark, root, "receipt", ["receipts", "logs", "unreadable/receipt"])] == [1, 2, 1]
    assert feeds.last(spark, root, "receipt")["broken"] == 1


def test_a_batch_that_goes_too_far_leaves_no_files(spark, tmp_path):
    root = str(tmp_path)

    def too_many():
        raise jobs.TooManyBroken("too many")

    feeds.append(spark, root, "f", 0, {"t": spark.range(3)}, more=lambda: {"broken": 1})
    with pytest.raises(jobs.TooManyBroken):
        feeds.append(spark, root, "f", 1, {"t": spark.range(3)}, more=too_many)
    assert feeds.last(spark, root, "f")["broken"] == 1 and feeds.read(spark, root, "f", "t").count() == 3
    assert len(list((tmp_path / "t").iterdir())) == 1


def test_options_of_a_queue(spark, monkeypatch):
    """There is no Kafka here: what the reader is given is held against what its source expects."""
    told = {}

    class Reader:
        def format(self, name):
            told["format"] = name
            return self

        def options(self, **settings):
            told.update(settings)
            return self

        def load(self):
            return "rows"

    class Session:
        readStream = Reader()

    assert readers.stream(Session(), "chain.blocks.v0", kafka__bootstrap__servers="a:1,b:2", maxOffsetsPerTrigger="1000") == "rows"
    assert told == {"format": "kafka", "subscribe": "chain.blocks.v0", "startingOffsets": "earliest", "failOnDataLoss": "false", "kafka.bootstrap.servers": "a:1,b:2", "maxOffsetsPerTrigger": "1000"}
