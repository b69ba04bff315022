"""The streaming jobs: trending metrics, alerts, continuous normalisation, and following a chain of blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts, entities, market
from ..sources import feeds, readers, tables

WATERMARK, WINDOW, SLIDE, TRIGGER = "10 minutes", "5 minutes", "1 minute", "1 minute"
#: Messages that cannot be read, over all batches, beyond which a stream stops.
MOST_BROKEN = 10_000
#: By queue, the field that every message has.
KEYS = {"tick": "id", "protocol": "slug"}


class TooManyBroken(RuntimeError):
    """A queue has more unreadable messages than its stream may skip."""


def trending(ticks: DataFrame) -> DataFrame:
    """Documents of sliding windows of a stream of ticks: repeated (coin, time) rows count once, late ones not at all."""
    once = ticks.withWatermark("timestamp", WATERMARK).dropDuplicates(["coin_id", "timestamp"])
    return market.trending_documents(market.sliding_metrics(once, "timestamp", WINDOW, SLIDE))


def _start(rows: DataFrame, mode: str, checkpoint: str, write: Callable[[DataFrame, int], None], available_now: bool, every: str = TRIGGER) -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def start_trending(messages: DataFrame, target: str, checkpoint: str, mode: str = "update", available_now: bool = False, every: str = TRIGGER) -> StreamingQuery:
    """Upsert trending documents by doc_id. A batch that is repeated after a failure writes the same versions again.

    Messages that cannot be read are dropped here; start_unreadable() on the same queue sets them apart.
    """
    docs = trending(readers.parse_ticks(messages))
    return _start(docs, mode, checkpoint, lambda rows, batch: tables.upsert(rows, target, ["doc_id"], batch), available_now, every)


def start_alerts(messages: DataFrame, tokens: DataFrame, root: str, checkpoint: str, threshold: float = alerts.THRESHOLD_USD, available_now: bool = False, every: str = TRIGGER, most_broken: int | None = MOST_BROKEN) -> StreamingQuery:
    """Append alerts on large transfers to the table `alerts` of the feed `alerts`, unreadable messages to `unreadable`, each batch once."""

    def views(kept: DataFrame) -> dict[str, DataFrame]:
        rows = kept.where("contract_address IS NOT NULL").withColumn("timestamp", F.timestamp_seconds("block_timestamp"))
        return {"alerts": alerts.whale_alerts(rows, tokens, threshold)}

    return _start_feed(messages, "token_transfer", "alerts", views, root, checkpoint, available_now, every, most_broken, None)


#: By queue: the tables that one pass over it feeds.
FEEDS: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "block": {"blocks": lambda rows: entities.normalised("block", rows), "withdrawals": entities.withdrawals},
    "receipt": {"receipts": lambda rows: entities.normalised("receipt", rows), "logs": entities.logs},
    "transaction": {"transactions": lambda rows: entities.normalised("transaction", rows)},
    "token_transfer": {"token_transfers": lambda rows: entities.normalised("token_transfer", rows)},
    "contract": {"contracts": lambda rows: entities.normalised("contract", rows)},
    "tick": {"coin_market_history": lambda rows: entities.normalised("tick", rows)},
    "protocol": {"protocol_metrics": lambda rows: entities.normalised("protocol", rows)},
}


def _readable(entity: str) -> Column:
    """Whether a message was read: a struct that cannot be read is all null."""
    return F.coalesce(F.col("data").getField(KEYS.get(entity, "type")).isNotNull(), F.lit(False))


def _broken(rows: DataFrame, entity: str) -> DataFrame:
    return rows.where(~_readable(entity)).select(readers.payload(F.col("value")).cast("string").alias("message"))


def _start_feed(messages: DataFrame, entity: str, feed: str, views: Callable[[DataFrame], dict[str, DataFrame]], root: str, checkpoint: str, available_now: bool, every: str, most_broken: int | None, avro_schema: str | None) -> StreamingQuery:
    """Write all tables of a feed from one read of its queue, together with the messages that cannot be read.

    A batch is visible in all tables or in none. The number of unreadable messages is carried from commit to commit, also over
    restarts; the batch that would bring it beyond most_broken is not committed, and the stream stops with TooManyBroken.

    Nothing of a batch is kept in memory, however large it is: each table reads the batch's messages from the queue again.
    """
    rows = messages.select("value", readers.decoded(entity, avro_schema).alias("data"))

    def write(batch_rows: DataFrame, batch: int) -> None:
        spark = batch_rows.sparkSession
        known = feeds.last(spark, root, feed)
        if batch <= known["batch"]:
            return
        seen = Observation()
        counted = batch_rows.observe(seen, F.count_if(~_readable(entity)).alias("broken"))

        def broken() -> dict[str, int]:
            total = known.get("broken", 0) + seen.get["broken"]
            if most_broken is not None and total > most_broken:
                raise TooManyBroken(f"{total} messages of {feed} cannot be read; {most_broken} may be")
            return {"broken": total}

        added = views(batch_rows.where(_readable(entity)).select("data.*"))
        feeds.append(spark, root, feed, batch, {f"unreadable/{feed}": _broken(counted, entity)} | added, more=broken)

    return _start(rows, "append", checkpoint, write, available_now, every)


def start_normalising(messages: DataFrame, entity: str, root: str, checkpoint: str, available_now: bool = False, avro_schema: str | None = None, every: str = TRIGGER, most_broken: int | None = MOST_BROKEN) -> StreamingQuery:
    """Write all tables that an entity's queue feeds, in one commit a batch; read them with feeds.read(spark, root, entity, table).

    Messages that cannot be read, or lack the entity's key, are set apart as text in the table unreadable/<entity>; more
    than most_broken of them (None: any number) stop the stream.
    """
    views = lambda kept: {table: view(kept) for table, view in FEEDS[entity].items()}
    return _start_feed(messages, entity, entity, views, root, checkpoint, available_now, every, most_broken, avro_schema)


def start_unreadable(messages: DataFrame, entity: str, feed: str, root: str, checkpoint: str, available_now: bool = False, avro_schema: str | None = None, every: str = TRIGGER, most_broken: int | None = MOST_BROKEN) -> StreamingQuery:
    """Set the unreadable messages of a queue apart in unreadable/<feed>, beside a stream that drops them."""
    return _start_feed(messages, entity, feed, lambda kept: {}, root, checkpoint, available_now, every, most_broken, avro_schema)


def follow(spark: SparkSession, arrived: DataFrame, root: str, batch: int, lag: int, first: int = 0, most: int | None = None) -> bool:
    """Take blocks that arrived into the feed `chain`: the tables blocks and withdrawals grow by what is confirmed, in order of number.

    The cursor, the last block given out, is committed together with the rows. It moves up to the head less `lag`, by
    at most `most` blocks a batch, and never past a block that is missing, so that none is skipped; what lies behind
    it is never given out again. Blocks that wait are kept in `pending`; of several arrivals of a number the latest counts.
    """
    state = feeds.last(spark, root, "chain")
    if batch <= state["batch"]:
        return False
    cursor = state.get("cursor", first - 1)
    rows = arrived.withColumn("_arrived", F.lit(batch).cast("long"))
    if "pending" in state["tables"]:
        rows = feeds.read(spark, root, "chain", "pending").unionByName(rows, allowMissingColumns=True)
    waiting = tables.latest(rows.where(F.col("number") > cursor), ["number"], "_arrived").persist()
    try:
        numbers = waiting.select("number")
        follows = numbers.select((F.col("number") - 1).alias("number"))
        # the first number without a successor ends the part without gaps
        ends = numbers.join(follows, "number", "left_anti").agg(F.min("number")).first()[0]
        bounds = numbers.agg(F.min("number").alias("low"), F.max("number").alias("high")).first()
        whole = ends if bounds["low"] == cursor + 1 else cursor
        target = max(cursor, min(cursor if bounds["high"] is None else bounds["high"] - lag, whole if whole is not None else cursor, cursor + most if most else 1 << 62))
        confirmed = waiting.where(F.col("number") <= target).drop("_arrived")
        added = {table: view(confirmed) for table, view in FEEDS["block"].items()}
        return feeds.append(spark, root, "chain", batch, added, {"pending": waiting.where(F.col("number") > target)}, {"cursor": target})
    finally:
        waiting.unpersist()


def start_following(messages: DataFrame, root: str, checkpoint: str, lag: int, first: int = 0, most: int | None = None, available_now: bool = False, avro_schema: str | None = None, every: str = TRIGGER) -> StreamingQuery:
    """follow() on a queue of blocks. A restarted stream goes on behind the committed cursor, whatever its last batch had written."""
    rows = readers.parsed(messages, "block", avro_schema).where("type IS NOT NULL AND number IS NOT NULL")
    return _start(rows, "append", checkpoint, lambda batch_rows, batch: follow(batch_rows.sparkSession, batch_rows, root, batch, lag, first, most), available_now, every)
