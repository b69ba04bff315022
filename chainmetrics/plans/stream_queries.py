"""The registered streaming queries: given tables as messages in a file source, run until all of them are read."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, entities
from ..session import scratch
from ..sources import feeds, readers, tables
from ..streaming import jobs, progress
from . import fixtures as fx
from . import queries as q

QUERIES: dict[str, q.Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: q.Query) -> q.Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _tick_messages(rows: DataFrame) -> DataFrame:
    return fx.framed(rows.select(F.col("coin_id").alias("id"), "symbol", "current_price", "total_volume", "price_change_percentage_1h", F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("last_updated")))


def _transfer_messages(rows: DataFrame) -> DataFrame:
    return fx.framed(rows.drop("timestamp"))


def _landed(spark: SparkSession, messages: DataFrame, path: str, **options: str) -> DataFrame:
    messages.write.mode("append").parquet(path)
    return readers.stream(spark, "", "parquet", path=path, **options)


@query(f"WITH {q.TICKS} SELECT coin_id, symbol, current_price, price_change_percentage_1h, last_updated AS timestamp FROM ticks")
def stream_ticks_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    rows = readers.parse_ticks(_landed(spark, _tick_messages(fx.ticks(spark, sf_dir)), f"{root}/in"))
    picked = rows.select("coin_id", "symbol", "current_price", "price_change_percentage_1h", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))
    picked.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema(picked.schema).parquet(f"{root}/out")


@query(f"SELECT {q.WORD.format('l_orderkey')} AS transaction_hash, CAST(l_linenumber AS BIGINT) AS log_index, {q.VALUE} AS value, CAST(epoch(l_shipdate) AS BIGINT) AS block_timestamp FROM lineitem")
def stream_transfers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    rows = readers.parse_transfers(_landed(spark, _transfer_messages(fx.transfers(spark, sf_dir)), f"{root}/in"))
    picked = rows.select("transaction_hash", F.col("log_index").cast("long").alias("log_index"), "value", "block_timestamp")
    picked.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.schema(picked.schema).parquet(f"{root}/out")


def _trending(spark: SparkSession, messages: DataFrame, root: str) -> DataFrame:
    jobs.start_trending(messages, f"{root}/docs", f"{root}/state", available_now=True).awaitTermination()
    return q.rounded(tables.read_upserted(spark, f"{root}/docs", ["doc_id"]), *q.DOCUMENT_ROUNDED)


@query(f"WITH {q.TICKS}, {q.FAST}, {q.SLIDING.format(source='fast')} {q.DOCUMENT_SQL}")
def stream_dedup_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick comes twice; windows hold it once."""
    root = scratch(spark)
    ticks = fx.fast_ticks(spark, sf_dir)
    return _trending(spark, _landed(spark, _tick_messages(ticks.union(ticks)), f"{root}/in"), root)


@query(f"WITH {q.TICKS}, {q.FAST}, half AS (SELECT * FROM fast WHERE event_id % 2 = 0), {q.SLIDING.format(source='half')} {q.DOCUMENT_SQL}")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd ticks come after the watermark has passed them; none of them counts.

    The stream runs once for each phase and goes on from its checkpoint. A batch is held against the watermark that
    the batch before it began with, so one more lies between.
    """
    return _late_phases(spark, sf_dir, scratch(spark))


def _late_phases(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    ticks = fx.fast_ticks(spark, sf_dir)
    even = ticks.where("event_id % 2 = 0")
    mark = even.agg((F.max("last_updated") - F.expr("INTERVAL 10 MINUTES")).alias("mark"))
    late = ticks.where("event_id % 2 = 1").join(F.broadcast(mark)).where("last_updated < mark").drop("mark")  # one row
    newest = even.join(F.broadcast(even.agg(F.max("last_updated").alias("last_updated"))), "last_updated", "left_semi")  # one row
    for phase in (even, newest):
        _trending(spark, _landed(spark, _tick_messages(phase), f"{root}/in"), root)
    return _trending(spark, _landed(spark, _tick_messages(late), f"{root}/in"), root)


@query(f"WITH {q.TICKS}, {q.FAST} SELECT count(*) AS late_rows FROM fast WHERE event_id % 2 = 1 AND last_updated < (SELECT max(last_updated) FROM fast WHERE event_id % 2 = 0) - INTERVAL 10 MINUTE")
def stream_late_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late ticks of stream_late_rows, as a listener counts what the watermark drops."""
    late = progress.listen(spark)
    try:
        _late_phases(spark, sf_dir, scratch(spark))
        progress.settle(spark)
        return spark.range(1).select(F.lit(late.total()).cast("long").alias("late_rows"))
    finally:
        spark.streams.removeListener(late)


@query(f"WITH {q.PRICED} {q.ALERT} WHERE usd_value >= 1000000 OR (token_symbol = 'UNKNOWN' AND amount > 1000000)")
def stream_whale_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    messages = _landed(spark, _transfer_messages(fx.transfers(spark, sf_dir)), f"{root}/in")
    jobs.start_alerts(messages, alerts.known_tokens(spark), f"{root}/feed", f"{root}/state", available_now=True).awaitTermination()
    rows = feeds.read(spark, f"{root}/feed", "alerts", "alerts")
    return rows.withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "amount": F.round("amount", 4), "usd_value": F.round("usd_value", 2)})


def _fed(spark: SparkSession, messages: DataFrame, entity: str, *tables_read: str, **options) -> list[DataFrame]:
    """What start_normalising writes of an entity's messages, table by table."""
    root = scratch(spark)
    jobs.start_normalising(_landed(spark, messages, f"{root}/in"), entity, f"{root}/tables", f"{root}/state", available_now=True, **options).awaitTermination()
    return feeds.read_together(spark, f"{root}/tables", entity, list(tables_read))


@query(q.WITHDRAWAL_SQL)
def stream_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as messages feed the tables of blocks and of withdrawals in one pass; the latter is the result."""
    return _fed(spark, fx.framed(q._blocks(spark, sf_dir)), "block", "withdrawals")[0]


@query(f"WITH {q.DAYS} SELECT n AS number, {q.WORD.format('n')} AS hash, CAST(n * n * 1000000 AS VARCHAR) AS difficulty, CAST(count(*) AS INT) AS transaction_count, 788918400 + 86400 * n AS timestamp FROM good GROUP BY n")
def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fed(spark, fx.framed(q._blocks(spark, sf_dir)), "block", "blocks")[0].select("number", "hash", "difficulty", "transaction_count", "timestamp")


@query(q.LOG_SQL)
def stream_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts as messages feed the tables of receipts and of logs; the latter is the result."""
    receipts = entities.raw_receipts(fx.raw_typed(spark, sf_dir))
    return _fed(spark, fx.framed(receipts), "receipt", "logs")[0].select("transaction_hash", "block_number", "block_timestamp", "address", "topic0", "log_index")


@query(q.ORACLES["receipts_normalised"])
def stream_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.receipts_rows(spark, sf_dir).withColumn("type", F.lit("receipt"))
    return _fed(spark, fx.framed(rows), "receipt", "receipts")[0].transform(q.plain)


@query(q.ORACLES["transactions_normalised"])
def stream_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.transactions_rows(spark, sf_dir).withColumn("type", F.lit("transaction"))
    return _fed(spark, fx.framed(rows), "transaction", "transactions")[0].transform(q.plain)


@query(q.ORACLES["token_transfers_normalised"])
def stream_token_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fed(spark, _transfer_messages(fx.transfers(spark, sf_dir)), "token_transfer", "token_transfers")[0].transform(q.plain)


@query(q.ORACLES["contracts_normalised"])
def stream_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.contracts_rows(spark, sf_dir).withColumn("type", F.lit("contract"))
    return _fed(spark, fx.framed(rows), "contract", "contracts")[0].transform(q.plain)


@query(q.ORACLES["ticks_normalised"])
def stream_coin_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fed(spark, fx.framed(q.ticks_rows(spark, sf_dir)), "tick", "coin_market_history")[0].transform(q.plain)


@query(q.ORACLES["protocols_normalised"])
def stream_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fed(spark, fx.framed(q.protocols_rows(spark, sf_dir)), "protocol", "protocol_metrics")[0].transform(q.plain)


@query(
    f"""SELECT 'kept' AS fate, concat({q.WORD.format('l_orderkey')}, ':', l_linenumber) AS message FROM lineitem WHERE l_linenumber % 3 <> 0
  UNION ALL SELECT 'unreadable', concat('{{"transaction_hash": ', l_orderkey, ':', l_linenumber) FROM lineitem WHERE l_linenumber = 3
  UNION ALL SELECT 'unreadable', '' FROM lineitem WHERE l_linenumber = 6"""
)
def stream_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the transfers, the third of each order is cut short and the sixth is empty; both are set apart, the rest goes on."""
    rows = fx.transfers(spark, sf_dir)
    junk = F.concat(F.lit('{"transaction_hash": '), F.conv(F.substring("transaction_hash", 3, 64), 16, 10), F.lit(":"), F.col("log_index"))
    cut = rows.where("log_index = 3").select(F.encode(junk, "UTF-8").alias("value"))
    empty = rows.where("log_index = 6").select(F.encode(F.lit(""), "UTF-8").alias("value"))
    good = _transfer_messages(rows.where("log_index % 3 <> 0"))
    # of the given lines two sevenths are broken, more than a stream skips by default
    kept, broken = _fed(spark, good.union(cut).union(empty), "token_transfer", "token_transfers", "unreadable/token_transfer", most_broken=None)
    return kept.select(F.lit("kept").alias("fate"), F.concat_ws(":", "transaction_hash", "log_index").alias("message")).union(broken.select(F.lit("unreadable"), "message"))


@query(f"SELECT {q.WORD.format('l_orderkey')} AS transaction_hash, CAST(l_linenumber AS INT) AS log_index FROM lineitem WHERE l_linenumber <= 2")
def stream_broken_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third line of each order is broken, and the stream may skip that many; the rest of the lines brings one more and stops it.

    What was committed before stays, and nothing of the batch that went too far.
    """
    root = scratch(spark)
    rows = fx.transfers(spark, sf_dir)
    junk = lambda which: rows.where(f"log_index IN ({which})").select(F.encode(F.lit("{broken"), "UTF-8").alias("value"))
    limit = rows.where("log_index = 3").count()
    for good, bad in (("1, 2", "3"), ("4, 5, 7", "6")):
        messages = _landed(spark, _transfer_messages(rows.where(f"log_index IN ({good})")).union(junk(bad)), f"{root}/in")
        stream = jobs.start_normalising(messages, "token_transfer", f"{root}/tables", f"{root}/state", available_now=True, most_broken=limit)
        try:
            stream.awaitTermination()
        except StreamingQueryException as e:
            if "TooManyBroken" not in str(e):
                raise
    return feeds.read(spark, f"{root}/tables", "token_transfer", "token_transfers").select("transaction_hash", "log_index")


@query("SELECT o_orderkey AS number, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS validator_index FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) - 12 FROM orders)")
def stream_followed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as blocks that arrive with gaps, out of order and partly twice, over two runs of a stream that stays 12 blocks behind the head."""
    root = scratch(spark)
    key = F.col("o_orderkey")
    withdrawal = F.struct(key.alias("index"), F.col("o_custkey").alias("validator_index"), fx.address(F.col("o_custkey")).alias("address"), F.lit("1").alias("amount"))
    found = fx.table(spark, sf_dir, "orders").select(F.lit("block").alias("type"), key.alias("number"), fx.wide_hash(key).alias("hash"), (fx.DAY_ZERO + key).alias("timestamp"), F.when(F.col("o_orderstatus") == "F", F.array(withdrawal)).otherwise(F.array().cast(f"array<{withdrawal_type()}>")).alias("withdrawals"))
    for phase in ("number % 3 <> 1", "number % 3 = 1 OR number % 2 = 0"):
        messages = _landed(spark, fx.framed(found.where(phase)), f"{root}/in")
        jobs.start_following(messages, f"{root}/chain", f"{root}/state", lag=12, available_now=True).awaitTermination()
    blocks, withdrawals = feeds.read_together(spark, f"{root}/chain", "chain", ["blocks", "withdrawals"])
    return blocks.select("number").join(withdrawals.select(F.col("block_number").alias("number"), "validator_index"), "number", "left")


def withdrawal_type() -> str:
    return "struct<index:bigint,validator_index:bigint,address:string,amount:string>"
