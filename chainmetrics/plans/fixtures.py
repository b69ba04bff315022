"""Adapters: the given tables as ticks, transfers, blocks, logs, contracts and responses.

Every function derives its rows from whole tables with DataFrame functions, so that its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts as c
from ..operators.alerts import KNOWN_TOKENS
from ..operators.transfers import TRANSFER, TRANSFER_BATCH, TRANSFER_SINGLE
from ..sources.readers import dealt, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_word(number: Column, digits: int = 64) -> Column:
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def address(number: Column) -> Column:
    return F.concat(F.lit("0x"), hex_word(number, 40))


def wide_hash(number: Column) -> Column:
    return F.concat(F.lit("0x"), hex_word(number, 64))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat('coin-', user_id % 10) AS coin_id",
        "concat('S', user_id % 10) AS symbol",
        "concat('0xc', user_id % 20) AS eth_contract_address",
        "value AS current_price",
        "value * (1000000 + (user_id % 10) * 1000) AS market_cap",
        "cast(user_id % 10 + 1 AS int) AS market_cap_rank",
        "CASE WHEN user_id % 10 = 0 THEN 0D ELSE value * (1000000 + (user_id % 10) * 1000) * (1 + user_id % 3) END AS fully_diluted_valuation",
        "500D AS ath",
        "cast(1000 * (1 + user_id % 10) AS double) AS max_supply",
        "cast(900 * (1 + user_id % 10) AS double) AS total_supply",
        "cast(800 * (1 + user_id % 10) AS double) AS circulating_supply",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(event_id % 21 - 10 AS double) END AS price_change_percentage_1h",
        "cast(regexp_extract(props, '([0-9]+)', 1) AS double) * 1000 AS total_volume",
        "ts AS last_updated",
    )


def fast_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with time compressed 60 times, so that five-minute windows hold several; timestamp is the event time."""
    fast = F.expr("cast(timestamp_micros(1704067200000000 + (unix_micros(cast(last_updated AS timestamp)) - 1704067200000000) div 60) AS timestamp_ntz)")
    return ticks(spark, sf_dir).withColumn("last_updated", fast).withColumn("timestamp", F.col("last_updated").cast("timestamp"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as decoded transfers of known and unknown tokens (USDC in mixed case)."""
    kind = F.col("l_suppkey") % 7
    known = {i: a for i, (a, *_) in enumerate(KNOWN_TOKENS)}
    known[1] = "0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48"
    contract = F.concat(F.lit("0xunknown"), kind.cast("string"))
    for i, a in known.items():
        contract = F.when(kind == i, a).otherwise(contract)
    zeros = F.when(kind <= 1, "0" * 6).when(kind == 4, "0" * 8).otherwise("0" * 18)
    value = F.when(F.col("l_linenumber") != 7, F.concat(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), zeros))
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    return table(spark, sf_dir, "lineitem").select(
        F.lit("token_transfer").alias("type"),
        wide_hash(F.col("l_orderkey")).alias("transaction_hash"),
        F.col("l_linenumber").cast("long").alias("log_index"),
        contract.alias("contract_address"),
        address(F.col("l_suppkey")).alias("from_address"),
        address(F.col("l_partkey")).alias("to_address"),
        value.alias("value"),
        seconds.alias("block_timestamp"),
        F.timestamp_seconds(seconds).alias("timestamp"),
    )


DAY_ZERO = 788918400


def day_number(column: str) -> Column:
    """Days since 1995-01-01."""
    return F.datediff(F.to_date(column), F.lit("1995-01-01").cast("date")).cast("long")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day with orders: n, and its orders.

    The days lie in a set number of partitions: what is made of an order is dozens of times its size, so partitions that are
    merged by their size here would be too large behind it.
    """
    orders = table(spark, sf_dir, "orders").withColumn("n", day_number("o_orderdate"))
    order = F.struct("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderstatus", "o_orderpriority")
    return dealt(orders, "n").groupBy("n").agg(F.array_sort(F.collect_list(order)).alias("orders"))


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed responses: a block a day with its orders as transactions and finished ones as withdrawals; one in 50 failed."""
    h = lambda x: F.concat(F.lit("0x"), F.lower(F.hex(x)))
    n = F.col("n")
    transaction = lambda o: F.struct(wide_hash(o["o_orderkey"]).alias("hash"), h(o["o_orderkey"]).alias("nonce"), F.lit("0x1").alias("chainId"), address(o["o_custkey"]).alias("from"), F.when(o["o_orderpriority"] != "1-URGENT", F.upper(address(o["o_custkey"] + 1))).alias("to"), h(o["cents"]).alias("value"), F.lit("0x5208").alias("gas"))
    withdrawal = lambda o: F.struct(h(o["o_orderkey"]).alias("index"), h(o["o_custkey"]).alias("validatorIndex"), address(o["o_custkey"]).alias("address"), h(o["cents"]).alias("amount"))
    log = lambda o: F.array(F.struct(F.lit("0x0").alias("logIndex"), address(o["o_custkey"]).alias("address"), F.lit("0x").alias("data"), F.array(F.lit(TRANSFER)).alias("topics")))
    receipt = lambda o: F.struct(wide_hash(o["o_orderkey"]).alias("transactionHash"), F.lit("0x0").alias("transactionIndex"), address(o["o_custkey"]).alias("from"), F.when(o["o_orderpriority"] == "1-URGENT", address(o["o_orderkey"])).alias("contractAddress"), h(o["cents"] % 1000).alias("gasUsed"), F.when(o["o_orderstatus"] == "F", "0x1").otherwise("0x0").alias("status"), log(o).alias("logs"))
    block = F.struct(
        wide_hash(n).alias("hash"),
        h(n).alias("number"),
        wide_hash(n - 1).alias("parentHash"),
        h(n * n * 1000000).alias("difficulty"),
        h(F.lit(DAY_ZERO) + n * 86400).alias("timestamp"),
        F.upper(address(n)).alias("miner"),
        F.when(n % 2 == 0, h(n)).alias("baseFeePerGas"),
        F.transform("orders", transaction).alias("transactions"),
        F.transform(F.filter("orders", lambda o: o["o_orderstatus"] == "F"), withdrawal).alias("withdrawals"),
    )
    bad = n % 50 == 49
    return _days(spark, sf_dir).select(n.alias("number"), F.when(~bad, block).alias("block"), F.transform("orders", receipt).alias("receipts"), F.when(bad, F.struct(F.lit(-32000).alias("code"), F.lit("no such block").alias("message"))).alias("error"))


def raw_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_responses as a reader gives them: through JSON text and the declared schema."""
    from ..schemas import RAW

    text = raw_responses(spark, sf_dir).select(F.to_json(F.struct("number", "block", "receipts", "error")).alias("j"))
    return text.select(F.from_json("j", RAW).alias("r")).select("r.*")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem as event logs: by line number ERC20, ERC721, single and batch transfers."""
    kind, line = F.col("l_linenumber") % 4, F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    sender = F.when(line == 1, hex_word(F.lit(0))).otherwise(hex_word(F.col("l_suppkey")))
    receiver = F.when(line == 6, hex_word(F.lit(0))).otherwise(hex_word(F.col("l_partkey")))
    topic = lambda word: F.concat(F.lit("0x"), word)
    operator = topic(hex_word(F.col("l_orderkey")))
    topics = (
        F.when(kind == 1, F.array(F.lit(TRANSFER), topic(sender), topic(receiver)))
        .when(kind == 2, F.array(F.lit(TRANSFER), topic(sender), topic(receiver), topic(hex_word(F.col("l_partkey")))))
        .when(kind == 3, F.array(F.lit(TRANSFER_SINGLE), operator, topic(sender), topic(receiver)))
        .otherwise(F.array(F.upper(F.lit(TRANSFER_BATCH)), operator, topic(sender), topic(receiver)))
    )
    part = F.col("l_partkey")
    fixed = lambda x: hex_word(F.lit(x))
    data = (
        F.when(kind == 1, topic(hex_word(cents)))
        .when(kind == 2, "0x")
        .when(kind == 3, F.concat(F.lit("0x"), hex_word(part), hex_word(cents)))
        .otherwise(F.concat(F.lit("0x"), fixed(64), fixed(160), fixed(2), hex_word(part), hex_word(part + 1), fixed(2), hex_word(cents), hex_word(cents + 1)))
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return spread(lines).select(
        day_number("l_shipdate").alias("block_number"),
        wide_hash(F.col("l_orderkey")).alias("transaction_hash"),
        line.cast("long").alias("log_index"),
        F.upper(address(F.col("l_suppkey"))).alias("address"),
        topics.alias("topics"),
        data.alias("data"),
    )


ARCHETYPES = {5: c.DIAMOND[:1], 6: c.ERC20, 7: [*c.ERC721, c.ERC721_TRANSFERS[0]], 8: c.ERC1155, 9: c.FACTORY[:1], 10: c.VAULT, 11: ["0xdeadbeef"]}


def contract_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part as contracts, by p_partkey % 12: account, minimal, slot, beacon and safe proxy, diamond, ERC20, ERC721, ERC1155, factory, vault, none of these."""
    key = F.col("p_partkey")
    kind = key % 12
    code = F.lit("0x608060405200")
    for k, own in ARCHETYPES.items():
        code = F.when(kind == k, "0x6080604052" + "".join(f"8063{s[2:]}1461000057" for s in own)).otherwise(code)
    from ..functions.bytecode import MINIMAL_PREFIX, MINIMAL_SUFFIX

    code = F.when(kind == 0, "0x").when(kind == 1, F.concat(F.lit("0x" + MINIMAL_PREFIX), hex_word(key + 5, 40), F.lit(MINIMAL_SUFFIX))).otherwise(code)
    return table(spark, sf_dir, "part").select(address(key).alias("address"), F.lit(1).cast("long").alias("chain_id"), key.alias("block_number"), code.alias("bytecode"))


def contract_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage words of the slot, beacon and safe proxies; others have a zero word in the implementation slot."""
    key = F.col("p_partkey")
    kind = key % 12
    slot = F.when(kind == 3, c.SLOT_BEACON).when(kind == 4, c.SLOT_ZERO).otherwise(c.SLOT_IMPLEMENTATION)
    value = F.when(kind == 2, hex_word(key + 5)).when(kind == 3, hex_word(key + 6)).when(kind == 4, F.lpad(F.lit(c.MASTER_COPIES[1][0][2:]), 64, "0")).otherwise("0" * 64)
    return table(spark, sf_dir, "part").select(address(key).alias("address"), slot.alias("slot"), F.concat(F.lit("0x"), value).alias("value"))


def contract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed call results: names as ABI strings, symbols as bytes32."""
    key = F.col("p_partkey")
    name = F.hex(F.encode("p_name", "UTF-8"))
    size = F.octet_length("p_name")
    body = F.rpad(name, F.call_function("div", (size.cast("long") + 31), F.lit(32).cast("long")).cast("int") * 64, "0")
    rows = F.array(
        F.struct(F.lit("name").alias("field"), F.concat(F.lit("0x"), hex_word(F.lit(32)), hex_word(size), body).alias("result")),
        F.struct(F.lit("symbol").alias("field"), F.concat(F.lit("0x"), F.rpad(F.hex(F.encode("p_brand", "UTF-8")), 64, "0")).alias("result")),
        F.struct(F.lit("decimals").alias("field"), F.concat(F.lit("0x"), hex_word(F.col("p_size"))).alias("result")),
        F.struct(F.lit("totalSupply").alias("field"), F.concat(F.lit("0x"), hex_word(F.round(F.col("p_retailprice") * 100).cast("long"))).alias("result")),
    )
    return table(spark, sf_dir, "part").select(address(key).alias("address"), F.inline(rows))


def framed(rows: DataFrame) -> DataFrame:
    """Rows as messages: a five-byte header and JSON."""
    return rows.select(F.concat(F.unhex(F.lit("0000000001")), F.encode(F.to_json(F.struct(*rows.columns)), "UTF-8")).alias("value"))
