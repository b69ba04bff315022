"""Alerts on large token transfers, in batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known tokens (address, symbol, decimals, price) that stand in where no token table is given.
KNOWN_TOKENS = [
    ("0xdac17f958d2ee523a2206206994597c13d831ec7", "USDT", 6, 1.0),
    ("0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", "USDC", 6, 1.0),
    ("0x6b175474e89094c44da98b954eedeac495271d0f", "DAI", 18, 1.0),
    ("0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2", "WETH", 18, 2500.0),
    ("0x2260fac5e5542a773aa44fbcfedf7c193bc2c599", "WBTC", 8, 65000.0),
]
THRESHOLD_USD = 1_000_000.0
UNKNOWN, DEFAULT_DECIMALS = "UNKNOWN", 18


def known_tokens(spark: SparkSession) -> DataFrame:
    """KNOWN_TOKENS as a token table: five fixed rows, which go to every task, so that no join on them shuffles transfers by their few contracts."""
    return F.broadcast(spark.createDataFrame(KNOWN_TOKENS, "token_address string, token_symbol string, token_decimals int, token_price double"))


def priced_transfers(transfers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Transfers with token_symbol, amount and usd_value. tokens: as of known_tokens, addresses in lower case.

    The token table is joined plainly: Spark broadcasts it when it is marked or its size allows, and shuffles it when not.
    """
    joined = transfers.withColumn("token_address", F.lower("contract_address")).join(tokens, "token_address", "left")
    raw = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))
    amount = raw / F.pow(F.lit(10.0), F.coalesce("token_decimals", F.lit(DEFAULT_DECIMALS)).cast("double"))
    return joined.withColumns({"token_symbol": F.coalesce("token_symbol", F.lit(UNKNOWN)), "amount": amount, "usd_value": F.coalesce(amount * F.col("token_price"), F.lit(0.0))}).drop("token_address", "token_decimals", "token_price")


def whale_alerts(transfers: DataFrame, tokens: DataFrame, threshold: float = THRESHOLD_USD) -> DataFrame:
    """The nine columns of an alert for each transfer worth `threshold` or, of an unknown token, of more than that many units."""
    priced = priced_transfers(transfers, tokens)
    large = (F.col("usd_value") >= threshold) | ((F.col("token_symbol") == UNKNOWN) & (F.col("amount") > threshold))
    return priced.where(large).select("timestamp", "block_timestamp", "transaction_hash", "contract_address", "token_symbol", "from_address", "to_address", "amount", "usd_value")


def register_token_functions(spark: SparkSession, tokens: list[tuple[str, str, int, float]] | None = None) -> None:
    """get_token_symbol, normalize_amount and calculate_usd_value as SQL functions over a fixed, small token list."""
    rows = tokens or KNOWN_TOKENS

    def pick(column: int, default: str) -> str:
        cases = " ".join(f"WHEN '{r[0]}' THEN {repr(r[column]) if isinstance(r[column], str) else r[column]}" for r in rows)
        return f"CASE lower(address) {cases} ELSE {default} END"

    for name, arguments, kind, body in (
        ("get_token_symbol", "address STRING", "STRING", pick(1, "'UNKNOWN'")),
        ("normalize_amount", "address STRING, raw STRING", "DOUBLE", f"coalesce(try_cast(raw AS DOUBLE), 0D) / power(10D, CAST({pick(2, '18')} AS DOUBLE))"),
        ("calculate_usd_value", "address STRING, amount DOUBLE", "DOUBLE", f"coalesce(amount * CAST({pick(3, 'NULL')} AS DOUBLE), 0D)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")


