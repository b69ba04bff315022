"""Oracle prices from landed call results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexnum import round_data


def latest_prices(pairs: DataFrame, feeds: DataFrame, results: DataFrame) -> DataFrame:
    """pair, price, updated_at, contract_address of the newest round of each requested pair.

    pairs: pair; feeds: pair, contract_address; results: contract_address, result (hex), decimals. Pairs are matched in
    any case, unknown ones skipped; empty or malformed results give no row.
    """
    feeds = feeds.select(F.lower("pair").alias("_pair"), F.lower("contract_address").alias("contract_address"))
    wanted = pairs.withColumn("_pair", F.lower("pair")).join(feeds, "_pair")
    rows = results.select(F.lower("contract_address").alias("contract_address"), round_data(F.col("result"), F.col("decimals")).alias("round")).where("round IS NOT NULL")
    newest = rows.groupBy("contract_address").agg(F.max(F.struct("round.updated_at", "round.price")).alias("round"))
    return wanted.join(newest, "contract_address").select("pair", F.col("round.price").alias("price"), F.col("round.updated_at").alias("updated_at"), "contract_address")


def merge_feeds(old: DataFrame, new: DataFrame) -> DataFrame:
    """pair, contract_address: rows of new replace those of old with the same pair."""
    both = old.select("pair", "contract_address", F.lit(0).alias("p")).union(new.select("pair", "contract_address", F.lit(1).alias("p")))
    return both.groupBy("pair").agg(F.max(F.struct("p", "contract_address"))["contract_address"].alias("contract_address"))


def page_addresses(pages: DataFrame, text: str = "html") -> DataFrame:
    """Pages with the first contract address in their text; null if there is none."""
    return pages.withColumn("contract_address", F.nullif(F.regexp_extract(F.col(text), "0x[a-fA-F0-9]{40}", 0), F.lit("")))
