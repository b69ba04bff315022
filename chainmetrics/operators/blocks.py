"""Block ranges, counts and incremental selection."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_range(start: int, end: int) -> None:
    """Block numbers are not negative, and a range does not run backwards."""
    if start < 0 or end < 0:
        raise ValueError("block numbers must not be negative")
    if start > end:
        raise ValueError("the first block must not come after the last")


def ranges_by_date(blocks: DataFrame) -> DataFrame:
    """First and last block of each UTC date."""
    return blocks.groupBy(F.to_date(F.timestamp_seconds("timestamp")).alias("date")).agg(F.min("number").alias("first_block"), F.max("number").alias("last_block"))


def range_of_time(blocks: DataFrame, start: int, end: int) -> tuple[int, int]:
    """First block at or after `start` and last at or before `end` (seconds). A start at or before the first block gives 0.

    It is an error if the end lies beyond the last block or no block lies between.
    """
    span = blocks.agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high")).first()
    if span["high"] is None or end > span["high"]:
        raise ValueError("the end lies beyond the last block")
    inside = blocks.where(F.col("timestamp").between(start, end)).agg(F.min("number").alias("first"), F.max("number").alias("last")).first()
    if inside["last"] is None:
        raise ValueError("no block lies between")
    return (0 if start <= max(span["low"], 1) else inside["first"]), inside["last"]


def range_of_date(blocks: DataFrame, day: date) -> tuple[int, int]:
    start = int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp())
    return range_of_time(blocks, start, start + 86399)


def transaction_counts(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("block_number").agg(F.count("*").alias("transaction_count"))


def next_blocks(blocks: DataFrame, last: int, lag: int, batch: int, end: int | None = None) -> DataFrame:
    """Blocks after `last` up to the smallest of head - lag, last + batch and end; none if that is not after `last`."""
    check_range(0, max(last, 0))
    head = blocks.agg((F.max("number") - lag).alias("_target"))
    target = F.least("_target", F.lit(last + batch), F.lit(end if end is not None else (1 << 62)))
    return blocks.join(F.broadcast(head)).where((F.col("number") > last) & (F.col("number") <= target)).drop("_target")  # one row
