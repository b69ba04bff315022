"""The batch jobs: daily and hourly metrics, and documents of metric slices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market
from ..sources import readers, tables


def daily_job(ticks: DataFrame, date: str, path: str, calculated_at: datetime) -> bool:
    """Replace the date's slice of daily metrics; False if there are no ticks of that date."""
    rows = readers.day(ticks, date)
    if not readers.ready(rows):
        return False
    tables.replace_slices(market.daily_metrics(rows, date).withColumn("calculated_at", F.lit(calculated_at)), path, "date")
    return True


def hourly_job(ticks: DataFrame, hour: str, path: str, calculated_at: datetime, partials: str | None = None) -> bool:
    """Replace the hour's slice of trending scores; False if there are no ticks of that hour.

    partials: folder of volume sums by hour. The job adds the hour's slice to it, and its baseline reads the 168 slices before,
    not the ticks of seven days; without it the baseline is computed from ticks.
    """
    at = market.parse_hour(hour)
    start = F.lit(at).cast("timestamp_ntz")
    own = ticks.where((F.col("last_updated") >= start) & (F.col("last_updated") < start + F.expr("INTERVAL 1 HOUR")))
    if not readers.ready(own):
        return False
    if partials is None:
        baseline = market.volume_baseline(ticks, at)
    else:
        tables.replace_slices(market.volume_partials(own), partials, "hour")
        baseline = market.baseline_of_partials(read_partials(ticks.sparkSession, partials), at)
    scores = market.trending_scores(market.hourly_ohlc(own), baseline)
    tables.replace_slices(scores.withColumn("calculated_at", F.lit(calculated_at)), path, "hour")
    return True


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """The volume sums that hourly_job keeps; slices are folders by hour."""
    return spark.read.schema("coin_id string, volume_sum double, volume_count long, hour timestamp_ntz").parquet(path)


def fill_partials(ticks: DataFrame, path: str) -> None:
    """Volume sums of all hours that ticks have, in place of those there are: for a new table, or after ticks were corrected."""
    tables.replace_slices(market.volume_partials(ticks), path, "hour")


def metric_documents(metrics: DataFrame, kind: str) -> DataFrame:
    """Metric rows with their doc_id: `yyyyMMdd_coin` of daily ones, `coin_hour` of hourly ones; any other kind is an error."""
    if kind == "daily":
        return metrics.withColumn("doc_id", F.concat_ws("_", F.date_format("date", "yyyyMMdd"), "coin_id"))
    if kind == "hourly":
        return metrics.withColumn("doc_id", F.concat_ws("_", "coin_id", F.date_format("hour", "yyyy-MM-dd HH:mm:ss")))
    raise ValueError(f"no such metrics: {kind!r}")


def sync_documents(spark: SparkSession, source: str, kind: str, value: str, target: str, version: int) -> bool:
    """Upsert the documents of one date or hour of a metric table; False, and nothing written, if it is empty."""
    docs = metric_documents(spark.read.parquet(source), kind).where(F.col("date" if kind == "daily" else "hour") == F.lit(value).cast("date" if kind == "daily" else "timestamp_ntz"))
    if not readers.ready(docs):
        return False
    tables.upsert(docs, target, ["doc_id"], version)
    return True


def daily_counts(ticks: DataFrame) -> DataFrame:
    """Ticks a date: what a job waits for."""
    return ticks.groupBy(F.to_date("last_updated").alias("date")).agg(F.count("*").alias("tick_count"))
