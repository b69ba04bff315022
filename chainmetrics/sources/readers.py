"""Readers of landed and streamed messages and of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import RAW, schema
from . import sqlite

HEADER_BYTES = 5


def stream(spark: SparkSession, topic: str, source: str = "kafka", starting: str = "earliest", **options: str) -> DataFrame:
    """value BINARY of a topic. source "kafka" takes kafka.* options (dots written as __); any other is a file format with a path."""
    reader = spark.readStream.format(source)
    settings = {k.replace("__", "."): v for k, v in options.items()}
    if source == "kafka":
        settings |= {"subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"}
    else:
        reader = reader.schema("value binary")
    return reader.options(**settings).load()


def payload(value: Column) -> Column:
    """The message without its header: a zero byte and a four-byte schema id, if it is there."""
    framed = F.substring(F.hex(value), 1, 2) == "00"
    return F.when(framed, F.substring(value, HEADER_BYTES + 1, 1 << 30)).otherwise(value)


def decoded(entity: str, avro_schema: str | None = None) -> Column:
    """A message's value as a struct of the entity, all null if it cannot be read. avro_schema needs spark-avro on the class path; else JSON."""
    body = payload(F.col("value"))
    if avro_schema:
        from pyspark.sql.avro.functions import from_avro

        return from_avro(body, avro_schema, {"mode": "PERMISSIVE"})
    return F.from_json(body.cast("string"), schema(entity))


def parsed(messages: DataFrame, entity: str, avro_schema: str | None = None) -> DataFrame:
    """Columns of the entity; a message that cannot be read is all null."""
    return messages.select(decoded(entity, avro_schema).alias("data")).select("data.*")


def parse_ticks(messages: DataFrame, avro_schema: str | None = None) -> DataFrame:
    """Ticks with coin_id and timestamp (from last_updated); those without an id are dropped."""
    rows = parsed(messages, "tick", avro_schema).withColumnRenamed("id", "coin_id")
    return rows.withColumn("timestamp", F.try_to_timestamp("last_updated")).where("coin_id IS NOT NULL")


def parse_transfers(messages: DataFrame, avro_schema: str | None = None) -> DataFrame:
    """Transfers with timestamp (from block_timestamp); those without a contract are dropped."""
    rows = parsed(messages, "token_transfer", avro_schema)
    return rows.withColumn("timestamp", F.timestamp_seconds("block_timestamp")).where("contract_address IS NOT NULL")


def read_entity(spark: SparkSession, entity: str, path: str, source: str = "json") -> tuple[DataFrame, DataFrame]:
    """Good rows of an entity, and the broken ones as text (JSON and CSV; other formats have none)."""
    own = schema(entity)
    if source not in ("json", "csv"):
        rows = spark.read.format(source).schema(own).load(path)
        return rows, rows.select(F.lit(None).cast("string").alias("_corrupt_record")).limit(0)
    text = spark.read.text(path)
    kind = StructType([*own.fields, StructField("_corrupt_record", StringType())])
    make = F.from_json if source == "json" else F.from_csv
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    data = make("value", kind if source == "json" else kind.simpleString()[7:-1].replace(":", " "), options)
    rows = text.select(data.alias("d"), "value").select("d.*", "value")
    broken = rows.where("_corrupt_record IS NOT NULL").select("_corrupt_record")
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record", "value"), broken


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Landed block and receipt responses: one row a block number, a missing partner being null."""
    return spark.read.schema(RAW).json(path)


def jdbc_slice(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The rows of a query that the database runs. A database in a shared file (jdbc:sqlite:path) has no types: it takes customSchema alone."""
    if url.startswith(sqlite.PREFIX):
        return sqlite.read(spark, url, query, options["customSchema"])
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def day(table: DataFrame, date: str, column: str = "last_updated") -> DataFrame:
    """Rows of one UTC date, as a range, so that the scan can skip files."""
    start = F.lit(date).cast("date").cast("timestamp_ntz")
    return table.where((F.col(column) >= start) & (F.col(column) < start + F.expr("INTERVAL 1 DAY")))


def ready(table: DataFrame) -> bool:
    """Whether there is any row; one is read at most from the first partitions that have some."""
    return not table.limit(1).isEmpty()


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one task, over the set number of shuffle partitions.

    For work that needs far more memory than its input has compressed bytes: with a number given, Spark does not merge
    partitions by those bytes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as can run at once, if they come from fewer: one file of few splits would leave cores idle behind costly expressions."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)
