"""Routing and writing of rows to topics, databases and several sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqlite

ENTITIES = ["block", "transaction", "receipt", "token_transfer", "contract", "log", "withdrawal"]


def routed(rows: DataFrame, prefix: str = "", entities: list[str] | None = None, key: str | None = None) -> DataFrame:
    """topic, key, value of mixed entities: `{prefix}{type}s.v0` and the row as JSON. Rows of unknown or missing type are dropped."""
    known = rows.where(F.col("type").isin(entities or ENTITIES))
    body = F.to_json(F.struct(*[c for c in rows.columns]))
    name = (F.col(key) if key else F.lit(None)).cast("string")
    return known.select(F.concat(F.lit(prefix), "type", F.lit("s.v0")).alias("topic"), name.alias("key"), body.alias("value"))


def only(rows: DataFrame, entities: list[str]) -> DataFrame:
    return rows.where(F.col("type").isin(entities))


def fan_out(rows: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Give the same rows to several sinks; they are computed once."""
    kept = rows.persist()
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()


def write_json(rows: DataFrame, path: str, most: int = 500_000) -> None:
    """Documents as lines of JSON, compressed, at most `most` of them a file, since one task reads a compressed file whole."""
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", most).json(path)


def jdbc_append(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Through Spark's JDBC writer; a database in a shared file (jdbc:sqlite:path) through Python's module, without options."""
    if url.startswith(sqlite.PREFIX):
        return sqlite.append(rows, url, table)
    rows.write.format("jdbc").mode("append").options(url=url, dbtable=table, **options).save()


LEDGER = "loaded_batches"


def jdbc_append_once(rows: DataFrame, url: str, table: str, batch: str, driver: str | None = None, **options: str) -> bool:
    """Append the rows of a batch exactly once, whatever fails on the way; False if the batch is there already.

    Tasks write to a staging table, each row with its number; a task that runs twice gives the same rows the same numbers,
    because they are sorted. Then one transaction in the database notes the batch in the table loaded_batches and
    moves the staged rows, each number once. What an attempt that failed left in staging is written over by the next.

    Columns must be of kinds that the database can compare (options: createTableColumnTypes, where strings become large objects).
    A database in a shared file (jdbc:sqlite:path) is written without options and staging, see sqlite.append_once.
    """
    if url.startswith(sqlite.PREFIX):
        return sqlite.append_once(rows, url, table, batch)
    settings = {"url": url} | ({"driver": driver} if driver else {}) | options
    spark = rows.sparkSession
    if driver:
        spark.sparkContext._jvm.java.lang.Class.forName(driver)
    staging = f"{table}_staged"
    with _connection(spark, url, options) as run:
        if not run.has(LEDGER):
            run(f"CREATE TABLE {LEDGER} (target VARCHAR(128) NOT NULL, batch VARCHAR(128) NOT NULL, PRIMARY KEY (target, batch))")
        if run.count(f"SELECT count(*) FROM {LEDGER} WHERE target = '{_quoted(table)}' AND batch = '{_quoted(batch)}'"):
            return False
    sort = [f"`{c}`" for c in rows.columns]
    # a set number of partitions: with it the numbers do not depend on how partitions are merged at run time
    numbered = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *sort).sortWithinPartitions(*sort).withColumn("row_number", F.monotonically_increasing_id())
    numbered.write.format("jdbc").mode("overwrite").options(dbtable=staging, **settings).save()
    rows.limit(0).write.format("jdbc").mode("append").options(dbtable=table, **settings).save()
    names = ", ".join(f'"{c}"' for c in rows.columns)
    with _connection(spark, url, options) as run:
        run(f"INSERT INTO {LEDGER} VALUES ('{_quoted(table)}', '{_quoted(batch)}')")
        run(f'INSERT INTO {table} ({names}) SELECT {names} FROM (SELECT DISTINCT "row_number", {names} FROM {staging}) staged')
        run(f"DROP TABLE {staging}")
    return True


def _quoted(text: str) -> str:
    return text.replace("'", "''")


class _connection:
    """Statements of one transaction on the driver's connection; no rows come through it. An error rolls all of them back."""

    def __init__(self, spark: SparkSession, url: str, options: dict[str, str]):
        jvm = spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for key in ("user", "password"):
            if key in options:
                properties.setProperty(key, options[key])
        self._connection = jvm.java.sql.DriverManager.getConnection(url, properties)
        self._connection.setAutoCommit(False)

    def __enter__(self) -> _connection:
        return self

    def __exit__(self, kind, error, trace) -> None:
        try:
            self._connection.rollback() if kind else self._connection.commit()
        finally:
            self._connection.close()

    def __call__(self, statement: str) -> None:
        made = self._connection.createStatement()
        try:
            made.executeUpdate(statement)
        finally:
            made.close()

    def count(self, query: str) -> int:
        made = self._connection.createStatement()
        try:
            found = made.executeQuery(query)
            found.next()
            return found.getLong(1)
        finally:
            made.close()

    def has(self, table: str) -> bool:
        tables = self._connection.getMetaData().getTables(None, None, "%", None)
        while tables.next():
            if tables.getString("TABLE_NAME").lower() == table.lower():
                return True
        return False
