"""Table layouts, newest versions, slices that are replaced, and keyed upserts (see keyed), on plain Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import LAYOUTS, VERSIONED
from . import keyed

PART = "part"


def laid_out(name: str, rows: DataFrame) -> DataFrame:
    """Rows with their partition column, rows of a partition and sort range together and sorted."""
    expression, keys = LAYOUTS[name]
    if expression is None:
        return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    parted = rows.withColumn(PART, F.expr(expression).cast("string"))
    return parted.repartitionByRange(PART, *keys).sortWithinPartitions(PART, *keys)


def write_table(name: str, rows: DataFrame, path: str, mode: str = "append") -> None:
    """A large partition is several files, split by ranges of its sort keys, so no task writes one alone."""
    writer = laid_out(name, rows).write.mode(mode).option("compression", "zstd")
    (writer if LAYOUTS[name][0] is None else writer.partitionBy(PART)).parquet(path)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key. One aggregation that combines before the shuffle; ties are settled by the other columns."""
    rest = [c for c in rows.columns if c not in keys and c != version]
    plain = [c for c in rest if "map<" not in dict(rows.dtypes)[c]]
    if len(plain) < len(rest):  # maps cannot be compared: rank instead
        order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last())
        return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    own = [version] if version not in keys else []
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*own, *rest)).alias("_row"))
    return newest.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns))


def read_latest(spark: SparkSession, name: str, path: str) -> DataFrame:
    return latest(spark.read.parquet(path), *VERSIONED[name])


def replace_slices(rows: DataFrame, path: str, column: str) -> None:
    """Write rows in place of all rows of the slices (values of column) that they have; other slices stay."""
    spread = [F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema if f.dataType.typeName() != "map"))]
    rows.repartitionByRange(column, *spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def upsert(rows: DataFrame, path: str, keys: list[str], version: int, buckets: int = keyed.BUCKETS) -> None:
    """Merge rows as a version of their keys; of a key the newest version stays. Only the buckets that rows touch are rewritten."""
    keyed.merge(rows, path, keys, version, buckets)


def read_upserted(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """The newest committed state; keys are those of the table."""
    return keyed.read(spark, path)


def compact(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drop what older states of an upserted table alone consist of; the number of dropped folders."""
    return keyed.vacuum(spark, path, keep)
