"""Tables by key that are merged by copy-on-write.

Rows are dealt to buckets by a hash of their keys. A merge rewrites the buckets that its rows touch, and no other, to a new
folder, and then commits where each bucket lies; a reader takes one committed state as a snapshot, so that it never
sees half a merge. Choose the number of buckets so that one holds some hundred megabytes: a task writes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .commits import Log

VERSION, BUCKET = "_version", "_bucket"
BUCKETS = 32


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge(rows: DataFrame, path: str, keys: list[str], version: int, buckets: int = BUCKETS) -> list[int]:
    """Put rows in place of those of their keys whose version is not newer; the buckets that were rewritten come back.

    Of several rows of a key with the same version the largest by its other columns stays, so merging a batch again
    changes nothing. New columns are added, and null in older rows. buckets counts when the table is made. Rows with a null in a key are
    keyed by it.
    """
    from .tables import latest

    spark = rows.sparkSession
    log = Log(spark, path)
    state = log.newest()
    if state.setdefault("keys", keys) != keys:
        raise ValueError(f"the table is keyed by {state['keys']}, not by {keys}")
    buckets, files = state.setdefault("buckets", buckets), state.setdefault("files", {})
    name = f"{state['version'] + 1:010d}-{uuid.uuid4().hex[:8]}"
    # the rows are computed once; which buckets they touch is what folders there are
    staged = f"{path}/incoming/{name}"
    fresh = rows.withColumn(VERSION, F.lit(version).cast("long"))
    fresh.withColumn(BUCKET, _bucket(keys, buckets)).write.partitionBy(BUCKET).parquet(staged)
    touched = sorted(int(n.split("=")[1]) for n in log.folders(staged) if n.startswith(f"{BUCKET}="))
    schema = fresh.schema
    if touched:
        both = spark.read.schema(schema).parquet(*(f"{staged}/{BUCKET}={b}" for b in touched))
        old = [f"{path}/{files[str(b)]}" for b in touched if str(b) in files]
        if old:
            both = spark.read.schema(StructType.fromJson(state["schema"])).parquet(*old).unionByName(both, allowMissingColumns=True)
        elif "schema" in state:
            both = spark.createDataFrame([], StructType.fromJson(state["schema"])).unionByName(both, allowMissingColumns=True)
        schema = both.schema
        merged = latest(both, keys, VERSION).withColumn(BUCKET, _bucket(keys, buckets))
        merged.repartition(len(touched), BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{path}/data/{name}")
        files |= {str(b): f"data/{name}/{BUCKET}={b}" for b in touched}
        state["schema"] = json.loads(schema.json())
    else:
        state.setdefault("schema", json.loads(schema.json()))
    log.commit(state)
    log.remove(staged)
    return touched


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's newest state, or that of a commit which vacuum() has not dropped, without the version column."""
    log = Log(spark, path)
    state = log.newest() if version is None else log.read(version)
    if not state["version"]:
        raise FileNotFoundError(f"no committed state in {path}")
    schema, files = StructType.fromJson(state["schema"]), [f"{path}/{f}" for f in state["files"].values()]
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.drop(VERSION)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Drop the files that none of the newest `keep` states names, and all older states; the number of dropped folders."""
    log = Log(spark, path)
    used = {f for v in log.versions()[-keep:] for f in log.read(v)["files"].values()}
    log.forget(keep)
    dropped = [f"data/{name}/{bucket}" for name in log.folders(f"{path}/data") for bucket in log.folders(f"{path}/data/{name}") if f"data/{name}/{bucket}" not in used]
    for folder in [*dropped, *(f"incoming/{n}" for n in log.folders(f"{path}/incoming"))]:
        log.remove(f"{path}/{folder}")
    return len(dropped)
