"""Tables that a stream's batches are appended to, several at once, under one committed list of what they consist of.

A batch's rows are written to folders of their own for all its tables, and become visible in all of them by one commit, which
carries whatever else moves with the batch (a cursor, counts). A batch that is repeated after a failure is known by its
number and left alone. Folders are merged by tens, and the merged ones by tens again, so that a table is a few dozen folders
however long its stream runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .commits import Log

FAN = 10


def last(spark: SparkSession, root: str, feed: str) -> dict[str, Any]:
    """The newest committed state: batch (-1 before the first), tables, and what batches brought along."""
    return {"batch": -1, "tables": {}} | Log(spark, root, feed).newest()


def append(spark: SparkSession, root: str, feed: str, batch: int, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None, more: dict[str, Any] | Callable[[], dict[str, Any]] | None = None, fan: int = FAN) -> bool:
    """Add rows to tables, put others in place of whole tables, and commit both with `more`; False if the batch is committed already.

    `more` may be a function, called once all rows are written: what it raises keeps the batch from being committed. What a
    batch has written is removed if one of its tables or `more` fails.
    """
    log = Log(spark, root, feed)
    state = last(spark, root, feed)
    if batch <= state["batch"]:
        return False

    written = []

    def write(table: str, rows: DataFrame) -> str:
        folder = f"{table}/{batch:010d}-{uuid.uuid4().hex[:8]}"
        written.append(folder)
        rows.write.option("compression", "zstd").parquet(f"{root}/{folder}")
        return folder

    gone = []
    try:
        for table, rows in added.items():
            own = state["tables"].setdefault(table, {"folders": []})
            own["schema"] = json.loads(rows.schema.json())
            own["folders"].append([0, write(table, rows)])
        for table, rows in (replaced or {}).items():
            gone += [f for _, f in state["tables"].get(table, {"folders": []})["folders"]]
            state["tables"][table] = {"schema": json.loads(rows.schema.json()), "folders": [[0, write(table, rows)]]}
        for table in added:
            own, level = state["tables"][table], 0
            while len(small := [f for k, f in own["folders"] if k == level]) >= fan:
                merged = spark.read.schema(StructType.fromJson(own["schema"])).parquet(*(f"{root}/{f}" for f in small))
                own["folders"] = [x for x in own["folders"] if x[0] != level] + [[level + 1, write(table, merged)]]
                level += 1
        more = more() if callable(more) else more
    except BaseException:
        for folder in written:
            log.remove(f"{root}/{folder}")
        raise
    log.commit(state | (more or {}) | {"batch": batch, "gone": gone})
    # readers of the state before this one are still served; what it had dropped is not named by either
    for folder in state.get("gone", []):
        log.remove(f"{root}/{folder}")
    log.forget(2 * fan)
    return True


def read(spark: SparkSession, root: str, feed: str, table: str) -> DataFrame:
    """A table of the newest committed state."""
    return read_together(spark, root, feed, [table])[0]


def read_together(spark: SparkSession, root: str, feed: str, tables: list[str]) -> list[DataFrame]:
    """Several tables of one and the same committed state."""
    state = last(spark, root, feed)
    missing = [t for t in tables if t not in state["tables"]]
    if missing:
        raise FileNotFoundError(f"no committed rows of {missing} in {root}")
    return [spark.read.schema(StructType.fromJson(own["schema"])).parquet(*(f"{root}/{f}" for _, f in own["folders"])) for own in (state["tables"][t] for t in tables)]


def vacuum(spark: SparkSession, root: str, feed: str) -> int:
    """Drop folders of the feed's tables that the newest state does not name (merged ones, and those of failed batches); their number."""
    log = Log(spark, root, feed)
    state = last(spark, root, feed)
    dropped = 0
    for table, own in state["tables"].items():
        used = {f for _, f in own["folders"]}
        for name in log.folders(f"{root}/{table}"):
            if f"{table}/{name}" not in used:
                log.remove(f"{root}/{table}/{name}")
                dropped += 1
    return dropped
