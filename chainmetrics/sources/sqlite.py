"""Tables of an SQLite database in a folder that all processes share, written and read by tasks.

Spark's jars bring no JDBC driver for SQLite, so the rows go through Python's own module; several processes may write, one
at a time, the others wait. The folder must be a file system with locks. Columns are numbers, truth values, strings or bytes.
"""

from __future__ import annotations

import contextlib
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

PREFIX = "jdbc:sqlite:"
LEDGER = "loaded_batches"
#: Seconds that a writer waits for its turn.
WAIT = 3600
#: Rows of a query's result that are handed on at once.
FETCH = 10_000
KINDS = {"boolean": "INTEGER", "tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}


@contextlib.contextmanager
def connection(url: str, begin: str = "BEGIN IMMEDIATE") -> Iterator[sqlite3.Connection]:
    """One transaction, which may write; an error rolls it back."""
    made = sqlite3.connect(url.removeprefix(PREFIX).removeprefix("file://"), timeout=WAIT, isolation_level=None)
    try:
        made.execute(begin)
        yield made
        made.execute("COMMIT")
    finally:  # what is not committed is rolled back
        made.close()


def _columns(rows: DataFrame) -> str:
    odd = [f"{c} {kind}" for c, kind in rows.dtypes if kind not in KINDS]
    if odd:
        raise ValueError(f"SQLite keeps no {', '.join(odd)}: cast them before")
    return ", ".join(f'"{c}" {KINDS[kind]}' for c, kind in rows.dtypes)


def _written(rows: DataFrame, url: str, table: str, attempt: str | None) -> int:
    """Rows that tasks have appended, each in one transaction; with an attempt's name a part that is there already counts as it is."""
    names = [*rows.columns, *["attempt"] * bool(attempt)]
    insert = f'INSERT INTO "{table}" ({", ".join(f'"{c}"' for c in names)}) VALUES ({", ".join("?" * len(names))})'
    real = [c for c, kind in rows.dtypes if kind in ("float", "double")]

    def write(batches):
        n, part, batches = 0, TaskContext.get().partitionId(), iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with connection(url) as run:
            if attempt and run.execute("SELECT n FROM parts WHERE attempt = ? AND part = ?", (attempt, part)).fetchone():
                return
            while first is not None:
                if any(pc.any(pc.is_nan(first.column(first.schema.get_field_index(c)))).as_py() for c in real):
                    raise ValueError("SQLite makes NaN null")
                values = [x.to_pylist() for x in first.columns]
                run.executemany(insert, zip(*values, *[[attempt] * first.num_rows] * bool(attempt)))
                n += first.num_rows
                first = next(batches, None)
            if attempt:
                run.execute("INSERT INTO parts VALUES (?, ?, ?)", (attempt, part, n))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def append(rows: DataFrame, url: str, table: str) -> None:
    made = _columns(rows)
    with connection(url) as run:
        run.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({made})')
    _written(rows, url, table, None)


def append_once(rows: DataFrame, url: str, table: str, batch: str) -> bool:
    """Append the rows of a batch exactly once; False if it is there already.

    Tasks write to {table}_rows under the name of their attempt, a task that runs twice once. What one row in the ledger then
    makes visible is the whole batch: {table} is a view of the attempts in it, and no row is moved. What an attempt that failed
    has left is deleted by the next.
    """
    made, store, attempt = _columns(rows), f"{table}_rows", uuid.uuid4().hex
    with connection(url) as run:
        run.execute(f"CREATE TABLE IF NOT EXISTS {LEDGER} (target TEXT, batch TEXT, attempt TEXT, PRIMARY KEY (target, batch))")
        run.execute("CREATE TABLE IF NOT EXISTS attempts (target TEXT, batch TEXT, attempt TEXT PRIMARY KEY)")
        run.execute("CREATE TABLE IF NOT EXISTS parts (attempt TEXT, part INTEGER, n INTEGER, PRIMARY KEY (attempt, part))")
        if run.execute(f"SELECT 1 FROM {LEDGER} WHERE target = ? AND batch = ?", (table, batch)).fetchone():
            return False
        run.execute(f'CREATE TABLE IF NOT EXISTS "{store}" ({made}, attempt TEXT)')
        shown = ", ".join(f'"{c}"' for c in rows.columns)
        run.execute(f"""CREATE VIEW IF NOT EXISTS "{table}" AS SELECT {shown} FROM "{store}" WHERE attempt IN (SELECT attempt FROM {LEDGER})""")
        if run.execute("SELECT 1 FROM attempts WHERE target = ? AND batch = ?", (table, batch)).fetchone():
            run.execute(f'DELETE FROM "{store}" WHERE attempt IN (SELECT attempt FROM attempts WHERE target = ? AND batch = ?)', (table, batch))
            run.execute("DELETE FROM attempts WHERE target = ? AND batch = ?", (table, batch))
        run.execute("INSERT INTO attempts VALUES (?, ?, ?)", (table, batch, attempt))
    # dealt by value over a set number of partitions, a part has the same rows each time that its task runs
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _written(rows.repartition(n, *(f"`{c}`" for c in rows.columns)), url, store, attempt)
    with connection(url) as run:
        run.execute(f"INSERT INTO {LEDGER} VALUES (?, ?, ?)", (table, batch, attempt))
        run.execute("DELETE FROM attempts WHERE attempt = ?", (attempt,))
    return True


def read(spark: SparkSession, url: str, query: str, schema: str) -> DataFrame:
    """The rows of a query, which the database runs in a task."""
    made = spark.createDataFrame([], schema).schema
    kinds = to_arrow_schema(made)

    def fetch(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                with connection(url, "BEGIN") as run:
                    found = run.execute(query)
                    while some := found.fetchmany(FETCH):
                        yield pa.RecordBatch.from_arrays([pa.array(x).cast(kind) for x, kind in zip(zip(*some), kinds.types)], schema=kinds)

    return spark.range(1, numPartitions=1).mapInArrow(fetch, made)
