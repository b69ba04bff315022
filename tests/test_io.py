import os
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from chainmetrics.operators import market
from chainmetrics.plans import jobs
from chainmetrics.sources import commits, feeds, keyed, readers, sinks, sqlite, tables


def test_slices_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_slices(spark.createDataFrame([(1, "a"), (2, "b")], "v long, d string"), path, "d")
    tables.replace_slices(spark.createDataFrame([(3, "b")], "v long, d string"), path, "d")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}


def test_upserts_keep_the_newest(spark, tmp_path):
    path = str(tmp_path / "t")
    for version, value in ((1, "old"), (3, "new"), (2, "late")):
        tables.upsert(spark.createDataFrame([("k", value)], "doc_id string, v string"), path, ["doc_id"], version)
    assert tables.read_upserted(spark, path, ["doc_id"]).collect()[0]["v"] == "new"


def test_merge_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    assert keyed.merge(rows, path, ["k"], 1, buckets=64) == list(range(64))
    before = commits.Log(spark, path).newest()["files"]
    touched = keyed.merge(spark.createDataFrame([("7", -7), ("new", 1), (None, 5)], "k string, v long"), path, ["k"], 2)
    after = commits.Log(spark, path).newest()["files"]
    assert 0 < len(touched) <= 3 and {b for b in after if after[b] != before[b]} == set(map(str, touched))
    got = {r["k"]: r["v"] for r in keyed.read(spark, path).collect()}
    assert len(got) == 5002 and got["7"] == -7 and got["8"] == 8 and got["new"] == 1 and got[None] == 5


def test_a_snapshot_stays_while_others_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    one = lambda v: spark.createDataFrame([("a", v)], "k string, v long")
    keyed.merge(one(1), path, ["k"], 1)
    old = keyed.read(spark, path)
    keyed.merge(one(2), path, ["k"], 2)
    assert old.first()["v"] == 1 and keyed.read(spark, path, version=1).first()["v"] == 1 and keyed.read(spark, path).first()["v"] == 2
    assert keyed.vacuum(spark, path) == 1 and keyed.read(spark, path).first()["v"] == 2 and commits.Log(spark, path).versions() == [2]


def test_merging_a_batch_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v long")
    for _ in range(2):
        keyed.merge(batch, path, ["k"], 4)
    keyed.merge(spark.createDataFrame([("b", 9)], "k string, v long"), path, ["k"], 3)
    assert {tuple(r) for r in keyed.read(spark, path).collect()} == {("a", 3), ("b", 2)}


def test_merge_of_nothing_new_columns_and_other_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, path)
    assert keyed.merge(spark.createDataFrame([], "k string, v long"), path, ["k"], 1) == [] and keyed.read(spark, path).count() == 0
    keyed.merge(spark.createDataFrame([("a", 1)], "k string, v long"), path, ["k"], 2)
    keyed.merge(spark.createDataFrame([("b", 2, "x")], "k string, v long, w string"), path, ["k"], 3)
    keyed.merge(spark.createDataFrame([("c", 3)], "k string, v long"), path, ["k"], 4)
    assert {tuple(r) for r in keyed.read(spark, path).select("k", "v", "w").collect()} == {("a", 1, None), ("b", 2, "x"), ("c", 3, None)}
    with pytest.raises(ValueError):
        keyed.merge(spark.createDataFrame([("a", 1)], "k string, v long"), path, ["v"], 5)


def test_a_merge_that_fails_before_its_commit_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keyed.merge(spark.createDataFrame([("a", 1)], "k string, v long"), path, ["k"], 1)
    with monkeypatch.context() as m:
        m.setattr(commits.Log, "commit", lambda self, state: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            keyed.merge(spark.createDataFrame([("a", 2)], "k string, v long"), path, ["k"], 2)
    assert keyed.read(spark, path).first()["v"] == 1
    log = commits.Log(spark, path)
    with pytest.raises(commits.Conflict):
        log.commit(log.newest() | {"version": 0})


def test_feeds_commit_tables_together_and_batches_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = lambda n: spark.createDataFrame([(n,)], "n long")
    for batch in range(23):
        assert feeds.append(spark, root, "f", batch, {"a": rows(batch), "b": rows(-batch)}, more={"cursor": batch}, fan=4)
        a, b = feeds.read_together(spark, root, "f", ["a", "b"])
        if batch in (0, 3, 15, 22):
            assert sorted(r["n"] for r in a.collect()) == sorted(-r["n"] for r in b.collect()) == list(range(batch + 1))
    assert not feeds.append(spark, root, "f", 22, {"a": rows(99), "b": rows(99)}) and feeds.last(spark, root, "f")["cursor"] == 22
    assert len(feeds.last(spark, root, "f")["tables"]["a"]["folders"]) <= 9
    own = feeds.uuid.uuid4
    calls = iter([own])
    with monkeypatch.context() as m:  # the second table of the batch cannot be written
        m.setattr(feeds.uuid, "uuid4", lambda: next(calls)())
        with pytest.raises(StopIteration):
            feeds.append(spark, root, "f", 23, {"a": rows(23), "b": rows(-23)})
    a, b = feeds.read_together(spark, root, "f", ["a", "b"])
    assert a.count() == b.count() == 23
    assert feeds.append(spark, root, "f", 23, {"a": rows(23), "b": rows(-23)}) and feeds.vacuum(spark, root, "f") > 0
    assert [x.count() for x in feeds.read_together(spark, root, "f", ["a", "b"])] == [24, 24]


def test_jdbc_rows_come_once_whatever_fails(spark, tmp_path, monkeypatch):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"n{i % 3}") for i in range(50)], "i long, n string")
    types = {"createTableColumnTypes": "n VARCHAR(10)"}
    count = lambda: spark.read.format("jdbc").options(url=url, dbtable="t").load().count()
    # the first attempt dies in a task, after other tasks have written their rows to staging
    fail = F.udf(lambda i: i if i != 49 else 1 // 0, "long")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        sinks.jdbc_append_once(rows.repartition(4).withColumn("i", fail("i")), url, "t", "b1", **types)
    # the second when the staged rows are moved: the transaction is undone as a whole
    own = sinks._connection.__call__
    with monkeypatch.context() as m:
        m.setattr(sinks._connection, "__call__", lambda self, sql: own(self, sql if not sql.startswith("DROP") else "DROP TABLE not_there"))
        with pytest.raises(Exception, match="NOT_THERE"):
            sinks.jdbc_append_once(rows, url, "t", "b1", **types)
    assert count() == 0
    assert sinks.jdbc_append_once(rows, url, "t", "b1", **types) and count() == 50
    assert not sinks.jdbc_append_once(rows, url, "t", "b1", **types) and count() == 50
    assert sinks.jdbc_append_once(rows.union(rows), url, "t", "it's b2", **types) and count() == 150


def test_rows_of_a_shared_database_come_once_whatever_fails(spark, tmp_path):
    url = f"jdbc:sqlite:{tmp_path}/db"
    rows = spark.createDataFrame([(i, f"n{i % 3}", i / 2, i % 2 == 0) for i in range(50)] + [(None, None, None, None)], "i long, n string, x double, even boolean")
    back = lambda: readers.jdbc_slice(spark, url, "SELECT * FROM t", customSchema="i long, n string, x double, even boolean")
    fail = F.udf(lambda i: i if i != 49 else 1 // 0, "long")
    # other tasks have written their parts when one dies; a batch of other rows follows under the same name
    with pytest.raises(Exception, match="ZeroDivisionError"):
        sinks.jdbc_append_once(rows.repartition(4, "i").withColumn("i", fail("i")), url, "t", "it's b1")
    assert back().count() == 0
    assert sinks.jdbc_append_once(rows, url, "t", "it's b1") and not sinks.jdbc_append_once(rows, url, "t", "it's b1")
    assert sorted(map(str, back().collect())) == sorted(map(str, rows.collect()))
    # a task that runs again for the same attempt adds nothing
    assert sqlite._written(rows.coalesce(1).where("i < 3"), url, "t_rows", "again") == 3 and sqlite._written(rows.coalesce(1).where("i < 3"), url, "t_rows", "again") == 0
    assert sinks.jdbc_append_once(rows.limit(0), url, "t", "b2") and sinks.jdbc_append_once(rows.union(rows), url, "t", "b3") and back().count() == 153
    sinks.jdbc_append(rows, url, "plain")
    assert readers.jdbc_slice(spark, url, "SELECT count(*), sum(x) FROM plain WHERE i > 47", customSchema="n long, x double").collect() == [(2, 48.5)]
    assert readers.jdbc_slice(spark, url, "SELECT i FROM plain WHERE i > 50", customSchema="i long").collect() == []
    with pytest.raises(ValueError, match="date"):
        sinks.jdbc_append(spark.sql("SELECT current_date() d"), url, "dates")
    with pytest.raises(Exception, match="NaN"):
        sinks.jdbc_append(spark.sql("SELECT double('NaN') x"), url, "nans")


def test_jdbc_rows_are_read_by_a_query(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    sinks.jdbc_append(spark.range(5), url, "t")
    assert readers.jdbc_slice(spark, url, 'SELECT "id" FROM t WHERE "id" > 3').collect() == [(4,)]


CLUSTER = """
import sys, duckdb, __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,2,1024]").config(map={"spark.checkpoint.dir": sys.argv[1], "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4"}).getOrCreate()
d = "/root/testdata/sf0.001"
duckdb.sql(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
for name in ("jdbc_roundtrip", "jdbc_append_once"):
    got = sorted(map(tuple, e.queries()[name](spark, d).collect()))
    assert got and got == sorted(duckdb.sql(e.oracle_sql()[name]).fetchall()), (name, got)
print("all", "right")
"""


def test_database_queries_on_several_processes(tmp_path):
    root = Path(__file__).resolve().parent.parent
    env = os.environ | {"PYTHONPATH": str(root), "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    # the executors' logs go to work in Spark's home
    home = tmp_path / "home"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    run = subprocess.run([sys.executable, "-c", CLUSTER, f"file://{tmp_path}/shared"], cwd=root, env=env | {"SPARK_HOME": str(home)}, capture_output=True, text=True, timeout=300)
    assert "all right" in run.stdout, run.stderr[-3000:]


def test_hourly_job_reads_the_kept_slices_alone(spark, tmp_path):
    start = datetime(2024, 1, 1)
    ticks = spark.createDataFrame([(f"c{i % 2}", "S", 1.0 + i % 7, float(i % 11), start + timedelta(minutes=17 * i)) for i in range(1000)], "coin_id string, symbol string, current_price double, total_volume double, last_updated timestamp_ntz")
    at = datetime(2024, 1, 9, 12)
    jobs.fill_partials(ticks.where(F.col("last_updated") < F.lit(at)), str(tmp_path / "p"))
    for kept, path in ((None, "plain"), (str(tmp_path / "p"), "kept")):
        assert jobs.hourly_job(ticks, "2024-01-09 12", str(tmp_path / path), at, kept)
    plain, kept = ({r["coin_id"]: r for r in spark.read.parquet(str(tmp_path / p)).collect()} for p in ("plain", "kept"))
    assert plain.keys() == kept.keys() and all(plain[c]["trending_score"] == pytest.approx(kept[c]["trending_score"]) for c in plain)
    plan = market.baseline_of_partials(jobs.read_partials(spark, str(tmp_path / "p")), at)
    assert len(plan.inputFiles()) > 160 and "PartitionFilters: [isnotnull(hour" in plan._jdf.queryExecution().executedPlan().toString()
    read = plan.select(F.lit(1)).sparkSession.read.parquet(str(tmp_path / "p")).where(F.col("hour").between(at - timedelta(days=7), at - timedelta(hours=1))).select("hour").distinct().count()
    assert read == 168


def test_latest_with_maps(spark):
    df = spark.createDataFrame([("a", 1, {"x": 1}), ("a", 2, {"x": 2})], "k string, v long, m map<string,int>")
    assert tables.latest(df, ["k"], "v").first()["m"] == {"x": 2}


def test_broken_messages_are_set_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "contract", "address": "0x1"}\n{broken\n')
    good, broken = readers.read_entity(spark, "contract", str(tmp_path))
    assert [r["address"] for r in good.collect()] == ["0x1"] and broken.count() == 1


def test_framed_and_plain_messages(spark):
    body = b'{"id": "a", "last_updated": "2024-01-01T00:00:00Z", "current_price": 1.5}'
    df = spark.createDataFrame([(b"\0\0\0\0\1" + body,), (body,), (b"junk",), (b'{"symbol": "x"}',)], "value binary")
    got = readers.parse_ticks(df).select("coin_id", "current_price", "timestamp").collect()
    assert [(r[0], r[1]) for r in got] == [("a", 1.5)] * 2 and got[0]["timestamp"] == datetime(2024, 1, 1)


def test_scan_of_a_day_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, 1), 1.0, "x")], "last_updated timestamp_ntz, current_price double, other string").write.parquet(str(tmp_path / "t"))
    plan = readers.day(spark.read.parquet(str(tmp_path / "t")), "2024-01-01").select("current_price")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(last_updated" in plan and "other" not in plan.split("ReadSchema")[1]


def test_routing_drops_unknown_types(spark):
    df = spark.createDataFrame([("block", 1), ("odd", 2), (None, 3)], "type string, n long")
    assert [r["topic"] for r in sinks.routed(df, "p.").collect()] == ["p.blocks.v0"] and sinks.only(df, ["odd"]).count() == 1


def test_jobs_skip_empty_days(spark, tmp_path):
    df = spark.createDataFrame([], "coin_id string, symbol string, eth_contract_address string, current_price double, total_volume double, market_cap double, market_cap_rank long, fully_diluted_valuation double, ath double, max_supply double, total_supply double, circulating_supply double, last_updated timestamp_ntz")
    assert not jobs.daily_job(df, "2024-01-01", str(tmp_path / "d"), datetime(2024, 1, 2)) and not jobs.hourly_job(df, "2024-01-01 10", str(tmp_path / "h"), datetime(2024, 1, 2))
    full = df.union(spark.createDataFrame([("a", "A", None, 1.0, 1.0, 1.0, 1, 1.0, 1.0, 1.0, 1.0, 1.0, datetime(2024, 1, 1, 10))], df.schema))
    assert jobs.daily_job(full, "2024-01-01", str(tmp_path / "d"), datetime(2024, 1, 2)) and jobs.hourly_job(full, "2024-01-01 10", str(tmp_path / "h"), datetime(2024, 1, 2))
    assert spark.read.parquet(str(tmp_path / "h")).select(F.col("trending_score")).count() == 1


def test_documents_are_compressed_and_in_files_of_few_rows(spark, tmp_path):
    rows = spark.range(10, numPartitions=1).select("id", F.lit("text " * 50).alias("t"))
    sinks.write_json(rows, str(tmp_path / "j"), most=4)
    files = sorted((tmp_path / "j").glob("part-*"))
    assert len(files) == 3 and all(f.name.endswith(".json.gz") for f in files)
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(str(tmp_path / "j")).collect())) == sorted(map(tuple, rows.collect()))
