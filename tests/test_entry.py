"""Registered queries against their SQL, on the smallest tables; and that the text operators may be absent."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["hourly_trending_score", "daily_market_metrics", "sliding_metrics", "whale_alerts", "raw_blocks", "transfer_extract_batch", "proxy_resolution", "oracle_prices", "replace_slice", "jdbc_roundtrip", "stream_dedup_sliding", "stream_late_rows", "stream_normalised", "stream_logs", "stream_coin_history", "stream_unreadable", "doc_sync"]


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return x.isoformat() if hasattr(x, "isoformat") else x


def rows(names, records):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=str)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_entry_without_text_operators(tmp_path):
    code = "import sys; sys.modules['chainmetrics.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'hourly_ohlc' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
