"""The operators' SQL against the operators, on rows with nulls, copies, short and odd texts."""

import random

import duckdb
import pandas as pd
import pytest

from chainmetrics.llm import queries

LINE = " ".join(f"word{i}" for i in range(40))


def texts():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(["Ärger", "to", "be", "x-1", "日本", "or", "🙂", "not", "a.b", "the", "end"]) for _ in range(n))
    base = prose(120)
    near = [" ".join("changed" if i == k * 9 else w for i, w in enumerate(base.split())) for k in range(4)]
    return [None, "", " \n\t", "one", "ONE", "two words", base, base.upper(), base + " more", *near, LINE, f"{prose(9)} {LINE.upper()}\n{prose(9)}", f"{LINE}{LINE}", prose(300), "a" * 450, *(prose(5) for _ in range(8))]


def conversations():
    """Nulls, ties, repeated rows, blank texts, odd roles, gaps, shared beginnings, negative ids and one conversation of many turns."""
    rng = random.Random(5)
    rows = [(3, None, None, None), (3, None, "user", None), (None, 0, "user", "Hi."), (None, 1, None, " \n"), (7, 2, "", ""), (7, 2, "", ""), (-4, 0, "user", "x."), (-4, 9, "assistant", "y!"), (12, 0, "system", "日本。"), (12, 0, "sudo", "日本.")]
    for conv in range(20, 95):
        roles = ["system"] * (conv % 4 == 0) + ["user", "assistant"] * (conv % 5)
        rows += [(conv, turn, role, rng.choice(["Same first." if turn == 0 else "Yes.", "No! ", "What? ...", "cut off", "", "Ärger.\t"])) for turn, role in enumerate(roles)]
    rows += [(200, turn, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["One.", "Two", f"{turn}!"])) for turn in range(0, 700, 2)]
    return pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}).assign(seq=1, node="x", depth=2)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees_with_the_operator(spark, tmp_path, name):
    docs = pd.DataFrame({"doc_id": range(100, 100 + len(texts())), "text": texts(), "lang": "en", "source": "s", "n_chars": 0})
    items = pd.DataFrame({"item_id": [7, 12, 3, 4, 5], "text": [LINE, "to be", None, "", " ".join(LINE.split()[5:17])]})
    con = duckdb.connect()
    for table, rows in (("documents", docs), ("benchmark", items), ("conversations", conversations())):
        rows.to_parquet(tmp_path / f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(columns) == sorted(got.columns)
    assert sorted(str(tuple(row)) for row in got.select(columns).collect()) == sorted(map(str, want.fetchall()))
