import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chainmetrics.functions import bytecode, hexnum
from chainmetrics.operators import alerts, blocks, contracts, entities, oracle, transfers
from chainmetrics.schemas import FIELDS, RAW, schema

W = lambda n: f"{n % (1 << 256):064x}"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("n", [0, 1, 10**12 - 1, 10**12, 2**64, 2**255 + 12345, 2**256 - 1])
def test_wide_numbers_are_exact(spark, n):
    assert one(spark, hexnum.u256_decimal(F.col("x")), x=hex(n)) == str(n)


@pytest.mark.parametrize("text, want", [(None, None), ("", None), ("0x", None), ("0xzz", None), ("0x" + "1" * 65, None), ("0x00ff", "255")])
def test_wide_numbers_of_odd_text(spark, text, want):
    assert one(spark, hexnum.u256_decimal(F.col("x")), x=text) == want


@pytest.mark.parametrize("text, want", [("0x10", 16), ("0x7fffffffffffffff", 2**63 - 1), ("0x8000000000000000", None), ("0x0000000000000000000001", 1), ("", None), (None, None), ("xyz", None)])
def test_hex_to_dec(spark, text, want):
    assert one(spark, hexnum.hex_to_dec(F.col("x")), x=text) == want


def test_abi_text_in_its_three_forms(spark):
    text = lambda x: one(spark, hexnum.abi_text(F.col("x")), x=x)
    dynamic = "0x" + W(32) + W(6) + "Tether".encode().hex().ljust(64, "0")
    assert text(dynamic) == "Tether" and text("0x" + b"MKR".hex().ljust(64, "0")) == "MKR" and text("0x" + b"raw".hex()) == "raw" and text("0x") is None and text(None) is None


def test_abi_arrays(spark):
    data = lambda ids, values: "0x" + W(64) + W(64 + 32 * (1 + len(ids))) + W(len(ids)) + "".join(map(W, ids)) + W(len(values)) + "".join(map(W, values))
    got = one(spark, hexnum.two_uint_arrays(F.col("x")), x=data([1, 2, 2**256 - 1], [4, 5]))
    assert got["ids"] == ["1", "2", str(2**256 - 1)] and got["values"] == ["4", "5"]
    assert one(spark, hexnum.two_uint_arrays(F.col("x")), x=data([1, 2], [4, 5])[:-10]) is None


def test_round_data(spark):
    result = "0x" + W(1) + W(-250) + W(5) + W(1700) + W(1)
    df = spark.createDataFrame([(result, 2), (result, None), (result[:100], 2), (None, 2)], "x string, d int")
    got = [r["r"] for r in df.select(hexnum.round_data(F.col("x"), F.col("d")).alias("r")).collect()]
    assert got[0]["price"] == -2.5 and got[0]["updated_at"] == 1700 and got[1]["price"] == pytest.approx(-250 / 1e18) and got[2:] == [None, None]


def test_selectors_walk_opcode_by_opcode(spark):
    rng = random.Random(3)
    programs = ["", "0x", None, "0x63a9059cbb", "0x6063a9059cbb00", "0x7f63a9059cbb"] + ["0x" + bytes(rng.choice([0x63, 0x60, 0x7F, 0x5B, rng.randrange(256)]) for _ in range(rng.randrange(1, 900))).hex() for _ in range(30)]

    def walk(code):
        raw, i, found, steps = bytes.fromhex((code or "").removeprefix("0x")), 0, set(), 0
        while i < len(raw) and steps < 500:
            op, steps = raw[i], steps + 1
            size = op - 0x5F if 0x60 <= op <= 0x7F else 0
            if op == 0x63 and i + 4 < len(raw):
                found.add("0x" + raw[i + 1 : i + 5].hex())
            i += 1 + size
        return sorted(found)

    df = spark.createDataFrame([(p,) for p in programs], "code string").select("code", bytecode.selectors(F.col("code")).alias("s"))
    assert all(r["s"] == walk(r["code"]) for r in df.collect())


LOG = "address string, topics array<string>, data string, log_index long"
A, B, Z = "0x" + "0" * 24 + "a" * 40, "0x" + "0" * 24 + "b" * 40, "0x" + "0" * 64


def moves(spark, topics, data):
    rows = transfers.extract(spark.createDataFrame([("0xC0", topics, data, 1)], LOG)).collect()
    return [(r["token_standard"], r["token_id"], r["value"], r["transfer_type"]) for r in rows]


def test_transfer_rules(spark):
    t, s, b = transfers.TRANSFER, transfers.TRANSFER_SINGLE, transfers.TRANSFER_BATCH
    assert moves(spark, [t, A, B], "0x" + W(100)) == [("ERC20", None, "100", "TRANSFER")]
    assert moves(spark, [t, Z, B], "0x" + W(100) + W(1)) == [("UNKNOWN", None, None, "MINT")]
    assert moves(spark, [t.upper().replace("0X", "0x"), A, Z, "0x" + W(7)], "0x") == [("ERC721", "7", None, "BURN")]
    assert moves(spark, [t, A, B, "0x1", "0x2"], "0x") == [("UNKNOWN", None, None, "TRANSFER")]
    assert moves(spark, [t, A], "0x") == [] and moves(spark, None, "0x") == [] and moves(spark, [], None) == [] and moves(spark, ["0x12", A, B], "0x") == []
    assert moves(spark, [s, A, A, B], "0x" + W(3) + W(4)) == [("ERC1155", "3", "4", "TRANSFER")]
    assert moves(spark, [s, A, A, B], "0x" + W(3)) == [("UNKNOWN", None, None, "TRANSFER")] and moves(spark, [s, A, B], "0x" + W(3) + W(4)) == []
    batch = lambda ids, values: "0x" + W(64) + W(96 + 32 * len(ids)) + W(len(ids)) + "".join(map(W, ids)) + W(len(values)) + "".join(map(W, values))
    assert moves(spark, [b, A, A, B], batch([1, 2], [8, 9])) == [("ERC1155", "1", "8", "TRANSFER"), ("ERC1155", "2", "9", "TRANSFER")]
    assert moves(spark, [b, A, A, B], batch([1, 2], [8])) == [] and moves(spark, [b, A, A, B], batch([1, 2], [8, 9])[:-20]) == [] and moves(spark, [b, A, A, B], batch([], [])) == []


def test_raw_responses(spark):
    good = {"number": 16, "block": {"hash": "0xb", "number": "0x10", "timestamp": "0x64", "miner": "0xAB", "difficulty": "0x2", "transactions": [{"hash": "0xT1", "from": "0xF", "value": "0x64"}], "withdrawals": [{"index": "0x1", "amount": "0x5"}]}, "receipts": [{"transactionHash": "0xt1", "status": "0x1", "gasUsed": "0x5208", "logs": [{"logIndex": "0x0", "address": "0xC0", "topics": [transfers.TRANSFER, A, B], "data": "0x" + W(100)}]}], "error": None}
    bad = good | {"number": 17, "block": None, "error": {"code": -1, "message": "x"}}
    raw = spark.createDataFrame([(json.dumps(r),) for r in (good, bad)], "j string").select(F.from_json("j", RAW).alias("r")).select("r.*")
    found = entities.raw_blocks(raw)
    assert [(r["number"], r["transaction_count"], r["base_fee_per_gas"], r["miner"]) for r in found.collect()] == [(16, 1, 0, "0xab")]
    receipts = entities.raw_receipts(raw)
    enriched = entities.with_receipts(entities.raw_transactions(raw), receipts).collect()
    assert len(enriched) == 1 and enriched[0]["receipt_status"] == 1 and enriched[0]["block_timestamp"] == 100
    logs = entities.logs(receipts)
    assert [r["value"] for r in transfers.extract(logs).collect()] == ["100"] and logs.first()["block_timestamp"] == 100
    assert entities.withdrawals(found).first()["amount"] == "5"


def test_views_fill_every_null(spark):
    for entity, fields in FIELDS.items():
        rows = spark.createDataFrame([tuple(("2024-01-01T00:00:00Z" if n == "last_updated" else None) for n, _, _ in fields)], schema(entity))
        got = entities.normalised(entity, rows).first().asDict()
        assert all(got["coin_id" if (entity, n) == ("tick", "id") else n] is not None for n, _, d in fields if d not in ("-", "*"))


def test_contract_order_and_proxies(spark):
    code = lambda *s: "0x60806040" + "".join(f"8063{x[2:]}1461000057" for x in s)
    impl, key = "0x" + "1" * 40, lambda n: "0x" + f"{n:040x}"
    minimal = "0x" + bytecode.MINIMAL_PREFIX + "1" * 40 + bytecode.MINIMAL_SUFFIX
    rows = [(key(1), None), (key(2), minimal), (key(3), code()), (key(4), code(contracts.DIAMOND[1])), (impl, code(*contracts.ERC20)), (key(5), code(contracts.UUPS[0])), (key(6), code(*contracts.ERC721[:3]))]
    df = spark.createDataFrame([(a, 1, 1, c) for a, c in rows], "address string, chain_id long, block_number long, bytecode string")
    slots = spark.createDataFrame([(key(3), contracts.SLOT_ZERO, "0x" + "0" * 24 + contracts.MASTER_COPIES[1][0][2:].upper()), (key(5), contracts.SLOT_IMPLEMENTATION, "0x" + "0" * 24 + impl[2:])], "address string, slot string, value string")
    own = contracts.classify(df, slots)
    got = {r["address"]: r["proxy_type"] for r in own.collect()}
    assert got == {key(1): None, key(2): "MINIMAL", key(3): "GNOSIS_SAFE", key(4): "DIAMOND", impl: None, key(5): "TRANSPARENT", key(6): None}
    metadata = spark.createDataFrame([(impl, "Token", "TOK", 6, "5"), (key(5), "Own", None, None, None)], "address string, name string, symbol string, decimals int, total_supply string")
    solved = {r["address"]: r for r in contracts.resolve_proxies(own, metadata).collect()}
    assert solved[key(2)]["is_erc20"] and solved[key(2)]["name"] == "Token" and solved[key(5)]["name"] == "Own" and solved[key(5)]["symbol"] == "TOK" and solved[key(3)]["impl_category"] == "UNKNOWN"
    uups = {r["address"]: r["proxy_type"] for r in contracts.classify(df, slots, implementation_upgrades=True).collect()}
    assert uups[key(5)] == "TRANSPARENT"


def test_alert_rule(spark):
    rows = [("0xDAC17f958d2ee523a2206206994597c13d831ec7", "1100000000000"), ("0xdac17f958d2ee523a2206206994597c13d831ec7", "500000000000"), ("0xother", str(2 * 10**24)), ("0xother", "x"), (None, None)]
    df = spark.createDataFrame([(a, v, 0) for a, v in rows], "contract_address string, value string, block_timestamp long").select("*", F.timestamp_seconds("block_timestamp").alias("timestamp"), *(F.lit("").alias(c) for c in ("transaction_hash", "from_address", "to_address")))
    got = [(r["token_symbol"], r["amount"], r["usd_value"]) for r in alerts.whale_alerts(df, alerts.known_tokens(spark)).collect()]
    assert sorted(got) == [("UNKNOWN", 2e6, 0.0), ("USDT", 1.1e6, 1.1e6)]


def test_alerts_do_not_shuffle_transfers(spark):
    from chainmetrics.plans import fixtures as fx

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    found = alerts.whale_alerts(fx.transfers(spark, "/root/testdata/sf0.001"), alerts.known_tokens(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_token_metadata_is_shuffled_before_it_is_sorted(spark):
    """Texts are aggregated by sorting: a task sorts its share of the addresses, not all that the one file in its hands holds."""
    calls = [(a, f, "0x" + W(n)) for n, a in enumerate(("0xA", "0xb")) for f in ("decimals", "totalSupply")] * 2
    calls = spark.createDataFrame(calls, "address string, field string, result string")
    code = spark.createDataFrame([("0xa", True, False, False), ("0xb", False, True, False), ("0xc", True, False, False)], "address string, is_erc20 boolean, is_erc721 boolean, is_erc1155 boolean")
    found = contracts.token_metadata(code, calls)
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sorted(map(tuple, found.collect())) == [("0xa", None, None, 0, "0"), ("0xb", None, None, 0, None), ("0xc", None, None, None, None)]
    assert any("REPARTITION_BY_NUM" in x for x in lines) and not any("Broadcast" in x for x in lines)  # neither merged nor broadcast by compressed bytes
    sorts = [i for i, x in enumerate(lines) if "SortAggregate" in x]
    exchanges = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert sorts and max(sorts) < max(exchanges)  # the plan reads upwards: every sort lies above the calls' exchange


def test_logs_are_nested_behind_their_shuffle(spark):
    logs = spark.createDataFrame([("0x1", 1, "a"), ("0x1", 0, "b"), ("0x2", 5, "c")], "transaction_hash string, log_index long, data string")
    found = entities.nested_receipts(logs)
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    exchange = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert len(exchange) == 1 and all(i < exchange[0] for i, x in enumerate(lines) if "HashAggregate" in x)
    assert {r["transaction_hash"]: [x["data"] for x in r["logs"]] for r in found.collect()} == {"0x1": ["b", "a"], "0x2": ["c"]}


def test_responses_are_made_in_as_many_tasks_as_are_set(spark, monkeypatch):
    from chainmetrics.plans import fixtures as fx

    orders = spark.range(40).selectExpr("id AS o_orderkey", "id AS o_custkey", "1D AS o_totalprice", "'F' AS o_orderstatus", "'2-HIGH' AS o_orderpriority", "date_add(date '1995-01-01', cast(id AS int)) AS o_orderdate")
    monkeypatch.setattr(fx, "table", lambda *_: orders)
    text = fx.raw_typed(spark, "")
    assert text.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert text._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert text.count() == 40


def test_block_ranges(spark):
    df = spark.createDataFrame([(n, 1000 + 10 * n) for n in range(1, 11)], "number long, timestamp long")
    assert blocks.range_of_time(df, 1035, 1062) == (4, 6) and blocks.range_of_time(df, 5, 1062) == (0, 6)
    for span in ((1035, 5000), (1041, 1049)):
        with pytest.raises(ValueError):
            blocks.range_of_time(df, *span)
    assert sorted(r["number"] for r in blocks.next_blocks(df, 2, 3, 4).collect()) == [3, 4, 5, 6] and blocks.next_blocks(df, 8, 3, 4).count() == 0
    with pytest.raises(ValueError):
        blocks.check_range(5, 4)


def test_feeds(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "pair string, contract_address string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "pair string, contract_address string")
    assert {tuple(r) for r in oracle.merge_feeds(old, new).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
