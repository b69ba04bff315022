import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chainmetrics.operators import market

TICKS = "coin_id string, symbol string, eth_contract_address string, current_price double, total_volume double, market_cap double, market_cap_rank long, fully_diluted_valuation double, ath double, max_supply double, total_supply double, circulating_supply double, last_updated timestamp_ntz"


def ticks(spark, rows):
    return spark.createDataFrame([("bitcoin", "btc", None, p, v, 1e12, 1, fdv, 69000.0, 21e6, 19e6, 19e6, t) for p, v, fdv, t in rows], TICKS)


def test_daily_metrics_of_one_coin(spark):
    at = lambda h, m: datetime(2023, 7, 19, h, m)
    rows = [(320.0, 710.0, 4e12, at(2, 15)), (355.5, 740.0, 4e12, at(3, 1)), (288.25, 795.0, 4e12, at(9, 40)), (301.0, 880.0, 4e12, at(17, 5)), (336.0, 930.0, 4e12, at(21, 59))]
    got = market.daily_metrics(ticks(spark, rows), "2023-07-19").first()
    assert (got["open_price"], got["high_price"], got["low_price"], got["close_price"], got["volume_24h"]) == (320, 355.5, 288.25, 336, 930)
    assert got["price_change_24h"] == 16 and got["price_change_percentage_24h"] == 5.0 and got["fdv_ratio"] == 0.25


def test_daily_metrics_zero_denominators(spark):
    got = market.daily_metrics(ticks(spark, [(0.0, 1.0, 0.0, datetime(2024, 1, 1))])).first()
    assert got["fdv_ratio"] is None and got["price_change_percentage_24h"] == 0


def test_daily_plan_has_one_shuffle_of_ticks(spark):
    plan = market.daily_metrics(ticks(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_hourly_score(spark):
    hour = datetime(2023, 7, 19, 21)
    hourly = spark.createDataFrame([("bitcoin", "btc", hour, 200.0, 210.6, 195.0, 206.0, 690.0, 4)], "coin_id string, symbol string, hour timestamp_ntz, open_price double, high_price double, low_price double, close_price double, current_volume double, tick_count long")
    base = spark.createDataFrame([("bitcoin", 460.0)], "coin_id string, avg_volume_7d double")
    got = market.trending_scores(hourly, base).first()
    assert got["momentum"] == pytest.approx(0.03) and got["volume_spike_ratio"] == 1.5
    assert got["trending_score"] == pytest.approx(3 * 8 + 2 * 3 + 5 * 3)
    alone = market.trending_scores(hourly, base.limit(0)).first()
    assert alone["volume_spike_ratio"] == 1.0


@pytest.mark.parametrize("text", ["2024-01-01", "now", "2024-01-01 1"])
def test_bad_hours_are_errors(text):
    with pytest.raises(ValueError):
        market.parse_hour(text)


def test_missing_hourly_change_zeroes_the_score(spark):
    rows = spark.createDataFrame([("a", "A", 1.0, 10.0, None, datetime(2024, 1, 1, 0, 0, 10)), ("a", "A", 2.0, 10.0, None, datetime(2024, 1, 1, 0, 0, 20))], "coin_id string, symbol string, current_price double, total_volume double, price_change_percentage_1h double, timestamp timestamp")
    got = market.sliding_metrics(rows).collect()
    assert len(got) == 5 and all(r["trending_score"] == 0 and r["momentum"] == 0 and r["volatility"] > 0 for r in got)


def test_nearest_history(spark):
    m = 60_000
    chart = spark.createDataFrame([("a", 0 * m, 1.0, 1.0, 1.0), ("a", 50 * m, 2.0, 2.0, 2.0), ("a", 200 * m, 3.0, 3.0, 3.0)], "coin_id string, timestamp long, price double, market_cap double, volume double")
    ohlc = spark.createDataFrame([("a", t * m, 1.0, 1.0, 1.0, 1.0) for t in (0, 10, 40, 60, 120)], "coin_id string, timestamp long, open double, high double, low double, close double")
    got = {(r["timestamp"] // m): (r["price"], r["open"]) for r in market.history_nearest(chart, ohlc).collect()}
    # 0 is exact; 40 takes 50 before 60 can; 10 finds 0 used and 50 too far; 120 is alone; 200 stays a chart row
    assert got == {0: (1.0, 1.0), 10: (None, 1.0), 40: (2.0, 1.0), 60: (None, 1.0), 120: (None, 1.0), 200: (3.0, None)}


def brute_nearest(points, bars, tolerance):
    out = []
    for coin in {r[0] for r in points + bars}:
        free, rest, mine = sorted(p for p in points if p[0] == coin), [], sorted(b for b in bars if b[0] == coin)
        for b in mine:
            same = [p for p in free if p[1] == b[1]]
            if same:
                free.remove(same[0])
                out.append((*b[:2], *same[0][2:], *b[2:]))
            else:
                rest.append(b)
        for b in rest:
            near = [p for p in free if abs(p[1] - b[1]) <= tolerance]
            best = min(near, key=lambda p: (abs(p[1] - b[1]), p), default=(None,) * 5)
            if near:
                free.remove(best)
            out.append((*b[:2], *best[2:], *b[2:]))
        out += [(*p, *(None,) * 4) for p in free]
    return sorted(out, key=str)


def test_nearest_history_of_long_and_repeated_times_equals_brute_force(spark):
    rng, span = random.Random(9), {"dense": 400, "gaps": 40_000, "midnight": 3000}
    points = [(c, rng.randrange(n), float(i), 1.0, 2.0) for c, n in span.items() for i in range(250)]
    bars = [(c, rng.randrange(n), float(i), 1.0, 2.0, 3.0) for c, n in span.items() for i in range(250)]
    day = 86_400_000
    points, bars = points + [("b", day - 9, 1.0, 1.0, 1.0)] * 2, bars + [("b", day + 9, 1.0, 1.0, 1.0, 1.0)] * 3
    chart = spark.createDataFrame([*points, ("b", None, 7.0, 7.0, 7.0)], "coin_id string, timestamp long, price double, market_cap double, volume double").repartition(3)
    ohlc = spark.createDataFrame(bars, "coin_id string, timestamp long, open double, high double, low double, close double").repartition(3)
    found = market.history_nearest(chart, ohlc, 25)
    got = [tuple(r) for r in found.collect()]
    assert sorted((r for r in got if r[1] is not None), key=str) == brute_nearest(points, bars, 25)
    assert [r for r in got if r[1] is None] == [("b", None, 7.0, 7.0, 7.0, None, None, None, None)]
    assert sum(r[1] == day + 9 and r[2] == 1.0 for r in got) == 2


def test_universe_keeps_the_native_coin(spark):
    markets = spark.createDataFrame([("ethereum", 5.0), ("tether", 4.0), ("bitcoin", 9.0), ("late", 1.0)], "id string, market_cap double")
    listing = spark.createDataFrame([("ethereum", {}), ("tether", {"ethereum": "0xdac"}), ("bitcoin", None), ("late", {"ethereum": "0x1"})], "id string, platforms map<string,string>")
    got = {r["id"]: r["eth_contract_address"] for r in market.top_coins(markets, listing, 3).collect()}
    assert got == {"ethereum": None, "tether": "0xdac"}


def test_valuation_and_bands(spark):
    rows = spark.createDataFrame([(2e10, 0.5, -90.0), (5e9, 0.05, 0.0), (1e6, 2.0, -100.0)], "market_cap double, volume_to_market_cap_ratio double, drawdown_from_ath double")
    got = [(r["cap_tier"], r["liquidity"], r["suspicious"], r["recovery_gain"]) for r in market.bands(rows).collect()]
    assert got[0][:3] == ("large", "high", False) and got[0][3] == pytest.approx(900) and got[1][:3] == ("mid", "normal", False) and got[2] == ("small", "high", True, None)


def test_latest_ticks_by_time(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 1, None)], "coin_id string, last_updated long, v long")
    assert {tuple(r) for r in market.latest_ticks(rows).collect()} == {("a", 2, 4), ("b", 1, None)}
    assert market.top_trending(rows.withColumnsRenamed({"last_updated": "hour"}).withColumn("trending_score", F.col("v").cast("double")), 1).count() == 1
