"""The registered queries: an operator over whole tables, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytecode, hexnum
from ..operators import alerts, blocks, contracts, entities, market, oracle, transfers
from ..schemas import FIELDS
from ..session import scratch
from ..sources import readers, sinks, tables
from . import fixtures as fx
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# SQL of the adapters

TICKS = """ticks AS (
  SELECT event_id, concat('coin-', user_id % 10) AS coin_id, concat('S', user_id % 10) AS symbol, concat('0xc', user_id % 20) AS eth_contract_address,
    value AS current_price, value * (1000000 + (user_id % 10) * 1000) AS market_cap, CAST(user_id % 10 + 1 AS INT) AS market_cap_rank,
    CASE WHEN user_id % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE value * (1000000 + (user_id % 10) * 1000) * (1 + user_id % 3) END AS fully_diluted_valuation,
    CAST(500 AS DOUBLE) AS ath, CAST(800 * (1 + user_id % 10) AS DOUBLE) AS circulating_supply,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 21 - 10 AS DOUBLE) END AS price_change_percentage_1h,
    CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) * 1000 AS total_volume, ts AS last_updated FROM events)"""
FAST = """fast AS (SELECT * REPLACE (make_timestamp(1704067200000000 + (epoch_us(last_updated) - 1704067200000000) // 60) AS last_updated) FROM ticks)"""
HOURLY = """hourly AS (
  SELECT coin_id, date_trunc('hour', last_updated) AS hour, min(symbol) AS symbol, arg_min(current_price, last_updated) AS open_price,
    max(current_price) AS high_price, min(current_price) AS low_price, arg_max(current_price, last_updated) AS close_price,
    max(total_volume) AS current_volume, count(*) AS tick_count FROM ticks GROUP BY ALL)"""
ROLLING = """sums AS (SELECT coin_id, date_trunc('hour', last_updated) AS hour, sum(total_volume) AS s, count(total_volume) AS n FROM ticks GROUP BY ALL),
rolling AS (SELECT coin_id, hour, sum(s) OVER w / sum(n) OVER w AS avg_volume_7d FROM sums
  WINDOW w AS (PARTITION BY coin_id ORDER BY hour RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING))"""
SCORES = """rated AS (SELECT h.*, coalesce(r.avg_volume_7d, 0) AS base, CASE WHEN low_price > 0 THEN (high_price - low_price) / low_price ELSE 0 END AS volatility,
    CASE WHEN open_price > 0 THEN (close_price - open_price) / open_price ELSE 0 END AS momentum FROM hourly h LEFT JOIN rolling r USING (coin_id, hour)),
scores AS (SELECT hour, coin_id, symbol, current_volume AS volume_avg, volatility, momentum, CASE WHEN base > 0 THEN current_volume / base ELSE 1 END AS volume_spike_ratio FROM rated),
scored AS (SELECT *, 3 * least(100 * volatility, 10) + 2 * least(100 * abs(momentum), 10) + 5 * least(2 * volume_spike_ratio, 10) AS trending_score, 'batch' AS data_source FROM scores)"""
DAILY = """daily AS (
  SELECT CAST(last_updated AS DATE) AS date, coin_id, symbol, eth_contract_address, max(current_price) AS high_price, min(current_price) AS low_price,
    max(total_volume) AS volume_24h, avg(market_cap) AS market_cap, arg_max(market_cap_rank, last_updated) AS market_cap_rank,
    arg_max(fully_diluted_valuation, last_updated) AS fdv, max(ath) AS ath, avg(circulating_supply) AS circulating_supply FROM ticks GROUP BY ALL),
opens AS (SELECT CAST(last_updated AS DATE) AS date, coin_id, arg_min(current_price, last_updated) AS open_price, arg_max(current_price, last_updated) AS close_price FROM ticks GROUP BY ALL),
metrics AS (SELECT date, coin_id, symbol, eth_contract_address, open_price, high_price, low_price, close_price, volume_24h, market_cap, market_cap_rank,
    CAST(0 AS DOUBLE) AS volume_change_24h, CASE WHEN fdv > 0 AND market_cap > 0 THEN market_cap / fdv END AS fdv_ratio,
    CASE WHEN market_cap > 0 THEN volume_24h / market_cap ELSE 0 END AS volume_to_market_cap_ratio, close_price - open_price AS price_change_24h,
    CASE WHEN open_price > 0 THEN 100 * (close_price - open_price) / open_price ELSE 0 END AS price_change_percentage_24h,
    CASE WHEN ath > 0 THEN 100 * (close_price - ath) / ath ELSE 0 END AS drawdown_from_ath, circulating_supply, 'batch' AS data_source
  FROM daily JOIN opens USING (date, coin_id))"""
TOKEN = """CASE l_suppkey % 7 WHEN 0 THEN 'USDT' WHEN 1 THEN 'USDC' WHEN 2 THEN 'DAI' WHEN 3 THEN 'WETH' WHEN 4 THEN 'WBTC' ELSE 'UNKNOWN' END"""
CONTRACT = """CASE l_suppkey % 7 WHEN 0 THEN '0xdac17f958d2ee523a2206206994597c13d831ec7' WHEN 1 THEN '0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48'
  WHEN 2 THEN '0x6b175474e89094c44da98b954eedeac495271d0f' WHEN 3 THEN '0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2'
  WHEN 4 THEN '0x2260fac5e5542a773aa44fbcfedf7c193bc2c599' ELSE concat('0xunknown', l_suppkey % 7) END"""
VALUE = """CASE WHEN l_linenumber <> 7 THEN concat(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), repeat('0', CASE WHEN l_suppkey % 7 <= 1 THEN 6 WHEN l_suppkey % 7 = 4 THEN 8 ELSE 18 END)) END"""
ADDRESS = "concat('0x', lpad(lower(to_hex({})), 40, '0'))"
WORD = "concat('0x', lpad(lower(to_hex({})), 64, '0'))"
AMOUNT = "CASE WHEN l_linenumber <> 7 THEN CAST(round(l_extendedprice * 100) AS DOUBLE) ELSE 0 END"
PRICED = f"""priced AS (SELECT *, {TOKEN} AS token_symbol, {CONTRACT} AS contract_address, {AMOUNT} AS amount,
  ({AMOUNT}) * CASE l_suppkey % 7 WHEN 3 THEN 2500.0 WHEN 4 THEN 65000.0 WHEN 5 THEN 0 WHEN 6 THEN 0 ELSE 1 END AS usd_value FROM lineitem)"""
DAYS = """days AS (SELECT o.*, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS n, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders o),
good AS (SELECT * FROM days WHERE n % 50 <> 49)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_sql(body: str, source: str, *columns: str, digits: int = 6) -> str:
    return f"WITH {body} SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM {source}"


_KINDS = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "array<string>": "VARCHAR"}


def table_sql(entity: str, source: str, **given: str) -> str:
    """The whole table view of rows of which `given` are the columns that they have: all others are the entity's defaults."""
    out = []
    for name, kind, default in FIELDS[entity]:
        if default == "*":
            continue
        own = "TIMESTAMP" if name in ("last_updated", "ath_date", "atl_date") else _KINDS[kind]
        value = f"CAST({given.get(name, 'NULL')} AS {own})"
        if default != "-":
            value = f"coalesce({value}, CAST('{default}' AS {own}))"
        out.append(f"{value} AS {'coin_id' if (entity, name) == ('tick', 'id') else name}")
        if name in entities.WIDE and kind == "string":
            out.append(f"TRY_CAST({value} AS DOUBLE) AS {name}_double")
    return f"SELECT {', '.join(out)} FROM {source}"


def plain(rows: DataFrame) -> DataFrame:
    """Times without a zone, and lists as text."""
    kinds = dict(rows.dtypes)
    return rows.select(*(F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.array_join(c, ",").alias(c) if k == "array<string>" else F.col(c) for c, k in kinds.items()))


# market


@query(f"WITH {TICKS}, {HOURLY} SELECT * FROM hourly")
def hourly_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.hourly_ohlc(fx.ticks(spark, sf_dir))


@query(f"WITH {TICKS} SELECT coin_id, round(avg(total_volume), 6) AS avg_volume_7d FROM ticks WHERE last_updated >= TIMESTAMP '2024-01-13 12:00:00' AND last_updated < TIMESTAMP '2024-01-20 12:00:00' GROUP BY coin_id")
def volume_baseline_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.volume_baseline(fx.ticks(spark, sf_dir), datetime(2024, 1, 20, 12)), "avg_volume_7d")


@query(rounded_sql(f"{TICKS}, {ROLLING}", "rolling", "avg_volume_7d"))
def rolling_volume_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.rolling_baseline(fx.ticks(spark, sf_dir)), "avg_volume_7d")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = fx.ticks(spark, sf_dir)
    return market.trending_scores(market.hourly_ohlc(ticks), market.rolling_baseline(ticks), ["coin_id", "hour"])


RATIOS = ("volatility", "momentum", "volume_spike_ratio", "trending_score")


@query(rounded_sql(f"{TICKS}, {HOURLY}, {ROLLING}, {SCORES}", "scored", *RATIOS))
def hourly_trending_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir), *RATIOS)


@query(rounded_sql(f"{TICKS}, {HOURLY}, {ROLLING}, {SCORES}", "(SELECT * FROM scored WHERE hour = (SELECT max(hour) FROM scored) ORDER BY trending_score DESC, coin_id LIMIT 5)", *RATIOS))
def top_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.top_trending(_scores(spark, sf_dir)), *RATIOS)


DAILY_ROUNDED = ("market_cap", "fdv_ratio", "volume_to_market_cap_ratio", "price_change_24h", "price_change_percentage_24h", "drawdown_from_ath")


@query(rounded_sql(f"{TICKS}, {DAILY}", "metrics", *DAILY_ROUNDED, digits=4))
def daily_market_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.daily_metrics(fx.ticks(spark, sf_dir)), *DAILY_ROUNDED, digits=4)


@query(f"WITH {TICKS} SELECT event_id, first(current_price) OVER w AS open_price, last(current_price) OVER w AS close_price FROM ticks WINDOW w AS (PARTITION BY coin_id, CAST(last_updated AS DATE) ORDER BY last_updated ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def daily_open_close_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.daily_open_close(fx.ticks(spark, sf_dir)).select("event_id", "open_price", "close_price")


@query(
    f"""WITH {TICKS}, {DAILY}, tiers AS (SELECT *, CASE WHEN market_cap > 10e9 THEN 'large' WHEN market_cap >= 1e9 THEN 'mid' ELSE 'small' END AS cap_tier FROM metrics)
SELECT date, coin_id, eth_contract_address, cap_tier, CASE WHEN volume_to_market_cap_ratio > 0.1 THEN 'high' WHEN volume_to_market_cap_ratio < 0.01 THEN 'low' ELSE 'normal' END AS liquidity,
  cap_tier = 'small' AND volume_to_market_cap_ratio > 1 AS suspicious, round(CASE WHEN drawdown_from_ath > -100 THEN -drawdown_from_ath / (100 + drawdown_from_ath) * 100 END, 4) AS recovery_gain FROM tiers"""
)
def market_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.bands(market.daily_metrics(fx.ticks(spark, sf_dir)))
    return rounded(rows.select("date", "coin_id", "eth_contract_address", "cap_tier", "liquidity", "suspicious", "recovery_gain"), "recovery_gain", digits=4)


@query(f"WITH {TICKS} SELECT event_id, round(current_price * 2000 * (1 + event_id % 3), 4) AS fdv, round(current_price * circulating_supply, 4) AS market_cap FROM ticks")
def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.ticks(spark, sf_dir).select("event_id", F.col("current_price").alias("price"), (2000 * (1 + F.col("event_id") % 3)).alias("max_supply"), "circulating_supply")
    return rounded(market.valuations(rows).select("event_id", "fdv", "market_cap"), "fdv", "market_cap", digits=4)


SLIDING = """spread AS (SELECT *, unnest(generate_series(date_trunc('minute', last_updated) - INTERVAL 4 MINUTE, date_trunc('minute', last_updated), INTERVAL 1 MINUTE)) AS window_start FROM {source}),
windows AS (SELECT window_start, coin_id, symbol, arg_min(current_price, last_updated) AS open_price, arg_max(current_price, last_updated) AS close_price, max(current_price) AS high_price,
    min(current_price) AS low_price, avg(current_price) AS avg_price, stddev_samp(current_price) AS stddev_price, avg(total_volume) AS volume_avg,
    max(CASE WHEN last_updated = top THEN price_change_percentage_1h END) AS change_1h, count(*) AS tick_count
  FROM (SELECT *, max(last_updated) OVER (PARTITION BY window_start, coin_id, symbol) AS top FROM spread) GROUP BY ALL),
rated AS (SELECT *, CASE WHEN avg_price > 0 THEN 100 * coalesce(stddev_price, 0) / avg_price ELSE 0 END AS volatility, CASE WHEN open_price > 0 THEN 100 * (close_price - open_price) / open_price ELSE 0 END AS price_roc FROM windows),
moved AS (SELECT *, 0.5 * price_roc + 0.5 * change_1h AS raw_momentum FROM rated)"""
# max_by over a null value: Spark and the SQL above both take the newest tick's change, null or not


@query(
    f"""WITH {TICKS}, {FAST}, {SLIDING.format(source='fast')} SELECT window_start, coin_id, symbol, open_price, close_price, high_price, low_price, round(avg_price, 6) AS avg_price, round(coalesce(stddev_price, 0), 6) AS stddev_price,
  round(volume_avg, 6) AS volume_avg, coalesce(change_1h, 0) AS price_change_1h, tick_count, round(volatility, 6) AS volatility, round(price_roc, 6) AS price_roc, round(coalesce(raw_momentum, 0), 6) AS momentum,
  CAST(1 AS DOUBLE) AS volume_spike_ratio, round(coalesce(0.4 * volatility + 0.6 * abs(raw_momentum), 0), 6) AS trending_score FROM moved"""
)
def sliding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market.sliding_metrics(fx.fast_ticks(spark, sf_dir))
    rows = rows.withColumn("window_start", F.col("window.start").cast("timestamp_ntz")).drop("window")
    return rounded(rows, "avg_price", "stddev_price", "volume_avg", "volatility", "price_roc", "momentum", "trending_score")


DOCUMENT_SQL = """SELECT concat(coin_id, '_', strftime(window_start, '%Y-%m-%d %H:%M:%S')) AS doc_id, coin_id, symbol, window_start, window_start + INTERVAL 5 MINUTE AS window_end, round(volume_avg, 6) AS volume_avg,
  round(volatility, 6) AS volatility, round(coalesce(raw_momentum, 0), 6) AS momentum, CAST(1 AS DOUBLE) AS volume_spike_ratio, round(coalesce(0.4 * volatility + 0.6 * abs(raw_momentum), 0), 6) AS trending_score, 'stream' AS data_source FROM moved"""
DOCUMENT_ROUNDED = ("volume_avg", "volatility", "momentum", "trending_score")


@query(f"WITH {TICKS}, {FAST}, {SLIDING.format(source='fast')} {DOCUMENT_SQL}")
def trending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.trending_documents(market.sliding_metrics(fx.fast_ticks(spark, sf_dir))), *DOCUMENT_ROUNDED)


@query(f"WITH {TICKS} SELECT coin_id, max(last_updated) AS last_updated, arg_max(current_price, last_updated) AS current_price, arg_max(event_id, last_updated) AS event_id FROM ticks GROUP BY coin_id")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest(fx.ticks(spark, sf_dir), ["coin_id"], "last_updated").select("coin_id", "last_updated", "current_price", "event_id")


@query(f"WITH {TICKS} SELECT CAST(last_updated AS DATE) AS date, count(*) AS tick_count FROM ticks GROUP BY 1")
def ready_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.daily_counts(fx.ticks(spark, sf_dir))


def _listing(ticks: DataFrame) -> DataFrame:
    """Every user as a coin of its own; even ones have an address."""
    return ticks.select("id").distinct().withColumn("platforms", F.when(F.expr("cast(substring(id, 3) AS int) % 2 = 0"), F.create_map(F.lit("ethereum"), F.concat(F.lit("0x"), "id"))).otherwise(F.create_map(F.lit("other"), F.lit("x"))))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "value", "event_id")).alias("r"))
    return newest.select(F.concat(F.lit("u-"), "user_id").alias("id"), (F.col("r.value") * 1000).alias("market_cap"), F.col("r.value").alias("current_price"), F.col("r.event_id").alias("event_id"))


USERS = """users AS (SELECT concat('u-', user_id) AS id, arg_max(value, ts) * 1000 AS market_cap, arg_max(value, ts) AS current_price, arg_max(event_id, ts) AS event_id, user_id FROM events GROUP BY user_id),
top AS (SELECT * FROM (SELECT * FROM users ORDER BY market_cap DESC, id LIMIT 250) WHERE user_id % 2 = 0)"""


@query(f"WITH {USERS} SELECT id, market_cap, concat('0x', id) AS eth_contract_address FROM top")
def top_market_cap_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    return market.top_coins(users, _listing(users)).select("id", "market_cap", "eth_contract_address")


QUOTED = {  # what the quotes have beside id, price and market cap; the rest is missing or cannot be read
    "symbol": "concat('S', event_id % 10)", "name": "concat('name ', event_id)", "image": "CASE WHEN event_id % 2 = 0 THEN 'i.png' END", "ath_date": "'2024-01-01T00:00:00Z'", "last_updated": "concat('t', event_id)", "market_cap_rank": "event_id % 500",
    "fully_diluted_valuation": "current_price * 3", "total_volume": "event_id * 2", "high_24h": "current_price + 1", "low_24h": "current_price - 1", "price_change_24h": "current_price / 2", "price_change_percentage_24h": "event_id % 9",
    "price_change_percentage_1h_in_currency": "event_id % 7", "price_change_percentage_7d_in_currency": "CASE WHEN event_id % 5 = 0 THEN event_id END", "circulating_supply": "event_id", "total_supply": "event_id + 1", "ath": "'n/a'", "atl": "current_price / 4",
}
_UNREAD = {"ath": "NULL"}


@query(
    f"WITH {USERS} SELECT id, concat('0x', id) AS eth_contract_address, current_price, market_cap, "
    + ", ".join(f"CAST({'NULL' if c in _UNREAD else QUOTED.get(c, 'NULL')} AS DOUBLE) AS {c.removesuffix('_in_currency')}" for c in market.QUOTE_NUMBERS if c not in ("current_price", "market_cap"))
    + ", "
    + ", ".join(f"CAST({QUOTED.get(c, 'NULL')} AS VARCHAR) AS {c}" for c in ("symbol", "name", "image", "ath_date", "atl_date", "last_updated"))
    + f", CAST({QUOTED['market_cap_rank']} AS BIGINT) AS market_cap_rank FROM top WHERE event_id % 3 <> 0"
)
def quote_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    quotes = users.where("event_id % 3 <> 0").select("id", "current_price", F.col("market_cap").cast("string").alias("market_cap"), *(F.expr(sql).alias(c) for c, sql in QUOTED.items()))
    return market.quoted_ticks(market.top_coins(users, _listing(users)), quotes)


@query("SELECT user_id, CASE WHEN user_id % 2 = 0 THEN concat('0xu-', user_id) END AS eth_contract_address FROM (SELECT DISTINCT user_id FROM events)")
def platform_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listing(fx.table(spark, sf_dir, "events").select(F.concat(F.lit("u-"), "user_id").alias("id")))
    return rows.select(F.expr("cast(substring(id, 3) AS bigint)").alias("user_id"), market.platform_address(F.col("platforms")).alias("eth_contract_address"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ticks(spark, sf_dir).withColumn("timestamp", F.expr("unix_micros(cast(last_updated AS timestamp)) div 1000"))


@query(
    f"""WITH {TICKS}, s AS (SELECT *, epoch_us(last_updated) // 1000 AS timestamp FROM ticks),
a AS (SELECT coin_id, timestamp, current_price AS price FROM s WHERE event_id % 2 = 0), b AS (SELECT coin_id, timestamp, market_cap FROM s WHERE event_id % 3 = 0), c AS (SELECT coin_id, timestamp, total_volume AS volume FROM s WHERE event_id % 5 = 0)
SELECT coin_id, timestamp, price, market_cap, volume FROM a FULL JOIN b USING (coin_id, timestamp) FULL JOIN c USING (coin_id, timestamp)"""
)
def history_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    pick = lambda n, column, name: s.where(F.col("event_id") % n == 0).select("coin_id", "timestamp", F.col(column).alias(name))
    return market.history_outer(pick(2, "current_price", "price"), pick(3, "market_cap", "market_cap"), pick(5, "total_volume", "volume"))


NEAREST = f"""WITH RECURSIVE {TICKS}, s AS (SELECT *, epoch_us(last_updated) // 1000 AS timestamp FROM ticks),
points AS (SELECT event_id AS pid, coin_id, timestamp, current_price AS price, market_cap, total_volume AS volume, row_number() OVER (PARTITION BY coin_id, timestamp ORDER BY current_price, market_cap, total_volume) AS nth FROM s WHERE event_id % 2 = 0),
bars AS (SELECT event_id AS bid, coin_id, timestamp, current_price AS bar, row_number() OVER (PARTITION BY coin_id, timestamp ORDER BY current_price) AS nth FROM s WHERE event_id % 2 = 1),
same AS (SELECT pid, bid FROM points JOIN bars USING (coin_id, timestamp, nth)),
free AS (SELECT * FROM points WHERE pid NOT IN (SELECT pid FROM same)),
waiting AS (SELECT *, row_number() OVER (PARTITION BY coin_id ORDER BY timestamp, nth) AS turn FROM bars WHERE bid NOT IN (SELECT bid FROM same)),
wanted AS (SELECT w.coin_id, w.turn, w.bid, coalesce(list(f.pid ORDER BY abs(f.timestamp - w.timestamp), f.timestamp, f.nth) FILTER (f.pid IS NOT NULL), []) AS pids
  FROM waiting w LEFT JOIN free f ON f.coin_id = w.coin_id AND abs(f.timestamp - w.timestamp) <= 1800000 GROUP BY ALL),
turns AS (
  SELECT DISTINCT coin_id, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS bid, CAST(NULL AS BIGINT) AS pid, CAST([] AS BIGINT[]) AS taken FROM waiting
  UNION ALL
  SELECT coin_id, turn, bid, pid, CASE WHEN pid IS NULL THEN taken ELSE list_append(taken, pid) END
  FROM (SELECT w.coin_id, w.turn, w.bid, list_filter(w.pids, lambda p: NOT list_contains(t.taken, p))[1] AS pid, t.taken FROM turns t JOIN wanted w ON w.coin_id = t.coin_id AND w.turn = t.turn + 1)),
pairs AS (SELECT pid, bid FROM same UNION ALL SELECT pid, bid FROM turns WHERE pid IS NOT NULL)
SELECT coalesce(b.coin_id, p.coin_id) AS coin_id, coalesce(b.timestamp, p.timestamp) AS timestamp, price, market_cap, volume, bar AS open, bar AS high, bar AS low, bar AS close
FROM points p LEFT JOIN pairs USING (pid) FULL JOIN bars b ON b.bid = pairs.bid"""


@query(NEAREST)
def history_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    chart = s.where("event_id % 2 = 0").select("coin_id", "timestamp", F.col("current_price").alias("price"), "market_cap", F.col("total_volume").alias("volume"))
    ohlc = s.where("event_id % 2 = 1").select("coin_id", "timestamp", *(F.col("current_price").alias(x) for x in ("open", "high", "low", "close")))
    return market.history_nearest(chart, ohlc)


# alerts

ALERT = f"""SELECT l_shipdate AS timestamp, CAST(epoch(l_shipdate) AS BIGINT) AS block_timestamp, {WORD.format('l_orderkey')} AS transaction_hash, contract_address, token_symbol,
  {ADDRESS.format('l_suppkey')} AS from_address, {ADDRESS.format('l_partkey')} AS to_address, round(amount, 4) AS amount, round(usd_value, 2) AS usd_value FROM priced"""


def _alerts(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    found = alerts.whale_alerts(fx.transfers(spark, sf_dir), alerts.known_tokens(spark), threshold)
    return found.withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "amount": F.round("amount", 4), "usd_value": F.round("usd_value", 2)})


@query(f"WITH {PRICED} {ALERT} WHERE usd_value >= 1000000 OR (token_symbol = 'UNKNOWN' AND amount > 1000000)")
def whale_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir, alerts.THRESHOLD_USD)


@query(f"WITH {PRICED} {ALERT} WHERE usd_value >= 200000000000 OR (token_symbol = 'UNKNOWN' AND amount > 200000000000)")
def whale_alerts_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir, 2e11)


@query(f"WITH {PRICED} SELECT l_orderkey, l_linenumber, l_extendedprice, token_symbol, round(amount, 4) AS amount, round(usd_value, 2) AS usd_value FROM priced")
def token_udfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts.register_token_functions(spark)
    adapted = _with_transfer_columns(fx.table(spark, sf_dir, "lineitem"))
    return adapted.selectExpr("l_orderkey", "l_linenumber", "l_extendedprice", "get_token_symbol(contract_address) AS token_symbol", "round(normalize_amount(contract_address, value), 4) AS amount", "round(calculate_usd_value(contract_address, normalize_amount(contract_address, value)), 2) AS usd_value")


def _with_transfer_columns(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr("l_orderkey", "l_linenumber", "l_extendedprice", f"{CONTRACT} AS contract_address", f"{VALUE.replace('VARCHAR', 'STRING')} AS value")


# table views


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.raw_blocks(fx.raw_typed(spark, sf_dir))


BLOCK_TABLE = table_sql("block", "good GROUP BY n", number="n", parent_hash=WORD.format("n - 1"), miner=ADDRESS.format("n"), difficulty="n * n * 1000000", base_fee_per_gas="CASE WHEN n % 2 = 0 THEN n END", transaction_count="count(*)", timestamp="788918400 + 86400 * n")


@query(f"WITH {DAYS} {BLOCK_TABLE}")
def blocks_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(entities.normalised("block", _blocks(spark, sf_dir).withColumn("hash", F.lit(None).cast("string"))))


def transactions_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return fx.table(spark, sf_dir, "orders").select(
        fx.wide_hash(key).alias("hash"), F.when(key % 3 != 0, F.round(F.col("o_totalprice") * 100).cast("long").cast("string")).alias("value"), F.when(key % 2 != 0, "x").alias("input"), F.col("o_custkey").alias("nonce"),
        fx.day_number("o_orderdate").alias("block_number"), F.when(key % 5 != 0, fx.address(F.col("o_custkey"))).alias("from_address"), (key % 7).cast("int").alias("transaction_index"), F.when(key % 4 == 0, F.array(F.lit("a"), F.col("o_orderstatus"))).alias("blob_versioned_hashes"), (key % 3).cast("int").alias("receipt_status"),
    )


DAY_NUMBER = "CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"


@query(
    table_sql(
        "transaction", "orders", hash=WORD.format("o_orderkey"), value="CASE WHEN o_orderkey % 3 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END", input="CASE WHEN o_orderkey % 2 <> 0 THEN 'x' END", nonce="o_custkey", block_number=DAY_NUMBER,
        from_address=f"CASE WHEN o_orderkey % 5 <> 0 THEN {ADDRESS.format('o_custkey')} END", transaction_index="o_orderkey % 7", blob_versioned_hashes="CASE WHEN o_orderkey % 4 = 0 THEN concat('a,', o_orderstatus) END", receipt_status="o_orderkey % 3",
    )
)
def transactions_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(entities.normalised("transaction", transactions_rows(spark, sf_dir)))


def receipts_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return fx.table(spark, sf_dir, "orders").select(
        fx.wide_hash(key).alias("transaction_hash"), F.when(key % 3 != 0, F.col("o_custkey")).alias("gas_used"), F.when(F.col("o_orderstatus") == "F", 1).alias("status"),
        fx.day_number("o_orderdate").alias("block_number"), F.when(key % 2 == 0, fx.address(key)).alias("contract_address"), (key * 3).alias("cumulative_gas_used"), F.when(key % 4 != 1, key % 11).alias("blob_gas_price"),
    )


@query(
    table_sql(
        "receipt", "orders", transaction_hash=WORD.format("o_orderkey"), gas_used="CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END", status="CASE WHEN o_orderstatus = 'F' THEN 1 END", block_number=DAY_NUMBER,
        contract_address=f"CASE WHEN o_orderkey % 2 = 0 THEN {ADDRESS.format('o_orderkey')} END", cumulative_gas_used="o_orderkey * 3", blob_gas_price="CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey % 11 END",
    )
)
def receipts_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(entities.normalised("receipt", receipts_rows(spark, sf_dir)))


@query(table_sql("token_transfer", "lineitem", transaction_hash=WORD.format("l_orderkey"), log_index="l_linenumber", value=VALUE, contract_address=CONTRACT, from_address=ADDRESS.format("l_suppkey"), to_address=ADDRESS.format("l_partkey"), block_timestamp="epoch(l_shipdate)"))
def token_transfers_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(entities.normalised("token_transfer", fx.transfers(spark, sf_dir)))


def contracts_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return fx.table(spark, sf_dir, "part").select(
        fx.address(key).alias("address"), F.when(key % 2 != 0, F.col("p_name")).alias("name"), key.alias("block_number"), F.when(key % 3 == 0, F.col("p_size")).alias("decimals"), F.when(key % 4 == 0, key % 8 == 0).alias("is_erc20"),
        F.array(F.lit("0x1"), F.col("p_brand")).alias("function_sighashes"), F.when(key % 5 == 0, 0.5).cast("float").alias("impl_classify_confidence"), F.when(key % 7 == 0, key.cast("string")).alias("total_supply"),
    )


@query(
    table_sql(
        "contract", "part", address=ADDRESS.format("p_partkey"), name="CASE WHEN p_partkey % 2 <> 0 THEN p_name END", block_number="p_partkey", decimals="CASE WHEN p_partkey % 3 = 0 THEN p_size END", is_erc20="CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 8 = 0 END",
        function_sighashes="concat('0x1,', p_brand)", impl_classify_confidence="CASE WHEN p_partkey % 5 = 0 THEN 0.5 END", total_supply="CASE WHEN p_partkey % 7 = 0 THEN p_partkey END",
    )
)
def contracts_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(entities.normalised("contract", contracts_rows(spark, sf_dir)))


def ticks_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = fx.ticks(spark, sf_dir).withColumns({"id": F.col("coin_id"), "ath_date": F.when(F.col("event_id") % 2 == 0, text).otherwise("not a date"), "atl_date": text, "last_updated": text, "image": F.lit("not in the table")})
    return rows.drop("max_supply", "total_supply").withColumn("high_24h", F.when(F.col("event_id") % 4 != 0, F.col("current_price") * 2))


@query(
    f"WITH {TICKS} "
    + table_sql(
        "tick", "ticks", id="coin_id", ath_date="CASE WHEN event_id % 2 = 0 THEN last_updated END", atl_date="last_updated", high_24h="CASE WHEN event_id % 4 <> 0 THEN current_price * 2 END",
        **{c: c for c in ("symbol", "eth_contract_address", "current_price", "market_cap", "market_cap_rank", "fully_diluted_valuation", "total_volume", "price_change_percentage_1h", "circulating_supply", "ath", "last_updated")},
    )
)
def ticks_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(entities.normalised("tick", ticks_rows(spark, sf_dir)))


def protocols_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return fx.table(spark, sf_dir, "part").select(F.col("p_name").alias("slug"), F.when(key % 2 != 0, F.col("p_type")).alias("category"), F.when(key % 3 != 0, F.col("p_retailprice")).alias("tvl"), F.lit("2024-01-01T00:00:00Z").alias("last_updated"), F.array(F.col("p_brand"), F.col("p_type")).alias("chains"), F.when(key % 5 == 0, F.col("p_size").cast("double")).alias("mcap"))


@query(table_sql("protocol", "part", slug="p_name", category="CASE WHEN p_partkey % 2 <> 0 THEN p_type END", tvl="CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END", last_updated="TIMESTAMP '2024-01-01'", chains="concat(p_brand, ',', p_type)", mcap="CASE WHEN p_partkey % 5 = 0 THEN p_size END"))
def protocols_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(entities.normalised("protocol", protocols_rows(spark, sf_dir)))


# raw responses


@query(
    f"""WITH {DAYS} SELECT n AS number, {WORD.format('n')} AS hash, {WORD.format('n - 1')} AS parent_hash, CAST(n * n * 1000000 AS VARCHAR) AS difficulty, {ADDRESS.format('n')} AS miner, 788918400 + 86400 * n AS timestamp,
  CASE WHEN n % 2 = 0 THEN n ELSE 0 END AS base_fee_per_gas, count(*) AS transaction_count, count(*) FILTER (o_orderstatus = 'F') AS withdrawal_count FROM good GROUP BY n"""
)
def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir)
    return rows.select("number", "hash", "parent_hash", "difficulty", "miner", "timestamp", "base_fee_per_gas", "transaction_count", F.size("withdrawals").cast("long").alias("withdrawal_count"))


@query(
    f"""WITH {DAYS} SELECT {WORD.format('o_orderkey')} AS hash, n AS block_number, 788918400 + 86400 * n AS block_timestamp, o_orderkey AS nonce, {ADDRESS.format('o_custkey')} AS from_address,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN {ADDRESS.format('o_custkey + 1')} END AS to_address, CAST(cents AS VARCHAR) AS value, 21000 AS gas FROM good"""
)
def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.raw_transactions(fx.raw_typed(spark, sf_dir))
    return rows.select("hash", "block_number", "block_timestamp", "nonce", "from_address", "to_address", "value", "gas")


RECEIPT_SQL = f"""WITH {DAYS} SELECT {WORD.format('o_orderkey')} AS transaction_hash, n AS block_number, {ADDRESS.format('o_custkey')} AS from_address, CASE WHEN o_orderpriority = '1-URGENT' THEN {ADDRESS.format('o_orderkey')} END AS contract_address,
  cents % 1000 AS gas_used, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS status FROM good"""


@query(RECEIPT_SQL)
def raw_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.raw_receipts(fx.raw_typed(spark, sf_dir))
    return rows.select("transaction_hash", "block_number", "from_address", "contract_address", "gas_used", "status")


LOG_SQL = f"WITH {DAYS} SELECT {WORD.format('o_orderkey')} AS transaction_hash, n AS block_number, 788918400 + 86400 * n AS block_timestamp, {ADDRESS.format('o_custkey')} AS address, '{transfers.TRANSFER}' AS topic0, CAST(0 AS INT) AS log_index FROM good"


@query(LOG_SQL, "raw_logs_typed")
@query(LOG_SQL)
def logs_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.logs(entities.raw_receipts(fx.raw_typed(spark, sf_dir)))
    return rows.select("transaction_hash", "block_number", "block_timestamp", "address", "topic0", "log_index")


WITHDRAWAL_SQL = f"""WITH {DAYS} SELECT n AS block_number, 788918400 + 86400 * n AS block_timestamp, {WORD.format('n')} AS block_hash, o_orderkey AS index, o_custkey AS validator_index, {ADDRESS.format('o_custkey')} AS address, CAST(cents AS VARCHAR) AS amount
  FROM good WHERE o_orderstatus = 'F'"""


@query(WITHDRAWAL_SQL, "raw_withdrawals")
@query(WITHDRAWAL_SQL)
def withdrawals_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.withdrawals(_blocks(spark, sf_dir))


@query(f"SELECT {WORD.format('l_orderkey')} AS transaction_hash, count(*) AS log_count, CAST(min(l_linenumber) AS BIGINT) AS first_index, CAST(max(l_linenumber) AS BIGINT) AS last_index FROM lineitem GROUP BY l_orderkey")
def receipts_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.nested_receipts(fx.logs(spark, sf_dir))
    return rows.select("transaction_hash", F.size("logs").cast("long").alias("log_count"), F.element_at("logs", 1)["log_index"].alias("first_index"), F.element_at("logs", -1)["log_index"].alias("last_index"))


@query(
    f"""SELECT {WORD.format('o_orderkey')} AS hash, cumulative AS receipt_cumulative_gas_used, price AS receipt_effective_gas_price, lines AS receipt_gas_used, blob_price AS receipt_blob_gas_price, blob_used AS receipt_blob_gas_used,
  CASE WHEN lines > 2 THEN {ADDRESS.format('l_orderkey')} END AS receipt_contract_address, status AS receipt_status, CASE WHEN l_orderkey % 2 = 0 THEN {WORD.format('blob_used')} END AS receipt_root
FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS cumulative, CAST(sum(l_partkey) AS BIGINT) AS price, count(*) AS lines, min(l_suppkey) AS blob_price, max(l_suppkey) AS blob_used, CAST(max(l_linenumber) AS BIGINT) AS status FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""
)
def tx_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, with receipts made of all their lines; an order without lines has no receipt."""
    transactions = fx.table(spark, sf_dir, "orders").select(fx.wide_hash(F.col("o_orderkey")).alias("hash"))
    key = F.col("l_orderkey")
    sums = fx.table(spark, sf_dir, "lineitem").groupBy(key).agg(F.sum("l_quantity").cast("long").alias("cumulative_gas_used"), F.sum("l_partkey").alias("effective_gas_price"), F.count("*").alias("gas_used"), F.min("l_suppkey").alias("blob_gas_price"), F.max("l_suppkey").alias("blob_gas_used"), F.max("l_linenumber").cast("long").alias("status"))
    receipts = sums.withColumns({"transaction_hash": F.upper(fx.wide_hash(key)), "contract_address": F.when(F.col("gas_used") > 2, fx.address(key)), "root": F.when(key % 2 == 0, fx.wide_hash(F.col("blob_gas_used")))})
    return entities.with_receipts(transactions, receipts)


@query(
    f"""WITH {DAYS}, b AS (SELECT DISTINCT n FROM good) SELECT {WORD.format('l_orderkey')} AS transaction_hash, CAST(l_linenumber AS BIGINT) AS log_index, n AS block_number, {WORD.format('n')} AS block_hash, 788918400 + 86400 * n AS block_timestamp
  FROM lineitem JOIN b ON n = date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))"""
)
def block_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.with_block(fx.logs(spark, sf_dir), _blocks(spark, sf_dir))
    return rows.select("transaction_hash", "log_index", "block_number", "block_hash", "block_timestamp")


# transfers

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
ZERO = f"'{hexnum.ZERO_ADDRESS}'"
FROM_SQL = f"CASE WHEN l_linenumber = 1 THEN {ZERO} ELSE {ADDRESS.format('l_suppkey')} END"
TO_SQL = f"CASE WHEN l_linenumber = 6 THEN {ZERO} ELSE {ADDRESS.format('l_partkey')} END"
TYPE_SQL = "CASE WHEN l_linenumber = 1 OR l_suppkey = 0 THEN 'MINT' WHEN l_linenumber = 6 OR l_partkey = 0 THEN 'BURN' ELSE 'TRANSFER' END"
TRANSFER_COLUMNS = ["transaction_hash", "log_index", "contract_address", "operator_address", "from_address", "to_address", "token_standard", "token_id", "value", "transfer_type", "erc1155_mode"]


def _transfer_sql(kind: int, standard: str, token_id: str, value: str, mode: str = "NULL", rest: str = "") -> str:
    operator = ADDRESS.format("l_orderkey") if mode != "NULL" else "CAST(NULL AS VARCHAR)"
    return f"""SELECT {WORD.format('l_orderkey')} AS transaction_hash, CAST(l_linenumber AS BIGINT) AS log_index, {ADDRESS.format('l_suppkey')} AS contract_address, {operator} AS operator_address, {FROM_SQL} AS from_address, {TO_SQL} AS to_address,
  '{standard}' AS token_standard, CAST({token_id} AS VARCHAR) AS token_id, CAST({value} AS VARCHAR) AS value, {TYPE_SQL} AS transfer_type, CAST({mode} AS VARCHAR) AS erc1155_mode FROM lineitem {rest} WHERE l_linenumber % 4 = {kind}"""


def _extracted(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    return transfers.extract(fx.logs(spark, sf_dir)).where(F.col("log_index") % 4 == kind).select(TRANSFER_COLUMNS)


@query(_transfer_sql(1, "ERC20", "NULL", CENTS))
def transfer_extract_erc20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, 1)


@query(_transfer_sql(2, "ERC721", "l_partkey", "NULL"))
def transfer_extract_erc721(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, 2)


@query(_transfer_sql(3, "ERC1155", "l_partkey", CENTS, "'SINGLE'"))
def transfer_extract_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, 3)


@query(_transfer_sql(0, "ERC1155", "l_partkey + i", f"{CENTS} + i", "'BATCH'", "CROSS JOIN (SELECT unnest([0, 1]) AS i)"))
def transfer_extract_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, 0)


@query(f"SELECT {TYPE_SQL} AS transfer_type, CAST(sum(CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def transfer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers.extract(fx.logs(spark, sf_dir)).groupBy("transfer_type").agg(F.count("*").alias("n"))


# contracts


def _classified(spark: SparkSession, sf_dir: str, **flags: bool) -> DataFrame:
    return contracts.classify(fx.contract_code(spark, sf_dir), fx.contract_slots(spark, sf_dir), **flags)


def _list_sql(values: list[str]) -> str:
    return "'" + ",".join(sorted(set(values))) + "'"


SELECTORS_SQL = "CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN {_list_sql(v)}" for k, v in fx.ARCHETYPES.items()) + " ELSE '' END"


@query(f"SELECT {ADDRESS.format('p_partkey')} AS address, {SELECTORS_SQL} AS selectors FROM part")
def selectors_from_bytecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.contract_code(spark, sf_dir).select("address", F.array_join(bytecode.selectors(F.col("bytecode")), ",").alias("selectors"))


@query(f"SELECT {ADDRESS.format('p_partkey')} AS address, p_partkey % 12 = 6 AS is_erc20, p_partkey % 12 = 7 AS is_erc721, p_partkey % 12 = 8 AS is_erc1155, p_partkey % 12 IN (7, 8) AS supports_erc165 FROM part")
def contract_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("address", "is_erc20", "is_erc721", "is_erc1155", "supports_erc165")


@query(
    f"""SELECT {ADDRESS.format('p_partkey')} AS address, CASE p_partkey % 12 WHEN 6 THEN 'TOKEN' WHEN 7 THEN 'NFT' WHEN 8 THEN 'MULTI_TOKEN' ELSE 'UNKNOWN' END AS impl_category,
  CASE p_partkey % 12 WHEN 6 THEN 'direct:erc20' WHEN 7 THEN 'direct:erc721' WHEN 8 THEN 'direct:erc1155' ELSE '' END AS detected_by, CAST(CASE WHEN p_partkey % 12 BETWEEN 6 AND 8 THEN 1 ELSE 0 END AS DOUBLE) AS confidence FROM part"""
)
def contract_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("address", "impl_category", F.array_join("impl_detected_by", ",").alias("detected_by"), F.col("impl_classify_confidence").cast("double").alias("confidence"))


@query(
    f"""SELECT {ADDRESS.format('p_partkey')} AS address, CASE p_partkey % 12 WHEN 6 THEN 'TOKEN' WHEN 7 THEN 'NFT' WHEN 8 THEN 'MULTI_TOKEN' WHEN 9 THEN 'FACTORY' WHEN 10 THEN 'VAULT' ELSE 'UNKNOWN' END AS impl_category FROM part"""
)
def contract_category_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, direct_heuristics=True).select("address", "impl_category")


@query(
    f"""SELECT {ADDRESS.format('p_partkey')} AS address, CASE p_partkey % 12 WHEN 1 THEN 'MINIMAL' WHEN 2 THEN 'TRANSPARENT' WHEN 3 THEN 'BEACON' WHEN 4 THEN 'GNOSIS_SAFE' WHEN 5 THEN 'DIAMOND' END AS proxy_type,
  CASE p_partkey % 12 WHEN 1 THEN {ADDRESS.format('p_partkey + 5')} WHEN 2 THEN {ADDRESS.format('p_partkey + 5')} WHEN 3 THEN {ADDRESS.format('p_partkey + 6')} WHEN 4 THEN '{contracts.MASTER_COPIES[1][0]}' END AS implementation_address FROM part"""
)
def slot_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("address", "proxy_type", "implementation_address")


@query(
    f"""WITH p AS (SELECT p_partkey, p_partkey % 12 AS k, CASE p_partkey % 12 WHEN 1 THEN p_partkey + 5 WHEN 2 THEN p_partkey + 5 WHEN 3 THEN p_partkey + 6 END AS t FROM part),
e AS (SELECT p.p_partkey, CASE WHEN p.t IS NULL THEN p.k ELSE q.k END AS kind, q.k AS behind FROM p LEFT JOIN p q ON p.t = q.p_partkey)
SELECT {ADDRESS.format('p_partkey')} AS address, CASE kind WHEN 6 THEN 'TOKEN' WHEN 7 THEN 'NFT' WHEN 8 THEN 'MULTI_TOKEN' ELSE CASE WHEN behind = 9 THEN 'FACTORY' ELSE 'UNKNOWN' END END AS impl_category,
  coalesce(kind = 6, false) AS is_erc20, coalesce(kind = 7, false) AS is_erc721 FROM e"""
)
def proxy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.resolve_proxies(_classified(spark, sf_dir)).select("address", "impl_category", "is_erc20", "is_erc721")


@query(
    f"""SELECT {ADDRESS.format('p_partkey')} AS address, p_name AS name, p_brand AS symbol, CAST(CASE WHEN p_partkey % 12 = 6 THEN p_size ELSE 0 END AS INT) AS decimals,
  CASE WHEN p_partkey % 12 = 6 THEN CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) END AS total_supply FROM part WHERE p_partkey % 12 BETWEEN 6 AND 8"""
)
def token_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.token_metadata(_classified(spark, sf_dir), fx.contract_calls(spark, sf_dir))


@query(f"SELECT DISTINCT {ADDRESS.format('l_suppkey')} AS address FROM lineitem WHERE l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) UNION SELECT {ADDRESS.format('o_orderkey')} FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)")
def unseen_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = fx.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", fx.address(F.col("o_orderkey"))).alias("contract_address"))
    known = fx.contract_code(spark, sf_dir).where("block_number % 2 = 0")
    return entities.unseen(entities.touched_contracts(created, fx.logs(spark, sf_dir)), known)


@query(
    f"""WITH {DAYS}, made AS (SELECT {ADDRESS.format('o_orderkey % 500')} AS address, n, {WORD.format('o_orderkey')} AS hash, {ADDRESS.format('o_custkey')} AS sender FROM days WHERE o_orderpriority = '1-URGENT')
SELECT m.address, m.sender AS creator_address, m.hash AS creation_hash, m.n AS creation_block FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY n, hash) AS r FROM made) m WHERE r = 1 AND m.address IN (SELECT {ADDRESS.format('p_partkey')} FROM part)"""
)
def creator_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.col("o_orderpriority") == "1-URGENT"
    made = fx.table(spark, sf_dir, "orders").select(
        fx.wide_hash(F.col("o_orderkey")).alias("hash"), fx.day_number("o_orderdate").alias("block_number"), F.lit(0).alias("transaction_index"), F.when(~urgent, "0x1").alias("to_address"),
        fx.address(F.col("o_custkey")).alias("from_address"), F.when(urgent, fx.address(F.col("o_orderkey") % 500)).alias("receipt_contract_address"),
    )
    return entities.creators(fx.contract_code(spark, sf_dir), made)


# blocks


@query(f"WITH {DAYS} SELECT DATE '1995-01-01' + CAST(n AS INT) AS date, min(n) AS first_block, max(n) AS last_block FROM good GROUP BY n")
def block_range_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.ranges_by_date(_blocks(spark, sf_dir))


@query(f"WITH {DAYS} SELECT n AS block_number, count(*) AS transaction_count FROM good GROUP BY n")
def tx_count_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.transaction_counts(entities.raw_transactions(fx.raw_typed(spark, sf_dir)))


@query(f"WITH {DAYS} SELECT DISTINCT n AS number FROM good WHERE n > 100 AND n <= least((SELECT max(n) FROM good) - 12, 100 + 500)")
def incremental_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.next_blocks(_blocks(spark, sf_dir), 100, 12, 500).select("number")


# oracle


@query(
    """SELECT concat('P', s_suppkey) AS pair, round(CAST(round(s_acctbal * 100) AS BIGINT) / power(10.0, s_suppkey % 9), 6) AS price, 1700000000 + 2 * s_suppkey AS updated_at FROM supplier WHERE s_suppkey % 5 <> 0"""
)
def oracle_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    cents = F.round(F.col("s_acctbal") * 100).cast("long")
    word = lambda x: F.when(x < 0, F.concat(F.lit("f" * 48), F.right(F.lower(F.hex(x)), F.lit(16)))).otherwise(fx.hex_word(x))
    rows = fx.table(spark, sf_dir, "supplier").select(key, F.explode(F.array(F.lit(1), F.lit(2))).alias("round"), cents.alias("cents"))
    result = F.concat(F.lit("0x"), fx.hex_word(F.col("round")), word(F.when(F.col("round") == 2, F.col("cents")).otherwise(F.lit(1).cast("long"))), fx.hex_word(F.lit(7)), fx.hex_word(1700000000 + F.col("round") * key), fx.hex_word(F.col("round")))
    results = rows.select(F.upper(fx.address(key)).alias("contract_address"), F.when(key % 5 != 0, result).otherwise("0x").alias("result"), (key % 9).cast("int").alias("decimals"))
    feeds = fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), key).alias("pair"), fx.address(key).alias("contract_address"))
    pairs = fx.table(spark, sf_dir, "supplier").select(F.explode(F.array(F.concat(F.lit("P"), key), F.concat(F.lit("none"), key))).alias("pair"))
    return rounded(oracle.latest_prices(pairs, feeds, results).drop("contract_address"), "price")


@query("SELECT p_name AS pair, max(CASE WHEN p_partkey % 2 = 0 THEN concat('1:', p_partkey) ELSE concat('0:', p_partkey) END) AS contract_address FROM part GROUP BY p_name")
def feed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    pick = lambda odd: part.where(F.col("p_partkey") % 2 == odd).select(F.col("p_name").alias("pair"), F.concat(F.lit(f"{1 - odd}:"), "p_partkey").alias("contract_address"))
    return oracle.merge_feeds(pick(1), pick(0))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('0x', lpad(lower(to_hex(page_id)), 40, '0')) ELSE nullif(regexp_extract(html, '0x[a-fA-F0-9]{40}', 0), '') END AS contract_address FROM pages")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<a>"), fx.address(F.col("page_id")), F.lit("</a>"), "html")).otherwise(F.col("html")))
    return oracle.page_addresses(pages).select("page_id", "contract_address")


# functions


@query(
    f"""SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey AS dec, CAST({CENTS} * {CENTS} AS VARCHAR) AS wide, {ADDRESS.format('l_suppkey')} AS address, CASE WHEN l_suppkey = 0 THEN NULL ELSE {ADDRESS.format('l_suppkey')} END AS slot_address,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS number, CAST(3 AS INT) AS n_words FROM lineitem"""
)
def hex_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        hexnum.hex_to_dec(F.concat(F.lit("0x"), F.hex("l_partkey"))).alias("dec"),
        hexnum.u256_decimal(fx.wide_hash(cents * cents)).alias("wide"),
        hexnum.topic_address(F.upper(fx.wide_hash(F.col("l_suppkey")))).alias("address"),
        hexnum.word_address(fx.wide_hash(F.col("l_suppkey"))).alias("slot_address"),
        hexnum.to_double(F.when(F.col("l_linenumber") == 7, "seven").otherwise(F.col("l_linenumber").cast("string"))).alias("number"),
        F.size(hexnum.words(F.concat(F.lit("0x"), fx.hex_word(F.col("l_orderkey"), 180)))).alias("n_words"),
    )


@query(
    f"""SELECT {ADDRESS.format('p_partkey')} AS address, CASE WHEN p_partkey % 12 = 1 THEN {ADDRESS.format('p_partkey + 5')} END AS minimal, p_partkey % 12 <> 0 AS has_code, p_partkey % 12 = 6 AS all_erc20, p_partkey % 12 IN (7, 8) AS any_165,
  CASE WHEN p_partkey % 12 = 0 THEN sha256('0x') END AS empty_hash FROM part"""
)
def code_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("bytecode")
    have = bytecode.selectors(code)
    return fx.contract_code(spark, sf_dir).select("address", bytecode.minimal_proxy_target(code).alias("minimal"), bytecode.clean(code).isNotNull().alias("has_code"), bytecode.has_all(have, contracts.ERC20).alias("all_erc20"), bytecode.has_any(have, contracts.ERC165).alias("any_165"), F.when(bytecode.clean(code).isNull(), bytecode.fingerprint(code)).alias("empty_hash"))


@query(
    f"""WITH {TICKS} SELECT event_id, CAST(last_updated AS DATE) AS day, date_trunc('hour', last_updated) AS hour, strftime(last_updated, '%Y%m') AS month, concat(strftime(last_updated, '%Y%m%d'), '_', coin_id) AS doc_id,
  event_id // 1000 AS bucket, last_updated - INTERVAL 7 DAY AS week_before, coalesce(price_change_percentage_1h, 0) AS change_or_zero, least(abs(coalesce(price_change_percentage_1h, 0)), 5) AS bounded FROM ticks"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ticks(spark, sf_dir).selectExpr("event_id", "to_date(last_updated) AS day", "date_trunc('hour', last_updated) AS hour", "date_format(last_updated, 'yyyyMM') AS month", "concat_ws('_', date_format(last_updated, 'yyyyMMdd'), coin_id) AS doc_id", "event_id div 1000 AS bucket", "last_updated - INTERVAL 7 DAYS AS week_before", "coalesce(price_change_percentage_1h, 0D) AS change_or_zero", "least(abs(coalesce(price_change_percentage_1h, 0D)), 5D) AS bounded")


# writing and reading back


@query(f"WITH {TICKS}, {HOURLY} SELECT concat(coin_id, '_', strftime(hour, '%Y-%m-%d %H:%M:%S')) AS doc_id, coin_id, hour FROM hourly")
def metric_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.metric_documents(market.hourly_ohlc(fx.ticks(spark, sf_dir)), "hourly").select("doc_id", "coin_id", "hour")


@query(f"WITH {PRICED} {ALERT} WHERE usd_value >= 1000000 OR (token_symbol = 'UNKNOWN' AND amount > 1000000)")
def alert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts through a JSON sink and back, whole."""
    path, found = scratch(spark), _alerts(spark, sf_dir, alerts.THRESHOLD_USD)
    sinks.write_json(found, f"{path}/alerts")
    return spark.read.schema(found.schema).json(f"{path}/alerts")


@query(f"WITH {TICKS} SELECT event_id, CASE WHEN CAST(last_updated AS DATE) = DATE '2024-01-10' THEN current_price * 2 ELSE current_price END AS current_price FROM ticks")
def replace_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by date of which one date is written again, twice."""
    path = f"{scratch(spark)}/ticks"
    rows = fx.ticks(spark, sf_dir).select("event_id", "current_price", F.to_date("last_updated").alias("date"))
    tables.replace_slices(rows, path, "date")
    for _ in range(2):
        tables.replace_slices(rows.where("date = '2024-01-10'").withColumn("current_price", F.col("current_price") * 2), path, "date")
    return spark.read.parquet(path).select("event_id", "current_price")


def _database(spark: SparkSession) -> str:
    """A new database in a file that the executors reach; embedded Derby would be open to one process alone."""
    path = scratch(spark).removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return f"jdbc:sqlite:{path}/ticks.db"


@query(f"WITH {TICKS} SELECT coin_id, count(*) AS n, round(sum(current_price), 4) AS price FROM ticks WHERE CAST(last_updated AS DATE) = DATE '2024-01-10' GROUP BY coin_id")
def jdbc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks appended to a database, one date read back through its own query."""
    url = _database(spark)
    rows = fx.ticks(spark, sf_dir).select("coin_id", "current_price", F.date_format("last_updated", "yyyy-MM-dd").alias("day"))
    sinks.jdbc_append(rows, url, "ticks")
    back = readers.jdbc_slice(spark, url, "SELECT \"coin_id\", \"current_price\" FROM ticks WHERE \"day\" = '2024-01-10'", customSchema="coin_id string, current_price double")
    return back.groupBy("coin_id").agg(F.count("*").alias("n"), F.round(F.sum("current_price"), 4).alias("price"))


def _weeks(rows: DataFrame, time: str) -> list[DataFrame]:
    """rows by week; a table has 53 weeks a year at most."""
    keyed = rows.withColumn("week", F.date_trunc("week", time))
    weeks = [r["week"] for r in keyed.select("week").distinct().orderBy("week").collect()]
    return [keyed.where(F.col("week") == F.lit(w)).drop("week") for w in weeks]


@query(f"WITH {TICKS} SELECT coin_id, max(last_updated) AS last_updated, arg_max(current_price, last_updated) AS current_price FROM ticks GROUP BY coin_id")
def doc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks upserted by coin, a version for each week; what older states alone consisted of is dropped."""
    path = f"{scratch(spark)}/docs"
    for version, week in enumerate(_weeks(fx.ticks(spark, sf_dir).select("coin_id", "last_updated", "current_price"), "last_updated"), 1):
        tables.upsert(market.latest_ticks(week), path, ["coin_id"], version)
    tables.compact(spark, path)
    return tables.read_upserted(spark, path)


@query("SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events merged by user week by week, the newest week first, so that older versions come late and must not win."""
    path = f"{scratch(spark)}/users"
    weeks = _weeks(fx.table(spark, sf_dir, "events").select("user_id", "ts", "value", "event_id", "event_type"), "ts")
    for version, week in reversed(list(enumerate(weeks))):
        tables.upsert(market.latest_ticks(week, "user_id", "ts"), path, ["user_id"], version)
    return tables.read_upserted(spark, path).select("user_id", "ts", "value", "event_id", "event_type")


@query(ORACLES["volume_baseline_7d"])
def kept_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of seven days from hourly sums that are kept as a table."""
    path = f"{scratch(spark)}/volumes"
    jobs.fill_partials(fx.ticks(spark, sf_dir), path)
    return rounded(market.baseline_of_partials(jobs.read_partials(spark, path), datetime(2024, 1, 20, 12)), "avg_volume_7d")


@query(rounded_sql(f"{TICKS}, {HOURLY}, {ROLLING}, {SCORES}", "(SELECT * FROM scored WHERE hour = (SELECT max(hour) FROM scored))", *RATIOS))
def hourly_job_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job of the newest hour: its ticks, and the kept sums of the hours before."""
    path, ticks = scratch(spark), fx.ticks(spark, sf_dir)
    newest = ticks.agg(F.date_trunc("hour", F.max("last_updated")).alias("hour")).first()["hour"]
    jobs.fill_partials(ticks.where(F.col("last_updated") < F.lit(newest)), f"{path}/volumes")
    jobs.hourly_job(ticks, f"{newest:%Y-%m-%d %H}", f"{path}/scores", newest, f"{path}/volumes")
    return rounded(spark.read.parquet(f"{path}/scores").withColumn("hour", F.col("hour").cast("timestamp_ntz")).drop("calculated_at"), *RATIOS)


@query(f"WITH {TICKS} SELECT coin_id, count(*) AS n, round(sum(current_price), 4) AS price FROM ticks GROUP BY coin_id")
def jdbc_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks appended to a database by day as batches, each of them twice; every tick is there once."""
    url = _database(spark)
    rows = fx.ticks(spark, sf_dir).select("event_id", "coin_id", "current_price", (F.dayofmonth("last_updated") % 3).alias("third"))
    for _ in range(2):
        for third in range(3):
            sinks.jdbc_append_once(rows.where(F.col("third") == third).drop("third"), url, "ticks_once", f"third-{third}")
    back = readers.jdbc_slice(spark, url, 'SELECT "coin_id", count(*) AS "n", sum("current_price") AS "price" FROM ticks_once GROUP BY "coin_id"', customSchema="coin_id string, n long, price double")
    return back.select("coin_id", "n", F.round("price", 4).alias("price"))


@query(f"WITH {TICKS}, {DAILY} SELECT concat(strftime(date, '%Y%m%d'), '_', coin_id) AS doc_id, close_price, eth_contract_address FROM metrics WHERE date = DATE '2024-01-10' AND eth_contract_address IN (SELECT min(eth_contract_address) FROM metrics m WHERE m.date = DATE '2024-01-10' GROUP BY coin_id)")
def doc_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics written, one date of them synced as documents."""
    path = scratch(spark)
    first = market.daily_metrics(fx.ticks(spark, sf_dir), "2024-01-10")
    one = first.groupBy("date", "coin_id").agg(F.min(F.struct("eth_contract_address", "close_price")).alias("r")).select("date", "coin_id", "r.*")
    tables.replace_slices(one, f"{path}/daily", "date")
    jobs.sync_documents(spark, f"{path}/daily", "daily", "2024-01-10", f"{path}/docs", 1)
    return tables.read_upserted(spark, f"{path}/docs").select("doc_id", "close_price", "eth_contract_address")


@query("""SELECT concat('chain.', t, 's.v0') AS topic, CAST(o_orderkey AS VARCHAR) AS key, concat('{"type":"', t, '","o_orderkey":', o_orderkey, '}') AS value FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'transaction' WHEN 2 THEN 'odd' END AS t FROM orders) WHERE t IN ('block', 'transaction')""")
def topic_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    rows = fx.table(spark, sf_dir, "orders").select(F.when(kind == 0, "block").when(kind == 1, "transaction").when(kind == 2, "odd").alias("type"), "o_orderkey")
    path = f"{scratch(spark)}/topics"
    sinks.routed(rows, "chain.", key="o_orderkey").write.partitionBy("topic").parquet(path)
    return spark.read.parquet(path).select("topic", "key", "value")


@query("SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def sink_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "block").otherwise("odd").alias("type"))
    sinks.fan_out(rows, [lambda r: r.select("o_orderkey").write.parquet(f"{path}/a"), lambda r: sinks.only(r, ["block"]).select("o_orderkey").write.parquet(f"{path}/b")])
    return spark.read.parquet(f"{path}/a", f"{path}/b")


@query(f"WITH {DAYS} SELECT n AS number, strftime(DATE '1995-01-01' + CAST(n AS INT), '%Y%m') AS part, {WORD.format('n')} AS hash FROM (SELECT DISTINCT n FROM good)")
def table_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/blocks"
    tables.write_table("blocks", entities.normalised("block", _blocks(spark, sf_dir)), path)
    return spark.read.parquet(path).select("number", F.col(tables.PART).cast("string").alias("part"), "hash")
