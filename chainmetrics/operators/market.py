"""Market metrics over price ticks: hourly, daily, sliding windows, bands, price history, the coin universe.

Ticks have coin_id, symbol, current_price, total_volume, market_cap, last_updated (event time) and the other columns
that a function names. Ties of event time within a coin are broken by nothing: give unique times, or drop duplicates first.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_hour(text: str) -> datetime:
    """`yyyy-MM-dd HH` with optional `:mm:ss`; anything else, a bare date too, is an error."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}[ T]\d{2}(:\d{2}){0,2}", text):
        raise ValueError(f"not an hour: {text!r}")
    return datetime.fromisoformat(text.replace("T", " ")[:13] + ":00:00")


def _ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise))


# hourly


def hourly_ohlc(ticks: DataFrame) -> DataFrame:
    """One row a coin and hour. min_by and max_by combine before the shuffle, so a hot coin stays cheap."""
    return ticks.groupBy("coin_id", F.date_trunc("hour", "last_updated").alias("hour")).agg(
        F.min("symbol").alias("symbol"),
        F.min_by("current_price", "last_updated").alias("open_price"),
        F.max("current_price").alias("high_price"),
        F.min("current_price").alias("low_price"),
        F.max_by("current_price", "last_updated").alias("close_price"),
        F.max("total_volume").alias("current_volume"),
        F.count("*").alias("tick_count"),
    )


def volume_baseline(ticks: DataFrame, hour: datetime, days: int = 7) -> DataFrame:
    """Mean volume a coin over the `days` before `hour`, that hour itself left out."""
    time = F.col("last_updated")
    return ticks.where((time >= F.lit(hour - timedelta(days=days)).cast("timestamp_ntz")) & (time < F.lit(hour).cast("timestamp_ntz"))).groupBy("coin_id").agg(F.avg("total_volume").alias("avg_volume_7d"))


def rolling_baseline(ticks: DataFrame, days: int = 7) -> DataFrame:
    """coin_id, hour, avg_volume_7d for every hour that has ticks: ticks are summed by hour, then a range window runs over hours."""
    hourly = ticks.groupBy("coin_id", F.date_trunc("hour", "last_updated").alias("hour")).agg(F.sum("total_volume").alias("s"), F.count("total_volume").alias("n"))
    seconds = F.unix_timestamp(F.col("hour").cast("timestamp"))
    before = Window.partitionBy("coin_id").orderBy("at").rangeBetween(-days * 86400, -1)
    return hourly.withColumn("at", seconds).select("coin_id", "hour", (F.sum("s").over(before) / F.sum("n").over(before)).alias("avg_volume_7d"))


def volume_partials(ticks: DataFrame) -> DataFrame:
    """hour, coin_id, volume_sum, volume_count: what the baselines of later hours need of an hour's ticks."""
    hour = F.date_trunc("hour", "last_updated").alias("hour")
    return ticks.groupBy(hour, "coin_id").agg(F.sum("total_volume").alias("volume_sum"), F.count("total_volume").alias("volume_count"))


def baseline_of_partials(partials: DataFrame, hour: datetime, days: int = 7) -> DataFrame:
    """volume_baseline() from volume_partials() rows. The range of hours reaches the scan, so that slices by hour outside it are not read."""
    at = F.col("hour")
    span = partials.where((at >= F.lit(hour - timedelta(days=days)).cast("timestamp_ntz")) & (at < F.lit(hour).cast("timestamp_ntz")))
    return span.groupBy("coin_id").agg((F.sum("volume_sum") / F.sum("volume_count")).alias("avg_volume_7d"))


def trending_scores(hourly: DataFrame, baseline: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The hourly metric rows, scored 0 to 100; a coin without a baseline has 0 and so a spike of 1."""
    both = hourly.join(baseline, keys or ["coin_id"], "left").fillna({"avg_volume_7d": 0.0})
    rows = both.withColumns(
        {
            "volatility": _ratio(F.col("high_price") - F.col("low_price"), F.col("low_price")),
            "momentum": _ratio(F.col("close_price") - F.col("open_price"), F.col("open_price")),
            "volume_spike_ratio": _ratio(F.col("current_volume"), F.col("avg_volume_7d"), 1.0),
        }
    )
    ten = F.lit(10.0)
    score = 3 * F.least(100 * F.col("volatility"), ten) + 2 * F.least(100 * F.abs("momentum"), ten) + 5 * F.least(2 * F.col("volume_spike_ratio"), ten)
    return rows.select("hour", "coin_id", "symbol", F.col("current_volume").alias("volume_avg"), "volatility", "momentum", "volume_spike_ratio", score.alias("trending_score"), F.lit("batch").alias("data_source"))


def top_trending(scores: DataFrame, n: int = 5) -> DataFrame:
    """The n best coins of the newest hour."""
    newest = scores.agg(F.max("hour").alias("hour"))
    return scores.join(F.broadcast(newest), "hour").orderBy(F.desc("trending_score"), "coin_id").limit(n)  # one row is broadcast


# daily


def daily_open_close(ticks: DataFrame) -> DataFrame:
    """Ticks with the first and last price of their coin and day."""
    day = Window.partitionBy("coin_id", F.to_date("last_updated")).orderBy("last_updated").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ticks.withColumns({"open_price": F.first("current_price").over(day), "close_price": F.last("current_price").over(day)})


def daily_metrics(ticks: DataFrame, date: str | None = None) -> DataFrame:
    """One row a day, coin, symbol and contract; of one date only if given.

    Opening and closing prices are of the coin; the other last values are of the group's last tick. Coins are few per
    day, so prices go along as aggregates of the coin's groups, joined on the day and coin.
    """
    if date is not None:
        start = datetime.fromisoformat(date)
        ticks = ticks.where((F.col("last_updated") >= F.lit(start).cast("timestamp_ntz")) & (F.col("last_updated") < F.lit(start + timedelta(days=1)).cast("timestamp_ntz")))
    ticks = ticks.withColumn("date", F.to_date("last_updated"))
    time = F.col("last_updated")
    groups = ticks.groupBy("date", "coin_id", "symbol", "eth_contract_address").agg(
        F.min(F.struct(time.alias("t"), F.col("current_price").alias("p"))).alias("first"),
        F.max(F.struct(time.alias("t"), F.col("current_price").alias("p"))).alias("last"),
        F.max("current_price").alias("high_price"),
        F.min("current_price").alias("low_price"),
        F.max("total_volume").alias("volume_24h"),
        F.avg("market_cap").alias("market_cap"),
        F.max_by("market_cap_rank", time).alias("market_cap_rank"),
        F.max_by("fully_diluted_valuation", time).alias("fully_diluted_valuation"),
        F.max("ath").alias("ath"),
        F.max("max_supply").alias("max_supply"),
        F.max("total_supply").alias("total_supply"),
        F.avg("circulating_supply").alias("circulating_supply"),
    )
    coin = Window.partitionBy("date", "coin_id")
    rows = groups.withColumns({"open_price": F.min("first").over(coin)["p"], "close_price": F.max("last").over(coin)["p"]})
    change = F.col("close_price") - F.col("open_price")
    fdv = F.col("fully_diluted_valuation")
    return rows.select(
        "date",
        "coin_id",
        "symbol",
        "eth_contract_address",
        "open_price",
        "high_price",
        "low_price",
        "close_price",
        "volume_24h",
        "market_cap",
        "market_cap_rank",
        F.lit(0.0).alias("volume_change_24h"),
        F.when((fdv > 0) & (F.col("market_cap") > 0), F.col("market_cap") / fdv).alias("fdv_ratio"),
        _ratio(F.col("volume_24h"), F.col("market_cap")).alias("volume_to_market_cap_ratio"),
        change.alias("price_change_24h"),
        _ratio(100 * change, F.col("open_price")).alias("price_change_percentage_24h"),
        _ratio(100 * (F.col("close_price") - F.col("ath")), F.col("ath")).alias("drawdown_from_ath"),
        "circulating_supply",
        F.lit("batch").alias("data_source"),
    )


def bands(daily: DataFrame) -> DataFrame:
    """Capitalisation tier, liquidity band, suspicion of wash trading, and the gain that makes a drawdown good."""
    cap, ratio, fall = F.col("market_cap"), F.col("volume_to_market_cap_ratio"), F.col("drawdown_from_ath")
    tier = F.when(cap > 10e9, "large").when(cap >= 1e9, "mid").otherwise("small")
    return daily.withColumns(
        {
            "cap_tier": tier,
            "liquidity": F.when(ratio > 0.1, "high").when(ratio < 0.01, "low").otherwise("normal"),
            "suspicious": (tier == "small") & (ratio > 1.0),
            "recovery_gain": F.when(fall > -100, -fall / (100 + fall) * 100),
        }
    )


def valuations(prices: DataFrame) -> DataFrame:
    """price, max_supply, circulating_supply: with fdv and market_cap as their products."""
    return prices.withColumns({"fdv": F.col("price") * F.col("max_supply"), "market_cap": F.col("price") * F.col("circulating_supply")})


# sliding windows; also the body of the streaming job


def sliding_metrics(ticks: DataFrame, time: str = "timestamp", size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Aggregates and metrics of every coin's sliding windows; time must be a timestamp column.

    Batch rows are summed up once, to panes of one slide, and windows are put together of panes: a tick is one row and
    a pane one row of a shuffle. A stream's windows are Spark's own, which keep their state.
    """
    return _window_metrics(_streamed_windows(ticks, time, size, slide) if ticks.isStreaming else _paned_windows(ticks, time, size, slide))


def _streamed_windows(ticks: DataFrame, time: str, size: str, slide: str) -> DataFrame:
    return ticks.groupBy(F.window(time, size, slide), "coin_id", "symbol").agg(
        F.min_by("current_price", time).alias("open_price"),
        F.max_by("current_price", time).alias("close_price"),
        F.max("current_price").alias("high_price"),
        F.min("current_price").alias("low_price"),
        F.avg("current_price").alias("avg_price"),
        F.stddev_samp("current_price").alias("stddev_price"),
        F.avg("total_volume").alias("volume_avg"),
        F.max_by("price_change_percentage_1h", time).alias("price_change_1h"),
        F.count("*").alias("tick_count"),
    )


def _micros(span: str) -> int:
    """Microseconds of a span such as `5 minutes`."""
    number, unit = span.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def _paned_windows(ticks: DataFrame, time: str, size: str, slide: str) -> DataFrame:
    """The windows of _streamed_windows from panes: counts, sums, extremes and moments that can be merged."""
    width, step = _micros(size), _micros(slide)
    if width % step:
        return _streamed_windows(ticks, time, size, slide)
    many = width // step
    pane = F.expr(f"floor(unix_micros(`{time}`) / {step})").cast("long").alias("pane")
    rows = ticks.where(F.col(time).isNotNull()).groupBy("coin_id", "symbol", pane).agg(
        F.min_by("current_price", time).alias("open"),
        F.max_by("current_price", time).alias("close"),
        F.max_by("price_change_percentage_1h", time).alias("change"),
        F.max("current_price").alias("high"),
        F.min("current_price").alias("low"),
        F.count("current_price").alias("n"),
        F.avg("current_price").alias("mean"),
        (F.var_pop("current_price") * F.count("current_price")).alias("spread"),
        F.sum("total_volume").alias("volume"),
        F.count("total_volume").alias("volumes"),
        F.count("*").alias("ticks"),
    )
    parts = [c for c in rows.columns if c not in ("coin_id", "symbol")]
    by_time = Window.partitionBy("coin_id", "symbol").orderBy("pane")
    ahead = [F.struct(*parts), *(F.lead(F.struct(*parts), k).over(by_time) for k in range(1, many))]
    rows = rows.select("coin_id", "symbol", "pane", F.array(*ahead).alias("panes"), F.lag("pane").over(by_time).alias("before"))
    # a window that starts in a pane without ticks belongs to the next pane that has some
    starts = F.sequence(F.greatest(F.col("pane") - (many - 1), F.coalesce(F.col("before") + 1, F.col("pane") - (many - 1))), F.col("pane"))
    rows = rows.select("coin_id", "symbol", F.explode(starts).alias("start"), "panes")
    inside = F.filter("panes", lambda p: p.isNotNull() & (p["pane"] < F.col("start") + many))
    rows = rows.select("coin_id", "symbol", "start", inside.alias("panes"))
    column = lambda name: F.transform("panes", lambda p: p[name])
    total = lambda name, kind: F.aggregate(column(name), F.lit(0).cast(kind), lambda a, x: a + F.coalesce(x, F.lit(0).cast(kind)))
    mean = F.aggregate("panes", F.lit(0.0), lambda a, p: a + F.coalesce(p["mean"] * p["n"], F.lit(0.0))) / F.nullif(total("n", "long"), F.lit(0))
    rows = rows.withColumns({"n": total("n", "long"), "avg_price": mean})
    # Chan's rule: the squares within panes, and those of the panes' means around the window's
    squares = F.aggregate("panes", F.lit(0.0), lambda a, p: a + F.coalesce(p["spread"] + p["n"] * (p["mean"] - F.col("avg_price")) * (p["mean"] - F.col("avg_price")), F.lit(0.0)))
    micros = F.col("start") * step
    return rows.select(
        F.struct(F.timestamp_micros(micros).alias("start"), F.timestamp_micros(micros + width).alias("end")).alias("window"),
        "coin_id",
        "symbol",
        F.element_at("panes", 1)["open"].alias("open_price"),
        F.element_at("panes", -1)["close"].alias("close_price"),
        F.array_max(column("high")).alias("high_price"),
        F.array_min(column("low")).alias("low_price"),
        "avg_price",
        F.when(F.col("n") > 1, F.sqrt(squares / (F.col("n") - 1))).alias("stddev_price"),
        (total("volume", "double") / F.nullif(total("volumes", "long"), F.lit(0))).alias("volume_avg"),
        F.element_at("panes", -1)["change"].alias("price_change_1h"),
        total("ticks", "long").alias("tick_count"),
    )


def _window_metrics(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns(
        {
            "volatility": _ratio(100 * F.coalesce("stddev_price", F.lit(0.0)), F.col("avg_price")),
            "price_roc": _ratio(100 * (F.col("close_price") - F.col("open_price")), F.col("open_price")),
        }
    )
    rows = rows.withColumn("momentum", 0.5 * F.col("price_roc") + 0.5 * F.col("price_change_1h"))
    # the score comes before nulls are filled, so that a missing 1h change makes it 0
    rows = rows.withColumns({"volume_spike_ratio": F.lit(1.0), "trending_score": 0.4 * F.col("volatility") + 0.6 * F.abs("momentum")})
    return rows.fillna(0.0, ["volatility", "price_roc", "momentum", "trending_score", "stddev_price", "price_change_1h"])


def trending_documents(metrics: DataFrame) -> DataFrame:
    """The eleven columns of a trending document; doc_id is the coin and window start."""
    return metrics.select(
        F.concat_ws("_", "coin_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss")).alias("doc_id"),
        "coin_id",
        "symbol",
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        "volume_avg",
        "volatility",
        "momentum",
        "volume_spike_ratio",
        "trending_score",
        F.lit("stream").alias("data_source"),
    )


# history


def history_outer(prices: DataFrame, caps: DataFrame, volumes: DataFrame) -> DataFrame:
    """The three series (coin_id, timestamp, and price, market_cap or volume) on all their timestamps."""
    keys = ["coin_id", "timestamp"]
    return prices.join(caps, keys, "full_outer").join(volumes, keys, "full_outer")


def history_nearest(chart: DataFrame, ohlc: DataFrame, tolerance_ms: int = 30 * 60 * 1000) -> DataFrame:
    """OHLC rows with the nearest chart point of their coin, each point used once; all rows of both sides come out.

    chart: coin_id, timestamp (ms), price, market_cap, volume; ohlc: coin_id, timestamp, open, high, low, close. Equal times
    match first; then OHLC rows, in order of time, take the nearest free point within the tolerance (of two equally
    near the earlier). A matched row has the OHLC time, others keep their own. Rows of one coin and time are rows of
    their own, ordered by their values: the first of one side goes with the first of the other. A null time matches none.

    A coin's rows are dealt out by stretches that gaps wider than the tolerance part, which no match can cross. A task
    passes over a stretch in order of time and holds the rows of two tolerances, so that one without gaps fits as well.
    """
    points, bars = ["price", "market_cap", "volume"], ["open", "high", "low", "close"]
    null = F.lit(None).cast("double")
    side = lambda df, bar, own: df.select("coin_id", F.col("timestamp").cast("long").alias("timestamp"), F.lit(bar).alias("bar"), *((F.col(c).cast("double") if c in own else null).alias(c) for c in points + bars))
    rows = side(chart, False, points).union(side(ohlc, True, bars)).withColumn("cell", F.expr(f"timestamp div {max(tolerance_ms, 1)}"))
    # gaps are found between cells of a tolerance's length, of which a coin has few
    cells = rows.groupBy("coin_id", "cell").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    by_time = Window.partitionBy("coin_id").orderBy("cell")
    starts = cells.withColumn("starts", F.coalesce(F.col("first") - F.lag("last").over(by_time) > tolerance_ms, F.lit(True)).cast("long"))
    stretches = starts.select(F.col("coin_id").alias("coin"), F.col("cell").alias("at"), F.sum("starts").over(by_time).alias("stretch"))
    dealt = rows.join(stretches, F.col("coin_id").eqNullSafe(F.col("coin")) & F.col("cell").eqNullSafe(F.col("at")))
    order = ["coin_id", "stretch", "timestamp", "bar", *points, *bars]
    dealt = dealt.select(*order).repartition("coin_id", "stretch").sortWithinPartitions(*order)
    schema = "coin_id string, timestamp long, " + ", ".join(f"{c} double" for c in points + bars)

    def run(batches):
        import pyarrow as pa

        for found in nearest_rows((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), tolerance_ms):
            columns = list(zip(*found))
            kinds = [pa.string(), pa.int64()] + [pa.float64()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split(" ")[0] for f in schema.split(", ")])

    return dealt.mapInArrow(run, schema)


def nearest_rows(rows: Iterator[tuple], tolerance_ms: int, size: int = 10_000) -> Iterator[list[tuple]]:
    """Lists of history_nearest's rows. rows: coin_id, stretch, timestamp, bar, three point values, four bar values, sorted."""
    no_point, no_bar = (None,) * 3, (None,) * 4
    out: list[tuple] = []
    # free: points by time that may still be taken, times beside them; waiting: bars that no point of their own time took
    free: list[tuple] = []
    times: list[int] = []
    waiting: deque[tuple] = deque()
    group, now, fresh = None, None, 0  # of the free points the last `fresh` are of the time now

    def settle(before: int | None) -> None:
        """Take points for the waiting bars whose reach ends before that time (None: for all)."""
        while waiting and (before is None or waiting[0][1] + tolerance_ms < before):
            coin, t, values = waiting.popleft()
            k = bisect_left(times, t)
            near = [j for j in (k - 1, k) if 0 <= j < len(times) and abs(times[j] - t) <= tolerance_ms]
            if near:
                # of points of one time the first
                j = min(near, key=lambda j: (abs(times[j] - t), j))
                j = bisect_left(times, times[j])
                out.append((coin, t, *free[j][2], *values))
                del times[j], free[j]
            else:
                out.append((coin, t, *no_point, *values))
        # no bar to come or waiting reaches back further than this
        least = None if before is None else (waiting[0][1] if waiting else before) - tolerance_ms
        gone = len(times) if least is None else bisect_left(times, least)
        out.extend((coin, t, *values, *no_bar) for coin, t, values in free[:gone])
        del times[:gone], free[:gone]

    for coin, stretch, t, bar, *values in rows:
        if (coin, stretch) != group:
            settle(None)
            group, now = (coin, stretch), None
        if t is None:
            out.append((coin, None, *no_point, *values[3:]) if bar else (coin, None, *values[:3], *no_bar))
            continue
        if t != now:
            settle(t)
            now, fresh = t, 0
            if len(out) >= size:
                yield out
                out = []
        if not bar:
            free.append((coin, t, tuple(values[:3])))
            times.append(t)
            fresh += 1
        elif fresh:
            out.append((coin, t, *free[-fresh][2], *values[3:]))
            del times[len(times) - fresh], free[len(free) - fresh]
            fresh -= 1
        else:
            waiting.append((coin, t, tuple(values[3:])))
    settle(None)
    if out:
        yield out


# universe


def latest_ticks(ticks: DataFrame, key: str = "coin_id", time: str = "last_updated") -> DataFrame:
    """The newest row of each key, in one aggregation."""
    rest = [c for c in ticks.columns if c not in (key, time)]
    newest = ticks.groupBy(key).agg(F.max(F.struct(time, *rest)).alias("row"))
    return newest.select(key, *(F.col("row")[c].alias(c) for c in (time, *rest)))


def platform_address(platforms: Column, platform: str = "ethereum") -> Column:
    """Address on a platform; null if the map or the key is missing, or the address is empty."""
    return F.nullif(F.try_element_at(platforms, F.lit(platform)), F.lit(""))


def top_coins(markets: DataFrame, listing: DataFrame, n: int = 250, native: str = "ethereum") -> DataFrame:
    """The n coins of the largest market cap that have an address (listing: id, platforms), and the native coin with none.

    Joined plainly: the planner broadcasts the n rows by their estimated size, and shuffles both sides for a large n.
    """
    top = markets.orderBy(F.desc_nulls_last("market_cap"), "id").limit(n)
    addresses = listing.select("id", platform_address(F.col("platforms")).alias("eth_contract_address"))
    known = top.join(addresses, "id")
    return known.where(F.col("eth_contract_address").isNotNull() | (F.col("id") == native))


QUOTE_NUMBERS = ["current_price", "market_cap", "fully_diluted_valuation", "total_volume", "high_24h", "low_24h", "price_change_24h", "price_change_percentage_24h", "price_change_percentage_1h_in_currency", "price_change_percentage_7d_in_currency", "market_cap_change_24h", "market_cap_change_percentage_24h", "circulating_supply", "total_supply", "max_supply", "ath", "ath_change_percentage", "atl", "atl_change_percentage"]


def quoted_ticks(targets: DataFrame, quotes: DataFrame) -> DataFrame:
    """Ticks of the target coins (id, eth_contract_address) that have a quote; numbers that cannot be read are null, missing ones too."""
    joined = targets.select("id", "eth_contract_address").join(quotes, "id")
    numbers = [(F.col(c).cast("string").try_cast("double") if c in quotes.columns else F.lit(None).cast("double")).alias(c.removesuffix("_in_currency")) for c in QUOTE_NUMBERS]
    texts = [(F.col(c) if c in quotes.columns else F.lit(None)).cast("string").alias(c) for c in ("symbol", "name", "image", "ath_date", "atl_date", "last_updated")]
    rank = (F.col("market_cap_rank") if "market_cap_rank" in quotes.columns else F.lit(None)).cast("long").alias("market_cap_rank")
    return joined.select("id", "eth_contract_address", *texts, rank, *numbers)
