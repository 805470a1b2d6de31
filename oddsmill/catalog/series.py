"""Queries on bars, books and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.catalog.registry import query
from oddsmill.catalog.sqltext import sql
from oddsmill.operators import bars, features
from oddsmill.sources.adapters import AS_OF, Canon

SERIES = {"interval": "6h", "window_days": 20, "gap_fill_limit": 2}
BOOK_DOUBLES = "best_bid best_ask bid_size ask_size mid_price spread spread_pct bid_depth_5pct ask_depth_5pct"


def all_features(c: Canon):
    context = c.tokens.join(c.markets.select("market_id", "event_id"), "market_id").join(
        c.events.select("event_id", "start_ts", "end_ts"), "event_id"
    ).select("asset_id", "start_ts", "end_ts")
    return features.asset_features(
        c.prices, context=context, books=c.books, bars=c.bars, as_of_ts=AS_OF, **SERIES
    )


@query("volume_bars", sql("select * from t_bars", "volume buy_volume sell_volume vwap"))
def volume_bars(c: Canon):
    return c.bars


@query("book_metrics", sql("select * from t_books", BOOK_DOUBLES))
def book_metrics(c: Canon):
    return c.books


@query("median_spread", sql(
    "select asset_id, median(spread) as median_spread from t_books where spread is not null group by 1", "median_spread"))
def median_spread(c: Canon):
    return bars.median_spread(c.books)


@query("last_book", sql(
    """select asset_id, arg_max(spread, snapshot_ts) filter (spread is not null) as spread,
              arg_max(spread_pct, snapshot_ts) filter (spread_pct is not null) as spread_pct from t_books group by 1""",
    "spread spread_pct"))
def last_book(c: Canon):
    return bars.last_book(c.books)


@query("price_cadence", sql(
    """with a as (select min(ts) as lo, max(ts) as hi, count(*) as k from t_prices group by asset_id having count(*) >= 12),
            s as (select (hi - lo) / cast(k - 1 as double) as step from a where hi > lo)
       select count(*) as checked_assets, count(*) filter (step < 10800) as mismatch_assets,
              coalesce(count(*) filter (step < 10800) / cast(nullif(count(*), 0) as double), 0) as mismatch_ratio,
              median(step) as median_step_s from s""", "mismatch_ratio median_step_s"))
def price_cadence(c: Canon):
    return bars.cadence(c.prices, "6h")


@query("canonical_ticks", sql("select asset_id, ts, price from s_ticks", "price"))
def canonical_ticks(c: Canon):
    from oddsmill.plans.asof import canonical_ticks as ticks

    return ticks(c.prices)


@query("clean_series", sql("select asset_id, slot, idx, n, price from s_clean", "price"))
def clean_series(c: Canon):
    return features.clean_series(c.prices, **SERIES).select("asset_id", "slot", F.col("idx").cast("bigint").alias("idx"), "n", "price")


@query("asset_curves", sql(
    """select f.asset_id, f.gi as idx, f.slot, f.price from s_filled f
       join (select distinct asset_id from s_clean) c on f.asset_id = c.asset_id""", "price"))
def asset_curves(c: Canon):
    return features.curves(c.prices, **SERIES)


@query("price_features", sql(
    "select * from f_price",
    "p_start p_end max_price min_price time_of_max return_total volatility max_drawdown slope missing_ratio return_1d "
    "return_7d return_30d zscore_7d rsi_14"))
def price_features(c: Canon):
    return features.price_features(features.clean_series(c.prices, **SERIES), SERIES["interval"])


@query("book_features", sql(
    "select * from f_book", "avg_spread avg_spread_pct spread_trend avg_depth avg_bid_depth avg_ask_depth"))
def book_features(c: Canon):
    return features.book_features(c.books)


@query("time_features", sql(
    "select * from f_time", "days_to_resolution pct_lifetime_elapsed days_since_creation"))
def time_features(c: Canon):
    context = c.tokens.join(c.markets.select("market_id", "event_id"), "market_id").join(c.events, "event_id")
    return features.time_features(context, AS_OF)


@query("volume_features", sql(
    "select * from f_volume", "avg_daily_volume volume_trend buy_sell_ratio volume_price_corr"))
def volume_features(c: Canon):
    return features.volume_features(c.bars, features.clean_series(c.prices, **SERIES))


@query("asset_features", sql(
    "select * from f_all",
    "p_start p_end max_price min_price time_of_max return_total volatility max_drawdown slope missing_ratio return_1d "
    "return_7d return_30d zscore_7d rsi_14 days_to_resolution pct_lifetime_elapsed days_since_creation avg_spread "
    "avg_spread_pct spread_trend avg_depth avg_bid_depth avg_ask_depth avg_daily_volume volume_trend buy_sell_ratio "
    "volume_price_corr"))
def asset_features(c: Canon):
    return all_features(c)
