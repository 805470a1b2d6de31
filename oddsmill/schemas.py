"""Table schemas, keys and fixed settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Interval labels and their length in seconds.
INTERVAL_SECONDS = {
    "1m": 60,
    "5m": 300,
    "15m": 900,
    "1h": 3600,
    "4h": 14_400,
    "6h": 21_600,
    "1d": 86_400,
    "1w": 604_800,
}
DEFAULT_INTERVAL_SECONDS = 3600
DAY = 86_400


def interval_seconds(label: str) -> int:
    return INTERVAL_SECONDS.get(str(label).strip().lower(), DEFAULT_INTERVAL_SECONDS)


def points_per_day(interval: str) -> int:
    return max(1, round(DAY / interval_seconds(interval)))


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _struct(columns: str) -> T.StructType:
    """'name type, ...' without a running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in pairs])


EVENTS = _struct("event_id bigint, slug string, title string, start_ts bigint, end_ts bigint, tags string")
MARKETS = _struct(
    "market_id string, event_id bigint, condition_id string, question string, active boolean, closed boolean, "
    "resolved boolean, resolution_outcome string, resolution_ts bigint, market_type string, liquidity double"
)
TOKENS = _struct("market_id string, outcome string, asset_id string")
PRICES = _struct("asset_id string, ts bigint, price double, interval string, ingested_at bigint")
BARS = _struct(
    "asset_id string, ts bigint, interval string, volume double, trade_count bigint, buy_volume double, "
    "sell_volume double, vwap double"
)
BOOKS = _struct(
    "asset_id string, snapshot_ts bigint, best_bid double, best_ask double, bid_size double, ask_size double, "
    "mid_price double, spread double, spread_pct double, bid_depth_5pct double, ask_depth_5pct double"
)
RESOLUTIONS = _struct(
    "market_id string, condition_id string, resolution_outcome string, resolution_ts bigint, final_price double, "
    "ingested_at bigint"
)
SIGNALS = _struct(
    "signal_name string, asset_id string, market_id string, ts bigint, direction string, confidence double, "
    "entry_price double, target_price double, edge double, metadata_json string"
)
RUNS = _struct(
    "run_id string, run_ts bigint, duration_s double, events_count bigint, markets_count bigint, "
    "price_coverage_pct double, signals_generated bigint, signals_expected boolean, pipeline_profile string, "
    "status string, config_hash string"
)

# Feature name, family and window.
FEATURES = [
    ("p_start", "price", "lookback", "first price of the filled series"),
    ("p_end", "price", "lookback", "last price of the filled series"),
    ("max_price", "price", "lookback", "highest price"),
    ("min_price", "price", "lookback", "lowest price"),
    ("time_of_max", "price", "lookback", "where the first maximum lies, 0 = start and 1 = end"),
    ("return_total", "price", "lookback", "last price less first price"),
    ("volatility", "price", "lookback", "population deviation of step changes"),
    ("max_drawdown", "price", "lookback", "largest fall from a running peak"),
    ("slope", "price", "lookback", "least-squares slope per step"),
    ("missing_ratio", "price", "lookback", "share of empty grid slots before filling"),
    ("num_points", "price", "lookback", "slots holding a price after filling"),
    ("days_to_resolution", "time", "point-in-time", "days from the as-of time to the event end"),
    ("pct_lifetime_elapsed", "time", "point-in-time", "share of the event's life that has passed"),
    ("days_since_creation", "time", "point-in-time", "days from the event start to the as-of time"),
    ("avg_spread", "microstructure", "recent snapshots", "mean of best ask less best bid"),
    ("avg_spread_pct", "microstructure", "recent snapshots", "mean spread relative to mid"),
    ("spread_trend", "microstructure", "recent snapshots", "slope of the spread over snapshots"),
    ("avg_depth", "microstructure", "recent snapshots", "mean of both sides' depth near mid"),
    ("avg_bid_depth", "microstructure", "recent snapshots", "mean bid depth near mid"),
    ("avg_ask_depth", "microstructure", "recent snapshots", "mean ask depth near mid"),
    ("avg_daily_volume", "volume", "lookback", "mean volume of traded days"),
    ("volume_trend", "volume", "lookback", "slope of daily volume over traded days"),
    ("buy_sell_ratio", "volume", "lookback", "bought volume over sold volume"),
    ("volume_price_corr", "volume", "lookback", "correlation of daily volume with the daily price move"),
    ("return_1d", "momentum", "1d", "price change over one day of slots"),
    ("return_7d", "momentum", "7d", "price change over seven days of slots"),
    ("return_30d", "momentum", "30d", "price change over thirty days of slots"),
    ("zscore_7d", "momentum", "7d", "last price standardised by its last seven days"),
    ("rsi_14", "momentum", "14 periods", "relative strength with Wilder smoothing"),
]
FEATURE_COLUMNS = [name for name, *_ in FEATURES]


@dataclass(frozen=True)
class TableSpec:
    schema: T.StructType
    keys: tuple[str, ...]
    sort: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    time: str = "ts"  # seconds whose day a table is partitioned by


# Keys and sort orders of the stored tables.
TABLES = {
    "events": TableSpec(EVENTS, ("event_id",), ("event_id",)),
    "markets": TableSpec(MARKETS, ("market_id",), ("market_id",)),
    "tokens": TableSpec(TOKENS, ("market_id", "asset_id"), ("market_id", "asset_id")),
    "price_history": TableSpec(PRICES, ("asset_id", "ts", "interval"), ("asset_id", "ts"), ("dt",)),
    "volume_bars": TableSpec(BARS, ("asset_id", "ts", "interval"), ("asset_id", "ts"), ("dt",)),
    "orderbook_snapshots": TableSpec(BOOKS, ("asset_id", "snapshot_ts"), ("asset_id", "snapshot_ts"), ("dt",), "snapshot_ts"),
    "resolutions": TableSpec(RESOLUTIONS, ("market_id",), ("market_id",)),
    "signals": TableSpec(SIGNALS, ("signal_name", "asset_id", "market_id", "ts"), ("ts", "signal_name", "asset_id")),
    "trade_candidates": TableSpec(
        T.StructType(), ("run_date", "market_id", "signal_name", "asset_id"), ("run_date", "rank")
    ),
    "pipeline_runs": TableSpec(RUNS, ("run_id",), ("run_ts",)),
}
