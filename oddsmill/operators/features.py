"""Per-asset features from irregular ticks.

Ticks are reduced to the last price per interval slot before anything is ordered. A series then has at most
``window_days * 86400 / interval + 2`` slots, which bounds every per-asset window below, however many raw ticks an
asset has. All windows and the final grouping share the one exchange on asset_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oddsmill.functions.scalars import floor_to, safe_corr, to_double, to_long
from oddsmill.plans.asof import canonical_ticks
from oddsmill.schemas import DAY, FEATURE_COLUMNS, interval_seconds, points_per_day

SPREAD_SALTS = 32


def slot_prices(prices: DataFrame, interval: str, window_days: int) -> DataFrame:
    """Last price per slot inside the asset's own lookback window: asset_id, slot, price, ticks, end_ts."""
    n = interval_seconds(interval)
    ends = (
        prices.select(F.col("asset_id").cast("string").alias("asset_id"), to_long("ts").alias("ts"), to_double("price").alias("p"))
        .where("p is not null and ts is not null")
        .groupBy("asset_id")
        .agg(F.max("ts").alias("end_ts"))
        # The window ends are repeated per salt so that a hot asset's ticks join in many tasks.
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD_SALTS - 1))))
    )
    ticks = canonical_ticks(prices).withColumn("_salt", F.pmod(F.floor(F.col("ts") / n), F.lit(SPREAD_SALTS)).cast("int"))
    return (
        ticks.join(ends, ["asset_id", "_salt"])
        .where(F.col("ts") >= F.col("end_ts") - window_days * DAY)
        .groupBy("asset_id", floor_to("ts", n).alias("slot"))
        .agg(
            F.max_by("price", "ts").alias("price"),
            F.count(F.lit(1)).alias("ticks"),
            F.max("end_ts").alias("end_ts"),
        )
    )


def _runs(prices: DataFrame, interval: str, window_days: int) -> DataFrame:
    """One row per filled slot with the number of empty slots that follow it on the grid."""
    n = interval_seconds(interval)
    asset = Window.partitionBy("asset_id")
    last_slot = F.col("end_ts") + F.pmod(-F.col("end_ts"), F.lit(n).cast("bigint"))
    following = F.lead("slot").over(asset.orderBy("slot"))
    return (
        slot_prices(prices, interval, window_days)
        .withColumn("gap", ((F.coalesce(following, last_slot + n) - F.col("slot")) / n).cast("bigint") - 1)
        .withColumn("n_ticks", F.sum("ticks").over(asset))
        .withColumn("grid", F.sum(F.col("gap") + 1).over(asset))
        .withColumn("filled", F.count(F.lit(1)).over(asset))
        .where("n_ticks >= 3")
        .withColumn("missing_ratio", 1.0 - F.col("filled") / F.col("grid"))
    )


def clean_series(prices: DataFrame, interval: str = "1h", window_days: int = 90, gap_fill_limit: int = 6) -> DataFrame:
    """Forward-filled series without holes: asset_id, slot, idx (0..n-1), price, n, missing_ratio; n >= 3."""
    step = interval_seconds(interval)
    asset = Window.partitionBy("asset_id")
    # A slot's price is carried over the following empty slots, at most gap_fill_limit of them.
    carried = F.sequence(F.lit(0).cast("bigint"), F.least(F.col("gap"), F.lit(gap_fill_limit).cast("bigint")))
    return (
        _runs(prices, interval, window_days)
        .select("asset_id", "slot", "price", "missing_ratio", F.explode(carried).alias("_k"))
        .withColumn("slot", F.col("slot") + F.col("_k") * step)
        .drop("_k")
        .withColumn("idx", F.row_number().over(asset.orderBy("slot")) - 1)
        .withColumn("n", F.count(F.lit(1)).over(asset))
        .where("n >= 3")
    )


def curves(prices: DataFrame, interval: str = "1h", window_days: int = 90, gap_fill_limit: int = 6) -> DataFrame:
    """Gridded curve with nulls where the fill limit was passed: asset_id, idx, slot, price."""
    step = interval_seconds(interval)
    asset = Window.partitionBy("asset_id")
    filled = F.least(F.col("gap"), F.lit(gap_fill_limit).cast("bigint"))
    return (
        _runs(prices, interval, window_days)
        .withColumn("_clean", F.sum(filled + 1).over(asset))
        .where("_clean >= 3")
        .withColumn("_lo", F.min("slot").over(asset))
        .select("asset_id", "slot", "price", "_lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("gap"))).alias("_k"))
        .select(
            "asset_id",
            ((F.col("slot") + F.col("_k") * step - F.col("_lo")) / step).cast("bigint").alias("idx"),
            (F.col("slot") + F.col("_k") * step).alias("slot"),
            F.when(F.col("_k") <= gap_fill_limit, F.col("price")).alias("price"),
        )
    )


def price_features(clean: DataFrame, interval: str = "1h") -> DataFrame:
    """Price and momentum features of a clean series, one row per asset."""
    ppd = points_per_day(interval)
    asset = Window.partitionBy("asset_id")
    forward = asset.orderBy("idx")
    idx, n, price = F.col("idx"), F.col("n"), F.col("price")
    stepped = (
        clean.withColumn("diff", price - F.lag("price").over(forward))
        .withColumn("peak", F.max("price").over(forward.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("top", F.max("price").over(asset))
    )
    # Wilder smoothing in closed form: the first change seeds the average, later ones enter with weight 1/14.
    decay = 13.0 / 14.0
    weight = F.when(idx == 1, F.pow(F.lit(decay), n - 2)).otherwise(F.pow(F.lit(decay), n - 1 - idx) / 14.0)
    gain = F.sum(weight * F.greatest(F.col("diff"), F.lit(0.0)))
    loss = F.sum(weight * F.greatest(-F.col("diff"), F.lit(0.0)))
    week = 7 * ppd
    recent = F.when(idx >= n - week, price)

    def back(days: int) -> Column:
        return F.max(F.when(idx == n - 1 - days * ppd, price))

    sums = stepped.groupBy("asset_id").agg(
        F.min_by("price", "idx").alias("p_start"),
        F.max_by("price", "idx").alias("p_end"),
        F.max("price").alias("max_price"),
        F.min("price").alias("min_price"),
        F.min(F.when(price == F.col("top"), idx)).alias("_argmax"),
        F.stddev_pop("diff").alias("volatility"),
        F.max(F.col("peak") - price).alias("max_drawdown"),
        F.regr_slope(price, idx.cast("double")).alias("slope"),
        F.max("missing_ratio").alias("missing_ratio"),
        F.max("n").alias("num_points"),
        back(1).alias("_b1"),
        back(7).alias("_b7"),
        back(30).alias("_b30"),
        F.avg(recent).alias("_mean"),
        F.stddev_pop(recent).alias("_std"),
        gain.alias("_gain"),
        loss.alias("_loss"),
    )
    rs = F.col("_gain") / F.nullif(F.col("_loss"), F.lit(0.0))
    return sums.select(
        "asset_id",
        "p_start",
        "p_end",
        "max_price",
        "min_price",
        (F.col("_argmax") / (F.col("num_points") - 1)).alias("time_of_max"),
        (F.col("p_end") - F.col("p_start")).alias("return_total"),
        "volatility",
        "max_drawdown",
        F.coalesce("slope", F.lit(0.0)).alias("slope"),
        "missing_ratio",
        "num_points",
        (F.col("p_end") - F.col("_b1")).alias("return_1d"),
        (F.col("p_end") - F.col("_b7")).alias("return_7d"),
        (F.col("p_end") - F.col("_b30")).alias("return_30d"),
        F.when(
            (F.col("num_points") > week) & (F.col("_std") > 0), (F.col("p_end") - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
        ).alias("zscore_7d"),
        F.when(F.col("num_points") > 14, 100 - 100 / (1 + rs)).alias("rsi_14"),
    )


def time_features(context: DataFrame, as_of_ts: int) -> DataFrame:
    """context: asset_id, start_ts, end_ts (one row per asset)."""
    now = F.lit(as_of_ts).cast("bigint")
    start, end = to_double("start_ts"), to_double("end_ts")
    return context.select(
        F.col("asset_id").cast("string").alias("asset_id"),
        ((end - now) / float(DAY)).alias("days_to_resolution"),
        F.when(end > start, (now - start) / F.nullif(end - start, F.lit(0.0))).alias("pct_lifetime_elapsed"),
        ((now - start) / float(DAY)).alias("days_since_creation"),
    )


def book_features(books: DataFrame) -> DataFrame:
    """Books are keyed (asset, hour), so the ordering window per asset is bounded by the hours kept."""
    order = Window.partitionBy("asset_id", F.col("spread").isNull()).orderBy("snapshot_ts")
    bid, ask = F.col("bid_depth_5pct"), F.col("ask_depth_5pct")
    rows = books.withColumn("_i", F.when(F.col("spread").isNotNull(), F.row_number().over(order)).cast("double"))
    return rows.groupBy(F.col("asset_id").cast("string").alias("asset_id")).agg(
        F.avg("spread").alias("avg_spread"),
        F.avg("spread_pct").alias("avg_spread_pct"),
        F.regr_slope(F.col("spread"), F.col("_i")).alias("spread_trend"),
        F.avg((F.coalesce(bid, F.lit(0.0)) + F.coalesce(ask, F.lit(0.0))) / 2.0).alias("avg_depth"),
        F.avg(bid).alias("avg_bid_depth"),
        F.avg(ask).alias("avg_ask_depth"),
    )


def daily_volume(bars: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return bars.groupBy(
        F.col("asset_id").cast("string").alias("asset_id"), F.floor(F.col("ts") / DAY).alias("day")
    ).agg(
        F.sum(F.coalesce("volume", zero)).alias("volume"),
        F.sum(F.coalesce("buy_volume", zero)).alias("buy_volume"),
        F.sum(F.coalesce("sell_volume", zero)).alias("sell_volume"),
    )


def volume_features(bars: DataFrame, clean: DataFrame) -> DataFrame:
    days = daily_volume(bars)
    closes = clean.groupBy("asset_id", F.floor(F.col("slot") / DAY).alias("day")).agg(F.max_by("price", "slot").alias("close"))
    by_day = Window.partitionBy("asset_id").orderBy("day")
    moves = closes.withColumn("move", F.abs(F.col("close") - F.lag("close").over(by_day))).drop("close")
    joined = (
        days.join(moves, ["asset_id", "day"], "left")
        .withColumn("_i", F.row_number().over(by_day).cast("double"))
        .withColumn("_paired", F.when(F.col("move").isNotNull(), F.col("volume")))
    )
    sums = joined.groupBy("asset_id").agg(
        F.avg("volume").alias("avg_daily_volume"),
        F.regr_slope("volume", "_i").alias("volume_trend"),
        F.sum("buy_volume").alias("_buy"),
        F.sum("sell_volume").alias("_sell"),
        F.count("_paired").alias("_pairs"),
        safe_corr(F.col("_paired"), F.col("move")).alias("_corr"),
    )
    return sums.select(
        "asset_id",
        "avg_daily_volume",
        "volume_trend",
        F.when(F.col("_sell") > 0, F.col("_buy") / F.nullif(F.col("_sell"), F.lit(0.0))).alias("buy_sell_ratio"),
        F.when(F.col("_pairs") >= 3, F.col("_corr")).alias("volume_price_corr"),
    )


def asset_features(
    prices: DataFrame,
    *,
    interval: str = "1h",
    window_days: int = 90,
    gap_fill_limit: int = 6,
    context: DataFrame | None = None,
    books: DataFrame | None = None,
    bars: DataFrame | None = None,
    as_of_ts: int,
) -> DataFrame:
    """All 29 features, one row per asset; a family without input stays null."""
    clean = clean_series(prices, interval, window_days, gap_fill_limit)
    out = price_features(clean, interval)
    families = []
    if context is not None:
        families.append(time_features(context, as_of_ts))
    if books is not None:
        families.append(book_features(books))
    if bars is not None:
        families.append(volume_features(bars, clean))
    for family in families:
        out = out.join(family, "asset_id", "left")
    have = set(out.columns)
    return out.select(
        "asset_id",
        *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in FEATURE_COLUMNS],
    )
