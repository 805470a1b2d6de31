"""Order-book metrics, volume bars and cadence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oddsmill.functions.scalars import floor_to, to_double
from oddsmill.plans.selection import global_quantiles
from oddsmill.schemas import interval_seconds

DEPTH_BAND = 0.05


def snapshot_hour(ts: Column | str) -> Column:
    return floor_to(ts, 3600)


def book_metrics(levels: DataFrame) -> DataFrame:
    """levels: asset_id, snapshot_ts, side ('bid'/'ask'), price, size -> one row per snapshot.

    Sizes are first summed per price level with map-side combine. The window then covers the distinct price levels of one
    book, a bounded number on a price grid, and shares its exchange with the final aggregation. Equal prices at the top
    report the largest size.
    """
    keys = ["asset_id", "snapshot_ts"]
    book = Window.partitionBy(*keys)
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    price, size, mid = F.col("price"), F.col("size"), F.col("mid_price")
    by_price = (
        levels.where((price > 0) & (size >= 0))
        .groupBy(*keys, "side", "price")
        .agg(F.sum("size").alias("size"), F.max("size").alias("top_size"))
        .withColumn("best_bid", F.max(F.when(bid, price)).over(book))
        .withColumn("best_ask", F.min(F.when(ask, price)).over(book))
        .withColumn("mid_price", F.when(F.col("best_ask") >= F.col("best_bid"), (F.col("best_bid") + F.col("best_ask")) / 2.0))
    )
    rows = by_price.groupBy(*keys).agg(
        F.max("best_bid").alias("best_bid"),
        F.max("best_ask").alias("best_ask"),
        F.max(F.when(bid & (price == F.col("best_bid")), F.col("top_size"))).alias("bid_size"),
        F.max(F.when(ask & (price == F.col("best_ask")), F.col("top_size"))).alias("ask_size"),
        F.max("mid_price").alias("mid_price"),
        F.sum(F.when(bid & (price >= mid * (1 - DEPTH_BAND)), size)).alias("_bid"),
        F.sum(F.when(ask & (price <= mid * (1 + DEPTH_BAND)), size)).alias("_ask"),
    )
    spread = F.when(mid.isNotNull(), F.col("best_ask") - F.col("best_bid"))
    zero = F.lit(0.0)
    return rows.select(
        *keys, "best_bid", "best_ask", "bid_size", "ask_size", "mid_price", spread.alias("spread"),
        (spread / F.nullif(mid, zero)).alias("spread_pct"),
        F.when(mid.isNotNull(), F.coalesce("_bid", zero)).alias("bid_depth_5pct"),
        F.when(mid.isNotNull(), F.coalesce("_ask", zero)).alias("ask_depth_5pct"),
    )


def book_metrics_from_arrays(books: DataFrame) -> DataFrame:
    """books: asset_id, snapshot_ts, bids/asks array<struct<price,size>> -> the same metrics without a shuffle."""
    def valid(name: str) -> Column:
        return F.filter(name, lambda x: (x["price"] > 0) & (x["size"] >= 0))

    def total(name: str, keep) -> Column:
        return F.aggregate(F.filter(name, keep), F.lit(0.0), lambda acc, x: acc + x["size"])

    best_bid, best_ask = F.col("_b.price"), F.col("_a.price")
    straight = best_ask >= best_bid
    mid = F.col("mid_price")
    return (
        books.withColumn("bids", valid("bids"))
        .withColumn("asks", valid("asks"))
        .withColumn("_b", F.array_max("bids"))
        .withColumn("_a", F.get(F.array_sort("asks", lambda x, y: F.when(x["price"] < y["price"], -1)
                                             .when(x["price"] > y["price"], 1)
                                             .when(x["size"] > y["size"], -1)
                                             .when(x["size"] < y["size"], 1).otherwise(0)), F.lit(0)))
        .withColumn("mid_price", F.when(straight, (best_bid + best_ask) / 2.0))
        .withColumn("spread", F.when(straight, best_ask - best_bid))
        .select(
            "asset_id", "snapshot_ts", best_bid.alias("best_bid"), best_ask.alias("best_ask"),
            F.col("_b.size").alias("bid_size"), F.col("_a.size").alias("ask_size"), "mid_price", "spread",
            (F.col("spread") / F.nullif(mid, F.lit(0.0))).alias("spread_pct"),
            F.when(mid.isNotNull(), total("bids", lambda x: x["price"] >= mid * (1 - DEPTH_BAND))).alias("bid_depth_5pct"),
            F.when(mid.isNotNull(), total("asks", lambda x: x["price"] <= mid * (1 + DEPTH_BAND))).alias("ask_depth_5pct"),
        )
    )


def trade_bars(trades: DataFrame, interval: str = "1h", min_ts: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling volume bars per asset, and per the columns ``by``: trades (asset_id, ts, price, size, side).

    A window start is floored to the interval, so that an incremental reload never replaces a full first bar by a
    partial one. One aggregation with map-side combine; the shuffle carries bars, not trades.
    """
    n = interval_seconds(interval)
    price, size = to_double("price"), to_double("size")
    side = F.lower(F.trim(F.coalesce("side", F.lit(""))))
    rows = trades.select(
        F.col("asset_id").cast("string").alias("asset_id"), "ts", price.alias("p"), size.alias("v"), side.alias("side"), *by
    ).where("p > 0 and v > 0 and ts is not null")
    if min_ts is not None:
        rows = rows.where(F.col("ts") >= min_ts - min_ts % n)
    zero = F.lit(0.0)
    return (
        rows.groupBy("asset_id", floor_to("ts", n).alias("ts"), *by)
        .agg(
            F.sum("v").alias("volume"),
            F.count(F.lit(1)).alias("trade_count"),
            F.sum(F.when(F.col("side") == "buy", F.col("v")).otherwise(zero)).alias("buy_volume"),
            F.sum(F.when(F.col("side") == "sell", F.col("v")).otherwise(zero)).alias("sell_volume"),
            (F.sum(F.col("p") * F.col("v")) / F.sum("v")).alias("vwap"),
        )
        .select("asset_id", "ts", F.lit(interval).alias("interval"), "volume", "trade_count", "buy_volume", "sell_volume", "vwap", *by)
    )


def cadence(prices: DataFrame, interval: str = "1h") -> DataFrame:
    """One row: checked_assets, mismatch_assets, mismatch_ratio, median_step_s."""
    expected = interval_seconds(interval)
    per_asset = prices.groupBy("asset_id").agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("ts").alias("points")
    )
    steps = (
        per_asset.where("points >= 12")
        .withColumn("step_s", (F.col("hi") - F.col("lo")) / (F.col("points") - 1))
        .where("step_s > 0")
    )
    bad = F.count_if(F.col("step_s") < expected * 0.5)
    totals = steps.agg(F.count(F.lit(1)).alias("checked_assets"), bad.alias("mismatch_assets"))
    median = global_quantiles(steps, "step_s", {"median": 0.5})["median"]
    return totals.select(
        "checked_assets",
        "mismatch_assets",
        F.when(F.col("checked_assets") > 0, F.col("mismatch_assets") / F.nullif("checked_assets", F.lit(0))).otherwise(0.0).alias("mismatch_ratio"),
        F.lit(median).cast("double").alias("median_step_s"),
    )


def median_spread(books: DataFrame) -> DataFrame:
    """Median of an asset's hourly snapshots, a bounded group."""
    return (
        books.where("spread is not null")
        .groupBy(F.col("asset_id").cast("string").alias("asset_id"))
        .agg(F.median("spread").alias("median_spread"))
    )


def last_book(books: DataFrame) -> DataFrame:
    """Latest non-null spread and spread_pct per asset, each column on its own."""
    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("snapshot_ts"))).alias(c)

    return books.groupBy(F.col("asset_id").cast("string").alias("asset_id")).agg(latest("spread"), latest("spread_pct"))
