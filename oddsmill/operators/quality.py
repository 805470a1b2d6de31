"""Quality gates, tag rollups, rankings and report blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from oddsmill.functions.scalars import tag_from_json, to_double
from oddsmill.plans.keep import top_per_group

QUALITY_FEATURES = ("num_points", "missing_ratio", "max_price", "min_price", "volatility", "return_total", "slope")
CHECKS = ("check_min_points", "check_missing_ratio", "check_price_range", "check_liquidity")


def point_counts(prices: DataFrame) -> DataFrame:
    return prices.groupBy(F.col("asset_id").cast("string").alias("asset_id")).agg(F.count("ts").alias("history_points_raw"))


def market_quality(
    targets: DataFrame,
    markets: DataFrame,
    prices: DataFrame,
    features: DataFrame,
    *,
    min_points: int = 24,
    max_missing_ratio: float = 0.8,
    min_price_range: float = 0.02,
    min_liquidity: float = 0.0,
) -> DataFrame:
    """One row per target asset with its four checks and their conjunction."""
    liquid = F.coalesce(F.col("liquidity") >= float(min_liquidity), F.lit(False)) if min_liquidity > 0 else F.lit(True)
    rows = (
        targets.select("market_id", F.col("asset_id").cast("string").alias("asset_id"))
        .distinct()
        .join(point_counts(prices), "asset_id", "left")
        .join(features.select("asset_id", *QUALITY_FEATURES), "asset_id", "left")
        .join(markets.select("market_id", to_double("liquidity").alias("liquidity")), "market_id", "left")
        .withColumn("history_points_raw", F.coalesce("history_points_raw", F.lit(0).cast("bigint")))
        .withColumn("has_history", F.col("history_points_raw") > 0)
        .withColumn("price_range", F.coalesce(F.col("max_price") - F.col("min_price"), F.lit(0.0)))
        .withColumn("check_min_points", F.col("history_points_raw") >= min_points)
        .withColumn("check_missing_ratio", F.coalesce("missing_ratio", F.lit(1.0)) <= max_missing_ratio)
        .withColumn("check_price_range", F.col("price_range") >= min_price_range)
        .withColumn("check_liquidity", liquid)
    )
    passed = F.col("has_history")
    for check in CHECKS:
        passed = passed & F.col(check)
    return rows.withColumn("quality_pass", passed).select(
        "market_id", "asset_id", "liquidity", "history_points_raw", "has_history", "num_points", "missing_ratio",
        "price_range", "volatility", "return_total", "slope", *CHECKS, "quality_pass",
    )


def market_tags(markets: DataFrame, events: DataFrame, extract=tag_from_json) -> DataFrame:
    """market_id, primary_tag; unknown without an event."""
    return markets.select("market_id", "event_id").join(
        events.select("event_id", extract("tags").alias("primary_tag")), "event_id", "left"
    ).select("market_id", F.coalesce("primary_tag", F.lit("unknown")).alias("primary_tag"))


def tag_summary(
    events: DataFrame, markets: DataFrame, tokens: DataFrame, prices: DataFrame, features: DataFrame, quality: DataFrame | None
) -> DataFrame:
    """Coverage, average features and quality per tag. Medians are of counts and grid shares: few distinct values."""
    priced = prices.select(F.col("asset_id").cast("string").alias("asset_id")).distinct().withColumn("_h", F.lit(True))
    rows = (
        tokens.select("market_id", F.col("asset_id").cast("string").alias("asset_id"))
        .join(market_tags(markets, events), "market_id", "left")
        .join(priced, "asset_id", "left")
        .join(features.select("asset_id", "volatility", "return_total", "slope", "num_points", "missing_ratio"), "asset_id", "left")
    )
    if quality is not None:
        rows = rows.join(quality.select("asset_id", "quality_pass"), "asset_id", "left")
    else:
        rows = rows.withColumn("quality_pass", F.lit(False))
    history = F.coalesce("_h", F.lit(False)).cast("int")
    passed = F.coalesce("quality_pass", F.lit(False)).cast("int")
    zero = F.lit(0.0)
    rows = rows.withColumn("primary_tag", F.coalesce("primary_tag", F.lit("unknown")))
    # The distinct counts are taken apart, so that the rollup itself combines in the map tasks.
    distinct = rows.groupBy("primary_tag").agg(
        F.count_distinct("market_id").alias("markets"), F.count_distinct("asset_id").alias("tokens")
    )
    sums = rows.groupBy("primary_tag").agg(
        F.sum(history).alias("tokens_with_history"),
        F.avg(history).alias("coverage_pct"),
        F.coalesce(F.avg("volatility"), zero).alias("avg_volatility"),
        F.coalesce(F.avg("return_total"), zero).alias("avg_return_total"),
        F.coalesce(F.avg("slope"), zero).alias("avg_slope"),
        F.coalesce(F.median("num_points"), zero).alias("median_num_points"),
        F.coalesce(F.median("missing_ratio"), F.lit(1.0)).alias("median_missing_ratio"),
        F.sum(passed).alias("tokens_quality_pass"),
        F.avg(passed).alias("quality_pass_rate"),
    )
    return distinct.join(sums, "primary_tag")


RANKINGS = {
    "highest_volatility_tags": [("avg_volatility", False)],
    "strongest_upward_trend_tags": [("avg_slope", False)],
    "strongest_downward_trend_tags": [("avg_slope", True)],
    "lowest_coverage_tags": [("coverage_pct", True)],
    "highest_quality_pass_rate_tags": [("quality_pass_rate", False), ("tokens", False)],
}
RANK_COLUMNS = ("primary_tag", "tokens", "coverage_pct", "quality_pass_rate", "avg_volatility", "avg_slope")


def tag_rankings(summary: DataFrame, top_n: int = 10, min_tokens: int = 5) -> DataFrame:
    """Five top-n lists over tags with at least ``min_tokens`` tokens (over all tags if there is none)."""
    big = F.col("tokens") >= min_tokens
    any_big = summary.agg(F.coalesce(F.max(big), F.lit(False)).alias("_any"))  # one row
    pool = summary.join(F.broadcast(any_big), big | ~F.col("_any")).drop("_any")
    keys = []
    for name, order in RANKINGS.items():
        # One sort key per list; descending columns are negated so that all lists sort upwards.
        sign = [F.col(c).cast("double") if up else -F.col(c).cast("double") for c, up in order]
        keys.append(F.struct(F.lit(name).alias("ranking"), sign[0].alias("k1"), (sign[1] if len(sign) > 1 else F.lit(0.0)).alias("k2")))
    rows = pool.select(*RANK_COLUMNS, F.inline(F.array(*keys)))
    ranked = top_per_group(rows, ["ranking"], [F.col("k1"), F.col("k2"), F.col("primary_tag")], max(1, top_n))
    return ranked.select("ranking", "rank", *RANK_COLUMNS)


def coverage_block(events: DataFrame, markets: DataFrame, tokens: DataFrame, targets: DataFrame, prices: DataFrame) -> DataFrame:
    """metric, value rows: table sizes, targeted assets, share with history, median points per targeted asset."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")

    targeted = targets.select(F.col("asset_id").cast("string").alias("asset_id")).distinct()
    counted = targeted.join(point_counts(prices), "asset_id", "left")
    held = counted.agg(
        F.count(F.lit(1)).cast("double").alias("tokens_targeted_for_history"),
        F.count("history_points_raw").cast("double").alias("tokens_with_non_empty_history"),
        F.coalesce(F.count("history_points_raw") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("pct_targeted_with_history"),
        F.coalesce(F.median("history_points_raw"), F.lit(0.0)).alias("median_points_per_token"),
    )
    return (
        count(events, "events_discovered")
        .unionByName(count(markets, "markets_discovered"))
        .unionByName(count(tokens.select("asset_id").distinct(), "tokens_extracted"))
        .unionByName(held.unpivot([], held.columns, "metric", "value"))
    )


def quality_block(quality: DataFrame) -> DataFrame:
    """metric, value rows: totals, pass rate, failures per check."""
    total = F.count(F.lit(1))
    passed = F.count_if("quality_pass")
    row = quality.agg(
        total.cast("double").alias("quality_total_assets"),
        passed.cast("double").alias("quality_pass_assets"),
        F.coalesce(passed / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("quality_pass_rate"),
        *[F.count_if(~F.coalesce(c, F.lit(False))).cast("double").alias(c.replace("check", "failed")) for c in CHECKS],
    )
    return row.unpivot([], row.columns, "metric", "value")


def top_tags_by_tokens(summary: DataFrame, n: int = 15) -> DataFrame:
    return (
        summary.orderBy(F.desc("tokens"), "primary_tag").limit(n)
        .select("primary_tag", "tokens", (F.col("coverage_pct") * 100).alias("coverage_pct"))
    )


def report_document(
    coverage: DataFrame, quality: DataFrame, rankings: DataFrame | None = None, members: DataFrame | None = None, shapes: DataFrame | None = None
) -> DataFrame:
    """The metric blocks, tag rankings and clusters as one nested row, ready for a JSON document sink.

    Rankings are cut at their n and clusters are few, so the row is small whatever the data; the rows of all tags are a
    table of their own.
    """
    def block(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias(name))

    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    blocks = [block(quality, "quality")]
    if rankings is not None:
        blocks.append(listed(rankings, "tag_rankings", "ranking", "rank", *RANK_COLUMNS))
    if members is not None:
        sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
        blocks.append(sizes.agg(
            F.count(F.lit(1)).alias("num_clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("cluster_input_assets"),
            F.sort_array(F.collect_list(F.struct("cluster_id", "size"))).alias("cluster_sizes")))
    if shapes is not None:
        blocks.append(listed(shapes, "cluster_descriptions", *shapes.columns))
    row = block(coverage, "coverage")
    for b in blocks:
        row = row.join(F.broadcast(b))
    return row
