"""Tables behind market exploration: summaries, filters, composites, pivots and drill-downs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.functions.scalars import tag_from_json, to_double
from oddsmill.operators.normalize import anchor_tokens
from oddsmill.plans.asof import canonical_ticks
from oddsmill.plans.ranges import row_numbers, running_sum
from oddsmill.plans.keep import keep_first, top_per_group
from oddsmill.plans.quantiles import exact_quantiles
from oddsmill.session import stored
from oddsmill.schemas import DAY



def price_summary(prices: DataFrame) -> DataFrame:
    """Points, first/last/min/max price, window return and times per asset."""
    points = prices.where("ts is not null and price is not null").groupBy("asset_id").agg(F.count(F.lit(1)).alias("points"))
    ends = canonical_ticks(prices).groupBy("asset_id").agg(
        F.min_by("price", "ts").alias("first_price"), F.max_by("price", "ts").alias("last_price"), F.max("price").alias("max_price"),
        F.min("price").alias("min_price"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    change = F.col("last_price") - F.col("first_price")
    return points.join(ends, "asset_id").withColumn("window_return", change).withColumn("window_return_pct", change * 100.0)


def market_table(
    events: DataFrame, markets: DataFrame, tokens: DataFrame, prices: DataFrame, quality: DataFrame | None = None, seq: str = "seq"
) -> DataFrame:
    """One row per market with event, tokens, anchor prices and quality rollup."""
    event = events.select(
        "event_id", F.col("title").alias("event_title"), F.col("slug").alias("event_slug"), tag_from_json("tags").alias("primary_tag"),
        "start_ts", "end_ts",
    )
    token_count = tokens.select("market_id", "asset_id").distinct().groupBy("market_id").agg(F.count(F.lit(1)).alias("token_count"))
    anchor = anchor_tokens(tokens, seq).select(
        "market_id", F.col("asset_id").alias("anchor_asset_id"), F.coalesce("outcome", F.lit("Unknown")).alias("anchor_outcome")
    )
    summary = price_summary(prices).withColumnRenamed("asset_id", "anchor_asset_id")
    rows = (
        markets.drop("resolved", "resolution_outcome", "resolution_ts")
        .withColumn("liquidity", to_double("liquidity"))
        .withColumn("active", F.coalesce("active", F.lit(False)))
        .withColumn("closed", F.coalesce("closed", F.lit(False)))
        .join(event, "event_id", "left")
        .join(token_count, "market_id", "left")
        .join(anchor, "market_id", "left")
        .join(summary, "anchor_asset_id", "left")
    )
    if quality is not None:
        rolled = quality.groupBy("market_id").agg(
            F.avg(F.col("quality_pass").cast("double")).alias("quality_pass_rate"), F.max("quality_pass").alias("quality_pass_any"),
            F.avg("missing_ratio").alias("avg_missing_ratio"), F.avg("volatility").alias("avg_volatility"),
            F.avg("price_range").alias("avg_price_range"), F.max("history_points_raw").alias("history_points"),
        )
        rows = rows.join(rolled, "market_id", "left")
    else:
        rows = rows.withColumn("quality_pass_rate", F.lit(None).cast("double")).withColumn("quality_pass_any", F.lit(None).cast("boolean"))
    return rows.withColumns(
        {
            "token_count": F.coalesce("token_count", F.lit(0).cast("bigint")),
            "has_history": F.coalesce("points", F.lit(0)) > 0,
            "quality_pass_any": F.coalesce("quality_pass_any", F.lit(False)),
            "quality_pass_rate": F.coalesce("quality_pass_rate", F.lit(0.0)),
            "event_title": F.coalesce("event_title", F.lit("Unknown event")),
            "primary_tag": F.coalesce("primary_tag", F.lit("unknown")),
            "question": F.coalesce("question", F.lit("Untitled market")),
        }
    )


def tag_table(table: DataFrame) -> DataFrame:
    table = stored(table.select("primary_tag", "market_id", "has_history", "quality_pass_any", "liquidity", "window_return_pct"))
    rows = table.groupBy("primary_tag").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.avg(F.col("has_history").cast("double")).alias("coverage_pct"),
        F.avg(F.col("quality_pass_any").cast("double")).alias("quality_pass_pct"),
        F.avg("liquidity").alias("avg_liquidity"),
    )
    markets = table.select("primary_tag", "market_id").distinct().groupBy("primary_tag").agg(F.count("market_id").alias("markets"))
    median = exact_quantiles(table, ["primary_tag"], "window_return_pct", {"median_return_pct": 0.5})
    return rows.drop("_rows").join(markets, "primary_tag").join(median, "primary_tag", "left")


def tag_chart(tags: DataFrame, n: int = 30) -> DataFrame:
    """The n largest tags with rates in percent."""
    return tags.orderBy(F.desc("markets"), "primary_tag").limit(n).withColumns(
        {"coverage_pct": F.col("coverage_pct") * 100, "quality_pass_pct": F.col("quality_pass_pct") * 100}
    )


SORTABLE = ("liquidity", "window_return_pct", "last_price", "points", "quality_pass_rate")


def filter_markets(
    table: DataFrame,
    *,
    search: str = "",
    tags: Sequence[str] = (),
    types: Sequence[str] = (),
    status: str = "all",
    min_liquidity: float = 0.0,
    require_history: bool = False,
    require_quality: bool = False,
    sort_by: str = "liquidity",
    descending: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Regular-expression search and flag filters; sorted, and cut to a page only if ``limit`` asks for one."""
    out = table
    if search:
        pattern = search.lower().strip()
        out = out.where(
            F.lower("question").rlike(pattern) | F.lower("event_title").rlike(pattern) | F.lower("market_id").rlike(pattern)
        )
    if tags:
        out = out.where(F.col("primary_tag").isin(*tags))
    if types:
        out = out.where(F.col("market_type").isin(*types))
    if status == "active_only":
        out = out.where("active")
    elif status == "closed_only":
        out = out.where("closed")
    if min_liquidity > 0:
        out = out.where(F.coalesce("liquidity", F.lit(0.0)) >= min_liquidity)
    if require_history:
        out = out.where("has_history")
    if require_quality:
        out = out.where("quality_pass_any")
    if sort_by in SORTABLE:
        key = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last()
        out = out.orderBy(key, "market_id")
    return out if limit is None else out.limit(limit)


def kpis(visible: DataFrame) -> DataFrame:
    """One row: markets, share with history, share passing quality (in percent), mean liquidity."""
    def pct(c: str) -> Column:
        return F.coalesce(F.avg(F.col(c).cast("double")) * 100, F.lit(0.0))

    return visible.agg(
        F.count(F.lit(1)).alias("markets"), pct("has_history").alias("history_pct"), pct("quality_pass_any").alias("quality_pct"),
        F.coalesce(F.avg("liquidity"), F.lit(0.0)).alias("avg_liquidity"),
    )


def downsample(series: DataFrame, max_points: int, group: str = "asset_id", ranges: int | None = None) -> DataFrame:
    """Every k-th point of a series (k = points div max_points) and its last point; numbered without a whole-series window."""
    rows = row_numbers(series, [group], [F.col("ts"), F.col("price")], "_rn", "_n", ranges)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / max_points))
    regular = (F.col("_rn") - 1) % step == 0
    last = F.col("_rn") == F.col("_n")
    # The last point is added unless the last regular point already has its time.
    last_regular = F.floor((F.col("_n") - 1) / step) * step + 1
    ends = rows.where(last | (F.col("_rn") == last_regular)).groupBy(F.col(group).alias("_group")).agg((F.min("ts") < F.max("ts")).alias("_open"))
    shown = rows.where(regular | last).join(ends, F.col(group).eqNullSafe(F.col("_group")))
    return shown.where(regular | F.col("_open")).select(*series.columns)


def outcome_series(market_id: str, tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """Price series of one market's outcomes; labels shared by several assets get the asset's first ten characters."""
    text = F.trim(F.coalesce("outcome", F.lit("")))
    labels = tokens.where(F.col("market_id") == market_id).select(
        "asset_id", F.when(text != "", text).otherwise(F.col("asset_id")).alias("outcome_label")
    ).distinct()
    return _labelled(labels, prices, []).drop("market_id")


def outcome_series_all(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """The same for every market at once."""
    text = F.trim(F.coalesce("outcome", F.lit("")))
    labels = tokens.select("market_id", "asset_id", F.when(text != "", text).otherwise(F.col("asset_id")).alias("outcome_label")).distinct()
    return _labelled(labels, prices, ["market_id"])


def _labelled(labels: DataFrame, prices: DataFrame, group: list[str]) -> DataFrame:
    priced = labels.join(prices.select("asset_id").distinct(), "asset_id", "left_semi")
    shared = priced.groupBy(*group, "outcome_label").agg((F.count(F.lit(1)) > 1).alias("_shared"))
    named = priced.join(shared, [*group, "outcome_label"]).select(
        *group, "asset_id", "outcome_label",
        F.when(F.col("_shared"), F.concat("outcome_label", F.lit(" | "), F.substring("asset_id", 1, 10))).otherwise(F.col("outcome_label")).alias("series_label"),
    )
    return named.join(prices.select("asset_id", "ts", "price"), "asset_id")


def event_composite(table: DataFrame, prices: DataFrame) -> DataFrame:
    """Per event and timestamp over the anchors of its markets: median, quartiles, mean and number of prices."""
    legs = table.where("anchor_asset_id is not null").select("event_id", "market_id", F.col("anchor_asset_id").alias("asset_id"))
    rows = stored(legs.join(prices.select("asset_id", "ts", "price"), "asset_id"))
    keys = ["event_id", "ts"]
    cuts = exact_quantiles(rows, keys, "price", {"p25": 0.25, "median_price": 0.5, "p75": 0.75})
    means = rows.groupBy(*keys).agg(F.avg("price").alias("mean_price"), F.count(F.lit(1)).alias("market_count"))
    return means.join(cuts, keys)


def event_series(table: DataFrame, prices: DataFrame, event_id: int) -> DataFrame:
    """Anchor series of one event with display labels."""
    label = F.concat(F.substring("question", 1, 65), F.lit(" | "), F.col("market_id"))
    legs = table.where((F.col("event_id") == event_id) & F.col("anchor_asset_id").isNotNull()).select(
        F.col("anchor_asset_id").alias("asset_id"), "market_id", label.alias("series_label")
    )
    return legs.join(prices.select("asset_id", "ts", "price"), "asset_id")


def market_map(visible: DataFrame, top: int = 10) -> DataFrame:
    """Markets with liquidity and return; tags beyond the ``top`` most frequent become Other."""
    rows = visible.where("liquidity is not null and window_return_pct is not null").select(
        "market_id", "question", "primary_tag", "liquidity", "window_return_pct", "points"
    )
    frequent = (
        rows.groupBy("primary_tag").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "primary_tag").limit(top)
        .select("primary_tag", F.lit(True).alias("_top"))
    )
    bucket = F.when(F.col("_top"), F.col("primary_tag")).otherwise("Other")
    return rows.join(F.broadcast(frequent), "primary_tag", "left").withColumn("tag_bucket", bucket).drop("_top")


def biggest_movers(visible: DataFrame, n: int = 20) -> DataFrame:
    rows = visible.where("liquidity is not null and window_return_pct is not null")
    return rows.orderBy(F.abs("window_return_pct").desc(), "market_id").limit(n).select(
        "market_id", "question", "primary_tag", "liquidity", "window_return_pct", "points"
    )


def pnl_curve(trades: DataFrame) -> DataFrame:
    """Cumulative profit in order of exit, over ranges of the order."""
    rows = trades.where("exit_ts is not null").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))
    order = [F.col(c) for c in ("exit_ts", "signal_name", "market_id", "asset_id")]
    return running_sum(rows, [], order, "pnl", "cum_pnl").select(
        "signal_name", "market_id", "asset_id", "exit_ts", "pnl", "cum_pnl"
    )


def backtest_kpis(trades: DataFrame) -> DataFrame:
    pnl = F.coalesce("pnl", F.lit(0.0))
    return trades.agg(
        F.count(F.lit(1)).alias("trades"), F.coalesce(F.sum(pnl), F.lit(0.0)).alias("total_pnl"),
        F.coalesce(F.avg((pnl > 0).cast("double")), F.lit(0.0)).alias("win_rate"), F.avg("hold_days").alias("avg_hold_days"),
    )


def trade_log(trades: DataFrame) -> DataFrame:
    """Trades, best first."""
    return trades.select(
        "signal_name", "asset_id", "market_id", "direction", "entry_price", "exit_price", "pnl", "return_pct", "hold_days", "exit_reason"
    ).orderBy(F.desc("pnl"))


def confidence_by_day(signals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean confidence per day with one column per signal. The names are given, so that no extra pass looks for them."""
    rows = signals.where("ts is not null and confidence is not null").withColumn("day", F.floor(F.col("ts") / DAY))
    return rows.groupBy("day").pivot("signal_name", list(names)).agg(F.avg("confidence"))


def latest_per_outcome(series: DataFrame, group: Sequence[str] = ("outcome_label",)) -> DataFrame:
    """Last point per outcome label (of equal times, the asset that sorts last)."""
    return keep_first(series, list(group), [F.col("ts").desc(), F.col("asset_id").desc()]).select(
        *group, "price", "ts", "asset_id"
    )


def series_pivot(series: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Timestamp by series, the last asset's price where two share a cell."""
    return series.groupBy(*keys).pivot("series_label", list(labels)).agg(F.max_by("price", "asset_id"))


# Columns of the detail table (fixed values).
QUALITY_ROWS = ("asset_id", "history_points_raw", "missing_ratio", "price_range", "volatility", "return_total", "quality_pass")


def market_detail(market_id: str, quality: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Quality rows and cluster membership of one market; the filter reaches the scans."""
    rows = quality.where(F.col("market_id") == market_id).select(*QUALITY_ROWS)
    if clusters is None:
        return rows
    member = clusters.where(F.col("market_id") == market_id).select("asset_id", "cluster_id", "primary_tag")
    return rows.join(member, "asset_id", "left")


def event_options(table: DataFrame) -> DataFrame:
    """Distinct events with a label, for a sorted list."""
    one = keep_first(table.where("event_id is not null"), ["event_id"], [F.col("market_id")])
    label = F.concat_ws(" | ", "event_title", "primary_tag", F.col("event_id").cast("string"))
    return one.select("event_id", "event_title", "primary_tag", label.alias("label")).orderBy("event_title", "event_id")


def event_kpis(table: DataFrame) -> DataFrame:
    """Per event: markets, with history, median liquidity and last price."""
    table = stored(table.select("event_id", "market_id", "has_history", "liquidity", "last_price"))
    rows = table.groupBy("event_id").agg(F.count_if("has_history").alias("with_history"))
    markets = table.select("event_id", "market_id").distinct().groupBy("event_id").agg(F.count(F.lit(1)).alias("markets"))
    liquidity = exact_quantiles(table, ["event_id"], "liquidity", {"median_liquidity": 0.5})
    last = exact_quantiles(table, ["event_id"], "last_price", {"median_last_price": 0.5})
    return markets.join(rows, "event_id").join(liquidity, "event_id", "left").join(last, "event_id", "left")


def event_markets(table: DataFrame, n: int) -> DataFrame:
    """The n most liquid markets of every event; the page length has no default, so no row is left out unasked."""
    return top_per_group(table, ["event_id"], [F.col("liquidity").desc_nulls_last(), F.col("market_id")], n).select(
        "event_id", "rank", "market_id", "question", "liquidity", "last_price", "window_return_pct", "points", "quality_pass_any"
    )


def top_market_lines(table: DataFrame, prices: DataFrame, event_id: int, n: int = 12, max_points: int = 500) -> DataFrame:
    """Downsampled anchor series of an event's n most liquid markets."""
    best = (
        table.where((F.col("event_id") == event_id) & F.col("anchor_asset_id").isNotNull())
        .orderBy(F.col("liquidity").desc_nulls_last(), "market_id").limit(n)
        .select(F.col("anchor_asset_id").alias("asset_id"))
    )
    lines = event_series(table, prices, event_id).join(F.broadcast(best.distinct()), "asset_id", "left_semi")
    return downsample(lines, max_points, "series_label")


def choices(table: DataFrame) -> DataFrame:
    """Distinct tags and market types."""
    tags = table.select(F.lit("primary_tag").alias("field"), F.col("primary_tag").alias("value"))
    types = table.select(F.lit("market_type").alias("field"), F.col("market_type").alias("value"))
    return tags.unionByName(types).where("value is not null").distinct()


def ordered_candidates(candidates: DataFrame) -> DataFrame:
    key = "expected_value" if "expected_value" in candidates.columns else "edge"
    return candidates.orderBy(F.col(key).desc())


def confidence_edge_pairs(signals: DataFrame) -> DataFrame:
    return signals.select("confidence", "edge", "signal_name").dropna()


def cluster_list(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("assets")).orderBy(F.desc("assets"), "cluster_id")
