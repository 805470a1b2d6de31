"""What to load next: watermarks per asset, load metadata, plan and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.functions.scalars import tag_from_json, to_long
from oddsmill.operators.normalize import anchor_tokens
from oddsmill.plans.ranges import row_numbers
from oddsmill.schemas import interval_seconds

BUCKET_RANK = {"existing": 0, "new_active": 1, "new_inactive": 2}


def latest_ts(prices: DataFrame, interval: str | None = None) -> DataFrame:
    """Last second per asset for one interval (a null interval counts as '')."""
    rows = prices
    if interval is not None and "interval" in prices.columns:
        rows = rows.where(F.coalesce("interval", F.lit("")) == interval)
    return (
        rows.select(F.col("asset_id").cast("string").alias("asset_id"), to_long("ts").alias("ts"))
        .where("ts is not null")
        .groupBy("asset_id")
        .agg(F.max("ts").alias("latest_ts"))
    )


def load_metadata(tokens: DataFrame, markets: DataFrame, events: DataFrame, latest: DataFrame, now_ts: int) -> DataFrame:
    """asset_id, market_id, primary_tag, latest_ts, has_history, is_inactive, tag_coverage."""
    def yes(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    tag = F.trim(tag_from_json("tags"))
    rows = (
        tokens.select(F.col("asset_id").cast("string").alias("asset_id"), F.col("market_id").cast("string").alias("market_id"))
        .distinct()
        .join(markets.select("market_id", "event_id", "active", "closed", "resolved"), "market_id", "left")
        .join(events.select("event_id", to_long("end_ts").alias("end_ts"), tag.alias("tag")), "event_id", "left")
        .join(latest, "asset_id", "left")
        .select(
            "asset_id",
            "market_id",
            F.coalesce(F.when(F.col("tag") != "", F.col("tag")), F.lit("unknown")).alias("primary_tag"),
            "latest_ts",
            F.col("latest_ts").isNotNull().alias("has_history"),
            (~F.coalesce("active", F.lit(True)) | yes("closed") | yes("resolved") | F.coalesce(F.col("end_ts") < now_ts, F.lit(False))).alias("is_inactive"),
        )
    )
    coverage = rows.groupBy("primary_tag").agg(F.avg(F.col("has_history").cast("double")).alias("tag_coverage"))
    return rows.join(coverage, "primary_tag").select(*rows.columns, "tag_coverage")


def mark_plan(
    metadata: DataFrame,
    *,
    interval: str,
    global_start_ts: int,
    mode: str = "tail",
    incremental: bool = True,
    overlap_points: int = 2,
    skip_inactive_priced: bool = True,
) -> DataFrame:
    """Adds bucket (existing/new_active/new_inactive or a skipped_* name) and fetch_start_ts."""
    skip_inactive = F.lit(skip_inactive_priced) & F.col("has_history") & F.col("is_inactive")
    skip_existing = F.lit(incremental and mode == "skip") & F.col("has_history")
    bucket = (
        F.when(skip_inactive, "skipped_inactive")
        .when(skip_existing, "skipped_existing")
        .when(F.col("has_history"), "existing")
        .when(F.col("is_inactive"), "new_inactive")
        .otherwise("new_active")
    )
    start = F.lit(global_start_ts).cast("bigint")
    if incremental and mode != "skip":
        overlap = max(0, overlap_points) * interval_seconds(interval)
        start = F.when(F.col("has_history"), F.greatest(start, F.col("latest_ts") - overlap)).otherwise(start)
    return metadata.withColumn("bucket", bucket).withColumn("fetch_start_ts", start)


def _ids(rows: DataFrame) -> list[Column]:
    """What tells the rows of a plan apart: the asset, and its market where that is known."""
    return [F.col(c) for c in ("asset_id", "market_id") if c in rows.columns]


def round_robin(rows: DataFrame, group: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Adds turn: the k-th asset of a tag is taken in the k-th turn; and tag_order, the tag's least coverage."""
    numbered = row_numbers(rows, [*group, "primary_tag"], _ids(rows), "turn", ranges=ranges)
    least = rows.groupBy(*group, "primary_tag").agg(F.min("tag_coverage").alias("tag_order"))
    return numbered.join(least, [*group, "primary_tag"])


def order_plan(plan: DataFrame, priority: str = "history_first", ranges: int | None = None) -> DataFrame:
    """Loadable rows with their 1-based position: existing by watermark, then new active, then new inactive.

    Assets are numbered in ranges of the whole order, so neither one watermark nor ids that begin alike meet in one task.
    """
    rank = F.create_map(*[F.lit(x) for kv in BUCKET_RANK.items() for x in kv])[F.col("bucket")]
    rows = plan.where(F.col("bucket").isin(*BUCKET_RANK)).withColumn("bucket_rank", rank)
    existing = F.col("bucket") == "existing"
    mark = F.when(existing, F.col("latest_ts"))
    if priority == "category_round_robin":
        rows = round_robin(rows, ("bucket_rank",), ranges)
        new = [F.when(~existing, F.col(c)) for c in ("turn", "tag_order", "primary_tag")]
    else:
        new = [F.when(~existing, F.col(c)) for c in ("tag_coverage", "primary_tag")]
    order = [F.col("bucket_rank"), mark, *new, *_ids(rows)]
    cols = [*plan.columns, "bucket_rank"]
    return row_numbers(rows, [], order, "position", ranges=ranges).select(*cols, F.col("position").cast("bigint").alias("position"))


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("bucket").agg(F.count(F.lit(1)).alias("assets"))


def backfill_plan(
    markets: DataFrame,
    tokens: DataFrame,
    bars: DataFrame,
    *,
    interval: str,
    global_start_ts: int,
    mode: str = "tail",
    overlap_points: int = 2,
    seq: str = "seq",
) -> DataFrame:
    """Start of the bar reload per (condition, anchor asset), floored to the interval; ``skip`` leaves out loaded assets."""
    n = interval_seconds(interval)
    rows = (
        markets.where("condition_id is not null")
        .select("market_id", "condition_id")
        .join(anchor_tokens(tokens, seq).select("market_id", "asset_id"), "market_id")
        .join(latest_ts(bars, interval), "asset_id", "left")
    )
    if mode == "skip":
        rows = rows.where("latest_ts is null")
    start = F.greatest(F.lit(global_start_ts).cast("bigint"), F.coalesce(F.col("latest_ts") - overlap_points * n, F.lit(global_start_ts).cast("bigint")))
    return rows.select("condition_id", "asset_id", (start - F.pmod(start, F.lit(n).cast("bigint"))).alias("start_ts"))
