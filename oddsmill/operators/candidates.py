"""Ranked trade candidates from accumulated signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from oddsmill.functions.scalars import position_size, to_double
from oddsmill.operators.bars import last_book
from oddsmill.operators.signals import explanation
from oddsmill.plans.keep import keep_last


def trade_candidates(
    signals: DataFrame,
    markets: DataFrame,
    features: DataFrame,
    *,
    quality: DataFrame | None = None,
    books: DataFrame | None = None,
    clusters: DataFrame | None = None,
    bankroll: float = 10_000.0,
    run_date: str,
    min_confidence: float = 0.55,
    min_edge: float = 0.05,
    max_candidates: int = 20,
    kelly: float = 0.25,
    max_position_pct: float = 0.05,
    min_position_size: float = 1.0,
) -> DataFrame:
    """Top candidates by expected value, with size and reasoning; the limit is the report's length."""
    rows = (
        signals.withColumn("confidence", to_double("confidence"))
        .withColumn("edge", to_double("edge"))
        .withColumn("entry_price", to_double("entry_price"))
        .where((F.col("confidence") >= min_confidence) & (F.col("edge") >= min_edge) & F.col("entry_price").isNotNull())
        .join(markets.select("market_id", "question", to_double("liquidity").alias("liquidity")), "market_id", "left")
        .join(features.select("asset_id", "days_to_resolution", "num_points"), "asset_id", "left")
        .where(F.coalesce("num_points", F.lit(0)) >= 7)
    )
    if quality is not None:
        rows = rows.join(quality.where("quality_pass").select("asset_id").distinct(), "asset_id", "left_semi")
    if books is not None:
        rows = rows.join(last_book(books), "asset_id", "left").where("spread_pct is null or spread_pct <= 0.10")
    else:
        rows = rows.select("*", F.lit(None).cast("double").alias("spread"), F.lit(None).cast("double").alias("spread_pct"))
    if clusters is not None:
        one = keep_last(clusters.select("asset_id", "cluster_id"), ["asset_id"], ["cluster_id"])
        rows = rows.join(one, "asset_id", "left")
    else:
        rows = rows.withColumn("cluster_id", F.lit(None).cast("int"))
    direction = F.lower("direction")
    entry = F.when(direction == "buy", F.col("entry_price")).otherwise(1.0 - F.col("entry_price"))
    raw, size = position_size(
        "kelly", F.lit(float(bankroll)), F.col("confidence"), entry, fraction=kelly, max_pct=max_position_pct, minimum=min_position_size
    )
    priced = (
        rows.withColumn("direction", direction)
        .withColumn("suggested_size", size)
        .withColumn("kelly_fraction", raw)
        .where("suggested_size > 0")
        .withColumn("expected_value", F.col("edge") * F.col("confidence"))
    )
    order = [F.desc("expected_value"), F.desc("edge"), F.desc("confidence"), F.col("signal_name"), F.col("asset_id"), F.col("ts")]
    best = priced.orderBy(*order).limit(max_candidates)
    # The window covers at most max_candidates rows.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(
        "rank", F.lit(run_date).alias("run_date"), "market_id", "asset_id", "question", F.col("entry_price").alias("current_price"),
        "signal_name", "direction", "confidence", "edge", "expected_value", "suggested_size", "kelly_fraction", "spread",
        "spread_pct", "liquidity", "days_to_resolution", "cluster_id",
        explanation(F.col("signal_name"), F.col("direction"), F.col("edge"), F.col("metadata_json")).alias("reasoning"), "ts",
    )
