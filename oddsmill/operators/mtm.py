"""Mark-to-market evaluation of signals at fixed horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from oddsmill.functions.scalars import to_double, to_long, unit_trade
from oddsmill.operators.settle import with_spread
from oddsmill.plans.asof import canonical_ticks, next_tick
from oddsmill.plans.quantiles import exact_quantiles
from oddsmill.session import stored

HORIZONS = (1, 6, 24, 72, 168)
# Signals that are no longer produced.
RETIRED = ("mean_reversion_spike", "calibration_mispricing")


def without_retired(signals: DataFrame, retired: Sequence[str] = RETIRED) -> DataFrame:
    return signals.where(~F.col("signal_name").isin(*retired))


def signal_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal_name").agg(F.count(F.lit(1)).alias("signals"))


def mark_to_market(
    signals: DataFrame,
    prices: DataFrame,
    books: DataFrame | None = None,
    *,
    horizons: Sequence[int] = HORIZONS,
    spread_assumption: float = 0.03,
    flat_position_size: float = 100.0,
) -> DataFrame:
    """One row per signal and horizon: profit against the first price at or after entry + horizon."""
    rows = (
        signals.select(
            "signal_name",
            F.col("asset_id").cast("string").alias("asset_id"),
            F.coalesce(F.col("market_id").cast("string"), F.lit("")).alias("market_id"),
            F.lower(F.coalesce("direction", F.lit("buy"))).alias("direction"),
            F.coalesce(to_double("confidence"), F.lit(0.0)).alias("confidence"),
            F.coalesce(to_double("edge"), F.lit(0.0)).alias("edge"),
            to_long("ts").alias("entry_ts"),
            to_double("entry_price").alias("entry_price"),
        )
        .where("entry_ts is not null and entry_price is not null")
        .withColumn("horizon_hours", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .withColumn("target_ts", F.col("entry_ts") + F.col("horizon_hours") * 3600)
    )
    exits = next_tick(rows, canonical_ticks(prices)).where("exit_ts is not null")
    marked = with_spread(rows.join(exits, ["asset_id", "target_ts"]), books, spread_assumption)
    cost, unit, ret = unit_trade(F.col("direction"), F.col("entry_price"), F.col("exit_price"), F.col("used_spread"))
    move = F.col("exit_price") - F.col("entry_price")
    return marked.select(
        "signal_name", "asset_id", "market_id", "direction", "confidence", "edge", "entry_ts", "entry_price", "exit_ts", "exit_price",
        "horizon_hours",
        F.when(F.col("direction") == "buy", move).otherwise(-move).alias("price_move"),
        (unit * flat_position_size).alias("pnl"),
        ret.alias("return_pct"),
        F.lit(float(flat_position_size)).alias("position_size"),
    )


def mtm_stats(marked: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Statistics per horizon, per signal and horizon, per signal at the shortest horizon and overall at the shortest.

    Every row counts once per level it belongs to; the aggregation combines in the map tasks and the medians are exact
    without gathering a level in one task.
    """
    shortest = min(horizons)
    levels = F.array(
        F.struct(F.lit("by_horizon").alias("level"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit("by_signal_horizon").alias("level"), F.col("signal_name").alias("name")),
    )
    at_shortest = F.array(
        F.struct(F.lit("by_signal").alias("level"), F.col("signal_name").alias("name")),
        F.struct(F.lit("aggregate").alias("level"), F.lit(None).cast("string").alias("name")),
    )
    marked = stored(marked.select("signal_name", "horizon_hours", "price_move", "pnl", "return_pct"))
    rows = marked.select(
        F.inline(F.when(F.col("horizon_hours") == shortest, F.concat(levels, at_shortest)).otherwise(levels)),
        "horizon_hours", "price_move", "pnl", "return_pct",
    )
    keys = ["level", "name", "horizon_hours"]
    n, std = F.count(F.lit(1)), F.stddev_pop("pnl")
    stats = rows.groupBy(*keys).agg(
        n.alias("trades"),
        (F.count_if(F.col("price_move") > 0) / n).alias("hit_rate"),
        F.avg("price_move").alias("avg_price_move"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("avg_pnl"),
        (F.count_if(F.col("pnl") > 0) / n).alias("win_rate"),
        F.avg("return_pct").alias("avg_return_pct"),
        F.when(std > 0, F.avg("pnl") / F.nullif(std, F.lit(0.0)) * float(365.0**0.5)).otherwise(0.0).alias("sharpe"),
        F.max("pnl").alias("best_trade"),
        F.min("pnl").alias("worst_trade"),
    )
    medians = exact_quantiles(rows, keys, "price_move", {"median_price_move": 0.5})
    same = (
        (F.col("s.level") == F.col("m.level"))
        & F.col("s.name").eqNullSafe(F.col("m.name"))
        & (F.col("s.horizon_hours") == F.col("m.horizon_hours"))
    )
    return stats.alias("s").join(medians.alias("m"), same).select("s.*", "m.median_price_move")


# Digits each statistic is reported with.
DIGITS = {
    "hit_rate": 4, "avg_price_move": 6, "median_price_move": 6, "total_pnl": 2, "avg_pnl": 4, "win_rate": 4,
    "avg_return_pct": 4, "sharpe": 4, "best_trade": 2, "worst_trade": 2,
}


def mtm_summary(marked: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return mtm_stats(marked, horizons).withColumns({c: F.bround(c, d) for c, d in DIGITS.items()})
