"""Settlement of signals at resolution and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from oddsmill.functions.scalars import position_size, to_double, to_long, unit_trade
from oddsmill.operators.bars import median_spread
from oddsmill.plans.keep import keep_first
from oddsmill.plans.quantiles import exact_quantiles
from oddsmill.session import stored
from oddsmill.schemas import DAY


def with_spread(rows: DataFrame, books: DataFrame | None, assumption: float) -> DataFrame:
    if books is None:
        return rows.withColumn("used_spread", F.lit(float(assumption)))
    joined = rows.join(median_spread(books), "asset_id", "left")
    return joined.withColumn("used_spread", F.coalesce("median_spread", F.lit(float(assumption)))).drop("median_spread")


def settle_at_resolution(
    signals: DataFrame,
    resolutions: DataFrame,
    books: DataFrame | None = None,
    *,
    start_ts: int | None = None,
    end_ts: int | None = None,
    bankroll: float = 10_000.0,
    spread_assumption: float = 0.03,
    timeout_days: int = 90,
    sizing_mode: str = "flat",
    kelly: float = 0.25,
    max_position_pct: float = 0.05,
    min_position_size: float = 1.0,
    flat_position_size: float = 100.0,
) -> DataFrame:
    """The earliest signal per (market, signal) settled at its Yes/No resolution or at the timeout, on a fixed bankroll."""
    rows = signals.select(
        F.col("signal_name").cast("string").alias("signal_name"),
        F.col("asset_id").cast("string").alias("asset_id"),
        F.col("market_id").cast("string").alias("market_id"),
        F.lower("direction").alias("direction"),
        to_long("ts").alias("entry_ts"),
        to_double("entry_price").alias("entry_price"),
        F.coalesce(to_double("confidence"), F.lit(0.0)).alias("confidence"),
    ).where("entry_ts is not null and entry_price is not null")
    if start_ts is not None:
        rows = rows.where(F.col("entry_ts") >= start_ts)
    if end_ts is not None:
        rows = rows.where(F.col("entry_ts") <= end_ts)
    outcome = F.col("resolution_outcome")
    rows = rows.join(
        resolutions.where(outcome.isin("Yes", "No")).select("market_id", "resolution_outcome", to_long("resolution_ts").alias("resolution_ts")),
        "market_id",
    )
    first = keep_first(
        rows, ["market_id", "signal_name"], [F.col("entry_ts"), F.col("asset_id"), F.col("entry_price"), F.col("confidence")]
    ).where(F.col("direction").isin("buy", "sell"))
    first = with_spread(first, books, spread_assumption)
    timeout = F.col("entry_ts") + timeout_days * DAY
    late = F.col("resolution_ts").isNull() | (F.col("resolution_ts") > timeout)
    exit_price = F.when(outcome == "Yes", 1.0).otherwise(0.0)
    cost, unit, ret = unit_trade(F.col("direction"), F.col("entry_price"), exit_price, F.col("used_spread"))
    entry = F.when(F.col("direction") == "buy", F.col("entry_price")).otherwise(1.0 - F.col("entry_price"))
    raw, size = position_size(
        sizing_mode, F.lit(float(bankroll)), F.col("confidence"), entry,
        flat=flat_position_size, fraction=kelly, max_pct=max_position_pct, minimum=min_position_size,
    )
    return (
        first.withColumn("position_size", size)
        .where("position_size > 0")
        .select(
            "signal_name",
            "asset_id",
            "market_id",
            F.when(F.col("direction") == "buy", "long").otherwise("short").alias("direction"),
            "entry_ts",
            "entry_price",
            cost.alias("entry_cost"),
            F.when(late, timeout).otherwise(F.col("resolution_ts")).alias("exit_ts"),
            exit_price.alias("exit_price"),
            F.when(late, "timeout").otherwise("resolution").alias("exit_reason"),
            (unit * F.col("position_size")).alias("pnl"),
            ret.alias("return_pct"),
            ((F.when(late, timeout).otherwise(F.col("resolution_ts")) - F.col("entry_ts")) / float(DAY)).alias("hold_days"),
            raw.alias("kelly_fraction"),
            "position_size",
            F.lit(float(bankroll)).alias("bankroll_at_entry"),
        )
    )


def summarize(trades: DataFrame) -> DataFrame:
    """One row per signal and one overall row (signal_name null).

    Trades are first summed per (signal, day); drawdown and Sharpe ratio then run over at most one row per day. A profit
    factor without losses is infinite, as is usual.
    """
    pnl = F.coalesce(to_double("pnl"), F.lit(0.0))
    rows = trades.select("signal_name", pnl.alias("pnl"), F.col("hold_days"), F.floor(F.col("exit_ts") / DAY).alias("day"))
    rows = stored(rows)
    # Two levels per trade: its own signal and the overall row.
    both = rows.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "signal_name", F.when(F.col("level") == 0, F.col("signal_name"))
    )
    days = both.groupBy("level", "signal_name", "day").agg(
        F.sum("pnl").alias("day_pnl"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pnl") > 0).alias("wins"),
        F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)).alias("profits"),
        F.sum(F.when(F.col("pnl") < 0, F.col("pnl")).otherwise(0.0)).alias("losses"),
        F.sum("hold_days").alias("held"),
        F.count("hold_days").alias("held_n"),
    )
    path = Window.partitionBy("level", "signal_name").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    equity = days.withColumn("equity", F.sum("day_pnl").over(path)).withColumn("peak", F.max("equity").over(path))
    n, losses, profits, std = F.sum("n"), F.sum("losses"), F.sum("profits"), F.stddev_pop("day_pnl")
    totals = equity.groupBy("level", "signal_name").agg(
        n.alias("total_trades"),
        (F.sum("wins") / n).alias("win_rate"),
        (F.sum("day_pnl") / n).alias("avg_pnl"),
        F.sum("day_pnl").alias("total_pnl"),
        F.min(F.col("equity") - F.col("peak")).alias("max_drawdown"),
        F.when(std > 0, F.avg("day_pnl") / F.nullif(std, F.lit(0.0)) * float(365.0**0.5)).otherwise(0.0).alias("sharpe_ratio"),
        (F.sum("held") / F.nullif(F.sum("held_n"), F.lit(0))).alias("avg_hold_days"),
        F.when(losses < 0, profits / F.nullif(F.abs(losses), F.lit(0.0)))
        .when(profits > 0, F.lit(float("inf")))
        .otherwise(0.0)
        .alias("profit_factor"),
    )
    medians = exact_quantiles(both, ["level", "signal_name"], "pnl", {"median_pnl": 0.5})
    same = (F.col("t.level") == F.col("m.level")) & F.col("t.signal_name").eqNullSafe(F.col("m.signal_name"))
    return totals.alias("t").join(medians.alias("m"), same).select("t.*", "m.median_pnl").drop("level")
