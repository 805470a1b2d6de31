"""Forward returns per observation and the price hypotheses tested on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from oddsmill.functions.scalars import to_double, to_long
from oddsmill.plans.asof import canonical_ticks, haloed
from oddsmill.plans.quantiles import exact_quantiles
from oddsmill.session import stored
from oddsmill.schemas import DAY

# Horizons in hours and how late a price may come to count for one.
HORIZONS = (1, 6, 24, 72, 168)
TOLERANCE = 7200
CHUNK = 30 * DAY


def forward_returns(
    prices: DataFrame, features: DataFrame | None = None, *, max_spread: float = 0.03, min_points: int = 24, chunk: int = CHUNK
) -> DataFrame:
    """Per observation: return over the last day and forward returns, each to the first price less than two hours late.

    Evaluated in chunks of time with the neighbours' ticks copied in (about a quarter of the rows at 30-day chunks). Inside a
    chunk ticks and the times asked for are walked once, newest first, carrying the last tick seen: the cost is linear in the
    ticks however dense they are. One shuffle on (asset, chunk) serves the walk and the grouping after it, and no window runs
    over a whole asset; ticks are unique per second, which bounds a chunk.
    """
    rows = prices.select(
        F.col("asset_id").cast("string").alias("asset_id"), to_long("ts").alias("ts"), to_double("price").alias("price"),
        *([F.col("seq")] if "seq" in prices.columns else []),
    ).where("ts is not null and price is not null")
    if features is not None:
        tight = features.where(F.col("avg_spread") <= max_spread).select("asset_id").distinct()
        rows = rows.join(tight, "asset_id", "left_semi")
    enough = rows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).select("asset_id")
    ticks = haloed(canonical_ticks(rows).join(enough, "asset_id", "left_semi"), DAY, max(HORIZONS) * 3600 + TOLERANCE, chunk)
    offsets = {"back": -DAY, **{f"at_{h}h": h * 3600 for h in HORIZONS}}
    # Kind 0 is the tick itself, the others are the times asked for by the rows that belong to the chunk.
    asked = [F.when(F.col("_core"), F.struct(F.lit(k).alias("kind"), (F.col("ts") + by).alias("at"))) for k, by in enumerate(offsets.values(), 1)]
    both = F.array_compact(F.array(F.struct(F.lit(0).alias("kind"), F.col("ts").alias("at")), *asked))
    walked = ticks.repartition("asset_id", "_chunk").select("asset_id", "_chunk", "_core", "ts", "price", F.inline(both))
    newest_first = Window.partitionBy("asset_id", "_chunk").orderBy(F.col("at").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)

    def last_tick(c: str) -> Column:
        return F.last(F.when(F.col("kind") == 0, F.col(c)), ignorenulls=True).over(newest_first)

    in_time = F.col("_ts") < F.col("at") + TOLERANCE
    seen = (
        walked.withColumn("_ts", last_tick("ts")).withColumn("_price", last_tick("price"))
        .where("_core")
        .groupBy("asset_id", "_chunk", "ts")
        .agg(
            F.max("price").alias("price"),
            *[F.max(F.when((F.col("kind") == k) & in_time, F.col("_price"))).alias(name) for k, name in enumerate(offsets, 1)],
        )
    )
    return seen.select(
        "asset_id", "ts", "price", (F.col("price") - F.col("back")).alias("return_1d"),
        *[(F.col(f"at_{h}h") - F.col("price")).alias(f"fwd_{h}h") for h in HORIZONS],
    )


def _long(returns: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per observation, rule it meets and horizon with a forward move: rule, horizon_hours, move, side."""
    named = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull())
    moves = F.array(*[F.struct(F.lit(h).alias("horizon_hours"), F.col(f"fwd_{h}h").alias("move")) for h in HORIZONS])
    return (
        returns.select(F.explode(named).alias("rule"), "return_1d", moves.alias("_m"))
        .select("rule", "return_1d", F.inline("_m"))
        .where("move is not null")
        .withColumn("side", F.when(F.col("return_1d") > 0, 1).when(F.col("return_1d") < 0, -1))
    )


def threshold_rules() -> list[tuple[str, Column]]:
    p = F.col("price")
    return [("above_0.85", p > 0.85), ("above_0.90", p > 0.90), ("below_0.15", p < 0.15), ("below_0.05", p < 0.05)]


def momentum_rules() -> list[tuple[str, Column]]:
    move = F.abs(F.col("return_1d"))
    return [("move_2pct", move > 0.02), ("move_5pct", move > 0.05)]


def threshold_hypotheses(returns: DataFrame) -> DataFrame:
    """n, share up, share down, mean and exact median of the forward move per price rule and horizon."""
    rows = stored(_long(returns, threshold_rules()))
    keys = ["rule", "horizon_hours"]
    n = F.count(F.lit(1))
    stats = rows.groupBy(*keys).agg(
        n.alias("n"),
        (F.count_if(F.col("move") > 0) / n).alias("share_up"),
        (F.count_if(F.col("move") < 0) / n).alias("share_down"),
        F.avg("move").alias("mean_move"),
    )
    return stats.join(exact_quantiles(rows, keys, "move", {"median_move": 0.5}), keys)


def momentum_hypotheses(returns: DataFrame) -> DataFrame:
    """Continuation and reversion after a daily move, overall and by its direction."""
    rows = _long(returns, momentum_rules()).withColumn("along", F.col("move") * F.col("side"))
    up, down, n = F.col("side") == 1, F.col("side") == -1, F.count(F.lit(1))

    def share(cond: Column, of: Column) -> Column:
        return F.coalesce(F.count_if(cond & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))

    return rows.groupBy("rule", "horizon_hours").agg(
        n.alias("n"),
        (F.count_if(F.col("along") > 0) / n).alias("continuation"),
        (F.count_if(F.col("along") < 0) / n).alias("reversion"),
        share(F.col("move") > 0, up).alias("up_continuation"),
        share(F.col("move") < 0, down).alias("down_continuation"),
        F.avg("move").alias("mean_move"),
    )


def net_edge(returns: DataFrame, spread: float = 0.03) -> DataFrame:
    """Mean move in the rule's direction less the spread, and the share of trades that beat it."""
    p, r = F.col("price"), F.col("return_1d")
    rows = _long(returns, [("convergence_buy", p > 0.85), ("convergence_sell", p < 0.15), ("momentum", F.abs(r) > 0.02)])
    gain = (
        F.when(F.col("rule") == "convergence_buy", F.col("move"))
        .when(F.col("rule") == "convergence_sell", -F.col("move"))
        .otherwise(F.col("move") * F.col("side"))
    )
    n = F.count(F.lit(1))
    return rows.withColumn("gain", gain).groupBy("rule", "horizon_hours").agg(
        n.alias("n"),
        F.avg("gain").alias("mean_gain"),
        (F.avg("gain") - spread).alias("net_after_spread"),
        (F.count_if(F.col("gain") > spread) / n).alias("profitable"),
    )
