"""Rule signals as column expressions.

A rule maps the signal frame (one row per asset, see ``signal_frame``) to a struct with a reject reason and the trade. All
rules run in one projection over the frame; users register their own with ``SIGNALS[name] = rule``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.functions.scalars import damped_confidence, round_even, tag_from_pattern, to_double, usable_spread
from oddsmill.operators.quality import market_tags
from oddsmill.plans.asof import clean_ticks, last_price
from oddsmill.plans.keep import top_per_group

WIDE_SPREAD = 0.05
OUT = ("direction", "confidence", "entry_price", "target_price", "edge", "metadata_json")


@dataclass(frozen=True)
class Settings:
    """Default thresholds of the rules."""

    convergence_days: int = 2
    volume_surge: float = 2.0
    imbalance_ratio: float = 3.0
    calibration: float = 0.15


def base_rates(resolutions: DataFrame, markets: DataFrame, events: DataFrame) -> DataFrame:
    """Share of Yes among Yes/No resolutions per lower-cased tag."""
    tags = market_tags(markets, events, tag_from_pattern).withColumn("primary_tag", F.lower("primary_tag"))
    return (
        resolutions.where(F.col("resolution_outcome").isin("Yes", "No"))
        .join(tags, "market_id", "left")
        .groupBy(F.coalesce("primary_tag", F.lit("unknown")).alias("primary_tag"))
        .agg(F.avg((F.col("resolution_outcome") == "Yes").cast("double")).alias("base_rate"))
    )


Rule = Callable[[Settings], Column]


@dataclass(frozen=True)
class SeriesRule:
    """A rule that needs aggregates of an asset's ticks (columns ts, price, seq); ``needs`` gives them by column name."""

    rule: Rule
    needs: Callable[[], dict[str, Column]]

    def __call__(self, settings: Settings) -> Column:
        return self.rule(settings)


def declared_aggregates(rules: dict[str, Rule]) -> dict[str, Column]:
    """What all rules together need, each aggregate once; two meanings of one name are an error."""
    found: dict[str, Column] = {}
    for rule in rules.values():
        for name, column in (rule.needs() if isinstance(rule, SeriesRule) else {}).items():
            if str(found.setdefault(name, column)) != str(column):
                raise ValueError(f"rules declare different aggregates named {name}")
    return found


def signal_frame(
    features: DataFrame,
    targets: DataFrame,
    markets: DataFrame,
    events: DataFrame,
    prices: DataFrame,
    bars: DataFrame | None = None,
    rates: DataFrame | None = None,
    rules: dict[str, Rule] | None = None,
) -> DataFrame:
    """One row per target asset with features: market meta, tag, last price, counts and last and mean bar volume.

    What ``rules`` declare about the price series is computed in the grouping that finds the last price.
    """
    clean = clean_ticks(prices)
    extra = [column.alias(name) for name, column in declared_aggregates(rules or {}).items()]
    ticks = clean.groupBy("asset_id").agg(F.count(F.lit(1)).alias("raw_points"), last_price(clean).alias("price"), *extra)
    frame = (
        targets.select("asset_id", "market_id").distinct()
        .join(features, "asset_id")
        .join(markets.select("market_id", "question", "event_id"), "market_id", "left")
        .join(market_tags(markets, events, tag_from_pattern), "market_id", "left")
        .join(ticks, "asset_id", "left")
    )
    if bars is not None:
        volumes = bars.where("volume is not null").groupBy("asset_id").agg(
            F.max_by("volume", "ts").alias("last_volume"), F.avg("volume").alias("mean_volume"), F.count(F.lit(1)).alias("bar_count")
        )
        frame = frame.join(volumes, "asset_id", "left")
    else:
        frame = frame.select(
            "*", F.lit(None).cast("double").alias("last_volume"), F.lit(None).cast("double").alias("mean_volume"),
            F.lit(None).cast("bigint").alias("bar_count"),
        )
    frame = frame.withColumn("primary_tag", F.coalesce("primary_tag", F.lit("unknown")))
    if rates is not None:
        frame = frame.join(rates.withColumnRenamed("primary_tag", "_tag"), F.lower(F.trim("primary_tag")) == F.col("_tag"), "left").drop("_tag")
    else:
        frame = frame.withColumn("base_rate", F.lit(None).cast("double"))
    return frame


def _result(rejects: Sequence[tuple[Column, str]], trade: dict[str, Column], metadata: dict[str, Column]) -> Column:
    """First matching reject reason in order (null = the signal fires) together with the trade."""
    reason = F.lit(None).cast("string")
    for cond, name in reversed(list(rejects)):
        reason = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(reason)
    doc = F.to_json(F.struct(*[c.alias(k) for k, c in metadata.items()]))
    return F.struct(reason.alias("reject_reason"), *[trade[c].alias(c) for c in OUT[:-1]], doc.alias("metadata_json"))


def convergence(s: Settings) -> Column:
    """Price near 0 or 1, shortly before the end, with a confirming slope."""
    p, dtr, slope, spread = F.col("price"), F.col("days_to_resolution"), F.coalesce("slope", F.lit(0.0)), usable_spread("avg_spread")
    high, low = p > 0.85, p < 0.15
    target = F.when(high, 1.0).otherwise(0.0)
    extremity = F.abs(p - 0.5) / 0.5
    edge = F.abs(target - p) - spread
    strength = extremity * (1.0 - dtr / max(1e-9, float(s.convergence_days)))
    return _result(
        [
            (p.isNull(), "missing_price"),
            (~(high | low), "price_not_extreme"),
            (dtr.isNull() | (dtr < 0) | (dtr > s.convergence_days), "out_of_window"),
            (high & (slope <= 0), "slope_contradicts_buy"),
            (low & (slope >= 0), "slope_contradicts_sell"),
            (spread > 0.03, "spread_too_wide"),
            (edge <= 0, "no_edge_after_spread"),
        ],
        {
            "direction": F.when(high, "buy").otherwise("sell"),
            "confidence": damped_confidence(strength, F.col("avg_daily_volume"), F.col("num_points")),
            "entry_price": p,
            "target_price": target,
            "edge": edge,
        },
        {"days_to_resolution": dtr, "slope": slope, "spread": spread, "price_extremity": round_even(extremity, 4)},
    )


def momentum(s: Settings) -> Column:
    """A daily move on surging volume with a confirming buy/sell ratio."""
    p, r, ratio, spread = F.col("price"), F.col("return_1d"), F.col("buy_sell_ratio"), usable_spread("avg_spread")
    last, mean = F.col("last_volume"), F.col("mean_volume")
    up = r > 0
    surge = last / F.greatest(F.lit(1e-9), mean)
    strength = F.least(F.lit(1.0), F.abs(r) / 0.05) * F.least(F.lit(1.0), surge / 5.0)
    edge = F.abs(r) - spread
    return _result(
        [
            (p.isNull(), "missing_price"),
            (F.col("raw_points") < 48, "insufficient_points"),
            (r.isNull() | (F.abs(r) < 0.02), "price_move_too_small"),
            (F.col("bar_count").isNull(), "no_volume_data"),
            (F.col("bar_count") < 5, "insufficient_volume_data"),
            ((mean > 0) & (last < mean * s.volume_surge), "volume_below_surge_threshold"),
            (ratio.isNull(), "missing_buy_sell_ratio"),
            (up & (ratio < 1.3), "bsr_contradicts_buy"),
            ((r < 0) & (ratio > 0.77), "bsr_contradicts_sell"),
            (spread > 0.04, "spread_too_wide"),
            (edge <= 0, "no_edge_after_spread"),
        ],
        {
            "direction": F.when(up, "buy").otherwise("sell"),
            "confidence": damped_confidence(strength, F.col("avg_daily_volume"), F.col("num_points")),
            "entry_price": p,
            "target_price": F.when(up, F.least(F.lit(0.99), p + 0.05)).otherwise(F.greatest(F.lit(0.01), p - 0.05)),
            "edge": edge,
        },
        {"return_1d": round_even(r, 4), "buy_sell_ratio": round_even(ratio, 4), "volume_ratio": round_even(surge, 2), "spread": spread},
    )


def orderbook_imbalance(s: Settings) -> Column:
    """Depth on one side of the book far above the other's."""
    p, spread, volume = F.col("price"), usable_spread("avg_spread"), F.col("avg_daily_volume")
    bid, ask = F.col("avg_bid_depth"), F.col("avg_ask_depth")
    one_sided = (ask <= 0) & (bid > 0)  # an infinite ratio
    ratio = bid / F.nullif(ask, F.lit(0.0))
    buy = one_sided | (ratio > s.imbalance_ratio)
    sell = ~one_sided & (ratio < 1.0 / s.imbalance_ratio)
    effective = F.when(buy, ratio).otherwise(ask / F.nullif(bid, F.lit(0.0)))
    # An infinite ratio, or a sell with no bids at all, counts as full strength and the largest raw edge.
    strength = F.coalesce(F.least(F.lit(1.0), effective / 10.0), F.lit(1.0))
    raw_edge = F.coalesce(F.least(F.lit(0.05), F.abs(effective - 1.0) / F.greatest(F.lit(1.0), effective) * 0.1), F.lit(0.05))
    edge = raw_edge - spread
    return _result(
        [
            (p.isNull(), "missing_price"),
            ((p < 0.10) | (p > 0.90), "price_at_extreme"),
            (bid.isNull() | ask.isNull(), "missing_depth_data"),
            ((bid <= 0) & (ask <= 0), "zero_depth"),
            (~(buy | sell), "imbalance_below_threshold"),
            (spread > 0.03, "spread_too_wide"),
            (volume.isNull() | (volume < 100), "insufficient_volume"),
            (edge <= 0, "no_edge_after_spread"),
        ],
        {
            "direction": F.when(buy, "buy").otherwise("sell"),
            "confidence": damped_confidence(strength, volume, F.col("num_points")),
            "entry_price": p,
            "target_price": F.when(buy, F.least(F.lit(0.95), p + 0.03)).otherwise(F.greatest(F.lit(0.05), p - 0.03)),
            "edge": edge,
        },
        {
            "bid_depth": round_even(bid, 2),
            "ask_depth": round_even(ask, 2),
            "imbalance_ratio": F.when(one_sided, 999.0).otherwise(round_even(ratio, 2)),
            "spread": spread,
            "avg_daily_volume": round_even(volume, 0),
        },
    )


def calibration(s: Settings) -> Column:
    """Price far from the tag's base rate; offered, but not active unless it is asked for."""
    p, rate = F.col("price"), F.col("base_rate")
    diff = rate - p
    return _result(
        [
            (p.isNull(), "missing_price"),
            (rate.isNull(), "missing_base_rate"),
            (F.abs(diff) < s.calibration, "threshold_fail"),
        ],
        {
            "direction": F.when(diff > 0, "buy").otherwise("sell"),
            "confidence": F.least(F.lit(1.0), F.abs(diff)),
            "entry_price": p,
            "target_price": rate,
            "edge": F.greatest(F.lit(0.0), F.abs(diff) - s.calibration),
        },
        {"base_rate": rate, "tag": F.lower(F.trim("primary_tag")), "threshold": F.lit(float(s.calibration)), "price_diff": diff},
    )


SIGNALS: dict[str, Rule] = {"convergence": convergence, "momentum": momentum, "orderbook_imbalance": orderbook_imbalance}
OPTIONAL_SIGNALS: dict[str, Rule] = {"calibration": calibration}
# The names signals are stored under.
STORED_NAMES = {
    "convergence": "resolution_convergence",
    "momentum": "momentum_breakout",
    "orderbook_imbalance": "orderbook_imbalance",
    "calibration": "calibration_mispricing",
}


def range_reversal(s: Settings) -> Column:
    """Price at an end of its own range: back to the mean of the series."""
    p, low, high, mean = F.col("price"), F.col("series_low"), F.col("series_high"), F.col("series_mean")
    width = high - low
    place = (p - low) / F.nullif(width, F.lit(0.0))
    return _result(
        [
            (p.isNull(), "missing_price"),
            (width < 0.05, "range_too_small"),
            ((place > 0.1) & (place < 0.9), "price_inside_range"),
        ],
        {
            "direction": F.when(place >= 0.9, "sell").otherwise("buy"),
            "confidence": F.least(F.lit(1.0), F.abs(place - 0.5) * 2),
            "entry_price": p,
            "target_price": mean,
            "edge": F.abs(mean - p),
        },
        {"low": low, "high": high, "mean": mean},
    )


# Rules over the series are offered in the same way, active only if asked for.
OPTIONAL_SIGNALS["range_reversal"] = SeriesRule(range_reversal, lambda: {
    "series_low": F.min("price"), "series_high": F.max("price"), "series_mean": F.avg("price")})


def active_rules(requested: Sequence[str] = ("all",), extra: dict[str, Rule] | None = None) -> dict[str, Rule]:
    """Rules by name; 'all' or nothing asks for the registered ones, unknown names are left out."""
    wanted = [r.strip().lower() for r in requested if r and r.strip()]
    registry = {**SIGNALS, **(extra or {})}
    if not wanted or "all" in wanted:
        return registry
    known = {**registry, **OPTIONAL_SIGNALS}
    return {name: known[name] for name in wanted if name in known}


def evaluate(frame: DataFrame, rules: dict[str, Rule] | None = None, settings: Settings = Settings()) -> DataFrame:
    """One row per asset and rule: signal, reason (null = fired), considered and the trade columns."""
    rules = rules if rules is not None else active_rules()
    wide = F.coalesce(F.col("avg_spread") > WIDE_SPREAD, F.lit(False))
    results = F.array(
        *[F.struct(F.lit(name).alias("signal"), rule(settings).alias("r")) for name, rule in rules.items()]
    )
    rows = frame.select("asset_id", "market_id", "primary_tag", wide.alias("wide"), F.col("price").isNull().alias("unpriced"), F.inline(results))
    reason = (
        F.when(F.col("wide"), "spread_too_wide").when(F.col("unpriced"), "missing_price_history").otherwise(F.col("r.reject_reason"))
    )
    return rows.select(
        "signal", "asset_id", "market_id", "primary_tag", (~F.col("wide")).alias("considered"), reason.alias("reason"),
        *[F.when(reason.isNull(), F.col(f"r.{c}")).alias(c) for c in OUT],
    )


def fired(evaluated: DataFrame, as_of_ts: int) -> DataFrame:
    """Signal records of the rules that fired."""
    names = F.create_map(*[F.lit(x) for kv in STORED_NAMES.items() for x in kv])
    return evaluated.where("reason is null").select(
        F.coalesce(names[F.col("signal")], F.col("signal")).alias("signal_name"),
        "asset_id",
        "market_id",
        F.lit(as_of_ts).cast("bigint").alias("ts"),
        *OUT,
    )


def diagnostics(evaluated: DataFrame) -> DataFrame:
    """signal, key, n: assets considered, generated, and rejected by reason."""
    by_reason = evaluated.groupBy("signal", F.coalesce("reason", F.lit("generated")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    considered = evaluated.where("considered").groupBy("signal").agg(F.count(F.lit(1)).alias("n"))
    return by_reason.unionByName(considered.select("signal", F.lit("considered").alias("key"), "n"))


def diagnostic_samples(evaluated: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` assets per signal and reason."""
    rows = evaluated.select("signal", F.coalesce("reason", F.lit("generated")).alias("key"), "asset_id", "market_id", "primary_tag")
    return top_per_group(rows, ["signal", "key"], [F.col("asset_id"), F.col("market_id")], limit).drop("rank")


def _tenth(x: Column) -> Column:
    """x to one digit as the printed binary value rounds: 2.05 is below its decimal tie and gives 2.0.

    The sign of 20 x - (2 k + 1) decides; both steps of it are exact in doubles.
    """
    k = F.floor(x * 10.0)
    beyond = (x * 16.0 - (k * 2 + 1)) + x * 4.0
    up = (beyond > 0) | ((beyond == 0) & (k % 2 != 0))
    return (k + F.when(up, 1).otherwise(0)) / 10.0


def explanation(signal_name: Column, direction: Column, edge: Column, metadata_json: Column) -> Column:
    """A sentence per signal; an unknown signal gets the general one."""
    def num(path: str) -> Column:
        return F.coalesce(F.get_json_object(metadata_json, f"$.{path}").try_cast("double"), F.lit(0.0))

    towards = F.when(direction == "buy", "1.0").otherwise("0.0")
    return (
        F.when(
            signal_name == "resolution_convergence",
            F.format_string("Market %.1fd from resolution, price near %s.", _tenth(num("days_to_resolution")), towards),
        )
        .when(
            signal_name == "momentum_breakout",
            F.format_string(
                "Price moved %+.1f%% on %.1fx avg volume; momentum %s.", _tenth(num("return_1d") * F.lit(100.0)), _tenth(num("volume_ratio")), direction
            ),
        )
        .when(signal_name == "orderbook_imbalance", F.format_string("Orderbook imbalance %.1fx favors %s.", _tenth(num("imbalance_ratio")), direction))
        .when(
            signal_name == "calibration_mispricing",
            F.format_string(
                "Base rate for %s is %.3f; price dislocation suggests %s (edge %.3f).",
                F.coalesce(F.get_json_object(metadata_json, "$.tag"), F.lit("unknown")), num("base_rate"), direction, edge,
            ),
        )
        .otherwise(F.format_string("%s generated %s with edge %.3f", signal_name, direction, edge))
    )
