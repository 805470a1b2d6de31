import json
import random

import pytest
from pyspark.sql import functions as F

from oddsmill.operators import audit, candidates, clusters, explore, health, relationships, settle, signals

DAY = 86_400
FRAME = (
    "asset_id string, market_id string, primary_tag string, price double, raw_points bigint, num_points bigint, days_to_resolution double, slope double, "
    "avg_spread double, avg_daily_volume double, return_1d double, buy_sell_ratio double, avg_bid_depth double, avg_ask_depth double, "
    "last_volume double, mean_volume double, bar_count bigint, base_rate double"
)
NAMES = [c.split()[0] for c in FRAME.split(", ")]
BASE = dict(asset_id="a", market_id="m", primary_tag="Sports", price=0.5, raw_points=100, num_points=100, days_to_resolution=1.0, slope=0.0,
            avg_spread=0.01, avg_daily_volume=500.0, return_1d=0.0, buy_sell_ratio=1.0, avg_bid_depth=100.0, avg_ask_depth=100.0,
            last_volume=10.0, mean_volume=10.0, bar_count=10, base_rate=0.5)


def run(spark, rule, *changes):
    rows = [tuple({**BASE, **c, "asset_id": str(i)}[n] for n in NAMES) for i, c in enumerate(changes)]
    known = {**signals.SIGNALS, **signals.OPTIONAL_SIGNALS}
    out = signals.evaluate(spark.createDataFrame(rows, FRAME), {rule: known[rule]})
    return [r for _, r in sorted((int(r["asset_id"]), r) for r in out.collect())]


HIGH = dict(price=0.9, slope=0.01)
MOVE = dict(return_1d=0.06, last_volume=50.0, buy_sell_ratio=2.0)
DEEP = dict(avg_bid_depth=500.0)
REJECTS = [
    ("convergence", {}, "price_not_extreme"), ("convergence", dict(price=0.85), "price_not_extreme"),
    ("convergence", {**HIGH, "days_to_resolution": None}, "out_of_window"), ("convergence", {**HIGH, "days_to_resolution": -0.1}, "out_of_window"),
    ("convergence", {**HIGH, "days_to_resolution": 2.1}, "out_of_window"), ("convergence", {**HIGH, "slope": 0.0}, "slope_contradicts_buy"),
    ("convergence", dict(price=0.1, slope=0.1), "slope_contradicts_sell"), ("convergence", {**HIGH, "avg_spread": 0.04}, "spread_too_wide"),
    ("convergence", {**HIGH, "price": 0.995}, "no_edge_after_spread"), ("convergence", {**HIGH, "price": None}, "missing_price_history"),
    ("convergence", {**HIGH, "avg_spread": 0.06}, "spread_too_wide"),
    ("momentum", dict(raw_points=47), "insufficient_points"), ("momentum", dict(return_1d=None), "price_move_too_small"),
    ("momentum", dict(return_1d=0.019), "price_move_too_small"), ("momentum", {**MOVE, "bar_count": None}, "no_volume_data"),
    ("momentum", {**MOVE, "bar_count": 4}, "insufficient_volume_data"), ("momentum", {**MOVE, "last_volume": 19.0}, "volume_below_surge_threshold"),
    ("momentum", {**MOVE, "buy_sell_ratio": None}, "missing_buy_sell_ratio"), ("momentum", {**MOVE, "buy_sell_ratio": 1.2}, "bsr_contradicts_buy"),
    ("momentum", {**MOVE, "return_1d": -0.06}, "bsr_contradicts_sell"), ("momentum", {**MOVE, "avg_spread": 0.045}, "spread_too_wide"),
    ("momentum", {**MOVE, "return_1d": 0.025, "avg_spread": 0.03}, "no_edge_after_spread"),
    ("orderbook_imbalance", {**DEEP, "price": 0.05}, "price_at_extreme"), ("orderbook_imbalance", dict(avg_ask_depth=None), "missing_depth_data"),
    ("orderbook_imbalance", dict(avg_bid_depth=0.0, avg_ask_depth=0.0), "zero_depth"), ("orderbook_imbalance", {}, "imbalance_below_threshold"),
    ("orderbook_imbalance", {**DEEP, "avg_spread": 0.04}, "spread_too_wide"), ("orderbook_imbalance", {**DEEP, "avg_daily_volume": 99.0}, "insufficient_volume"),
    ("calibration", dict(base_rate=None), "missing_base_rate"), ("calibration", dict(base_rate=0.6), "threshold_fail"),
]


@pytest.mark.parametrize("rule", ["convergence", "momentum", "orderbook_imbalance", "calibration"])
def test_reject_reasons(spark, rule):
    mine = [(c, reason) for r, c, reason in REJECTS if r == rule]
    assert [r["reason"] for r in run(spark, rule, *[c for c, _ in mine])] == [reason for _, reason in mine]


def test_fired(spark):
    buy, sell = run(spark, "convergence", HIGH, dict(price=0.1, slope=-0.1, days_to_resolution=0.5, avg_spread=None))
    assert (buy["direction"], buy["target_price"], buy["confidence"]) == ("buy", 1.0, 0.4) and buy["edge"] == pytest.approx(0.09)
    assert (sell["direction"], sell["target_price"], sell["confidence"]) == ("sell", 0.0, 0.6) and sell["edge"] == pytest.approx(0.07)
    assert json.loads(buy["metadata_json"]) == {"days_to_resolution": 1.0, "slope": 0.01, "spread": 0.01, "price_extremity": 0.8}
    buy, sell = run(spark, "momentum", MOVE, {**MOVE, "return_1d": -0.03, "buy_sell_ratio": 0.5, "price": 0.03})
    assert (buy["direction"], buy["confidence"], buy["target_price"]) == ("buy", 0.8, 0.55) and buy["edge"] == pytest.approx(0.05)
    assert (sell["direction"], sell["target_price"], sell["confidence"]) == ("sell", 0.01, 0.6)
    buy, sell, one = run(spark, "orderbook_imbalance", DEEP, dict(avg_ask_depth=400.0), dict(avg_ask_depth=0.0))
    assert (buy["direction"], buy["confidence"]) == ("buy", 0.5) and buy["edge"] == pytest.approx(0.04) and sell["direction"] == "sell"
    assert (one["direction"], one["confidence"], json.loads(one["metadata_json"])["imbalance_ratio"]) == ("buy", 0.8, 999.0)
    (low,) = run(spark, "calibration", dict(base_rate=0.8))
    assert (low["direction"], low["target_price"]) == ("buy", 0.8) and low["edge"] == pytest.approx(0.15)


def test_registry_and_user_rules(spark):
    assert list(signals.active_rules()) == ["convergence", "momentum", "orderbook_imbalance"]
    assert list(signals.active_rules([" Momentum", "nope", "calibration"])) == ["momentum", "calibration"]

    def cheap(_):
        return signals._result([(F.col("price") > 0.2, "not_cheap")], {c: F.lit("buy") if c == "direction" else F.col("price") for c in signals.OUT[:-1]}, {"p": F.col("price")})

    rules = signals.active_rules(extra={"cheap": cheap})
    rows = [tuple({**BASE, "asset_id": "x", "price": 0.1}[n] for n in NAMES)]
    out = signals.fired(signals.evaluate(spark.createDataFrame(rows, FRAME), rules), 7).collect()
    assert [(r["signal_name"], r["ts"]) for r in out if r["signal_name"] == "cheap"] == [("cheap", 7)]


def test_diagnostics(spark):
    rows = [tuple({**BASE, "asset_id": str(i), "avg_spread": 0.2 if i == 3 else 0.01}[n] for n in NAMES) for i in range(4)]
    out = signals.evaluate(spark.createDataFrame(rows, FRAME), {"convergence": signals.convergence})
    got = {r["key"]: r["n"] for r in signals.diagnostics(out).collect()}
    assert got == {"considered": 3, "price_not_extreme": 3, "spread_too_wide": 1}
    assert signals.diagnostic_samples(out, 2).count() == 3


@pytest.mark.parametrize("x", [2.05, 2.15, 0.25, 0.35, 1.45, -0.25, -0.35, 12.05, 8.449999, 3.0, 0.0])
def test_tenth_rounds_like_print(spark, x):
    assert spark.range(1).select(signals._tenth(F.lit(x)).alias("x")).first()["x"] == float(f"{x:.1f}")


def log_frame(spark, rows):
    return spark.createDataFrame(rows, "signal_name string, asset_id string, market_id string, ts bigint, direction string, confidence double, entry_price double")


def test_settlement(spark):
    log = log_frame(spark, [
        ("s", "a", "m1", 0, "buy", 0.9, 0.6), ("s", "a", "m1", 5, "buy", 0.9, 0.1), ("s", "a", "m2", 0, "sell", 0.9, 0.6),
        ("t", "a", "m3", 0, "buy", 0.9, 0.5), ("t", "a", "m4", 0, "buy", 0.9, 0.5), ("t", "b", "m1", 0, "hold", 0.9, 0.5), ("u", "c", "m5", 0, "buy", 0.9, 0.5)])
    res = spark.createDataFrame([("m1", "Yes", 5 * DAY), ("m2", "Yes", 400 * DAY), ("m3", "Invalid", 1), ("m5", "No", None)], "market_id string, resolution_outcome string, resolution_ts bigint")
    books = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.03), ("a", 3, None)], "asset_id string, snapshot_ts bigint, spread double")
    got = {r["market_id"]: r for r in settle.settle_at_resolution(log, res, books).collect()}
    assert set(got) == {"m1", "m2", "m5"}
    assert (got["m1"]["exit_reason"], got["m1"]["hold_days"], got["m1"]["direction"]) == ("resolution", 5.0, "long") and got["m1"]["pnl"] == pytest.approx(38.0)
    assert (got["m2"]["exit_reason"], got["m2"]["exit_ts"], got["m2"]["direction"]) == ("timeout", 90 * DAY, "short") and got["m2"]["pnl"] == pytest.approx(-42.0)
    assert got["m5"]["exit_reason"] == "timeout" and got["m5"]["pnl"] == pytest.approx(-53.0)
    kelly = settle.settle_at_resolution(log, res, books, sizing_mode="kelly", start_ts=0, end_ts=0)
    assert {r["market_id"]: r["position_size"] for r in kelly.collect()}["m1"] == pytest.approx(500.0)


def test_settlement_summary(spark):
    rows = [("s", 10.0, 1.0, DAY), ("s", -4.0, 3.0, 2 * DAY), ("s", -3.0, 2.0, 3 * DAY), ("w", 5.0, 1.0, DAY), ("w", 7.0, None, DAY + 5)]
    trades = spark.createDataFrame(rows, "signal_name string, pnl double, hold_days double, exit_ts bigint")
    got = {r["signal_name"]: r for r in settle.summarize(trades).collect()}
    s, w, all_ = got["s"], got["w"], got[None]
    assert (s["total_trades"], s["median_pnl"], s["max_drawdown"]) == (3, -3.0, -7.0) and s["profit_factor"] == pytest.approx(10 / 7)
    assert (w["profit_factor"], w["sharpe_ratio"], w["max_drawdown"], w["avg_hold_days"]) == (float("inf"), 0.0, 0.0, 1.0)
    assert (all_["total_trades"], all_["total_pnl"], all_["median_pnl"]) == (5, 15.0, 5.0)


def test_candidates(spark):
    log = log_frame(spark, [("s", a, "m", i, "buy", c, p) for i, (a, c, p) in enumerate([("ok", 0.8, 0.5), ("wide", 0.8, 0.5), ("poor", 0.8, 0.5), ("thin", 0.8, 0.5), ("dear", 0.8, 0.9), ("weak", 0.5, 0.1)])])
    log = log.withColumn("edge", F.lit(0.1)).withColumn("target_price", F.lit(1.0)).withColumn("metadata_json", F.lit("{}"))
    assets = ["ok", "wide", "poor", "thin", "dear", "weak"]
    feats = spark.createDataFrame([(a, 1.0, 6 if a == "thin" else 50) for a in assets], "asset_id string, days_to_resolution double, num_points bigint")
    quality = spark.createDataFrame([(a, a != "poor") for a in assets], "asset_id string, quality_pass boolean")
    books = spark.createDataFrame([("wide", 1, 0.1, 0.2), ("ok", 1, 0.02, 0.05), ("ok", 2, None, None)], "asset_id string, snapshot_ts bigint, spread double, spread_pct double")
    markets = spark.createDataFrame([("m", "q?", 5.0)], "market_id string, question string, liquidity double")
    got = candidates.trade_candidates(log, markets, feats, quality=quality, books=books, run_date="2024-01-01").collect()
    assert [r["asset_id"] for r in got] == ["ok"]
    r = got[0]
    assert (r["rank"], r["suggested_size"], r["spread"], r["reasoning"]) == (1, 500.0, 0.02, "s generated buy with edge 0.100") and r["kelly_fraction"] == pytest.approx(0.6)


def naive_corr(a, b):
    days = sorted(set(a) & set(b))
    if len(days) < 3:
        return None, len(days)
    x, y = [a[d] for d in days], [b[d] for d in days]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    vx, vy = sum((v - mx) ** 2 for v in x), sum((v - my) ** 2 for v in y)
    if vx < 1e-18 or vy < 1e-18:
        return None, len(days)
    return sum((p - mx) * (q - my) for p, q in zip(x, y)) / (vx * vy) ** 0.5, len(days)


@pytest.mark.parametrize("block", [3, 256])
def test_correlations_against_naive(spark, block):
    rng = random.Random(11)
    series = {f"a{i}": {d: (0.3 if i == 0 else round(rng.random(), 3)) for d in range(12) if rng.random() < 0.7} for i in range(14)}
    tag = {a: "x" if i % 3 else "y" for i, a in enumerate(series)}
    closes = spark.createDataFrame([(a, d, p) for a, s in series.items() for d, p in s.items()], "asset_id string, day bigint, close double")
    tags = spark.createDataFrame(list(tag.items()), "asset_id string, primary_tag string")
    got = {(r["asset_id_a"], r["asset_id_b"]): (r["correlation"], r["overlap_days"]) for r in relationships.correlated_pairs(closes, tags, threshold=0.2, min_overlap=4, block=block).collect()}
    want = {}
    for a in series:
        for b in series:
            if a < b and tag[a] == tag[b] and min(len(series[a]), len(series[b])) >= 4:
                r, n = naive_corr(series[a], series[b])
                if r is not None and n >= 4 and abs(r) >= 0.2:
                    want[a, b] = (pytest.approx(r, abs=1e-9), n)
    assert got == want and want


def test_pairs_of_a_tag_are_sent_by_the_block_and_given_once(spark, monkeypatch):
    rng = random.Random(5)
    series = {f"a{i:03}": [round(rng.random(), 3) for _ in range(8)] for i in range(60)}
    closes = spark.createDataFrame([(a, d, p) for a, s in series.items() for d, p in enumerate(s)], "asset_id string, day bigint, close double")
    # Every third asset sits in both tags, so its partners meet it twice.
    rows = [(a, t) for i, a in enumerate(series) for t in (["x", "y"] if i % 3 == 0 else ["x"] if i % 3 == 1 else ["y"])]
    tags = spark.createDataFrame(rows, "asset_id string, primary_tag string")
    want = {}
    for a in series:
        for b in series:
            if a < b and {t for k, t in rows if k == a} & {t for k, t in rows if k == b}:
                r, n = naive_corr(dict(enumerate(series[a])), dict(enumerate(series[b])))
                if abs(r) >= 0.1:
                    want[a, b] = (pytest.approx(r, abs=1e-9), n)
    monkeypatch.setattr(relationships, "STRIP", 7)
    monkeypatch.setattr(relationships, "CELLS", 200)  # 25 assets of 8 days
    found = relationships.correlated_pairs(closes, tags, threshold=0.1, min_overlap=4)
    got = found.collect()
    assert len(got) == len(want) and {(r["asset_id_a"], r["asset_id_b"]): (r["correlation"], r["overlap_days"]) for r in got} == want
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan.split("FlatMapGroups")[0]  # found pairs, which grow with the square, are not gathered


def test_overround_pairs(spark):
    tokens = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "c"), ("n", "a"), ("n", "b"), ("o", "a")], "market_id string, asset_id string")
    prices = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.5), ("b", 1, 0.4), ("c", 1, 0.3)], "asset_id string, ts bigint, price double")
    got = {(r["asset_id_a"], r["asset_id_b"]): r["overround"] for r in relationships.overround_pairs(tokens, prices).collect()}
    assert got == {("a", "b"): pytest.approx(-0.1), ("a", "c"): pytest.approx(0.2), ("b", "c"): pytest.approx(0.2)}


@pytest.mark.parametrize(
    "curve,want",
    [([0.5, 0.9, 0.6, 0.5, 0.4], "early pump then fade"), ([0.1, 0.2, 0.3, 0.5], "monotonic drift up"), ([0.9, 0.91, 0.92, 0.5, 0.93, 0.4, 0.3], "monotonic drift down"),
     ([0.5, 0.51, 0.5, 0.52], "mostly flat"), ([0.5, 0.3, 0.3, 0.9, 0.54], "range-bound and choppy")],
)
def test_shapes(spark, curve, want):
    bands = spark.createDataFrame([(0, i, p) for i, p in enumerate(curve)], "cluster_id int, pos bigint, median double")
    assert clusters.describe_curves(bands).first()["description"] == want


def test_kmeans_small_and_large(spark):
    rows = clusters.vectors(clusters.standardise(spark.createDataFrame([(str(i), float(i // 10), None) for i in range(30)], "asset_id string, x double, y double"), ["x", "y"]), ["x", "y"])
    out = clusters.assign(rows, clusters.fit_kmeans(rows, k=3, restarts=3))
    assert sorted(r["size"] for r in clusters.cluster_sizes(out).collect()) == [10, 10, 10]
    few = rows.limit(2)
    assert clusters.fit_kmeans(few) is None and {r["cluster_id"] for r in clusters.assign(few, None).collect()} == {0, 1}


def test_health(spark):
    coverage = spark.createDataFrame([("events_discovered", 50.0), ("markets_discovered", 0.0), ("pct_targeted_with_history", 0.6), ("median_points_per_token", 9.0)], "metric string, value double")
    cadence = spark.createDataFrame([(10, 3, 0.3, 1.0)], "checked_assets bigint, mismatch_assets bigint, mismatch_ratio double, median_step_s double")
    prices = spark.createDataFrame([(100,)], "ingested_at bigint")
    runs = spark.createDataFrame([(f"r{i}", i, 1.0 if i else 500.0) for i in range(21)], "run_id string, run_ts bigint, duration_s double")
    checks = health.health_checks(coverage, cadence, prices, prices, runs, runtime_s=2.5, now_ts=10 * DAY, include_resolved=True)
    failed = {r["name"] for r in checks.where("not passed").collect()}
    assert failed == {"events_discovered", "median_points_per_series", "history_cadence_mismatch_ratio", "runtime_vs_rolling_avg", "new_markets_discovered",
                      "price_history_staleness_24h", "resolution_staleness_7d"}
    assert tuple(health.overall_status(checks).first()) == ("CRITICAL", 4, 3)
    calm = health.health_checks(coverage, cadence, prices, None, None, runtime_s=9e9, now_ts=100, include_resolved=False)
    assert {r["name"] for r in calm.where("not passed").collect()} == {"events_discovered", "median_points_per_series", "history_cadence_mismatch_ratio"}
    assert health.config_hash({"b": 1, "a": 2}) == health.config_hash({"a": 2, "b": 1})


def test_audit_of_gaps_and_prices(spark):
    prices = spark.createDataFrame([("a", 0, -0.1), ("a", 0, 0.0), ("a", 100, 1.0), ("a", 3 * DAY, 1.1), ("b", 5, 0.5)], "asset_id string, ts bigint, price double")
    g = audit.gap_profile(prices).first()
    assert (g["gaps"], g["min"], g["max"], g["median"], g["non_positive"]) == (3, 0, 3 * DAY - 100, 100.0, 1)
    p = audit.price_sanity(prices).first()
    assert (p["below_zero"], p["above_one"], p["at_zero"], p["at_one"], p["median"]) == (1, 1, 1, 1, 0.5)
    current = spark.createDataFrame([("t", 90), ("u", 89), ("v", 5)], "table string, rows bigint")
    base = spark.createDataFrame([("t", 100), ("u", 100)], "table string, rows bigint")
    assert {r["table"]: r["note"] for r in audit.count_deltas(current, base).collect()} == {"t": "", "u": "shrunk", "v": "grew"}


@pytest.mark.parametrize("n,limit,want", [(5, 10, 5), (10, 10, 10), (25, 10, 13), (21, 10, 11), (22, 10, 12)])
def test_downsample(spark, n, limit, want):
    series = spark.createDataFrame([("a", i * 40_000, i / 100) for i in range(n)], "asset_id string, ts bigint, price double")
    got = sorted(r["ts"] // 40_000 for r in explore.downsample(series, limit).collect())
    step = max(1, n // limit) if n > limit else 1
    kept = list(range(0, n, step))
    assert got == kept + ([n - 1] if kept[-1] != n - 1 else []) and len(got) == want


def test_market_views(spark):
    tokens = spark.createDataFrame([("m", "a1", "Yes"), ("m", "a2", "Yes"), ("m", "a3", " "), ("n", "b", "No")], "market_id string, asset_id string, outcome string")
    prices = spark.createDataFrame([("a1", 1, 0.1), ("a1", 2, 0.2), ("a2", 2, 0.3), ("a3", 1, 0.4), ("b", 1, 0.5)], "asset_id string, ts bigint, price double")
    series = explore.outcome_series("m", tokens, prices)
    assert {(r["asset_id"], r["outcome_label"], r["series_label"]) for r in series.collect()} == {("a1", "Yes", "Yes | a1"), ("a2", "Yes", "Yes | a2"), ("a3", "a3", "a3")}
    assert {(r["outcome_label"], r["price"]) for r in explore.latest_per_outcome(series).collect()} == {("Yes", 0.3), ("a3", 0.4)}
    pivot = {r["ts"]: r.asDict() for r in explore.series_pivot(series, ["Yes | a1", "a3"]).collect()}
    assert pivot[1] == {"ts": 1, "Yes | a1": 0.1, "a3": 0.4}
    table = spark.createDataFrame([("m", "Q1", 5.0, True), ("n", "q2", None, False), ("o", "z", 7.0, True)], "market_id string, question string, liquidity double, has_history boolean")
    table = table.select("*", F.lit("E").alias("event_title"), F.lit("t").alias("primary_tag"), F.lit("binary").alias("market_type"), F.col("has_history").alias("quality_pass_any"))
    pick = lambda **kw: [r["market_id"] for r in explore.filter_markets(table, **kw).collect()]
    assert pick() == ["o", "m", "n"] and pick(search="Q[12]") == ["m", "n"] and pick(descending=False, limit=1) == ["m"]
    assert pick(min_liquidity=6) == ["o"] and pick(require_history=True, require_quality=True, tags=["t"], types=["binary"]) == ["o", "m"]
    k = explore.kpis(table).first()
    assert (k["markets"], k["avg_liquidity"]) == (3, 6.0) and k["history_pct"] == pytest.approx(200 / 3)


def test_hot_asset_is_split(spark):
    """One asset with most of the ticks: no ordered window may get the whole asset."""
    from oddsmill.plans.asof import canonical_ticks, haloed

    rows = spark.range(40_000).select(
        F.when(F.col("id") % 4 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("asset_id"), (F.col("id") * 600).alias("ts"),
        F.lit(0.5).alias("price"), F.col("id").alias("seq"))
    cut = haloed(canonical_ticks(rows), DAY, 7 * DAY, 30 * DAY)
    biggest = cut.groupBy("asset_id", "_chunk").count().agg(F.max("count")).first()[0]
    assert biggest <= 39 * DAY // 600 and cut.where("_core").count() == 40_000


def test_declared_aggregates_share_one_grouping(spark):
    rule = lambda needs: signals.SeriesRule(signals.range_reversal, needs)
    rules = {"a": rule(lambda: {"low": F.min("price")}), "b": rule(lambda: {"low": F.min("price"), "n": F.count("ts")}), "c": signals.convergence}
    assert list(signals.declared_aggregates(rules)) == ["low", "n"]
    with pytest.raises(ValueError, match="low"):
        signals.declared_aggregates({**rules, "d": rule(lambda: {"low": F.max("price")})})
    assert "range_reversal" not in signals.active_rules() and "range_reversal" in signals.active_rules(["range_reversal"])


def test_explanation_rounds_as_sql(spark):
    """A move of 0.63455 is 0.6345 to four digits, not a tie."""
    row = run(spark, "momentum", {**MOVE, "return_1d": 0.63455})[0]
    assert json.loads(row["metadata_json"])["return_1d"] == 0.6345
    text = signals.explanation(F.lit("momentum_breakout"), F.lit("buy"), F.lit(0.1), F.lit(row["metadata_json"]))
    assert spark.range(1).select(text.alias("x")).first()["x"].startswith("Price moved +63.4% on 5.0x")
