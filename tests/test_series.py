import random

import pytest
from pyspark.sql import functions as F

import naive
from oddsmill.operators import bars, features, hypotheses, mtm
from oddsmill.plans.asof import canonical_ticks, next_tick
from oddsmill.plans.chunked import row_numbers, running_sum
from oddsmill.plans.quantiles import exact_quantiles

HOUR, DAY = 3600, 86_400


def ticks_frame(spark, by_asset):
    rows = [(a, t, float(p), i) for a, ticks in by_asset.items() for i, (t, p) in enumerate(ticks)]
    return spark.createDataFrame(rows, "asset_id string, ts bigint, price double, seq bigint")


def random_ticks(rng, n, span, start=1_700_000_000):
    return [(start + rng.randrange(span), round(rng.random(), 4)) for _ in range(n)]


CASES = {
    "aligned": [(HOUR * k, 0.1 * k) for k in range(1, 6)],
    "unaligned_end": [(HOUR, 0.5), (2 * HOUR, 0.6), (3 * HOUR + 5, 0.4)],
    "gap_at_limit": [(HOUR, 0.5), (2 * HOUR, 0.6), (5 * HOUR, 0.7), (6 * HOUR, 0.8)],
    "gap_over_limit": [(HOUR, 0.5), (2 * HOUR, 0.6), (6 * HOUR, 0.7), (7 * HOUR, 0.8)],
    "constant": [(HOUR * k, 0.25) for k in range(1, 40)],
    "two_rows": [(HOUR, 0.1), (2 * HOUR, 0.2)],
    "two_seconds_apart": [(HOUR, 0.1), (HOUR, 0.3), (9 * HOUR, 0.2)],
    "rising": [(HOUR * k, k / 50) for k in range(1, 30)],
    "repeats": [(HOUR, 0.1), (HOUR, 0.9), (2 * HOUR, 0.2), (3 * HOUR, 0.3), (3 * HOUR, 0.4)],
    "old_ticks": [(0, 0.9), (HOUR, 0.8)] + [(40 * DAY + HOUR * k, 0.3 + k / 100) for k in range(5)],
}


def check_features(spark, data, interval, step, window, limit):
    clean = features.clean_series(ticks_frame(spark, data), interval, window, limit)
    got = {r["asset_id"]: r for r in features.price_features(clean, interval).collect()}
    for asset, ticks in data.items():
        want = naive.grid_series(ticks, step, window, limit)
        if want is None:
            assert asset not in got
            continue
        expected = naive.price_features(want[0], want[2], max(1, round(DAY / step)))
        for name, value in expected.items():
            assert got[asset][name] == (pytest.approx(value, abs=1e-9) if value is not None else None), (asset, name)


def test_price_features_of_cases(spark):
    check_features(spark, CASES, "1h", HOUR, 30, 2)


def test_price_features_at_random(spark):
    rng = random.Random(5)
    data = {f"a{i}": random_ticks(rng, rng.choice([2, 5, 40, 200]), rng.choice([DAY, 10 * DAY, 60 * DAY])) for i in range(25)}
    check_features(spark, data, "4h", 4 * HOUR, 20, 3)


def test_curves(spark):
    rng = random.Random(6)
    data = {**CASES, **{f"a{i}": random_ticks(rng, 30, 5 * DAY) for i in range(8)}}
    rows = features.curves(ticks_frame(spark, data), "1h", 30, 2).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["asset_id"], r["idx"])):
        got.setdefault(r["asset_id"], []).append(r["price"])
    for asset, ticks in data.items():
        want = naive.grid_series(ticks, HOUR, 30, 2)
        assert got.get(asset) == (want[1] if want else None), asset


def test_feature_families_and_missing_inputs(spark):
    prices = ticks_frame(spark, {"a": CASES["rising"], "b": CASES["aligned"]})
    context = spark.createDataFrame([("a", 0, 10 * DAY), ("b", None, 5)], "asset_id string, start_ts bigint, end_ts bigint")
    books = spark.createDataFrame(
        [("a", 1, 0.01, 0.1, 10.0, 20.0), ("a", 2, None, None, 5.0, None), ("a", 3, 0.03, 0.3, None, 40.0)],
        "asset_id string, snapshot_ts bigint, spread double, spread_pct double, bid_depth_5pct double, ask_depth_5pct double",
    )
    volume = spark.createDataFrame([("a", HOUR, 5.0, 4.0, 1.0), ("a", DAY + 1, 7.0, 1.0, 1.0)], "asset_id string, ts bigint, volume double, buy_volume double, sell_volume double")
    got = {r["asset_id"]: r for r in features.asset_features(prices, context=context, books=books, bars=volume, as_of_ts=4 * DAY).collect()}
    a, b = got["a"], got["b"]
    assert (a["days_to_resolution"], a["days_since_creation"], a["pct_lifetime_elapsed"]) == (6.0, 4.0, 0.4)
    assert b["pct_lifetime_elapsed"] is None and b["days_since_creation"] is None
    assert a["avg_spread"] == pytest.approx(0.02) and a["spread_trend"] == pytest.approx(0.02)
    assert a["avg_bid_depth"] == 7.5 and a["avg_ask_depth"] == 30.0 and a["avg_depth"] == pytest.approx((15 + 2.5 + 20) / 3)
    assert (a["avg_daily_volume"], a["volume_trend"], a["buy_sell_ratio"], a["volume_price_corr"]) == (6.0, 2.0, 2.5, None)
    assert b["avg_spread"] is None and b["avg_daily_volume"] is None and a["rsi_14"] is None
    bare = features.asset_features(prices, as_of_ts=0).collect()[0]
    assert len(bare) == 30 and bare["avg_spread"] is None


def test_volume_price_correlation_of_constant_series_is_null(spark):
    prices = ticks_frame(spark, {"a": [(DAY * k + HOUR * h, 0.1 + 0.01 * k) for k in range(6) for h in range(24)]})
    volume = spark.createDataFrame([("a", DAY * k, 5.0, 1.0, 1.0) for k in range(6)], "asset_id string, ts bigint, volume double, buy_volume double, sell_volume double")
    row = features.volume_features(volume, features.clean_series(prices)).first()
    assert row["volume_price_corr"] is None and row["volume_trend"] == 0.0


def test_next_tick_against_naive(spark):
    rng = random.Random(7)
    data = {f"a{i}": random_ticks(rng, rng.choice([0, 1, 30]), 20 * DAY, start=1000) for i in range(12)}
    targets = [(a, rng.randrange(22 * DAY)) for a in [*data, "none"] for _ in range(30)]
    targets += [(a, t) for a, ticks in data.items() for t, _ in ticks[:3]]
    frame = spark.createDataFrame(targets, "asset_id string, target_ts bigint")
    got = {(r["asset_id"], r["target_ts"]): (r["exit_ts"], r["exit_price"]) for r in next_tick(frame, canonical_ticks(ticks_frame(spark, data)), DAY).collect()}
    assert set(got) == set(targets)
    for (a, t), hit in got.items():
        last = dict(data.get(a, []))
        assert hit == (naive.next_price(list(last.items()), t) or (None, None))


@pytest.mark.parametrize("late,hit", [(0, True), (7199, True), (7200, False)])
def test_forward_return_tolerance(spark, late, hit):
    ticks = [(HOUR * 10 * k, 0.5) for k in range(30)] + [(HOUR * 10 * 29 + HOUR + late, 0.7)]
    rows = hypotheses.forward_returns(ticks_frame(spark, {"a": ticks})).where(F.col("ts") == HOUR * 290).collect()
    assert (rows[0]["fwd_1h"] is not None) is hit


def test_forward_returns_against_naive(spark):
    rng = random.Random(8)
    data = {f"a{i}": random_ticks(rng, n, 15 * DAY, start=5000) for i, n in enumerate([10, 24, 300])}
    got = hypotheses.forward_returns(ticks_frame(spark, data), chunk=3 * DAY).collect()
    assert {r["asset_id"] for r in got} == {"a1", "a2"}
    for r in got:
        ticks = list(dict(data[r["asset_id"]]).items())
        for col, off in [("return_1d", -DAY), *[(f"fwd_{h}h", h * HOUR) for h in (1, 6, 24, 72, 168)]]:
            nxt = naive.next_price(ticks, r["ts"] + off)
            want = None if nxt is None or nxt[0] - (r["ts"] + off) >= 7200 else nxt[1] - r["price"]
            if want is not None and col == "return_1d":
                want = -want
            assert r[col] == (pytest.approx(want) if want is not None else None), (r, col)


def test_bars_edges(spark):
    trades = spark.createDataFrame(
        [("a", 3600, 0.5, 10.0, "BUY"), ("a", 7199, 0.7, 30.0, " sell "), ("a", 7200, 0.5, 1.0, "?"), ("a", 3600, 0.5, 0.0, "buy"),
         ("a", 3600, 0.0, 5.0, "buy"), ("a", 3599, 0.5, 5.0, None), ("a", None, 0.5, 5.0, "buy")],
        "asset_id string, ts bigint, price double, size double, side string",
    )
    got = {r["ts"]: r for r in bars.trade_bars(trades, "1h", min_ts=3700).collect()}
    assert set(got) == {3600, 7200}
    first = got[3600]
    assert (first["volume"], first["trade_count"], first["buy_volume"], first["sell_volume"]) == (40.0, 2, 10.0, 30.0)
    assert first["vwap"] == pytest.approx(0.65) and got[7200]["buy_volume"] == got[7200]["sell_volume"] == 0.0


def book_rows(bids, asks):
    return [("a", 0, "bid", p, s) for p, s in bids] + [("a", 0, "ask", p, s) for p, s in asks]


@pytest.mark.parametrize(
    "bids,asks,want",
    [
        ([(0.49, 10.0), (0.475, 5.0), (0.47, 9.0)], [(0.51, 4.0), (0.525, 2.0), (0.53, 8.0)], (0.49, 0.51, 10.0, 4.0, 0.5, 15.0, 6.0)),
        ([(0.6, 1.0)], [(0.5, 2.0)], (0.6, 0.5, 1.0, 2.0, None, None, None)),
        ([(0.6, 1.0)], [], (0.6, None, 1.0, None, None, None, None)),
        ([(0.4, 1.0), (0.0, 5.0)], [(0.4, 0.0), (0.9, -1.0)], (0.4, 0.4, 1.0, 0.0, 0.4, 1.0, 0.0)),
    ],
)
def test_book_metrics(spark, bids, asks, want):
    long = spark.createDataFrame(book_rows(bids, asks), "asset_id string, snapshot_ts bigint, side string, price double, size double")
    arrays = spark.createDataFrame(
        [("a", 0, bids, asks)], "asset_id string, snapshot_ts bigint, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"
    )
    names = ("best_bid", "best_ask", "bid_size", "ask_size", "mid_price", "bid_depth_5pct", "ask_depth_5pct")
    for row in (bars.book_metrics(long).first(), bars.book_metrics_from_arrays(arrays).first()):
        assert tuple(row[n] for n in names) == want


def test_cadence(spark):
    data = {"ok": [(HOUR * k, 0.5) for k in range(12)], "fast": [(600 * k, 0.5) for k in range(20)], "few": [(k, 0.5) for k in range(11)], "still": [(7, 0.5)] * 12}
    row = bars.cadence(ticks_frame(spark, data), "1h").first()
    assert (row["checked_assets"], row["mismatch_assets"], row["mismatch_ratio"], row["median_step_s"]) == (2, 1, 0.5, 2100.0)
    assert bars.cadence(ticks_frame(spark, {"few": data["few"]}), "1h").first()["mismatch_ratio"] == 0.0


def test_mark_to_market(spark):
    prices = ticks_frame(spark, {"a": [(0, 0.5), (HOUR, 0.6), (7 * HOUR, 0.2)]})
    log = spark.createDataFrame(
        [("s", "a", "m", 0, "buy", 0.5, 0.1, 0.5), ("s", "a", "m", 0, "sell", 0.5, 0.1, 0.5), ("t", "b", "m", 0, "buy", 0.5, 0.1, 0.5)],
        "signal_name string, asset_id string, market_id string, ts bigint, direction string, confidence double, edge double, entry_price double",
    )
    marked = mtm.mark_to_market(log, prices)
    got = {(r["direction"], r["horizon_hours"]): r for r in marked.collect()}
    assert set(got) == {("buy", 1), ("buy", 6), ("sell", 1), ("sell", 6)}
    assert got["buy", 1]["pnl"] == pytest.approx(7.0) and got["sell", 6]["pnl"] == pytest.approx(27.0)
    assert got["buy", 6]["price_move"] == pytest.approx(-0.3) and got["buy", 6]["exit_ts"] == 7 * HOUR
    rows = {(r["level"], r["name"], r["horizon_hours"]): r for r in mtm.mtm_summary(marked).collect()}
    assert rows["aggregate", None, 1]["trades"] == 2 and rows["by_signal", "s", 1]["hit_rate"] == 0.5
    assert rows["by_horizon", None, 6]["total_pnl"] == -6.0 and rows["aggregate", None, 1]["sharpe"] == pytest.approx(-5.7315)


def test_exact_quantiles_of_large_and_small_groups(spark):
    import numpy as np

    rng = random.Random(9)
    values = [("x", rng.choice([0.1, 0.2, rng.random() ** 9])) for _ in range(60_000)] + [("y", float(i)) for i in range(7)] + [("y", None)]
    frame = spark.createDataFrame(values, "g string, v double")
    wanted = {"lo": 0.0, "a": 0.05, "m": 0.5, "b": 0.951, "hi": 1.0}
    for r in exact_quantiles(frame, ["g"], "v", wanted).collect():
        data = [v for g, v in values if g == r["g"] and v is not None]
        for name, q in wanted.items():
            assert r[name] == pytest.approx(np.quantile(data, q), abs=1e-12)
    assert exact_quantiles(frame.where("v > 9000"), ["g"], "v", wanted).count() == 0


def test_chunked_numbers_and_sums(spark):
    rng = random.Random(10)
    rows = [(rng.choice("ab"), rng.randrange(1000), i, float(rng.randrange(9))) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, t bigint, i bigint, v double")
    chunk, order = F.floor(F.col("t") / 50), [F.col("t"), F.col("i")]
    numbered = row_numbers(frame, ["g"], order, chunk, "rn", "n").collect()
    summed = {r["i"]: r["s"] for r in running_sum(frame, ["g"], order, chunk, "v", "s").collect()}
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        at = {r["i"]: (r["rn"], r["n"]) for r in numbered if r["g"] == g}
        total = 0.0
        for k, r in enumerate(mine, 1):
            total += r[3]
            assert at[r[2]] == (k, len(mine)) and summed[r[2]] == total


def test_quantiles_of_groups_of_any_size(spark):
    from oddsmill.plans.quantiles import exact_quantiles

    sizes = {1: 1, 2: 2, 3: 3, 4: 4, 5: 11, 6: 49_999, 7: 50_001, 8: 120_000}
    rows = spark.createDataFrame([(g, n) for g, n in sizes.items()], "g int, n int").selectExpr(
        "g", "explode(sequence(1, n)) as k", "n").selectExpr("g", "cast(pmod(xxhash64(k, g), case when g % 2 = 0 then 97 else 1000003 end) as double) as v")
    got = exact_quantiles(rows, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.999}).collect()
    want = {r.g: r for r in rows.groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in (("a", 0.25), ("b", 0.5), ("c", 0.75), ("d", 0.999))]).collect()}
    assert len(got) == len(sizes)
    for r in got:
        assert all(abs(r[c] - want[r.g][c]) < 1e-9 for c in "abcd"), r
