"""Positions and running sums by sampled ranges, and quantiles by narrowing histograms."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from oddsmill.operators import explore, loadplan
from oddsmill.plans import ranges, selection


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_positions_over_ranges_that_cut_groups(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(40), k) for k in range(3000)]
    df = spark.createDataFrame(data, "g string, x int, id long")
    rows = ranges.row_numbers(df, ["g"], [F.col("x"), F.col("id")], "rn", "n", ranges=7)
    assert tasks(ranges.ranged(df, ["g"], [F.col("x"), F.col("id")], 7)) == 7
    want = {}
    for g in {d[0] for d in data}:
        mine = sorted((x, i) for h, x, i in data if h == g)
        want |= {i: (n, len(mine)) for n, (_, i) in enumerate(mine, 1)}
    assert {r.id: (r.rn, r.n) for r in rows.collect()} == want
    assert rows.columns == ["g", "x", "id", "rn", "n"]
    assert ranges.row_numbers(df.where("false"), ["g"], [F.col("id")]).count() == 0


def test_running_sums_over_ranges(spark):
    data = [("hot" if k % 10 else "cold", k * 7919 % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(data, "g string, x int, id long")
    for group in (["g"], []):
        got = {r.id: r.s for r in ranges.running_sum(df, group, [F.col("x"), F.col("id")], "id", "s", ranges=5).collect()}
        for g in ("hot", "cold") if group else (None,):
            total = 0
            for _, i in sorted((x, i) for h, x, i in data if g in (None, h)):
                total += i
                assert got[i] == total


@pytest.mark.parametrize("priority", ["history_first", "category_round_robin"])
def test_one_watermark_and_ids_that_begin_alike_are_ordered_in_many_tasks(spark, priority):
    rows = [(f"asset-000-{k * 7919 % 2000:05d}", "m", "tag" if k % 3 else "other", 900_000, True, False, 0.5) for k in range(1000)]
    rows += [(f"asset-001-{k * 31 % 1000:05d}", "m", "tag" if k % 2 else "other", None, False, k % 5 == 0, 0.1 if k % 2 else 0.2) for k in range(1000)]
    plan = loadplan.mark_plan(spark.createDataFrame(rows, "asset_id string, market_id string, primary_tag string, latest_ts long, has_history boolean, is_inactive boolean, tag_coverage double"),
                              interval="1h", global_start_ts=0)
    got = loadplan.order_plan(plan, priority, ranges=6).collect()
    bucket = {"existing": 0, "new_active": 1, "new_inactive": 2}
    turns, key = {}, {}
    for r in sorted(got, key=lambda r: r.asset_id):
        turns[r.asset_id] = len([1 for k in turns if key[k] == (r.bucket, r.primary_tag)])
        key[r.asset_id] = (r.bucket, r.primary_tag)
    new = (lambda r: (turns[r.asset_id], r.tag_coverage, r.primary_tag)) if priority != "history_first" else (lambda r: (r.tag_coverage, r.primary_tag))
    want = sorted(got, key=lambda r: (bucket[r.bucket], () if r.bucket == "existing" else new(r), r.asset_id))
    assert [r.position for r in want] == list(range(1, 2001))


def test_downsample_of_a_series_cut_by_ranges(spark):
    data = [("s", 10 * (k // 3), k / 1000) for k in range(1000)]
    got = sorted(r.price for r in explore.downsample(spark.createDataFrame(data, "asset_id string, ts long, price double"), 30, ranges=5).collect())
    step = 1000 // 30
    want = [k / 1000 for k in range(0, 1000, step)]
    assert got == want + ([0.999] if 10 * (999 // 3) != 10 * (int(want[-1] * 1000 + 0.5) // 3) else [])


def quantile(values, q):
    s = sorted(values, key=lambda v: (math.isnan(v), v))
    p = q * (len(s) - 1)
    a, b = s[math.floor(p)], s[math.ceil(p)]
    return a if a == b else a + (b - a) * (p - math.floor(p))


QUANTILES = {"least": 0.0, "low": 0.05, "median": 0.5, "high": 0.95, "greatest": 1.0}


@pytest.mark.parametrize("make", [
    lambda rng: rng.random(), lambda rng: rng.choice([0.0, 0.5, 1.0]), lambda rng: rng.lognormvariate(0, 40) * rng.choice([-1, 1]),
    lambda rng: 1e9 + rng.random() * 1e-3, lambda rng: rng.choice([5e-324, 1.5e-323, 2e-323, 2.5e-323, -1e308, 1e308]), lambda rng: rng.choice([math.inf, -math.inf, 0.0, -0.0, 3.0])])
def test_quantiles_by_narrowing(spark, make):
    rng = random.Random(2)
    for n in (1, 2, 2500):
        values = [make(rng) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        got = selection.global_quantiles(df, "x", QUANTILES)
        for name, q in QUANTILES.items():
            want = quantile(values, q)
            assert got[name] == want or math.isnan(want) and math.isnan(got[name]), (name, n)
    assert got["median"] == statistics.median(values) or math.isinf(got["median"]) or abs(got["median"] - statistics.median(values)) < 1e-9 * abs(got["median"])


def test_quantiles_of_nothing_and_of_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (2.0,)], "x double")
    assert selection.global_quantiles(df.where("x is null"), "x", QUANTILES)["median"] is None
    got = selection.global_quantiles(df, "x", QUANTILES)
    assert got["least"] == 1.0 and got["median"] == 2.0 and math.isnan(got["greatest"])


def test_a_pass_returns_a_bounded_number_of_bins(spark):
    """However many values there are, the driver sees at most the bins of a pass."""
    df = spark.range(200_000).select((F.col("id") / 200_000).alias("x"))
    assert selection.global_quantiles(df, "x", {"median": 0.5})["median"] == pytest.approx(0.5, abs=1e-5)
    assert df.groupBy(selection._log_bin(F.col("x"))).count().count() < 300


def test_last_prices_are_hash_aggregates(spark):
    from oddsmill.operators import relationships

    rng = random.Random(3)
    data = [(f"a{rng.randrange(3)}", rng.randrange(20) - 5, rng.random(), rng.randrange(-5, 5) * 2**60 + k) for k in range(500)]
    df = spark.createDataFrame(data, "asset_id string, ts long, price double, seq long")
    for found, keys in ((relationships.latest_prices(df), lambda d: d[0]), (relationships.daily_closes(df), lambda d: (d[0], d[1] // 86_400))):
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
        want = {}
        for d in sorted(data, key=lambda d: (d[1], d[3])):
            want[keys(d)] = d[2]
        column = "price" if "price" in found.columns else "close"
        assert sorted(r[column] for r in found.collect()) == sorted(want.values())
    # Without seq the largest price of the last second counts.
    got = relationships.latest_prices(df.drop("seq")).collect()
    assert all(r.price == max(d[2] for d in data if d[0] == r.asset_id and d[1] == r.ts) for r in got)


def test_statistics_compute_their_input_once(spark):
    from oddsmill.operators import mtm
    from oddsmill.sources.adapters import Canon

    c = Canon(spark, "/root/testdata/sf0.001")
    summary = mtm.mtm_summary(mtm.mark_to_market(c.signal_log, c.prices, c.books))
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower() and summary.count() > 0


def test_landings_are_written_by_all_tasks_and_read_whole(spark, tmp_path):
    from oddsmill.catalog import streaming
    from oddsmill.sources.adapters import DAY, EPOCH_START, Canon

    rows = spark.range(0, 300, 1, 4).select((EPOCH_START + F.col("id") % 30 * DAY).alias("ts"), F.lit(0.5).alias("price"), F.col("id").alias("seq"))
    seen = []

    def sink(stream):
        count = lambda batch, number: seen.append((number, batch.count()))
        return stream.writeStream.foreachBatch(count).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)

    streaming.drained_by_landing(Canon(spark, ""), rows, True, str(tmp_path), sink)
    day, seq = (lambda i: i % 30), (lambda i: i % 5)
    third = [i for i in range(300) if day(i) >= 20 or (day(i) == 2 and seq(i) == 3)] + [i for i in range(300) if day(i) == 19 and i % 3 == 0]
    first = [i for i in range(300) if day(i) < 10 and not (day(i) == 9 and seq(i) == 2) and not (day(i) == 2 and seq(i) == 3)]
    again = len([i for i in range(300) if day(i) == 19 and i % 3 == 0])
    assert seen == [(0, len(first)), (1, 300 + again - len(first) - len(third)), (2, len(third))]
    assert len(list((tmp_path / "landed").glob("*.parquet"))) >= 12
