"""Streaming against batch, and whole runs over stored tables."""

import json

import pytest
from pyspark.sql import functions as F

from oddsmill.operators import audit, bars, normalize
from oddsmill.operators.health import run_trends
from oddsmill.plans import workflows
from oddsmill.sources import tables
from oddsmill.sources.adapters import Canon
from oddsmill.streaming import streams

SF = "/root/testdata/sf0.001"


def same(a, b):
    cols = sorted(a.columns)
    key = lambda df: sorted(map(repr, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())))
    return key(a) == key(b)


def drain(stream, name, spark, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def land(df, path, parts):
    """Files in time order, so that the watermark never passes unread rows by more than the lateness allowed."""
    edges = [r[0] for r in df.agg(F.percentile("ts", F.array(*[F.lit(i / parts) for i in range(1, parts)]))).collect()][0]
    cuts = [float("-inf"), *edges, float("inf")]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        df.where((F.col("ts") > lo) & (F.col("ts") <= hi)).coalesce(1).write.mode("append").parquet(path)


def test_stream_bars_equal_batch(spark, tmp_path):
    trades = Canon(spark, SF).trades
    path = str(tmp_path / "trades")
    land(trades, path, 4)
    stream = streams.read_files(spark, path, trades.schema, per_trigger=1)
    got = drain(streams.volume_bars(stream, "1h", "1 hour"), "bars", spark, str(tmp_path / "cp"))
    want = bars.trade_bars(trades, "1h")
    # The last bars stay open until the watermark passes them.
    newest = trades.agg(F.max("ts")).first()[0] - 3600
    assert same(got.where(F.col("ts") + 3600 <= newest), want.where(F.col("ts") + 3600 <= newest)) and got.count() > 100


def test_stream_deduplication(spark, tmp_path):
    ticks = Canon(spark, SF).prices.select("asset_id", "ts", "price", F.lit("1h").alias("interval"))
    path = str(tmp_path / "ticks")
    land(ticks, path, 3)
    ticks.where("ts % 2 = 0").orderBy("ts").coalesce(1).write.mode("append").parquet(path)
    stream = streams.read_files(spark, path, ticks.schema)
    got = drain(streams.distinct_ticks(stream, "60 days"), "ticks", spark, str(tmp_path / "cp"))
    assert same(got, ticks.dropDuplicates(["asset_id", "ts", "interval"]))


def test_stream_upserts(spark, tmp_path):
    prices = Canon(spark, SF).prices.select("asset_id", F.expr("ts div 86400 * 86400").alias("ts"), "price", F.lit("1d").alias("interval"), F.col("seq").alias("ingested_at"))
    path, table = str(tmp_path / "in"), str(tmp_path / "price_history.parquet")
    for i in range(3):
        prices.where(F.col("ingested_at") % 3 == i).withColumn("ingested_at", F.col("ingested_at") + i * 1_000_000).coalesce(1).write.mode("append").parquet(path)
    stream = streams.read_files(spark, path, prices.schema, per_trigger=1)
    streams.keep_last_into(stream, table, "price_history", str(tmp_path / "cp"), "ingested_at").start().awaitTermination()
    got = spark.read.parquet(table).drop("dt")
    want = tables.merge_keep_last(None, spark.read.parquet(path), ("asset_id", "ts", "interval"), "ingested_at")
    assert got.count() == want.count() and got.select("asset_id", "ts").distinct().count() == got.count()


AS_OF = 1_706_659_200


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Stored base tables made from landed documents and the test data."""
    base = str(tmp_path_factory.mktemp("store"))
    c = Canon(spark, SF)
    c.documents.select("value").write.text(f"{base}/raw/events")
    workflows.load_documents(spark, base, [f"{base}/raw/events"])
    prices = c.prices.select("asset_id", "ts", "price", F.lit("1h").alias("interval"), F.col("ts").alias("ingested_at"), "seq")
    tables.upsert(spark, f"{base}/price_history.parquet", prices, "price_history", "seq")
    return base


def test_analysis_needs_base_tables(spark, tmp_path):
    with pytest.raises(tables.MissingInputs):
        workflows.analyze(spark, str(tmp_path), AS_OF)


def test_analysis_run(spark, root):
    before = spark.read.parquet(f"{root}/markets.parquet").count()
    settings = workflows.Settings(quality_min_points=5, min_overlap_days=10, cluster_k=3, yes_only_binary=True)
    out = workflows.analyze(spark, root, AS_OF, settings)
    assert out["warnings"] == ["resolutions.parquet missing or empty; continuing without resolution data.",
                               "volume_bars.parquet missing or empty; continuing without volume data."]
    assert spark.read.parquet(f"{root}/markets.parquet").count() == before
    assert out["features"].count() == 15 and out["clusters"].select("cluster_id").distinct().count() == 3
    assert out["features"].where("avg_spread is not null").count() == 0
    assert spark.read.parquet(f"{root}/pipeline_runs.parquet").count() == 1
    report = json.loads("".join(r["value"] for r in spark.read.text(f"{root}/analysis/report.json").collect()))
    assert report["quality"]["quality_total_assets"] > 0 and report["coverage"]["tokens_with_non_empty_history"] == 15
    workflows.analyze(spark, root, AS_OF + 3600, settings)
    assert spark.read.parquet(f"{root}/pipeline_runs.parquet").count() == 2


def test_resolve_run(spark, root):
    res = workflows.resolve(spark, root, [f"{root}/raw/events"], 5)
    markets = spark.read.parquet(f"{root}/markets.parquet")
    assert res.where("final_price is not null").count() > 0
    assert markets.where("resolved").count() == res.where("resolution_outcome is not null").count()


def test_mark_to_market_and_audit_runs(spark, root):
    c = Canon(spark, SF)
    log = c.signal_log.drop("seq").withColumn("target_price", F.lit(1.0)).withColumn("metadata_json", F.lit("{}"))
    tables.upsert(spark, f"{root}/signals.parquet", log, "signals")
    assert workflows.mark_to_market(spark, root).where("level = 'aggregate'").count() == 1
    first = workflows.audit_tables(spark, root).collect()
    assert {r["area"] for r in first} >= {"nulls"}
    second = workflows.audit_tables(spark, root)
    assert second.where("area = 'delta'").count() == 0


def test_documents_are_parsed_once_per_load(spark, root):
    docs = workflows._documents(spark, root, [f"{root}/raw/events"])
    for extract in (normalize.extract_events, normalize.extract_markets, normalize.extract_tokens, normalize.extract_resolutions):
        plan = extract(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert "parse_json" not in plan.lower() and "parquet" in plan.lower()


def test_documents_hold_all_blocks(spark, root):
    def document(name):
        return json.loads("".join(r["value"] for r in spark.read.text(f"{root}/analysis/{name}.json").collect()))

    report, health = document("report"), document("health_check")
    assert report["num_clusters"] == 3 == len(report["cluster_sizes"]) and report["tag_rankings"] and len(report["cluster_descriptions"]) <= 3
    assert len(health["checks"]) == 8 and len(health["warnings"]) + len(health["errors"]) == sum(not c["passed"] for c in health["checks"])
    assert all(" failed (value=" in m for m in health["warnings"] + health["errors"])


def test_audit_of_results(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    prices = frame([(a, t, 0.5) for a in ("x", "y") for t in range(3)], "asset_id string, ts long, price double")
    rows = frame([("x", 2.0, 0.1), ("y", 2.0, 0.2)], "asset_id string, num_points double, volatility double")
    runs = frame([(str(i), i, 0.5, True, 0) for i in range(12)], "run_id string, run_ts long, price_coverage_pct double, signals_expected boolean, signals_generated long")
    members = frame([(str(i), int(i > 3)) for i in range(5)], "asset_id string, cluster_id int")
    gates = frame([(i == 0, True, True, True, True) for i in range(10)], "quality_pass boolean, check_min_points boolean, check_missing_ratio boolean, check_price_range boolean, check_liquidity boolean")
    found = audit.result_issues(audit.points_per_asset(prices), audit.feature_profile(rows), audit.cluster_audit(members), audit.quality_rates(gates), run_trends(runs))
    got = sorted((r.severity, r.area, r.subject, r.amount) for r in found.collect())
    assert got == [
        ("CRITICAL", "features", "num_points", 2.0), ("CRITICAL", "points", "too_few", 3.0), ("WARNING", "clusters", "under three members", 1.0),
        ("WARNING", "features", "num_points", 1.0), ("WARNING", "features", "volatility", 2.0), ("WARNING", "points", "uniform", 3.0),
        ("WARNING", "quality", "quality_pass", 0.1), ("WARNING", "runs", "price_coverage_pct", 0.5), ("WARNING", "runs", "signals_generated", 0.0)]
    lacking = {"markets": frame([("m",)], "market_id string"), "tokens": frame([("a",)], "token string")}
    assert audit.absent_columns(lacking) == ["markets.event_id", "tokens.asset_id", "tokens.market_id"]
    assert audit.duplicate_keys(lacking).count() == 1
