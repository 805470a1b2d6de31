"""Whole runs over stored tables: load landed files, resolve, analyze, mark to market, audit.

Results that several later steps read (features, quality, clusters, signals) are written as tables and read back, so no step
recomputes another one's plan and a lost executor costs only its own stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from oddsmill.operators import audit, bars, candidates, clusters, features, health, mtm, normalize, quality, relationships, settle, signals
from oddsmill.schemas import BARS, BOOKS, EVENTS, FEATURE_COLUMNS, MARKETS, PRICES, RESOLUTIONS, RUNS, SIGNALS, TOKENS
from oddsmill.session import tune
from oddsmill.sources import landing, tables


@dataclass(frozen=True)
class Settings:
    """Defaults of a run."""

    interval: str = "1h"
    window_days: int = 90
    gap_fill_limit: int = 6
    yes_only_binary: bool = False
    cluster_k: int = 8
    random_seed: int = 42
    quality_min_points: int = 24
    quality_max_missing_ratio: float = 0.8
    quality_min_price_range: float = 0.02
    quality_min_liquidity: float = 0.0
    tag_rank_top_n: int = 10
    active_signals: tuple[str, ...] = ("all",)
    signal_debug_limit: int = 20
    convergence_days_threshold: int = 2
    volume_surge_threshold: float = 2.0
    imbalance_ratio_threshold: float = 3.0
    calibration_threshold: float = 0.15
    backtest_initial_capital: float = 10_000.0
    backtest_spread_assumption: float = 0.03
    backtest_timeout_days: int = 90
    sizing_mode: str = "flat"
    kelly_fraction: float = 0.25
    max_position_pct: float = 0.05
    min_position_size: float = 1.0
    flat_position_size: float = 100.0
    min_confidence: float = 0.55
    min_edge: float = 0.05
    max_candidates: int = 20
    correlation_threshold: float = 0.5
    min_overlap_days: int = 30
    profile: str = "default"
    steps: tuple[str, ...] = field(default=("relationships", "signals", "settlement", "candidates"))

    def rules(self) -> signals.Settings:
        return signals.Settings(
            self.convergence_days_threshold, self.volume_surge_threshold, self.imbalance_ratio_threshold, self.calibration_threshold
        )


def _path(root: str, name: str) -> str:
    return f"{root}/{name}.parquet"


def _store(df: DataFrame, root: str, name: str) -> DataFrame:
    tables.replace(df, _path(root, name))
    return df.sparkSession.read.parquet(_path(root, name))


def _documents(spark: SparkSession, root: str, landed: Sequence[str]) -> DataFrame:
    """Documents of the landed paths in order, a later path being newer; parsed once into a staging table from which all extracts read."""
    parts = [
        landing.read_json_lines(spark, path).withColumn("seq", F.struct(F.lit(number).alias("file"), F.col("seq").alias("row")))
        for number, path in enumerate(landed)
    ]
    return _store(normalize.parse_documents(reduce(DataFrame.unionByName, parts)), root, "_staging/documents")


def load_documents(spark: SparkSession, root: str, landed: Sequence[str]) -> dict[str, DataFrame]:
    """Landed event documents (active and resolved alike) into the events, markets and tokens tables."""
    tune(spark)
    return _load_documents(spark, root, _documents(spark, root, landed))


def _load_documents(spark: SparkSession, root: str, docs: DataFrame) -> dict[str, DataFrame]:
    out = {
        "events": normalize.extract_events(docs),
        "markets": normalize.extract_markets(docs),
        "tokens": normalize.extract_tokens(docs),
    }
    return {name: tables.upsert(spark, _path(root, name), df, name) for name, df in out.items()}


def resolve(spark: SparkSession, root: str, landed: Sequence[str], ingested_at: int) -> DataFrame:
    """Resolved events: base tables, the resolutions table with final prices, and the markets' resolution state."""
    tune(spark)
    docs = _documents(spark, root, landed)
    base = _load_documents(spark, root, docs)
    prices = tables.read_optional(spark, _path(root, "price_history"), PRICES)
    found = normalize.extract_resolutions(docs)
    new = normalize.enrich_resolutions(found, base["tokens"], prices, ingested_at, seq="asset_id")
    resolutions = tables.upsert(spark, _path(root, "resolutions"), new, "resolutions")
    _store(normalize.refresh_markets(base["markets"], resolutions), root, "markets")
    return resolutions


def analyze(spark: SparkSession, root: str, as_of_ts: int, settings: Settings = Settings()) -> dict[str, object]:
    """Features, quality, clusters, relations, signals, settlement, candidates, health and the run log from stored tables.

    Stored order books are left out here, as they are only a snapshot of the time they were taken.
    """
    tune(spark)
    began = datetime.now(timezone.utc)
    warnings = tables.check_inputs(spark, root)
    s = settings

    def read(name: str, schema) -> DataFrame:
        return tables.read_optional(spark, _path(root, name), schema)

    events, markets, tokens, prices = read("events", EVENTS), read("markets", MARKETS), read("tokens", TOKENS), read("price_history", PRICES)
    resolutions, volume = read("resolutions", RESOLUTIONS), read("volume_bars", BARS)
    for c in ("volume", "buy_volume", "sell_volume"):
        if c not in volume.columns:
            volume = volume.withColumn(c, F.lit(None).cast("double"))
    books = spark.createDataFrame([], BOOKS)
    targets = normalize.select_tokens(tokens, markets, yes_only_binary=s.yes_only_binary, seq="asset_id")

    feature_table = _store(
        features.asset_features(
            prices, interval=s.interval, window_days=s.window_days, gap_fill_limit=s.gap_fill_limit,
            context=normalize.market_context(targets, markets, events), books=books, bars=volume, as_of_ts=as_of_ts,
        ),
        root, "features",
    )
    graded = _store(
        quality.market_quality(
            targets, markets, prices, feature_table, min_points=s.quality_min_points, max_missing_ratio=s.quality_max_missing_ratio,
            min_price_range=s.quality_min_price_range, min_liquidity=s.quality_min_liquidity,
        ),
        root, "market_quality",
    )
    tags = quality.market_tags(markets, events)
    chosen = clusters.cluster_input(targets, feature_table, tags, graded)
    rows = clusters.vectors(clusters.standardise(chosen.select("asset_id", *FEATURE_COLUMNS)))
    member = clusters.assign(rows, clusters.fit_kmeans(rows, s.cluster_k, s.random_seed)).select("asset_id", "cluster_id")
    clustered = _store(chosen.join(member, "asset_id"), root, "clusters")
    curves = features.curves(prices, s.interval, s.window_days, s.gap_fill_limit)
    bands = _store(clusters.curve_bands(curves, clustered), root, "analysis/cluster_curves")
    shapes = _store(clusters.describe_curves(bands), root, "analysis/cluster_shapes")
    tables.write_document(shapes, f"{root}/analysis/cluster_shapes.json")
    summary = _store(quality.tag_summary(events, markets, targets, prices, feature_table, graded), root, "analysis/by_tag")
    rankings = _store(quality.tag_rankings(summary, s.tag_rank_top_n), root, "analysis/tag_rankings")
    tables.write_document(rankings, f"{root}/analysis/tag_rankings.json")
    coverage = _store(quality.coverage_block(events, markets, tokens, targets, prices), root, "analysis/coverage")
    report = quality.report_document(coverage, quality.quality_block(graded), rankings, clustered, shapes)
    tables.write_document(report, f"{root}/analysis/report.json")
    tables.write_document(tables.feature_metadata(spark), f"{root}/analysis/feature_metadata.json")

    if "relationships" in s.steps:
        found = relationships.market_relationships(
            events, markets, tokens, prices, threshold=s.correlation_threshold, min_overlap=s.min_overlap_days, seq="asset_id"
        )
        _store(found, root, "market_relationships")
    generated = 0
    signal_table = None
    if set(s.steps) & {"signals", "settlement", "candidates"}:
        rules = signals.active_rules(s.active_signals)
        frame = signals.signal_frame(
            feature_table, targets, markets, events, prices, volume, signals.base_rates(resolutions, markets, events), rules
        )
        evaluated = _store(signals.evaluate(frame, rules, s.rules()), root, "analysis/signal_results")
        signal_table = tables.upsert(spark, _path(root, "signals"), signals.fired(evaluated, as_of_ts), "signals")
        generated = signal_table.count()
        tables.write_document(signals.diagnostics(evaluated), f"{root}/analysis/signal_debug.json")
        tables.write_document(signals.diagnostic_samples(evaluated, s.signal_debug_limit), f"{root}/analysis/signal_samples.json")
    if "settlement" in s.steps:
        trades = _store(
            settle.settle_at_resolution(
                signal_table, resolutions, books, bankroll=s.backtest_initial_capital, spread_assumption=s.backtest_spread_assumption,
                timeout_days=s.backtest_timeout_days, sizing_mode=s.sizing_mode, kelly=s.kelly_fraction,
                max_position_pct=s.max_position_pct, min_position_size=s.min_position_size, flat_position_size=s.flat_position_size,
            ),
            root, "backtest_results",
        )
        tables.write_document(settle.summarize(trades), f"{root}/analysis/backtest_summary.json")
    if "candidates" in s.steps:
        run_date = datetime.fromtimestamp(as_of_ts, timezone.utc).date().isoformat()
        best = candidates.trade_candidates(
            signal_table, markets, feature_table, quality=graded, clusters=clustered, bankroll=s.backtest_initial_capital, run_date=run_date,
            min_confidence=s.min_confidence, min_edge=s.min_edge, max_candidates=s.max_candidates, kelly=s.kelly_fraction,
            max_position_pct=s.max_position_pct, min_position_size=s.min_position_size,
        )
        stored = tables.upsert(spark, _path(root, "trade_candidates"), best, "trade_candidates")
        tables.write_document(stored.where(F.col("run_date") == run_date).orderBy("rank"), f"{root}/analysis/trade_candidates.json")

    runs = tables.read_optional(spark, _path(root, "pipeline_runs"), RUNS)
    runtime = (datetime.now(timezone.utc) - began).total_seconds()
    checks = health.health_checks(
        coverage, bars.cadence(prices, s.interval), prices, resolutions if "ingested_at" in resolutions.columns else None, runs,
        runtime_s=runtime, now_ts=as_of_ts, include_resolved=True,
    )
    checks = _store(checks, root, "analysis/health_check")
    status = health.overall_status(checks)
    expected = bool(set(s.steps) & {"signals", "settlement", "candidates"})
    document = health.health_document(checks, run_ts_text=began.isoformat(), profile=s.profile, signals_expected=expected)
    tables.write_document(document, f"{root}/analysis/health_check.json")
    row = health.run_row(
        coverage, status, run_ts=as_of_ts, run_ts_text=began.isoformat(), duration_s=runtime, signals_generated=generated,
        signals_expected=expected, profile=s.profile, config=asdict(s),
    )
    tables.upsert(spark, _path(root, "pipeline_runs"), row, "pipeline_runs")
    return {"warnings": warnings, "features": feature_table, "quality": graded, "clusters": clustered, "signals": signal_table, "health": checks}


def mark_to_market(spark: SparkSession, root: str) -> DataFrame:
    """Stored signals, without retired ones, against stored prices at all horizons."""
    tune(spark)
    live = mtm.without_retired(tables.read_optional(spark, _path(root, "signals"), SIGNALS))
    prices = tables.read_optional(spark, _path(root, "price_history"), PRICES)
    books = tables.read_optional(spark, _path(root, "orderbook_snapshots"), BOOKS)
    marked = _store(mtm.mark_to_market(live, prices, books), root, "mtm_backtest_results")
    summary = mtm.mtm_summary(marked)
    tables.write_document(summary, f"{root}/analysis/mtm_backtest_summary.json")
    return summary


AUDITED = ("events", "markets", "tokens", "price_history", "features", "clusters", "market_quality", "pipeline_runs")


def audit_tables(spark: SparkSession, root: str) -> DataFrame:
    """Audits the stored tables, replaces the row-count baseline and returns the issue list."""
    tune(spark)
    have = {n: spark.read.parquet(_path(root, n)) for n in AUDITED if tables.exists(spark, _path(root, n))}
    prices = have["price_history"]
    found = audit.issues(
        audit.null_profile(have), audit.duplicate_keys(have), audit.orphans(have), audit.time_span(prices), audit.price_sanity(prices),
        audit.gap_profile(prices),
    )
    found = found.unionByName(audit.result_issues(
        audit.points_per_asset(prices),
        audit.feature_profile(have["features"], [c for c in FEATURE_COLUMNS if c in have["features"].columns]) if "features" in have else None,
        audit.cluster_audit(have["clusters"]) if "clusters" in have else None,
        audit.quality_rates(have["market_quality"]) if "market_quality" in have else None,
        health.run_trends(have["pipeline_runs"]) if "pipeline_runs" in have else None,
    ))
    missing = [("CRITICAL", "tables", n, 1.0) for n in AUDITED if n not in have]
    missing += [("WARNING", "columns", c, 1.0) for c in audit.absent_columns(have)]
    if missing:
        found = found.unionByName(spark.createDataFrame(missing, "severity string, area string, subject string, amount double"))
    current = audit.row_counts(have)
    baseline = _path(root, "analysis/dq_baseline")
    if tables.exists(spark, baseline):
        shrunk = audit.count_deltas(current, spark.read.parquet(baseline)).where("note = 'shrunk'")
        found = found.unionByName(
            shrunk.select(F.lit("WARNING").alias("severity"), F.lit("delta").alias("area"), F.col("table").alias("subject"), F.col("delta").cast("double").alias("amount"))
        )
    stored = _store(found, root, "analysis/dq_issues")
    tables.replace(current, baseline)
    return stored
