"""Run health checks and the run log."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.functions.scalars import to_double
from oddsmill.schemas import DAY

SEVERITIES = ("HEALTHY", "WARNING", "CRITICAL")


def config_hash(config: dict) -> str:
    """SHA-256 of the settings as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def run_id(run_ts_text: Column) -> Column:
    return F.substring(F.sha2(run_ts_text, 256), 1, 24)


def recent_runtime(runs: DataFrame, n: int = 20) -> DataFrame:
    """Mean duration of the last n runs with a duration, as one row."""
    last = runs.where(to_double("duration_s").isNotNull()).orderBy(F.desc("run_ts"), F.desc("run_id")).limit(n)
    return last.agg(F.avg(to_double("duration_s")).alias("avg_runtime"), F.count(F.lit(1)).alias("runs"))


def health_checks(
    coverage: DataFrame,
    cadence: DataFrame,
    prices: DataFrame,
    resolutions: DataFrame | None,
    runs: DataFrame | None,
    *,
    runtime_s: float,
    now_ts: int,
    include_resolved: bool,
) -> DataFrame:
    """name, value, threshold, severity, passed; every input is an aggregate or is reduced to one row first.

    coverage: (metric, value) rows; cadence: its one-row summary; prices and resolutions need ``ingested_at``.
    """
    wanted = ["events_discovered", "markets_discovered", "pct_targeted_with_history", "median_points_per_token"]
    row = coverage.agg(*[F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in wanted])

    def one(df: DataFrame, *aggs: Column) -> None:
        nonlocal row
        row = row.join(F.broadcast(df.agg(*aggs) if aggs else df))

    one(cadence.select("checked_assets", F.col("mismatch_ratio").alias("mismatch")))
    one(prices, F.max(to_double("ingested_at")).alias("prices_at"))
    none = F.lit(None).cast("double")
    if include_resolved and resolutions is not None:
        one(resolutions, F.max(to_double("ingested_at")).alias("resolved_at"))
    else:
        row = row.withColumn("resolved_at", none)
    if runs is not None:
        one(recent_runtime(runs))
    else:
        row = row.withColumn("avg_runtime", none).withColumn("runs", F.lit(0))

    def check(name: str, value: Column, threshold: str, severity: str, passed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(threshold).alias("threshold"),
            F.lit(severity).alias("severity"), F.coalesce(passed, F.lit(True)).alias("passed"),
        )

    def fresh(at: str, days: int) -> Column:
        return F.coalesce(F.col(at) >= now_ts - days * DAY, F.lit(True))

    c = F.col
    runtime = F.lit(float(runtime_s))
    return row.select(
        F.inline(
            F.array(
                check("events_discovered", c("events_discovered"), "100", "CRITICAL", c("events_discovered") >= 100),
                check("price_history_coverage_pct", c("pct_targeted_with_history"), "0.5", "WARNING", c("pct_targeted_with_history") >= 0.5),
                check("median_points_per_series", c("median_points_per_token"), "10", "WARNING", c("median_points_per_token") >= 10),
                check("history_cadence_mismatch_ratio", c("mismatch"), "<= 0.2", "CRITICAL", (c("checked_assets") == 0) | (c("mismatch") <= 0.2)),
                check("runtime_vs_rolling_avg", runtime, "2x rolling average", "WARNING",
                      F.when(c("avg_runtime") > 0, runtime <= c("avg_runtime") * 2.0)),
                check("new_markets_discovered", c("markets_discovered"), "> 0", "WARNING", (c("runs") == 0) | (c("markets_discovered") > 0)),
                check("price_history_staleness_24h", fresh("prices_at", 1).cast("int"), "updated within 24h", "CRITICAL", fresh("prices_at", 1)),
                check("resolution_staleness_7d", fresh("resolved_at", 7).cast("int"), "updated within 7d", "WARNING", fresh("resolved_at", 7)),
            )
        )
    )


def overall_status(checks: DataFrame) -> DataFrame:
    """One row: worst failed severity and the numbers of failed checks."""
    rank = F.when(F.col("passed"), 0).when(F.upper("severity") == "CRITICAL", 2).otherwise(1)
    worst = F.coalesce(F.max(rank), F.lit(0))
    return checks.agg(
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (worst + 1).cast("int")).alias("status"),
        F.count_if(rank == 1).alias("warnings"),
        F.count_if(rank == 2).alias("errors"),
    )


def messages(checks: DataFrame) -> DataFrame:
    failed = checks.where(~F.col("passed"))
    text = F.concat(F.col("name"), F.lit(" failed (value="), F.col("value").cast("string"), F.lit(", threshold="), F.col("threshold"), F.lit(")"))
    return failed.select(F.when(F.upper("severity") == "CRITICAL", "error").otherwise("warning").alias("kind"), text.alias("message"))


def health_document(checks: DataFrame, *, run_ts_text: str, profile: str, signals_expected: bool) -> DataFrame:
    """One nested row, ready for a JSON document sink: status, all checks, and the failed ones in words. Checks are few."""
    told = messages(checks)

    def of(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("message"))))

    lines = told.agg(of("warning").alias("warnings"), of("error").alias("errors"))
    listed = checks.agg(F.sort_array(F.collect_list(F.struct("name", "value", "threshold", "severity", "passed"))).alias("checks"))
    return overall_status(checks).select("status").join(F.broadcast(listed)).join(F.broadcast(lines)).select(
        F.lit(run_ts_text).alias("run_ts"), "status", F.lit(profile).alias("pipeline_profile"), F.lit(signals_expected).alias("signals_expected"),
        "checks", "warnings", "errors")


def run_row(
    coverage: DataFrame, status: DataFrame, *, run_ts: int, run_ts_text: str, duration_s: float, signals_generated: int,
    signals_expected: bool, profile: str, config: dict,
) -> DataFrame:
    """The run's row for the run log."""
    def metric(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("metric") == name, F.col("value"))), F.lit(0.0))

    row = coverage.agg(
        metric("events_discovered").cast("bigint").alias("events_count"),
        metric("markets_discovered").cast("bigint").alias("markets_count"),
        metric("pct_targeted_with_history").alias("price_coverage_pct"),
    ).join(F.broadcast(status.select("status")))
    return row.select(
        run_id(F.lit(run_ts_text)).alias("run_id"), F.lit(run_ts).cast("bigint").alias("run_ts"), F.lit(float(duration_s)).alias("duration_s"),
        "events_count", "markets_count", "price_coverage_pct", F.lit(signals_generated).cast("bigint").alias("signals_generated"),
        F.lit(signals_expected).alias("signals_expected"), F.lit(profile).alias("pipeline_profile"), "status",
        F.lit(config_hash(config)).alias("config_hash"),
    )


def last_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("run_ts"), F.desc("run_id")).limit(n)


def run_trends(runs: DataFrame) -> DataFrame:
    """One row: is coverage stuck over the last 5 runs, and did the last 10 signal-enabled runs produce nothing."""
    recent = last_runs(runs, 5).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("price_coverage_pct").alias("std"), F.avg("price_coverage_pct").alias("mean")
    )
    quiet = last_runs(runs.where(F.coalesce("signals_expected", F.lit(False))), 10).agg(
        F.count(F.lit(1)).alias("signal_runs"), F.max("signals_generated").alias("most")
    )
    return recent.join(F.broadcast(quiet)).select(
        F.coalesce((F.col("n") >= 5) & (F.col("std") < 0.001), F.lit(False)).alias("coverage_stuck"),
        F.col("mean").alias("recent_coverage"),
        F.coalesce((F.col("signal_runs") > 0) & (F.col("most") == 0), F.lit(False)).alias("signals_silent"),
    )
