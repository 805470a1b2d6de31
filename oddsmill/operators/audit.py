"""Data-quality audit: profiles, keys, references, gaps, drift and a verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from oddsmill.plans.selection import global_quantiles
from oddsmill.schemas import DAY

# Columns that may be mostly null by design.
EXPECTED_NULLS = (
    "avg_spread", "avg_spread_pct", "spread_trend", "avg_depth", "avg_daily_volume", "volume_trend", "buy_sell_ratio",
    "volume_price_corr", "resolution_outcome", "resolution_ts", "return_30d", "return_1d", "return_7d", "zscore_7d", "rsi_14",
    "signals_expected", "pipeline_profile",
)
# Keys and references that are audited.
PRIMARY_KEYS = {
    "events": ("event_id",), "markets": ("market_id",), "tokens": ("asset_id",), "price_history": ("asset_id", "ts"),
    "features": ("asset_id",), "clusters": ("asset_id",),
}
REFERENCES = (
    ("markets", "event_id", "events", "event_id"), ("tokens", "market_id", "markets", "market_id"),
    ("price_history", "asset_id", "tokens", "asset_id"), ("features", "asset_id", "tokens", "asset_id"),
    ("features", "asset_id", "price_history", "asset_id"), ("clusters", "asset_id", "features", "asset_id"),
)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, column, rows, nulls, null_pct, severity: one pass per table."""
    parts = []
    for name, df in tables.items():
        # A NaN is missing, too.
        def missing(c: str, t: str) -> Column:
            return F.col(c).isNull() | F.isnan(c) if t in ("double", "float") else F.col(c).isNull()

        row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(missing(c, t)).alias(c) for c, t in df.dtypes])
        parts.append(
            row.unpivot(["_rows"], df.columns, "column", "nulls").select(
                F.lit(name).alias("table"), "column", F.col("_rows").alias("rows"), "nulls"
            )
        )
    pct = F.coalesce(F.col("nulls") * 100.0 / F.nullif(F.col("rows"), F.lit(0)), F.lit(0.0))
    expected = F.col("column").isin(*EXPECTED_NULLS)
    severity = F.when((F.col("null_pct") > 50) & ~expected, "CRITICAL").when((F.col("null_pct") > 10) & (F.col("null_pct") <= 50), "WARNING")
    return _union(parts).withColumn("null_pct", pct).withColumn("severity", severity)


def absent_columns(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] = PRIMARY_KEYS, references: Sequence[tuple[str, str, str, str]] = REFERENCES
) -> list[str]:
    """table.column of the audited keys and references that stored tables lack; their other checks leave those out."""
    wanted = [(t, c) for t, key in keys.items() for c in key]
    for child, ccol, parent, pcol in references:
        wanted += [(child, ccol), (parent, pcol)]
    return sorted({f"{t}.{c}" for t, c in wanted if t in tables and c not in tables[t].columns})


def duplicate_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] = PRIMARY_KEYS) -> DataFrame:
    """table, rows, duplicates: rows beyond the first per key. Counting per key combines in the map tasks."""
    parts = []
    for name, key in keys.items():
        if name in tables and set(key) <= set(tables[name].columns):
            per_key = tables[name].groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            parts.append(
                per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
                .select(F.lit(name).alias("table"), "rows", "duplicates")
            )
    return _union(parts)


def orphans(tables: Mapping[str, DataFrame], references: Sequence[tuple[str, str, str, str]] = REFERENCES) -> DataFrame:
    """child, parent, keys, orphans, orphan_pct over distinct non-null child keys."""
    parts = []
    for child, ccol, parent, pcol in references:
        if child not in tables or parent not in tables or ccol not in tables[child].columns or pcol not in tables[parent].columns:
            continue
        have = tables[parent].select(F.col(pcol).alias("k")).distinct().withColumn("_found", F.lit(True))
        want = tables[child].select(F.col(ccol).alias("k")).where("k is not null").distinct()
        row = want.join(have, "k", "left").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("_found").isNull()).alias("orphans"))
        parts.append(
            row.select(
                F.lit(f"{child}.{ccol}").alias("child"), F.lit(f"{parent}.{pcol}").alias("parent"), "keys", "orphans",
                F.coalesce(F.col("orphans") * 100.0 / F.nullif(F.col("keys"), F.lit(0)), F.lit(0.0)).alias("orphan_pct"),
            )
        )
    return _union(parts)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()])


def coverage_funnel(tables: Mapping[str, DataFrame]) -> DataFrame:
    """stage, assets from events down to clusters."""
    stages = [
        ("events", tables.get("events")), ("markets", tables.get("markets")), ("tokens", tables.get("tokens")),
        ("priced", tables["price_history"].select("asset_id").distinct() if "price_history" in tables else None),
        ("features", tables.get("features")), ("clustered", tables.get("clusters")),
    ]
    return _union([
        df.agg(F.count(F.lit(1)).alias("assets")).select(F.lit(n).alias("stage"), "assets") for n, df in stages if df is not None
    ])


def time_span(prices: DataFrame) -> DataFrame:
    row = prices.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    days = (F.col("last_ts") - F.col("first_ts")) / float(DAY)
    return row.select("first_ts", "last_ts", days.alias("days"), F.when(days < 1, "CRITICAL").when(days < 7, "WARNING").alias("severity"))


def points_per_asset(prices: DataFrame) -> DataFrame:
    """Distribution of rows per asset. Counts have few distinct values, so the percentiles stay small."""
    counts = prices.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    cuts = F.percentile("n", F.array(*[F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    row = counts.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), cuts.alias("p"))
    return row.select(
        "min", "max", "mean", *[F.col("p")[i].alias(name) for i, name in enumerate(("p5", "p25", "median", "p75", "p95"))],
        (F.col("min") == F.col("max")).alias("uniform"), (F.col("max") <= 10).alias("too_few"),
    )


def _gaps(prices: DataFrame, chunk: int) -> DataFrame:
    """gap, n over consecutive ticks of every asset, without a window over a whole asset.

    Rows are counted per (asset, second) first: copies of one second give gaps of zero. Inside a chunk of time the distinct
    seconds are bounded by its length; the gap between chunks comes from the chunk ends.
    """
    # The filter on n keeps the column in all three uses below, so that they share one scan and exchange.
    seconds = prices.where("ts is not null").groupBy("asset_id", "ts").agg(F.count(F.lit(1)).alias("n")).where("n >= 1")
    cut = seconds.withColumn("_chunk", F.floor(F.col("ts") / chunk))
    inside = Window.partitionBy("asset_id", "_chunk").orderBy("ts")
    within = cut.select((F.col("ts") - F.lag("ts").over(inside)).alias("gap"), F.lit(1).cast("bigint").alias("n")).where("gap is not null")
    ends = cut.groupBy("asset_id", "_chunk").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    across = ends.select(
        (F.col("lo") - F.lag("hi").over(Window.partitionBy("asset_id").orderBy("_chunk"))).alias("gap"), F.lit(1).cast("bigint").alias("n")
    ).where("gap is not null")
    copies = seconds.where("n > 1").select(F.lit(0).cast("bigint").alias("gap"), (F.col("n") - 1).alias("n"))
    rows = within.unionByName(across).unionByName(copies)
    return rows.groupBy("gap").agg(F.sum("n").alias("n"))


def gap_profile(prices: DataFrame, chunk: int = DAY) -> DataFrame:
    """Median, 95th percentile and extremes of the gaps between ticks, over all assets."""
    gaps = _gaps(prices, chunk)
    # percentile takes the counts as frequencies; gaps are whole seconds.
    cut = F.percentile("gap", F.array(F.lit(0.5), F.lit(0.95)), F.col("n"))
    row = gaps.agg(F.min("gap").alias("min"), F.max("gap").alias("max"), cut.alias("p"), F.sum("n").alias("gaps"),
                   F.sum(F.when(F.col("gap") <= 0, F.col("n")).otherwise(0)).alias("non_positive"))
    return row.select("gaps", "min", "max", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"), "non_positive")


def price_sanity(prices: DataFrame) -> DataFrame:
    p = F.col("price")
    row = prices.agg(
        F.count_if(p < 0).alias("below_zero"), F.count_if(p > 1).alias("above_one"), F.count_if(p == 0).alias("at_zero"),
        F.count_if(p == 1).alias("at_one"), F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"),
    )
    return row.withColumn("median", F.lit(global_quantiles(prices, "price", {"median": 0.5})["median"]).cast("double"))


def feature_profile(features: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, distinct values (counted up to 4), min, max, verdict. Distinct values are found by dropping them in turn.

    Only "none, one, up to three or more" matters, so instead of a distinct count per column the profile takes the smallest,
    the largest and one value between them on each side: a single aggregation without an expansion of the rows.
    """
    columns = list(columns or [c for c in features.columns if c != "asset_id"])
    typed = features.select(*[F.col(c).cast("double").alias(c) for c in columns])
    ends = typed.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])  # one row
    between = typed.join(F.broadcast(ends)).select(
        *[F.when((F.col(c) > F.col(f"lo_{c}")) & (F.col(c) < F.col(f"hi_{c}")), F.col(c)).alias(c) for c in columns]
    )
    mids = between.agg(*[F.min(c).alias(f"ml_{c}") for c in columns], *[F.max(c).alias(f"mh_{c}") for c in columns])  # one row
    rows = ends.join(F.broadcast(mids)).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"),
                        F.col(f"ml_{c}").alias("mid_lo"), F.col(f"mh_{c}").alias("mid_hi"),
                    )
                    for c in columns
                ]
            )
        )
    )
    lo, hi, ml, mh = (F.col(c) for c in ("min", "max", "mid_lo", "mid_hi"))
    # lo, hi and two different values between them make four.
    distinct = F.when(lo.isNull(), 0).when(lo == hi, 1).when(ml.isNull(), 2).when(ml == mh, 3).otherwise(4)
    verdict = (
        F.when(distinct == 0, F.when(F.col("feature").isin(*EXPECTED_NULLS), "all_null_expected").otherwise("all_null"))
        .when((distinct == 1) & (F.col("feature") == "num_points") & (lo <= 5), "constant_critical")
        .when(distinct == 1, "constant")
        .when(distinct <= 3, "low_variance")
        .otherwise("varied")
    )
    return rows.select("feature", distinct.alias("distinct_up_to_4"), "min", "max", verdict.alias("verdict"))


def cluster_audit(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("assets"), F.min("n").alias("smallest"),
        F.max("n").alias("largest"), F.avg("n").alias("mean_size"), F.count_if(F.col("n") < 3).alias("tiny"),
    )


def quality_rates(quality: DataFrame) -> DataFrame:
    cols = ["quality_pass", "check_min_points", "check_missing_ratio", "check_price_range", "check_liquidity"]
    row = quality.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    return row.unpivot([], cols, "check", "pass_rate").withColumn(
        "severity", F.when((F.col("check") == "quality_pass") & (F.col("pass_rate") < 0.2), "WARNING")
    )


def count_deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """table, previous, rows, delta, note against the stored row counts; the caller stores ``current`` as the new baseline."""
    joined = current.join(baseline.select("table", F.col("rows").alias("previous")), "table", "left")
    delta = F.col("rows") - F.col("previous")
    return joined.withColumn("previous", F.coalesce("previous", F.lit(0))).select(
        "table", "previous", "rows", delta.alias("delta"), F.when(delta < -10, "shrunk").when(delta > 0, "grew").otherwise("").alias("note")
    )


def _part(df: DataFrame, cond: Column, severity: Column, area: str, subject: Column, amount: Column) -> DataFrame:
    return df.where(cond).select(severity.alias("severity"), F.lit(area).alias("area"), subject.alias("subject"), amount.cast("double").alias("amount"))


def issues(
    nulls: DataFrame, duplicates: DataFrame, orphan_keys: DataFrame, span: DataFrame, sanity: DataFrame, gaps: DataFrame
) -> DataFrame:
    """severity, area, subject, amount for everything that is wrong."""
    c, lit = F.col, F.lit
    return _union(
        [
            _part(nulls, c("severity").isNotNull(), c("severity"), "nulls", F.concat_ws(".", "table", "column"), c("null_pct")),
            _part(duplicates, c("duplicates") > 0, lit("WARNING"), "duplicates", c("table"), c("duplicates")),
            _part(orphan_keys, c("orphans") > 0, lit("WARNING"), "orphans", F.concat_ws("->", "child", "parent"), c("orphans")),
            _part(span, c("severity").isNotNull(), c("severity"), "span", lit("price_history"), c("days")),
            _part(sanity, (c("below_zero") > 0) | (c("above_one") > 0), lit("CRITICAL"), "prices", lit("price_history"), c("below_zero") + c("above_one")),
            _part(gaps, c("non_positive") > 0, lit("CRITICAL"), "gaps", lit("price_history"), c("non_positive")),
        ]
    )


def result_issues(
    points: DataFrame, profile: DataFrame | None = None, sizes: DataFrame | None = None, rates: DataFrame | None = None, trends: DataFrame | None = None
) -> DataFrame:
    """Issues, as above, of what the analysis made: points per asset, features, clusters, pass rates and the last runs.

    Tables that are not stored yet are left out. A count of points that is constant and small is an issue twice: as a
    constant and as a sign that all features come from next to no data.
    """
    c, lit = F.col, F.lit
    warning, critical = lit("WARNING"), lit("CRITICAL")
    parts = [
        _part(points, c("uniform"), warning, "points", lit("uniform"), c("min")),
        _part(points, c("too_few"), critical, "points", lit("too_few"), c("max")),
    ]
    if profile is not None:
        flat = c("verdict").isin("all_null", "constant", "constant_critical", "low_variance")
        parts += [
            _part(profile, flat, warning, "features", c("feature"), c("distinct_up_to_4")),
            _part(profile, c("verdict") == "constant_critical", critical, "features", c("feature"), c("max")),
        ]
    if sizes is not None:
        parts.append(_part(sizes, c("tiny") > 0, warning, "clusters", lit("under three members"), c("tiny")))
    if rates is not None:
        parts.append(_part(rates, c("severity").isNotNull(), c("severity"), "quality", c("check"), c("pass_rate")))
    if trends is not None:
        parts += [
            _part(trends, c("coverage_stuck"), warning, "runs", lit("price_coverage_pct"), c("recent_coverage")),
            _part(trends, c("signals_silent"), warning, "runs", lit("signals_generated"), lit(0)),
        ]
    return _union(parts)


def verdict(found: DataFrame) -> DataFrame:
    """One row: ready iff nothing critical was found."""
    critical = F.count_if(F.col("severity") == "CRITICAL")
    return found.agg(critical.alias("critical"), F.count_if(F.col("severity") == "WARNING").alias("warnings"), (critical == 0).alias("ready"))
