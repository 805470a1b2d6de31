"""Queries on clusters, health, audit and exploration."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from oddsmill.catalog.registry import query
from oddsmill.catalog.series import SERIES
from oddsmill.catalog.sqltext import cte, sql
from oddsmill.catalog.trading import graded, price_features, settled, summary, targets
from oddsmill.operators import audit, bars, clusters, explore, features, health, quality
from oddsmill.plans.asof import canonical_ticks
from oddsmill.sources.adapters import AS_OF, EPOCH_START, Canon

# ---- clusters: labels of the given vectors stand for cluster ids where exact results are compared ----

cte("c_assigned", """
select f.*, g.market_id, g.primary_tag, cast(cast(f.asset_id as bigint) % 4 as integer) as cluster_id
from f_price f join (select t.asset_id, t.market_id, q.primary_tag from t_targets t join q_tags q on t.market_id = q.market_id) g on f.asset_id = g.asset_id""")
cte("c_bands", """
select c.cluster_id, f.gi as idx, quantile_cont(f.price, 0.25) as q1, median(f.price) as median, quantile_cont(f.price, 0.75) as q3,
       row_number() over (partition by c.cluster_id order by f.gi) - 1 as pos
from s_filled f join c_assigned c on f.asset_id = c.asset_id where f.price is not null group by 1, 2""")
cte("c_shape", """
select cluster_id, max(median) as hi, min(median) as lo, count(*) as n, arg_min(pos, struct_pack(a := -median, b := pos)) as peak,
       arg_min(median, pos) as f, arg_max(median, pos) as l, coalesce(regr_slope(median, pos), 0) as slope from c_bands group by 1""")


def assigned(c: Canon):
    tags = quality.market_tags(c.markets, c.events)
    rows = targets(c).select("asset_id", "market_id").join(price_features(c), "asset_id").join(tags, "market_id")
    return rows.withColumn("cluster_id", (F.col("asset_id").cast("bigint") % 4).cast("int"))


@query("cluster_input", sql(
    """select asset_id, market_id, primary_tag, p_end, num_points from c_assigned
       where asset_id in (select asset_id from q_quality where quality_pass) or (select count(*) from q_quality where quality_pass) < 3""", "p_end"))
def cluster_input(c: Canon):
    return clusters.cluster_input(targets(c), price_features(c), quality.market_tags(c.markets, c.events), graded(c)).select(
        "asset_id", "market_id", "primary_tag", "p_end", "num_points")


STANDARD = ["p_end", "volatility", "slope", "missing_ratio", "return_7d"]


@query("standardised_features", sql(
    "select asset_id, " + ", ".join(f"(coalesce({x}, 0) - avg(coalesce({x}, 0)) over ()) / nullif(stddev_pop(coalesce({x}, 0)) over (), 0) as {x}" for x in STANDARD)
    + " from f_price", " ".join(STANDARD)))
def standardised_features(c: Canon):
    return clusters.standardise(price_features(c).select("asset_id", *STANDARD), STANDARD)


@query("kmeans_clusters", "select count(*) as rows, count(distinct label) as clusters, true as nearest, true as no_worse, true as silhouette_in_range from embeddings")
def kmeans_clusters(c: Canon):
    """As many k-means clusters of the given vectors as they have labels, against the labels; cluster ids do not compare across engines."""
    given = c.table("embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))
    model = clusters.fit_kmeans(given, k=given.agg(F.count_distinct("label")).first()[0])
    return clusters.assignment_check(clusters.assign(given, model), model, F.col("label"))


@query("feature_clusters", sql(
    "select count(*) as rows, cast(5 as bigint) as clusters, true as nearest, true as no_worse, true as silhouette_in_range from f_price"))
def feature_clusters(c: Canon):
    """k-means on standardised asset features, against a grouping by asset."""
    rows = clusters.vectors(clusters.standardise(price_features(c).select("asset_id", *STANDARD), STANDARD), STANDARD)
    model = clusters.fit_kmeans(rows, k=5, restarts=3)
    return clusters.assignment_check(clusters.assign(rows, model), model, F.pmod(F.col("asset_id").cast("bigint"), F.lit(5)))


@query("cluster_sizes", sql("select cluster_id, count(*) as size from c_assigned group by 1"))
def cluster_sizes(c: Canon):
    return clusters.cluster_sizes(assigned(c))


def report(c: Canon):
    coverage = quality.coverage_block(c.events, c.markets, c.tokens, targets(c), c.prices)
    return quality.report_document(coverage, quality.quality_block(graded(c)), quality.tag_rankings(summary(c)), assigned(c))


@query("report_clusters", sql(
    """select count(*) over () as num_clusters, cast(sum(size) over () as bigint) as cluster_input_assets, cluster_id, size,
              cast((select count(*) from q_quality) as double) as quality_total_assets, cast((select count(*) from t_events) as double) as events_discovered
       from (select cluster_id, count(*) as size from c_assigned group by 1) s"""))
def report_clusters(c: Canon):
    return report(c).select(
        "num_clusters", "cluster_input_assets", F.col("quality")["quality_total_assets"].alias("quality_total_assets"),
        F.col("coverage")["events_discovered"].alias("events_discovered"), F.inline("cluster_sizes"))


@query("cluster_tags", sql("select cluster_id, primary_tag, count(*) as count from c_assigned group by 1, 2"))
def cluster_tags(c: Canon):
    return clusters.cluster_tags(assigned(c))


def bands(c: Canon):
    return clusters.curve_bands(features.curves(c.prices, **SERIES), assigned(c))


@query("cluster_curve_bands", sql("select cluster_id, idx, q1, median, q3, pos from c_bands", "q1 median q3"))
def cluster_curve_bands(c: Canon):
    return bands(c).withColumn("pos", F.col("pos").cast("bigint"))


@query("cluster_shapes", sql(
    """select cluster_id, case when peak / greatest(1, n - 1) < 0.35 and hi - l > 0.05 then 'early pump then fade'
              when l - f > 0.05 and slope > 0 then 'monotonic drift up' when l - f < -0.05 and slope < 0 then 'monotonic drift down'
              when hi - lo < 0.05 then 'mostly flat' else 'range-bound and choppy' end as description from c_shape"""))
def cluster_shapes(c: Canon):
    return clusters.describe_curves(bands(c))


@query("cluster_list", sql("select cluster_id, count(*) as assets from c_assigned group by 1"))
def cluster_list(c: Canon):
    return explore.cluster_list(assigned(c))


@query("cluster_audit", sql(
    """with s as (select cluster_id, count(*) as n from c_assigned group by 1)
       select count(*) as clusters, cast(sum(n) as bigint) as assets, min(n) as smallest, max(n) as largest, avg(n) as mean_size,
              count(*) filter (n < 3) as tiny from s""", "mean_size"))
def cluster_audit(c: Canon):
    return audit.cluster_audit(assigned(c))


# ---- health ----

cte("r_runs", """
select cast(o_custkey as varchar) as run_id, cast(1704067200 + o_custkey * 3600 as bigint) as run_ts, sum(o_totalprice) / 1e5 as duration_s,
       count(*) as events_count, count(distinct o_orderpriority) as markets_count, count(*) / 100.0 as price_coverage_pct,
       count(*) filter (o_orderstatus = 'F') as signals_generated, o_custkey % 2 = 0 as signals_expected
from orders group by o_custkey""")


def runs(c: Canon):
    """A run log derived from the orders, one run per customer."""
    per = c.table("orders").groupBy("o_custkey").agg(
        (F.sum("o_totalprice") / 1e5).alias("duration_s"), F.count(F.lit(1)).alias("events_count"),
        F.count_distinct("o_orderpriority").alias("markets_count"), (F.count(F.lit(1)) / 100.0).alias("price_coverage_pct"),
        F.count_if(F.col("o_orderstatus") == "F").alias("signals_generated"))
    return per.select(F.col("o_custkey").cast("string").alias("run_id"), (EPOCH_START + F.col("o_custkey") * 3600).alias("run_ts"), "duration_s",
                      "events_count", "markets_count", "price_coverage_pct", "signals_generated", (F.col("o_custkey") % 2 == 0).alias("signals_expected"))


def checks(c: Canon):
    coverage = quality.coverage_block(c.events, c.markets, c.tokens, targets(c), c.prices)
    stamped = c.prices.withColumn("ingested_at", F.col("ts"))
    resolved = c.resolutions.withColumn("ingested_at", F.col("resolution_ts") - 30 * 86_400)
    return health.health_checks(coverage, bars.cadence(c.prices, "6h"), stamped, resolved, runs(c), runtime_s=1e6, now_ts=AS_OF, include_resolved=True)


cte("r_checks", """
with cov as (select count(q.history_points_raw) / cast(count(*) as double) as pct, median(q.history_points_raw) as med
             from (select distinct asset_id from t_targets) t left join q_counts q on t.asset_id = q.asset_id),
     a as (select (max(ts) - min(ts)) / cast(count(*) - 1 as double) as step from t_prices group by asset_id having count(*) >= 12),
     m as (select avg(case when step < 10800 then 1.0 else 0.0 end) as ratio from a),
     r as (select avg(duration_s) as avg_runtime from (select duration_s from r_runs order by run_ts desc, run_id desc limit 20) x),
     f as (select (select max(ts) from t_prices) >= 1706659200 - 86400 as p, (select max(resolution_ts) - 30 * 86400 from t_resolutions) >= 1706659200 - 7 * 86400 as q)
select 'events_discovered' as name, cast((select count(*) from t_events) as double) as value, '100' as threshold, 'CRITICAL' as severity, (select count(*) from t_events) >= 100 as passed
union all select 'price_history_coverage_pct', pct, '0.5', 'WARNING', pct >= 0.5 from cov
union all select 'median_points_per_series', med, '10', 'WARNING', med >= 10 from cov
union all select 'history_cadence_mismatch_ratio', ratio, '<= 0.2', 'CRITICAL', ratio <= 0.2 from m
union all select 'runtime_vs_rolling_avg', 1e6, '2x rolling average', 'WARNING', 1e6 <= 2 * avg_runtime from r
union all select 'new_markets_discovered', (select count(*) from t_markets), '> 0', 'WARNING', (select count(*) from t_markets) > 0
union all select 'price_history_staleness_24h', cast(p as integer), 'updated within 24h', 'CRITICAL', p from f
union all select 'resolution_staleness_7d', cast(q as integer), 'updated within 7d', 'WARNING', q from f""")


@query("health_checks", sql("select * from r_checks", "value"))
def health_checks(c: Canon):
    return checks(c)


@query("health_status", sql(
    """select case when bool_or(not passed and severity = 'CRITICAL') then 'CRITICAL' when bool_or(not passed) then 'WARNING' else 'HEALTHY' end as status,
              count(*) filter (not passed and severity = 'WARNING') as warnings, count(*) filter (not passed and severity = 'CRITICAL') as errors from r_checks"""))
def health_status(c: Canon):
    return health.overall_status(checks(c))


@query("health_document", sql(
    """select case when severity = 'CRITICAL' then 'error' else 'warning' end as kind, name, threshold, 'nightly' as pipeline_profile,
              (select case when bool_or(not passed and severity = 'CRITICAL') then 'CRITICAL' else 'WARNING' end from r_checks) as status,
              (select count(*) from r_checks) as checks from r_checks where not passed"""))
def health_document(c: Canon):
    """The document's messages, taken apart again."""
    doc = health.health_document(checks(c), run_ts_text="2024-01-31T00:00:00+00:00", profile="nightly", signals_expected=True)

    def of(kind: str):
        return F.transform(f"{kind}s", lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("message")))

    told = F.concat(of("warning"), of("error"))
    rows = doc.select("status", "pipeline_profile", F.size("checks").cast("bigint").alias("checks"), F.inline(told))
    return rows.select(
        "kind", F.regexp_extract("message", "^([a-z0-9_]+) failed", 1).alias("name"), F.regexp_extract("message", "threshold=(.*)\\)$", 1).alias("threshold"),
        "pipeline_profile", "status", "checks")


@query("run_ids", sql("select run_id, left(sha256(cast(run_ts as varchar)), 24) as hashed from r_runs"))
def run_ids(c: Canon):
    return runs(c).select("run_id", health.run_id(F.col("run_ts").cast("string")).alias("hashed"))


@query("last_runs", sql("select * from r_runs order by run_ts desc, run_id desc limit 10", "duration_s price_coverage_pct"))
def last_runs(c: Canon):
    return health.last_runs(runs(c))


@query("run_trends", sql(
    """with a as (select * from r_runs order by run_ts desc, run_id desc limit 5), b as (select * from r_runs where signals_expected order by run_ts desc, run_id desc limit 10)
       select (select stddev_samp(price_coverage_pct) < 0.001 from a) as coverage_stuck, (select avg(price_coverage_pct) from a) as recent_coverage,
              (select max(signals_generated) = 0 from b) as signals_silent""", "recent_coverage"))
def run_trends(c: Canon):
    return health.run_trends(runs(c))


# ---- audit ----

SOURCE_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
}


def holed(c: Canon):
    """Orders and nations with values blanked by rule, so that every severity occurs."""
    orders = c.table("orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).alias("resolution_outcome"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("o_totalprice"))
    return {"orders": orders, "nation": c.table("nation")}


@query("null_profile", sql(
    """with p as (select 'orders' as "table", 'o_orderkey' as "column", count(*) as rows, 0 as nulls from orders
                  union all select 'orders', 'o_custkey', count(*), count(*) filter (o_orderkey % 5 = 0) from orders
                  union all select 'orders', 'resolution_outcome', count(*), count(*) filter (o_orderkey % 4 <> 0) from orders
                  union all select 'orders', 'o_totalprice', count(*), count(*) filter (o_orderkey % 4 <> 0) from orders
                  union all select 'nation', 'n_nationkey', count(*), 0 from nation union all select 'nation', 'n_name', count(*), 0 from nation
                  union all select 'nation', 'n_regionkey', count(*), 0 from nation)
       select *, nulls * 100.0 / rows as null_pct, case when "column" = 'o_totalprice' then 'CRITICAL' when "column" = 'o_custkey' then 'WARNING' end as severity from p""",
    "null_pct"))
def null_profile(c: Canon):
    return audit.null_profile(holed(c))


def tables(c: Canon):
    return {"events": c.events, "markets": c.markets, "tokens": c.tokens, "price_history": c.prices, "features": price_features(c), "clusters": assigned(c)}


def lines(c: Canon):
    return {"lineitem": c.table("lineitem"), "price_history": c.prices}


@query("duplicate_keys", sql(
    """select 'lineitem' as "table", count(*) as rows, count(*) - count(distinct (l_orderkey, l_linenumber)) as duplicates from lineitem
       union all select 'price_history', count(*), count(*) - count(distinct (asset_id, ts)) from t_prices"""))
def duplicate_keys(c: Canon):
    return audit.duplicate_keys(lines(c), {"lineitem": ("l_orderkey", "l_linenumber"), "price_history": ("asset_id", "ts")})


@query("orphan_keys", sql(
    """with x(child, parent, k, found) as (
         select distinct 'markets.event_id', 'events.event_id', cast(event_id as varchar), event_id in (select event_id from t_events) from t_markets
         union all select distinct 'tokens.market_id', 'markets.market_id', market_id, market_id in (select market_id from t_markets) from t_tokens
         union all select distinct 'tokens.asset_id', 'price_history.asset_id', asset_id, asset_id in (select asset_id from t_prices) from t_tokens
         union all select distinct 'price_history.asset_id', 'features.asset_id', asset_id, asset_id in (select asset_id from f_price) from t_prices)
       select child, parent, count(*) as keys, count(*) filter (not found) as orphans, count(*) filter (not found) * 100.0 / count(*) as orphan_pct from x group by 1, 2""",
    "orphan_pct"))
def orphan_keys(c: Canon):
    refs = (("markets", "event_id", "events", "event_id"), ("tokens", "market_id", "markets", "market_id"),
            ("tokens", "asset_id", "price_history", "asset_id"), ("price_history", "asset_id", "features", "asset_id"))
    return audit.orphans(tables(c), refs)


@query("coverage_funnel", sql(
    """select 'events' as stage, count(*) as assets from t_events union all select 'markets', count(*) from t_markets union all select 'tokens', count(*) from t_tokens
       union all select 'priced', count(distinct asset_id) from t_prices union all select 'features', count(*) from f_price union all select 'clustered', count(*) from c_assigned"""))
def coverage_funnel(c: Canon):
    return audit.coverage_funnel(tables(c))


@query("time_span", sql(
    """select min(ts) as first_ts, max(ts) as last_ts, (max(ts) - min(ts)) / 86400.0 as days,
              case when max(ts) - min(ts) < 86400 then 'CRITICAL' when max(ts) - min(ts) < 604800 then 'WARNING' end as severity from t_prices""", "days"))
def time_span(c: Canon):
    return audit.time_span(c.prices)


@query("points_per_asset", sql(
    """select min(k) as min, max(k) as max, avg(k) as mean, quantile_cont(k, 0.05) as p5, quantile_cont(k, 0.25) as p25, median(k) as median,
              quantile_cont(k, 0.75) as p75, quantile_cont(k, 0.95) as p95, min(k) = max(k) as uniform, max(k) <= 10 as too_few
       from (select cast(history_points_raw as bigint) as k from q_counts) x""", "mean p5 p25 median p75 p95"))
def points_per_asset(c: Canon):
    return audit.points_per_asset(c.prices)


def doubled(c: Canon):
    """Ticks with every tenth row repeated, so that gaps of zero occur."""
    return c.prices.unionByName(c.prices.where("seq % 10 = 0"))


@query("gap_profile", sql(
    """with d as (select asset_id, ts from t_prices union all select asset_id, ts from t_prices where seq % 10 = 0),
            g as (select ts - lag(ts) over (partition by asset_id order by ts) as gap from d)
       select count(gap) as gaps, min(gap) as min, max(gap) as max, median(gap) as median, quantile_cont(gap, 0.95) as p95,
              count(*) filter (gap <= 0) as non_positive from g""", "median p95"))
def gap_profile(c: Canon):
    return audit.gap_profile(doubled(c))


@query("price_sanity", sql(
    """select count(*) filter (price < 0) as below_zero, count(*) filter (price > 1) as above_one, count(*) filter (price = 0) as at_zero,
              count(*) filter (price = 1) as at_one, min(price) as min, max(price) as max, avg(price) as mean, median(price) as median from t_prices""",
    "min max mean median"))
def price_sanity(c: Canon):
    return audit.price_sanity(c.prices)


PROFILED = ["p_start", "volatility", "num_points", "return_30d", "pass", "three"]


PROFILE_SQL = (
    "with x as (select *, 1 as pass, idx3 as three from (select *, cast(asset_id as bigint) % 3 as idx3 from f_price)) " + " union all ".join(
        f"""select '{f}' as feature, cast(least(count(distinct {f}), 4) as integer) as distinct_up_to_4, cast(min({f}) as double) as min, cast(max({f}) as double) as max,
            case when count({f}) = 0 then 'all_null_expected' when count(distinct {f}) = 1 then 'constant' when count(distinct {f}) <= 3 then 'low_variance' else 'varied' end as verdict from x"""
        for f in PROFILED))


@query("feature_profile", sql(PROFILE_SQL, "min max"))
def feature_profile(c: Canon):
    rows = price_features(c).withColumn("pass", F.lit(1)).withColumn("three", F.col("asset_id").cast("bigint") % 3)
    return audit.feature_profile(rows, PROFILED)


@query("quality_rates", sql(
    " union all ".join(f"""select '{x}' as "check", avg(case when {x} then 1.0 else 0.0 end) as pass_rate,
        case when '{x}' = 'quality_pass' and avg(case when {x} then 1.0 else 0.0 end) < 0.2 then 'WARNING' end as severity from q_quality"""
        for x in ("quality_pass", "check_min_points", "check_missing_ratio", "check_price_range", "check_liquidity")), "pass_rate"))
def quality_rates(c: Canon):
    return audit.quality_rates(graded(c))


@query("count_deltas", sql(
    """with now as (select 'orders' as t, count(*) as n from orders union all select 'customer', count(*) from customer union all select 'nation', count(*) from nation),
            was as (select 'orders' as t, count(*) as n from lineitem union all select 'customer', count(*) from supplier)
       select now.t as "table", coalesce(was.n, 0) as previous, now.n as rows, now.n - coalesce(was.n, 0) as delta,
              case when now.n - coalesce(was.n, 0) < -10 then 'shrunk' when now.n - coalesce(was.n, 0) > 0 then 'grew' else '' end as note
       from now left join was on now.t = was.t"""))
def count_deltas(c: Canon):
    current = audit.row_counts({t: c.table(t) for t in ("orders", "customer", "nation")})
    baseline = audit.row_counts({"orders": c.table("lineitem"), "customer": c.table("supplier")})
    return audit.count_deltas(current, baseline)


def found(c: Canon):
    t = tables(c)
    refs = (("tokens", "asset_id", "price_history", "asset_id"),)
    return audit.issues(
        audit.null_profile(holed(c)), audit.duplicate_keys(lines(c), {"lineitem": ("l_orderkey", "l_linenumber")}), audit.orphans(t, refs),
        audit.time_span(c.prices), audit.price_sanity(c.prices), audit.gap_profile(doubled(c)))


cte("a_issues", """
select 'CRITICAL' as severity, 'nulls' as area, 'orders.o_totalprice' as subject, count(*) filter (o_orderkey % 4 <> 0) * 100.0 / count(*) as amount from orders
union all select 'WARNING', 'nulls', 'orders.o_custkey', count(*) filter (o_orderkey % 5 = 0) * 100.0 / count(*) from orders
union all select 'WARNING', 'duplicates', 'lineitem', count(*) - count(distinct (l_orderkey, l_linenumber)) from lineitem
union all select 'WARNING', 'orphans', 'tokens.asset_id->price_history.asset_id', count(distinct asset_id) filter (asset_id not in (select asset_id from t_prices)) from t_tokens
union all select 'CRITICAL', 'gaps', 'price_history', count(*) from t_prices where seq % 10 = 0""")


@query("audit_issues", sql("select * from a_issues", "amount"))
def audit_issues(c: Canon):
    return found(c)


@query("audit_verdict", sql(
    """select count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'WARNING') as warnings,
              count(*) filter (severity = 'CRITICAL') = 0 as ready from a_issues"""))
def audit_verdict(c: Canon):
    return audit.verdict(found(c))


@query("audit_result_issues", sql(
    """with p as (select count(*) as n from t_prices group by asset_id), s as (select count(*) as n from c_assigned group by cluster_id),
            q as (select avg(case when quality_pass then 1.0 else 0.0 end) as pass from q_quality),
            a as (select price_coverage_pct as pct from r_runs order by run_ts desc, run_id desc limit 5),
            b as (select signals_generated as made from r_runs where signals_expected order by run_ts desc, run_id desc limit 10)
       select 'WARNING' as severity, 'points' as area, 'uniform' as subject, cast(min(n) as double) as amount from p having min(n) = max(n)
       union all select 'CRITICAL', 'points', 'too_few', max(n) from p having max(n) <= 10
       union all select 'WARNING', 'features', feature, distinct_up_to_4 from (""" + PROFILE_SQL + """) f where verdict in ('constant', 'low_variance')
       union all select 'WARNING', 'clusters', 'under three members', count(*) from s where n < 3 having count(*) > 0
       union all select 'WARNING', 'quality', 'quality_pass', pass from q where pass < 0.2
       union all select 'WARNING', 'runs', 'price_coverage_pct', avg(pct) from a having count(*) = 5 and stddev_samp(pct) < 0.001
       union all select 'WARNING', 'runs', 'signals_generated', 0 from b having max(made) = 0""", "amount"))
def audit_result_issues(c: Canon):
    rows = price_features(c).withColumn("pass", F.lit(1)).withColumn("three", F.col("asset_id").cast("bigint") % 3)
    return audit.result_issues(
        audit.points_per_asset(c.prices), audit.feature_profile(rows, PROFILED), audit.cluster_audit(assigned(c)), audit.quality_rates(graded(c)),
        health.run_trends(runs(c)))


# ---- exploration ----

cte("e_sum", """
select asset_id, any_value(points) as points, arg_min(price, ts) as first_price, arg_max(price, ts) as last_price, max(price) as max_price, min(price) as min_price,
       min(ts) as first_ts, max(ts) as last_ts, arg_max(price, ts) - arg_min(price, ts) as window_return,
       (arg_max(price, ts) - arg_min(price, ts)) * 100 as window_return_pct
from s_ticks join (select asset_id as a, history_points_raw as points from q_counts) c on asset_id = a group by 1""")
cte("e_roll", """
select market_id, avg(case when quality_pass then 1.0 else 0.0 end) as quality_pass_rate, bool_or(quality_pass) as quality_pass_any, avg(missing_ratio) as avg_missing_ratio,
       avg(volatility) as avg_volatility, avg(price_range) as avg_price_range, max(history_points_raw) as history_points from q_quality group by 1""")
cte("e_table", """
select m.market_id, m.event_id, m.condition_id, m.question, m.active, m.closed, m.market_type, m.liquidity, e.title as event_title, e.slug as event_slug,
       e.tag as primary_tag, e.start_ts, e.end_ts, cast(2 as bigint) as token_count, a.asset_id as anchor_asset_id, a.outcome as anchor_outcome,
       s.points, s.first_price, s.last_price, s.max_price, s.min_price, s.first_ts, s.last_ts, s.window_return, s.window_return_pct,
       coalesce(r.quality_pass_rate, 0) as quality_pass_rate, coalesce(r.quality_pass_any, false) as quality_pass_any, r.avg_missing_ratio, r.avg_volatility,
       r.avg_price_range, r.history_points, s.points is not null as has_history
from t_markets m join t_events e on m.event_id = e.event_id join t_anchors a on m.market_id = a.market_id left join e_sum s on a.asset_id = s.asset_id
left join e_roll r on m.market_id = r.market_id""")
cte("e_tags", """
select primary_tag, count(distinct market_id) as markets, avg(case when has_history then 1.0 else 0.0 end) as coverage_pct,
       avg(case when quality_pass_any then 1.0 else 0.0 end) as quality_pass_pct, avg(liquidity) as avg_liquidity, median(window_return_pct) as median_return_pct
from e_table group by 1""")
cte("e_down", """
select *, row_number() over (partition by asset_id order by ts, price) as rn, count(*) over (partition by asset_id) as n from t_prices""")
TABLE_DOUBLES = (
    "liquidity first_price last_price max_price min_price window_return window_return_pct quality_pass_rate avg_missing_ratio avg_volatility avg_price_range")


def table(c: Canon):
    return explore.market_table(c.events, c.markets, c.tokens, c.prices, graded(c))


@query("price_summary", sql("select * from e_sum", "first_price last_price max_price min_price window_return window_return_pct"))
def price_summary(c: Canon):
    return explore.price_summary(c.prices)


@query("market_table", sql("select * from e_table", TABLE_DOUBLES))
def market_table(c: Canon):
    return table(c)


@query("tag_table", sql("select * from e_tags", "coverage_pct quality_pass_pct avg_liquidity median_return_pct"))
def tag_table(c: Canon):
    return explore.tag_table(table(c))


@query("tag_chart", sql(
    """select primary_tag, markets, coverage_pct * 100 as coverage_pct, quality_pass_pct * 100 as quality_pass_pct, avg_liquidity, median_return_pct
       from e_tags order by markets desc, primary_tag limit 30""", "coverage_pct quality_pass_pct avg_liquidity median_return_pct"))
def tag_chart(c: Canon):
    return explore.tag_chart(explore.tag_table(table(c)))


@query("filtered_markets", sql(
    """select market_id, liquidity, last_price from e_table where (regexp_matches(lower(question), '00[1-9]+$') or regexp_matches(lower(event_title), '00[1-9]+$')
       or regexp_matches(market_id, '00[1-9]+$')) and primary_tag in ('ASIA', 'EUROPE', 'AFRICA') and market_type in ('binary') and active and liquidity >= 500
       order by liquidity desc, market_id limit 50""", "liquidity last_price"))
def filtered_markets(c: Canon):
    return explore.filter_markets(table(c), search=" 00[1-9]+$", tags=["ASIA", "EUROPE", "AFRICA"], types=["binary"], status="active_only",
                                  min_liquidity=500, limit=50).select("market_id", "liquidity", "last_price")


@query("visible_kpis", sql(
    """select count(*) as markets, avg(case when has_history then 100.0 else 0.0 end) as history_pct, avg(case when quality_pass_any then 100.0 else 0.0 end) as quality_pct,
              avg(liquidity) as avg_liquidity from e_table where has_history and closed""", "history_pct quality_pct avg_liquidity"))
def visible_kpis(c: Canon):
    return explore.kpis(explore.filter_markets(table(c), status="closed_only", require_history=True, limit=None))


@query("downsampled_history", sql(
    """select asset_id, ts, price from e_down where n <= 20 or (rn - 1) % greatest(1, n // 20) = 0 or rn = n""", "price"))
def downsampled_history(c: Canon):
    return explore.downsample(c.prices.select("asset_id", "ts", "price"), 20)


def shared_labels(c: Canon):
    """Markets of three outcomes of which two share a label and one is blank."""
    key = F.col("asset_id").cast("bigint")
    return c.prices.select("asset_id").distinct().select(
        F.concat(F.lit("g"), F.floor(key / 3).cast("string")).alias("market_id"), "asset_id", F.when(key % 3 < 2, "Same").otherwise(" ").alias("outcome"))


cte("e_labels", """
select 'g' || cast(k // 3 as varchar) as market_id, asset_id, case when k % 3 < 2 then 'Same' else asset_id end as outcome_label,
       case when k % 3 < 2 then 'Same | ' || asset_id else asset_id end as series_label from (select asset_id, cast(asset_id as bigint) as k from q_counts) x""")


@query("outcome_series", sql(
    "select l.market_id, l.asset_id, l.outcome_label, l.series_label, p.ts, p.price from e_labels l join t_prices p on l.asset_id = p.asset_id", "price"))
def outcome_series(c: Canon):
    return explore.outcome_series_all(shared_labels(c), c.prices)


@query("latest_per_outcome", sql(
    """select l.market_id, l.outcome_label, arg_max(p.price, struct_pack(a := p.ts, b := p.asset_id)) as price, max(p.ts) as ts,
              arg_max(p.asset_id, struct_pack(a := p.ts, b := p.asset_id)) as asset_id
       from e_labels l join t_prices p on l.asset_id = p.asset_id group by 1, 2""", "price"))
def latest_per_outcome(c: Canon):
    return explore.latest_per_outcome(explore.outcome_series_all(shared_labels(c), c.prices), ("market_id", "outcome_label"))


@query("outcome_pivot", sql(
    """select market_id, p.ts // 86400 as day, arg_max(p.price, l.asset_id) filter (outcome_label = 'Same') as same,
              arg_max(p.price, l.asset_id) filter (outcome_label <> 'Same') as other
       from e_labels l join (select asset_id, ts // 86400 * 86400 as ts, arg_max(price, ts) as price from s_ticks group by 1, 2) p on l.asset_id = p.asset_id group by 1, 2""",
    "same other"))
def outcome_pivot(c: Canon):
    from oddsmill.operators.relationships import daily_closes

    daily = daily_closes(c.prices).select("asset_id", F.col("day").alias("ts"), F.col("close").alias("price"))
    series = explore.outcome_series_all(shared_labels(c), daily).withColumn("series_label", F.when(F.col("outcome_label") == "Same", "same").otherwise("other"))
    return explore.series_pivot(series, ["same", "other"], ("market_id", "ts")).withColumnRenamed("ts", "day")


@query("event_composite", sql(
    """select event_id, d.ts, avg(d.price) as mean_price, count(*) as market_count, quantile_cont(d.price, 0.25) as p25, median(d.price) as median_price,
              quantile_cont(d.price, 0.75) as p75
       from e_table t join s_ticks d on t.anchor_asset_id = d.asset_id group by 1, 2""",
    "mean_price p25 median_price p75"))
def event_composite(c: Canon):
    return explore.event_composite(table(c), canonical_ticks(c.prices))


@query("event_lines", sql(
    """with b as (select anchor_asset_id, question, market_id from e_table where event_id = 7 order by liquidity desc, market_id limit 12),
            p as (select asset_id, ts, price, rn, n from e_down)
       select p.asset_id, b.market_id, left(question, 65) || ' | ' || market_id as series_label, p.ts, p.price from b join p on b.anchor_asset_id = p.asset_id
       where n <= 20 or (rn - 1) % greatest(1, n // 20) = 0 or rn = n""", "price"))
def event_lines(c: Canon):
    return explore.top_market_lines(table(c), c.prices, 7, 12, 20)


@query("event_options", sql(
    "select event_id, title as event_title, tag as primary_tag, title || ' | ' || tag || ' | ' || event_id as label from t_events where event_id in (select event_id from t_markets)"))
def event_options(c: Canon):
    return explore.event_options(table(c))


@query("event_kpis", sql(
    """select event_id, count(distinct market_id) as markets, count(*) filter (has_history) as with_history, median(liquidity) as median_liquidity,
              median(last_price) as median_last_price from e_table group by 1""", "median_liquidity median_last_price"))
def event_kpis(c: Canon):
    return explore.event_kpis(table(c))


@query("event_markets", sql(
    """select event_id, cast(row_number() over (partition by event_id order by liquidity desc, market_id) as integer) as rank, market_id, question, liquidity, last_price,
              window_return_pct, points, quality_pass_any from e_table qualify row_number() over (partition by event_id order by liquidity desc, market_id) <= 10""",
    "liquidity last_price window_return_pct"))
def event_markets(c: Canon):
    return explore.event_markets(table(c), 10)


@query("market_map", sql(
    """with r as (select * from e_table where liquidity is not null and window_return_pct is not null),
            t as (select primary_tag from r group by 1 order by count(*) desc, primary_tag limit 3)
       select market_id, question, r.primary_tag, liquidity, window_return_pct, points, coalesce(t.primary_tag, 'Other') as tag_bucket
       from r left join t on r.primary_tag = t.primary_tag""", "liquidity window_return_pct"))
def market_map(c: Canon):
    return explore.market_map(table(c), 3)


@query("biggest_movers", sql(
    """select market_id, question, primary_tag, liquidity, window_return_pct, points from e_table where liquidity is not null and window_return_pct is not null
       order by abs(window_return_pct) desc, market_id limit 20""", "liquidity window_return_pct"))
def biggest_movers(c: Canon):
    return explore.biggest_movers(table(c))


@query("market_details", sql(
    """select q.asset_id, history_points_raw, q.missing_ratio, price_range, q.volatility, q.return_total, quality_pass, c.cluster_id, c.primary_tag
       from q_quality q left join c_assigned c on q.asset_id = c.asset_id where q.market_id = '7'""", "missing_ratio price_range volatility return_total"))
def market_details(c: Canon):
    return explore.market_detail("7", graded(c), assigned(c))


@query("filter_choices", sql("select 'primary_tag' as field, primary_tag as value from e_table group by 2 union all select 'market_type', market_type from e_table group by 2"))
def filter_choices(c: Canon):
    return explore.choices(table(c))


@query("pnl_curve", sql(
    """select signal_name, market_id, asset_id, exit_ts, pnl, sum(pnl) over (order by exit_ts, signal_name, market_id, asset_id rows unbounded preceding) as cum_pnl from b_trades""",
    "pnl cum_pnl"))
def pnl_curve(c: Canon):
    return explore.pnl_curve(settled(c))


@query("backtest_kpis", sql(
    "select count(*) as trades, sum(pnl) as total_pnl, avg(case when pnl > 0 then 1.0 else 0.0 end) as win_rate, avg(hold_days) as avg_hold_days from b_trades",
    "total_pnl win_rate avg_hold_days"))
def backtest_kpis(c: Canon):
    return explore.backtest_kpis(settled(c))


@query("trade_log", sql(
    "select signal_name, asset_id, market_id, direction, entry_price, exit_price, pnl, return_pct, hold_days, exit_reason from b_trades",
    "entry_price exit_price pnl return_pct hold_days"))
def trade_log(c: Canon):
    return explore.trade_log(settled(c))


SIGNAL_NAMES = ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low")
SIGNAL_COLUMNS = [n.replace(" ", "_") for n in SIGNAL_NAMES]


@query("confidence_by_day", sql(
    "select ts // 86400 as day, " + ", ".join(f"""avg(confidence) filter (signal_name = '{n}') as "{k}\"""" for n, k in zip(SIGNAL_NAMES, SIGNAL_COLUMNS))
    + " from t_signal_log group by 1", " ".join(f'"{k}"' for k in SIGNAL_COLUMNS)))
def confidence_by_day(c: Canon):
    return explore.confidence_by_day(c.signal_log, SIGNAL_NAMES).toDF("day", *SIGNAL_COLUMNS)


@query("confidence_edge_pairs", sql("select confidence, edge, signal_name from t_signal_log", "confidence edge"))
def confidence_edge_pairs(c: Canon):
    return explore.confidence_edge_pairs(c.signal_log)
