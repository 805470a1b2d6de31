"""Queries on quality, relationships, signals, settlement and hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.catalog.registry import query
from oddsmill.catalog.series import SERIES, all_features
from oddsmill.catalog.sqltext import sql
from oddsmill.operators import candidates, features, hypotheses, mtm, quality, relationships, settle, signals
from oddsmill.operators.normalize import anchor_tokens, select_tokens
from oddsmill.sources.adapters import AS_OF, Canon

GATES = {"min_points": 60, "max_missing_ratio": 0.4, "min_price_range": 0.5, "min_liquidity": 1000.0}
RULES = signals.Settings(imbalance_ratio=1.5)
SUMMARY_DOUBLES = (
    "coverage_pct avg_volatility avg_return_total avg_slope median_num_points median_missing_ratio quality_pass_rate")
RANK_SQL = ", ".join(quality.RANK_COLUMNS)


def targets(c: Canon):
    return select_tokens(c.tokens, c.markets, yes_only_binary=True)


def price_features(c: Canon):
    return features.price_features(features.clean_series(c.prices, **SERIES), SERIES["interval"])


def graded(c: Canon):
    return quality.market_quality(targets(c), c.markets, c.prices, price_features(c), **GATES)


def summary(c: Canon):
    return quality.tag_summary(c.events, c.markets, targets(c), c.prices, price_features(c), graded(c))


@query("market_quality", sql("select * from q_quality", "liquidity missing_ratio price_range volatility return_total slope"))
def market_quality(c: Canon):
    return graded(c)


@query("tag_summary", sql("select * from q_summary", SUMMARY_DOUBLES))
def tag_summary(c: Canon):
    return summary(c)


@query("tag_rankings", sql(
    f"""select 'highest_volatility_tags' as ranking, cast(row_number() over (order by avg_volatility desc, primary_tag) as integer) as rank, {RANK_SQL} from q_summary
        union all select 'strongest_upward_trend_tags', row_number() over (order by avg_slope desc, primary_tag), {RANK_SQL} from q_summary
        union all select 'strongest_downward_trend_tags', row_number() over (order by avg_slope, primary_tag), {RANK_SQL} from q_summary
        union all select 'lowest_coverage_tags', row_number() over (order by coverage_pct, primary_tag), {RANK_SQL} from q_summary
        union all select 'highest_quality_pass_rate_tags', row_number() over (order by quality_pass_rate desc, tokens desc, primary_tag), {RANK_SQL} from q_summary""",
    "coverage_pct quality_pass_rate avg_volatility avg_slope"))
def tag_rankings(c: Canon):
    return quality.tag_rankings(summary(c))


@query("coverage_report", sql(
    """with c as (select t.asset_id, q.history_points_raw as k from (select distinct asset_id from t_targets) t left join q_counts q on t.asset_id = q.asset_id)
       select 'events_discovered' as metric, cast(count(*) as double) as value from t_events
       union all select 'markets_discovered', count(*) from t_markets
       union all select 'tokens_extracted', count(distinct asset_id) from t_tokens
       union all select 'tokens_targeted_for_history', count(*) from c
       union all select 'tokens_with_non_empty_history', count(k) from c
       union all select 'pct_targeted_with_history', count(k) / count(*) from c
       union all select 'median_points_per_token', median(k) from c""", "value"))
def coverage_report(c: Canon):
    return quality.coverage_block(c.events, c.markets, c.tokens, targets(c), c.prices)


@query("quality_report", sql(
    """select 'quality_total_assets' as metric, cast(count(*) as double) as value from q_quality
       union all select 'quality_pass_assets', count(*) filter (quality_pass) from q_quality
       union all select 'quality_pass_rate', avg(case when quality_pass then 1.0 else 0.0 end) from q_quality
       union all select 'failed_min_points', count(*) filter (not check_min_points) from q_quality
       union all select 'failed_missing_ratio', count(*) filter (not check_missing_ratio) from q_quality
       union all select 'failed_price_range', count(*) filter (not check_price_range) from q_quality
       union all select 'failed_liquidity', count(*) filter (not check_liquidity) from q_quality""", "value"))
def quality_report(c: Canon):
    return quality.quality_block(graded(c))


@query("top_tags_by_tokens", sql(
    "select primary_tag, tokens, coverage_pct * 100 as coverage_pct from q_summary order by tokens desc, primary_tag limit 15", "coverage_pct"))
def top_tags_by_tokens(c: Canon):
    return quality.top_tags_by_tokens(summary(c))


@query("latest_prices", sql("select * from g_latest", "price"))
def latest_prices(c: Canon):
    return relationships.latest_prices(c.prices)


@query("daily_closes", sql("select asset_id, ts // 86400 as day, arg_max(price, ts) as close from s_ticks group by 1, 2", "close"))
def daily_closes(c: Canon):
    return relationships.daily_closes(c.prices)


def grouped_tokens(c: Canon):
    """Markets of three priced outcomes each, so that overrounds exist."""
    key = F.col("asset_id").cast("bigint")
    return c.prices.select("asset_id").distinct().select(F.concat(F.lit("g"), F.floor(key / 3).cast("string")).alias("market_id"), "asset_id")


@query("market_overround", sql(
    """select 'g' || cast(cast(asset_id as bigint) // 3 as varchar) as market_id, count(*) as priced, sum(price) - 1 as overround
       from g_latest group by 1 having count(*) >= 2""", "overround"))
def market_overround(c: Canon):
    return relationships.market_overround(grouped_tokens(c), c.prices)


@query("overround_pairs", sql(
    """with t as (select 'g' || cast(cast(asset_id as bigint) // 3 as varchar) as m, asset_id, price from g_latest),
            o as (select m, sum(price) - 1 as overround from t group by 1)
       select a.asset_id as asset_id_a, b.asset_id as asset_id_b, 'intra_event' as relationship_type, cast(null as double) as correlation,
              o.overround, cast(null as bigint) as overlap_days
       from t a join t b on a.m = b.m and a.asset_id < b.asset_id join o on a.m = o.m""", "correlation overround"))
def overround_pairs(c: Canon):
    return relationships.overround_pairs(grouped_tokens(c), c.prices)


@query("market_relationships", sql(
    """with d as (select asset_id, ts // 86400 as day, arg_max(price, ts) as close from s_ticks group by 1, 2),
            k as (select asset_id from d group by 1 having count(*) >= 15),
            t as (select a.asset_id, g.primary_tag, d.day, d.close from t_anchors a join q_tags g on a.market_id = g.market_id
                  join k on a.asset_id = k.asset_id join d on a.asset_id = d.asset_id)
       select x.asset_id as asset_id_a, y.asset_id as asset_id_b, 'cross_event' as relationship_type, corr(x.close, y.close) as correlation,
              cast(null as double) as overround, count(*) as overlap_days
       from t x join t y on x.primary_tag = y.primary_tag and x.day = y.day and x.asset_id < y.asset_id
       group by 1, 2 having count(*) >= 15 and abs(corr(x.close, y.close)) >= 0.3""", "correlation overround"))
def market_relationships(c: Canon):
    return relationships.market_relationships(c.events, c.markets, c.tokens, c.prices, threshold=0.3, min_overlap=15)


@query("base_rates", sql("select tag as primary_tag, base_rate from g_rates", "base_rate"))
def base_rates(c: Canon):
    return signals.base_rates(c.resolutions, c.markets, c.events)


def frame(c: Canon):
    return signals.signal_frame(
        all_features(c), targets(c), c.markets, c.events, c.prices, c.bars, signals.base_rates(c.resolutions, c.markets, c.events))


def evaluated(c: Canon):
    return signals.evaluate(frame(c), settings=RULES)


@query("signal_frame", sql(
    "select asset_id, market_id, event_id, question, primary_tag, price, raw_points, last_volume, mean_volume * bar_count as sum_volume, bar_count, base_rate, avg_spread from g_frame",
    "price last_volume sum_volume base_rate avg_spread"))
def signal_frame(c: Canon):
    return frame(c).select("asset_id", "market_id", "event_id", "question", "primary_tag", "price", "raw_points", "last_volume",
                           (F.col("mean_volume") * F.col("bar_count")).alias("sum_volume"), "bar_count", "base_rate", "avg_spread")


@query("signals_fired", sql("select * from g_fired", "confidence entry_price target_price edge"))
def signals_fired(c: Canon):
    return signals.fired(evaluated(c), AS_OF).drop("metadata_json")


@query("signals_calibration", sql(
    """select 'calibration_mispricing' as signal_name, asset_id, market_id, cast(1706659200 as bigint) as ts,
              case when base_rate > price then 'buy' else 'sell' end as direction, abs(base_rate - price) as confidence, price as entry_price,
              base_rate as target_price, abs(base_rate - price) - 0.15 as edge from g_frame where abs(base_rate - price) >= 0.15 and not wide""",
    "confidence entry_price target_price edge"))
def signals_calibration(c: Canon):
    rules = signals.active_rules(["calibration"])
    return signals.fired(signals.evaluate(frame(c), rules, RULES), AS_OF).drop("metadata_json")


@query("signals_range_reversal", sql(
    """with t as (select asset_id, min(price) as lo, max(price) as hi, avg(price) as mean from t_prices group by 1)
       select 'range_reversal' as signal_name, asset_id, market_id, cast(1706659200 as bigint) as ts,
              case when (price - lo) / (hi - lo) >= 0.9 then 'sell' else 'buy' end as direction, least(1.0, abs((price - lo) / (hi - lo) - 0.5) * 2) as confidence,
              price as entry_price, mean as target_price, abs(mean - price) as edge
       from g_frame join t using (asset_id) where hi - lo >= 0.05 and not wide and ((price - lo) / (hi - lo) >= 0.9 or (price - lo) / (hi - lo) <= 0.1)""",
    "confidence entry_price target_price edge"))
def signals_range_reversal(c: Canon):
    """A rule with aggregates of its own over the ticks."""
    rules = signals.active_rules(["range_reversal"])
    rows = signals.signal_frame(all_features(c), targets(c), c.markets, c.events, c.prices, rules=rules)
    return signals.fired(signals.evaluate(rows, rules, RULES), AS_OF).drop("metadata_json")


@query("signal_diagnostics", sql(
    """select signal, coalesce(reason, 'generated') as key, count(*) as n from g_eval group by 1, 2
       union all select signal, 'considered', count(*) from g_eval where considered group by 1"""))
def signal_diagnostics(c: Canon):
    return signals.diagnostics(evaluated(c))


@query("signal_diagnostic_samples", sql(
    """select signal, coalesce(reason, 'generated') as key, asset_id, market_id, primary_tag from g_eval
       qualify row_number() over (partition by signal, coalesce(reason, 'generated') order by asset_id, market_id) <= 5"""))
def signal_diagnostic_samples(c: Canon):
    return signals.diagnostic_samples(evaluated(c), 5)


@query("signal_explanations", sql(
    """select signal_name, s.asset_id, case signal_name when 'resolution_convergence' then
          printf('Market %.1fd from resolution, price near %s.', f.days_to_resolution, case when s.direction = 'buy' then '1.0' else '0.0' end)
          when 'momentum_breakout' then printf('Price moved %+.1f%% on %.1fx avg volume; momentum %s.', round_even(f.return_1d, 4) * 100,
               round_even(f.last_volume / f.mean_volume, 2), s.direction)
          else printf('Orderbook imbalance %.1fx favors %s.', round_even(f.avg_bid_depth / f.avg_ask_depth, 2), s.direction) end as reasoning
       from g_fired s join g_frame f on s.asset_id = f.asset_id and s.market_id = f.market_id"""))
def signal_explanations(c: Canon):
    rows = signals.fired(evaluated(c), AS_OF)
    text = signals.explanation(F.col("signal_name"), F.col("direction"), F.col("edge"), F.col("metadata_json"))
    return rows.select("signal_name", "asset_id", text.alias("reasoning"))


CANDIDATE_DOUBLES = "current_price confidence edge expected_value suggested_size kelly_fraction spread spread_pct liquidity days_to_resolution"


@query("trade_candidates", sql(
    """with l as (select asset_id, arg_max(spread, snapshot_ts) as spread, arg_max(spread_pct, snapshot_ts) as spread_pct from t_books where spread is not null group by 1),
            s as (select s.*, m.question, m.liquidity, f.days_to_resolution, l.spread, l.spread_pct,
                         least(0.999999, greatest(0.000001, case when direction = 'buy' then entry_price else 1 - entry_price end)) as c
                  from t_signal_log s join t_markets m on s.market_id = m.market_id join f_all f on s.asset_id = f.asset_id
                  join q_base q on q.asset_id = s.asset_id left join l on s.asset_id = l.asset_id
                  where q.history_points_raw >= 50 and q.missing_ratio <= 0.8 and q.price_range >= 0.02 and f.num_points >= 7 and s.confidence >= 0.55 and s.edge >= 0.05 and coalesce(l.spread_pct, 0) <= 0.1),
            k as (select *, least(1, greatest(0, (confidence * ((1 - c) / c) - (1 - confidence)) / ((1 - c) / c))) as kelly_fraction, edge * confidence as expected_value from s),
            z as (select *, least(10000 * kelly_fraction * 0.25, 500) as suggested_size from k where kelly_fraction > 0 and least(10000 * kelly_fraction * 0.25, 500) >= 1)
       select cast(row_number() over (order by expected_value desc, edge desc, confidence desc, signal_name, asset_id, ts) as integer) as rank, '2024-01-31' as run_date, market_id,
              asset_id, question, entry_price as current_price, signal_name, direction, confidence, edge, expected_value, suggested_size,
              kelly_fraction, spread, spread_pct, liquidity, days_to_resolution,
              printf('%s generated %s with edge %.3f', signal_name, direction, edge) as reasoning, ts
       from z order by 1 limit 20""", CANDIDATE_DOUBLES))
def trade_candidates(c: Canon):
    log = c.signal_log.withColumn("metadata_json", F.lit("{}"))
    loose = quality.market_quality(targets(c), c.markets, c.prices, price_features(c), min_points=50)
    return candidates.trade_candidates(
        log, c.markets, all_features(c), quality=loose, books=c.books, run_date="2024-01-31").drop("cluster_id")


def settled(c: Canon):
    return settle.settle_at_resolution(c.signal_log, c.resolutions, c.books, timeout_days=10)


@query("settled_signals", sql(
    "select * from b_trades",
    "entry_price entry_cost exit_price pnl return_pct hold_days kelly_fraction position_size bankroll_at_entry"))
def settled_signals(c: Canon):
    return settled(c)


@query("settlement_summary", sql(
    """select s.signal_name, total_trades, win_rate, avg_pnl, median_pnl, total_pnl, avg_hold_days, profit_factor, max_drawdown, sharpe_ratio
       from b_stats s join b_path p on s.level = p.level and s.signal_name is not distinct from p.signal_name""",
    "win_rate avg_pnl median_pnl total_pnl avg_hold_days profit_factor max_drawdown sharpe_ratio"))
def settlement_summary(c: Canon):
    return settle.summarize(settled(c))


def marked(c: Canon):
    return mtm.mark_to_market(c.signal_log, c.prices, c.books)


@query("mark_to_market", sql(
    "select * from m_marked", "confidence edge entry_price exit_price price_move pnl return_pct position_size"))
def mark_to_market(c: Canon):
    return marked(c)


@query("mark_to_market_summary", sql(
    """select level, name, horizon_hours, count(*) as trades, avg(case when price_move > 0 then 1.0 else 0.0 end) as hit_rate,
              avg(price_move) as avg_price_move, median(price_move) as median_price_move, sum(pnl) as total_pnl, avg(pnl) as avg_pnl,
              avg(case when pnl > 0 then 1.0 else 0.0 end) as win_rate, avg(return_pct) as avg_return_pct,
              case when stddev_pop(pnl) > 0 then avg(pnl) / stddev_pop(pnl) * sqrt(365) else 0 end as sharpe,
              max(pnl) as best_trade, min(pnl) as worst_trade from m_levels group by 1, 2, 3""",
    "hit_rate avg_price_move median_price_move total_pnl avg_pnl win_rate avg_return_pct sharpe best_trade worst_trade"))
def mark_to_market_summary(c: Canon):
    return mtm.mtm_stats(marked(c))


@query("signal_counts", sql(
    "select signal_name, count(*) as signals from t_signal_log where signal_name <> '5-low' group by 1"))
def signal_counts(c: Canon):
    return mtm.signal_counts(mtm.without_retired(c.signal_log, ("5-low",)))


def returns(c: Canon):
    return hypotheses.forward_returns(c.prices, min_points=60)


@query("forward_returns", sql("select * from h_returns", "price return_1d fwd_1h fwd_6h fwd_24h fwd_72h fwd_168h"))
def forward_returns(c: Canon):
    return returns(c)


@query("forward_returns_tight_spread", sql(
    """with tight as (select asset_id from f_book where avg_spread <= 0.03)
       select r.* from h_returns r join tight t on r.asset_id = t.asset_id""", "price return_1d fwd_1h fwd_6h fwd_24h fwd_72h fwd_168h"))
def forward_returns_tight_spread(c: Canon):
    return hypotheses.forward_returns(c.prices, features.book_features(c.books), min_points=60)


@query("threshold_hypotheses", sql(
    """with r as (select 'above_0.85' as rule, * from h_long where price > 0.85 union all select 'above_0.90', * from h_long where price > 0.90
                  union all select 'below_0.15', * from h_long where price < 0.15 union all select 'below_0.05', * from h_long where price < 0.05)
       select rule, horizon_hours, count(*) as n, avg(case when move > 0 then 1.0 else 0.0 end) as share_up,
              avg(case when move < 0 then 1.0 else 0.0 end) as share_down, avg(move) as mean_move, median(move) as median_move from r group by 1, 2""",
    "share_up share_down mean_move median_move"))
def threshold_hypotheses(c: Canon):
    return hypotheses.threshold_hypotheses(returns(c))


@query("momentum_hypotheses", sql(
    """with r as (select 'move_2pct' as rule, *, sign(return_1d) as side from h_long where abs(return_1d) > 0.02
                  union all select 'move_5pct', *, sign(return_1d) from h_long where abs(return_1d) > 0.05)
       select rule, horizon_hours, count(*) as n, avg(case when move * side > 0 then 1.0 else 0.0 end) as continuation,
              avg(case when move * side < 0 then 1.0 else 0.0 end) as reversion,
              coalesce(avg(case when move > 0 then 1.0 else 0.0 end) filter (side > 0), 0) as up_continuation,
              coalesce(avg(case when move < 0 then 1.0 else 0.0 end) filter (side < 0), 0) as down_continuation, avg(move) as mean_move from r group by 1, 2""",
    "continuation reversion up_continuation down_continuation mean_move"))
def momentum_hypotheses(c: Canon):
    return hypotheses.momentum_hypotheses(returns(c))


@query("net_edge", sql(
    """with r as (select 'convergence_buy' as rule, horizon_hours, move as gain from h_long where price > 0.85
                  union all select 'convergence_sell', horizon_hours, -move from h_long where price < 0.15
                  union all select 'momentum', horizon_hours, move * sign(return_1d) from h_long where abs(return_1d) > 0.02)
       select rule, horizon_hours, count(*) as n, avg(gain) as mean_gain, avg(gain) - 0.03 as net_after_spread,
              avg(case when gain > 0.03 then 1.0 else 0.0 end) as profitable from r group by 1, 2""", "mean_gain net_after_spread profitable"))
def net_edge(c: Canon):
    return hypotheses.net_edge(returns(c))
