"""SQL texts of the canonical tables and shared steps, composed into the checks' reference queries."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _needed(body: str, found: list[str]) -> None:
    for name in CTES:
        if name not in found and re.search(rf"\b{name}\b", body):
            _needed(CTES[name], found)
            if name not in found:
                found.append(name)


def sql(body: str, doubles: str = "") -> str:
    """The query with its CTEs in front; ``doubles`` are rounded to 6 digits as the registry does."""
    found: list[str] = []
    _needed(body, found)
    head = "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in found) + "\n" if found else ""
    if doubles:
        cols = ", ".join(f"round({c} * cast(1.000000000001 as double), 6) + 0.0 as {c}" for c in doubles.split())
        return head + f"select * replace ({cols}) from ({body}) as q"
    return head + f"select * from ({body}) as q"


cte("t_prices", """
select cast(user_id as varchar) as asset_id, cast(floor(epoch(ts)) as bigint) as ts,
       least(value / 200, 1.0) as price, event_id as seq from events""")
cte("t_trades", """
select cast(user_id as varchar) as asset_id, cast(floor(epoch(ts)) as bigint) as ts, least(value / 200, 1.0) as price,
       value as size, case when event_type in ('click', 'purchase') then 'buy'
                           when event_type in ('view', 'error') then 'sell' else 'other' end as side from events""")
cte("t_events", """
select cast(n_nationkey as bigint) as event_id, lower(n_name) as slug, n_name as title,
       cast(1704067200 - n_nationkey * 86400 as bigint) as start_ts,
       cast(1706659200 + (n_nationkey % 5 - 1) * 86400 as bigint) as end_ts, '["' || r_name || '"]' as tags, r_name as tag
from nation join region on n_regionkey = r_regionkey""")
cte("t_markets", """
select cast(c_custkey as varchar) as market_id, cast(c_nationkey as bigint) as event_id,
       'c' || cast(c_custkey as varchar) as condition_id, c_name as question, c_custkey % 11 <> 0 as active,
       c_custkey % 7 = 0 as closed, c_custkey % 13 = 0 as resolved,
       case when c_mktsegment = 'HOUSEHOLD' then 'multi' else 'binary' end as market_type, c_acctbal as liquidity
from customer""")
cte("t_tokens", """
select cast(c_custkey as varchar) as market_id, case when side = 0 then 'Yes' else 'No' end as outcome,
       cast(c_custkey + side * 1000000 as varchar) as asset_id,
       c_custkey * 2 + case when c_custkey % 3 = 0 then 1 - side else side end as seq
from customer, (values (0), (1)) as s(side)""")
cte("t_resolutions", """
select market_id, condition_id, resolution_outcome, resolution_ts from (
  select cast(o_custkey as varchar) as market_id, 'c' || cast(o_custkey as varchar) as condition_id,
         case o_orderstatus when 'F' then 'Yes' when 'O' then 'No' else 'Invalid' end as resolution_outcome,
         cast(1704067200 + (o_orderkey * 7919 % 30) * 86400 as bigint) as resolution_ts,
         row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) as x where rn = 1""")
cte("t_levels", """
select cast(l_partkey % 20 as varchar) as asset_id, cast(epoch(date_trunc('month', l_shipdate)) as bigint) as snapshot_ts,
       case when l_returnflag = 'R' then 'ask' else 'bid' end as side,
       case when l_returnflag = 'R' then 0.5 + l_tax / 5 else 0.5 - l_discount / 5 end as price,
       cast(l_quantity as double) as size from lineitem""")
cte("t_top", """
select asset_id, snapshot_ts, max(price) filter (side = 'bid') as best_bid, min(price) filter (side = 'ask') as best_ask
from t_levels where price > 0 and size >= 0 group by 1, 2""")
cte("t_books", """
select l.asset_id, l.snapshot_ts, any_value(best_bid) as best_bid, any_value(best_ask) as best_ask,
       max(size) filter (side = 'bid' and price = best_bid) as bid_size,
       max(size) filter (side = 'ask' and price = best_ask) as ask_size,
       any_value(case when best_ask >= best_bid then (best_bid + best_ask) / 2 end) as mid_price,
       any_value(case when best_ask >= best_bid then best_ask - best_bid end) as spread,
       any_value(case when best_ask >= best_bid then (best_ask - best_bid) / ((best_bid + best_ask) / 2) end) as spread_pct,
       case when any_value(best_ask) >= any_value(best_bid) then
         coalesce(sum(size) filter (side = 'bid' and price >= 0.95 * (best_bid + best_ask) / 2), 0) end as bid_depth_5pct,
       case when any_value(best_ask) >= any_value(best_bid) then
         coalesce(sum(size) filter (side = 'ask' and price <= 1.05 * (best_bid + best_ask) / 2), 0) end as ask_depth_5pct
from t_levels l join t_top t on l.asset_id = t.asset_id and l.snapshot_ts = t.snapshot_ts
where price > 0 and size >= 0 group by 1, 2""")
cte("t_bars", """
select asset_id, ts - ts % 3600 as ts, '1h' as interval, sum(size) as volume, count(*) as trade_count,
       coalesce(sum(size) filter (side = 'buy'), 0) as buy_volume, coalesce(sum(size) filter (side = 'sell'), 0) as sell_volume,
       sum(price * size) / sum(size) as vwap
from t_trades where price > 0 and size > 0 group by 1, 2""")
cte("t_signal_log", """
select lower(o_orderpriority) as signal_name, cast(o_custkey as varchar) as asset_id, cast(o_custkey as varchar) as market_id,
       cast(1704067200 + (o_orderkey * 31 % 30) * 86400 + (o_orderkey % 24) * 3600 as bigint) as ts,
       case when o_orderkey % 2 = 0 then 'buy' else 'sell' end as direction, (o_orderkey % 100) / 100.0 as confidence,
       0.05 + (o_orderkey * 17 % 90) / 100.0 as entry_price, (o_orderkey % 20) / 100.0 as edge, o_orderkey as seq
from orders""")

# Gridded series: 6h slots, 20 days back, at most 2 slots filled.
cte("s_ticks", "select asset_id, ts, arg_max(price, seq) as price from t_prices group by 1, 2")
cte("s_ends", "select asset_id, max(ts) as end_ts from s_ticks group by 1")
cte("s_window", """
select t.asset_id, t.ts, t.price, e.end_ts from s_ticks t join s_ends e on t.asset_id = e.asset_id
where t.ts >= e.end_ts - 20 * 86400""")
cte("s_base", "select asset_id, min(ts) as lo, max(end_ts) as hi from s_window group by 1 having count(*) >= 3")
cte("s_slots", "select asset_id, ts - ts % 21600 as slot, arg_max(price, ts) as price from s_window group by 1, 2")
cte("s_grid", """
select asset_id, unnest(generate_series(lo - lo % 21600, hi + (21600 - hi % 21600) % 21600, 21600)) as slot from s_base""")
cte("s_aligned", """
select g.asset_id, g.slot, s.price, row_number() over (partition by g.asset_id order by g.slot) - 1 as gi
from s_grid g left join s_slots s on g.asset_id = s.asset_id and g.slot = s.slot""")
cte("s_carried", """
select asset_id, slot, gi, price as raw, last_value(price ignore nulls) over w as lp,
       last_value(case when price is not null then gi end ignore nulls) over w as lg
from s_aligned window w as (partition by asset_id order by slot)""")
cte("s_filled", "select asset_id, slot, gi, raw, case when gi - lg <= 2 then lp end as price from s_carried")
cte("s_numbered", """
select asset_id, slot, price, row_number() over (partition by asset_id order by slot) - 1 as idx,
       count(*) over (partition by asset_id) as n from s_filled where price is not null""")
cte("s_clean", "select * from s_numbered where n >= 3")
cte("s_missing", "select asset_id, avg(case when raw is null then 1.0 else 0.0 end) as missing_ratio from s_filled group by 1")
cte("s_steps", """
select *, price - lag(price) over (partition by asset_id order by idx) as diff,
       max(price) over (partition by asset_id order by idx) as peak, max(price) over (partition by asset_id) as top
from s_clean""")
cte("s_weighted", """
select *, case when idx = 1 then pow(13.0 / 14.0, n - 2) else pow(13.0 / 14.0, n - 1 - idx) / 14.0 end as w from s_steps""")
cte("f_price", """
select s.asset_id, arg_min(price, idx) as p_start, arg_max(price, idx) as p_end, max(price) as max_price, min(price) as min_price,
       min(idx) filter (price = top) / cast(max(n) - 1 as double) as time_of_max,
       arg_max(price, idx) - arg_min(price, idx) as return_total, stddev_pop(diff) as volatility,
       max(peak - price) as max_drawdown, coalesce(regr_slope(price, idx), 0) as slope,
       any_value(m.missing_ratio) as missing_ratio, max(n) as num_points,
       arg_max(price, idx) - max(price) filter (idx = n - 1 - 4) as return_1d,
       arg_max(price, idx) - max(price) filter (idx = n - 1 - 28) as return_7d,
       arg_max(price, idx) - max(price) filter (idx = n - 1 - 120) as return_30d,
       case when max(n) > 28 and stddev_pop(price) filter (idx >= n - 28) > 0 then
         (arg_max(price, idx) - avg(price) filter (idx >= n - 28)) / (stddev_pop(price) filter (idx >= n - 28)) end as zscore_7d,
       case when max(n) > 14 and sum(w * greatest(-diff, 0)) > 0 then
         100 - 100 / (1 + sum(w * greatest(diff, 0)) / sum(w * greatest(-diff, 0))) end as rsi_14
from s_weighted s join s_missing m on s.asset_id = m.asset_id group by 1""")
cte("f_context", """
select t.asset_id, max(e.start_ts) as start_ts, max(e.end_ts) as end_ts from t_tokens t
join t_markets m on t.market_id = m.market_id join t_events e on m.event_id = e.event_id group by 1""")
cte("f_time", """
select asset_id, (end_ts - 1706659200) / 86400.0 as days_to_resolution,
       case when end_ts > start_ts then (1706659200 - start_ts) / cast(end_ts - start_ts as double) end as pct_lifetime_elapsed,
       (1706659200 - start_ts) / 86400.0 as days_since_creation from f_context""")
cte("f_spreads", """
select asset_id, spread, row_number() over (partition by asset_id order by snapshot_ts) as i from t_books where spread is not null""")
cte("f_book", """
select b.asset_id, avg(b.spread) as avg_spread, avg(b.spread_pct) as avg_spread_pct,
       any_value(r.trend) as spread_trend,
       avg((coalesce(bid_depth_5pct, 0) + coalesce(ask_depth_5pct, 0)) / 2) as avg_depth,
       avg(bid_depth_5pct) as avg_bid_depth, avg(ask_depth_5pct) as avg_ask_depth
from t_books b left join (select asset_id, regr_slope(spread, i) as trend from f_spreads group by 1) r
on b.asset_id = r.asset_id group by 1""")
cte("f_days", """
select asset_id, ts // 86400 as day, sum(volume) as volume, sum(buy_volume) as buy_volume, sum(sell_volume) as sell_volume,
       row_number() over (partition by asset_id order by ts // 86400) as i from t_bars group by 1, 2""")
cte("f_closes", "select asset_id, slot // 86400 as day, arg_max(price, slot) as close from s_clean group by 1, 2")
cte("f_moves", """
select asset_id, day, abs(close - lag(close) over (partition by asset_id order by day)) as move from f_closes""")
cte("f_pairs", """
select d.asset_id, case when count(*) >= 3 then corr(d.volume, m.move) end as volume_price_corr
from f_days d join f_moves m on d.asset_id = m.asset_id and d.day = m.day where m.move is not null group by 1""")
cte("f_volume", """
select d.asset_id, avg(volume) as avg_daily_volume, regr_slope(volume, i) as volume_trend,
       case when sum(sell_volume) > 0 then sum(buy_volume) / sum(sell_volume) end as buy_sell_ratio,
       any_value(p.volume_price_corr) as volume_price_corr
from f_days d left join f_pairs p on d.asset_id = p.asset_id group by 1""")
cte("f_all", """
select p.*, t.days_to_resolution, t.pct_lifetime_elapsed, t.days_since_creation, b.avg_spread, b.avg_spread_pct, b.spread_trend,
       b.avg_depth, b.avg_bid_depth, b.avg_ask_depth, v.avg_daily_volume, v.volume_trend, v.buy_sell_ratio, v.volume_price_corr
from f_price p left join f_time t on p.asset_id = t.asset_id left join f_book b on p.asset_id = b.asset_id
left join f_volume v on p.asset_id = v.asset_id""")

cte("t_anchors", """
select market_id, asset_id, outcome from (
  select *, row_number() over (partition by market_id order by lower(trim(outcome)) in ('yes', 'true') desc, seq) as rn from t_tokens) as x
where rn = 1""")
cte("d_raw", """
select c_custkey as k, c_nationkey as nation, c_name as name, c_mktsegment as seg, c_acctbal as bal,
       cast(c_custkey as varchar) as id, cast(c_custkey + 1000000 as varchar) as other,
       cast(1704067200 + (c_custkey % 30) * 86400 as bigint) as stamp from customer""")
cte("d_events", """
select cast(nation as bigint) as event_id, 'event-' || nation as slug, 'Event ' || nation as title,
       cast(case when k % 3 = 0 then 1704067200 else 1704067200 - nation * 86400 end as bigint) as start_ts,
       cast(1706659200 + (k % 5 - 1) * 86400 as bigint) as end_ts,
       case when k % 2 = 0 then '["' || seg || '","all"]' else '["' || seg || '"]' end as tags
from d_raw qualify row_number() over (partition by nation order by k desc) = 1""")
cte("d_markets", """
select id as market_id, cast(nation as bigint) as event_id, 'c' || id as condition_id, name as question, k % 11 <> 0 as active,
       k % 7 = 0 as closed, k % 5 in (0, 2, 3) as resolved,
       case k % 5 when 0 then 'Yes' when 2 then 'Invalid' when 3 then 'Unresolved' end as resolution_outcome,
       case when k % 5 <> 4 then stamp end as resolution_ts, case when k % 3 = 2 then 'multi' else 'binary' end as market_type,
       bal as liquidity from d_raw""")
cte("d_tokens", """
select id as market_id, 'Yes' as outcome, id as asset_id from d_raw
union all select id, case when k % 3 <> 2 then 'No' end, other from d_raw
union all select id, null, 'x' || id from d_raw where k % 3 = 2""")
cte("p_latest", "select asset_id, max(ts) as latest_ts from t_prices group by 1")
cte("p_rows", """
select t.asset_id, t.market_id, e.tag as primary_tag, l.latest_ts, l.latest_ts is not null as has_history,
       not m.active or m.closed or m.resolved or e.end_ts < 1706659200 as is_inactive
from t_tokens t join t_markets m on t.market_id = m.market_id join t_events e on m.event_id = e.event_id
left join p_latest l on t.asset_id = l.asset_id""")
cte("p_meta", """
select r.*, c.tag_coverage from p_rows r join (
  select primary_tag, avg(case when has_history then 1.0 else 0.0 end) as tag_coverage from p_rows group by 1) c
on r.primary_tag = c.primary_tag""")
cte("p_plan", """
select *, case when has_history and is_inactive then 'skipped_inactive' when has_history then 'existing'
               when is_inactive then 'new_inactive' else 'new_active' end as bucket,
       cast(case when has_history then greatest(1705363200, latest_ts - 43200) else 1705363200 end as bigint) as fetch_start_ts
from p_meta""")
cte("p_ranked", """
select *, case bucket when 'existing' then 0 when 'new_active' then 1 else 2 end as bucket_rank
from p_plan where bucket not like 'skipped%'""")

cte("t_targets", """
select t.market_id, t.asset_id from t_tokens t join t_markets m on t.market_id = m.market_id
where m.market_type <> 'binary' or t.outcome = 'Yes'""")
cte("q_counts", "select asset_id, count(*) as history_points_raw from t_prices group by 1")
cte("q_base", """
select t.market_id, t.asset_id, m.liquidity, coalesce(c.history_points_raw, 0) as history_points_raw,
       coalesce(c.history_points_raw, 0) > 0 as has_history, f.num_points, f.missing_ratio,
       coalesce(f.max_price - f.min_price, 0) as price_range, f.volatility, f.return_total, f.slope
from t_targets t join t_markets m on t.market_id = m.market_id left join q_counts c on t.asset_id = c.asset_id
left join f_price f on t.asset_id = f.asset_id""")
cte("q_checked", """
select *, history_points_raw >= 60 as check_min_points, coalesce(missing_ratio, 1) <= 0.4 as check_missing_ratio,
       price_range >= 0.5 as check_price_range, coalesce(liquidity >= 1000, false) as check_liquidity from q_base""")
cte("q_quality", """
select *, has_history and check_min_points and check_missing_ratio and check_price_range and check_liquidity as quality_pass from q_checked""")
cte("q_tags", "select m.market_id, e.tag as primary_tag from t_markets m join t_events e on m.event_id = e.event_id")
cte("q_tag_rows", """
select t.market_id, t.asset_id, g.primary_tag, c.asset_id is not null as has_history, f.volatility, f.return_total, f.slope, f.num_points,
       f.missing_ratio, coalesce(q.quality_pass, false) as quality_pass
from t_targets t join q_tags g on t.market_id = g.market_id left join q_counts c on t.asset_id = c.asset_id
left join f_price f on t.asset_id = f.asset_id left join q_quality q on t.asset_id = q.asset_id""")
cte("q_summary", """
select primary_tag, count(distinct market_id) as markets, count(distinct asset_id) as tokens,
       count(*) filter (has_history) as tokens_with_history, avg(case when has_history then 1.0 else 0.0 end) as coverage_pct,
       coalesce(avg(volatility), 0) as avg_volatility, coalesce(avg(return_total), 0) as avg_return_total, coalesce(avg(slope), 0) as avg_slope,
       coalesce(median(num_points), 0) as median_num_points, coalesce(median(missing_ratio), 1) as median_missing_ratio,
       count(*) filter (quality_pass) as tokens_quality_pass, avg(case when quality_pass then 1.0 else 0.0 end) as quality_pass_rate
from q_tag_rows group by 1""")
cte("g_latest", "select asset_id, arg_max(price, ts) as price, max(ts) as ts from s_ticks group by 1")
cte("g_volumes", """
select asset_id, arg_max(volume, ts) as last_volume, avg(volume) as mean_volume, count(*) as bar_count from t_bars group by 1""")
cte("g_rates", """
select lower(g.primary_tag) as tag, avg(case when resolution_outcome = 'Yes' then 1.0 else 0.0 end) as base_rate
from t_resolutions r join q_tags g on r.market_id = g.market_id where resolution_outcome in ('Yes', 'No') group by 1""")
cte("g_frame", """
select f.*, t.market_id, m.question, m.event_id, g.primary_tag, l.price, c.history_points_raw as raw_points,
       v.last_volume, v.mean_volume, v.bar_count, r.base_rate,
       case when f.avg_spread > 0 then f.avg_spread else 0.03 end as sp, coalesce(f.avg_spread > 0.05, false) as wide
from t_targets t join f_all f on t.asset_id = f.asset_id join t_markets m on t.market_id = m.market_id
join q_tags g on t.market_id = g.market_id left join g_latest l on t.asset_id = l.asset_id left join q_counts c on t.asset_id = c.asset_id
left join g_volumes v on t.asset_id = v.asset_id left join g_rates r on lower(g.primary_tag) = r.tag""")
cte("g_conv", """
select 'convergence' as signal, asset_id, market_id, primary_tag, wide,
       case when not (price > 0.85 or price < 0.15) then 'price_not_extreme'
            when days_to_resolution is null or days_to_resolution < 0 or days_to_resolution > 2 then 'out_of_window'
            when price > 0.85 and slope <= 0 then 'slope_contradicts_buy' when price < 0.15 and slope >= 0 then 'slope_contradicts_sell'
            when sp > 0.03 then 'spread_too_wide'
            when abs(case when price > 0.85 then 1 else 0 end - price) - sp <= 0 then 'no_edge_after_spread' end as rule_reason,
       case when price > 0.85 then 'buy' else 'sell' end as direction,
       abs(price - 0.5) / 0.5 * (1 - days_to_resolution / 2) as strength, price as entry_price,
       case when price > 0.85 then 1.0 else 0.0 end as target_price,
       abs(case when price > 0.85 then 1 else 0 end - price) - sp as edge, avg_daily_volume as vol, num_points as pts from g_frame""")
cte("g_mom", """
select 'momentum' as signal, asset_id, market_id, primary_tag, wide,
       case when raw_points < 48 then 'insufficient_points' when return_1d is null or abs(return_1d) < 0.02 then 'price_move_too_small'
            when bar_count is null then 'no_volume_data' when bar_count < 5 then 'insufficient_volume_data'
            when mean_volume > 0 and last_volume < mean_volume * 2 then 'volume_below_surge_threshold'
            when buy_sell_ratio is null then 'missing_buy_sell_ratio' when return_1d > 0 and buy_sell_ratio < 1.3 then 'bsr_contradicts_buy'
            when return_1d < 0 and buy_sell_ratio > 0.77 then 'bsr_contradicts_sell' when sp > 0.04 then 'spread_too_wide'
            when abs(return_1d) - sp <= 0 then 'no_edge_after_spread' end as rule_reason,
       case when return_1d > 0 then 'buy' else 'sell' end as direction,
       least(1, abs(return_1d) / 0.05) * least(1, last_volume / greatest(1e-9, mean_volume) / 5) as strength, price as entry_price,
       case when return_1d > 0 then least(0.99, price + 0.05) else greatest(0.01, price - 0.05) end as target_price,
       abs(return_1d) - sp as edge, avg_daily_volume as vol, num_points as pts from g_frame""")
cte("g_obi", """
select 'orderbook_imbalance' as signal, asset_id, market_id, primary_tag, wide,
       case when price < 0.1 or price > 0.9 then 'price_at_extreme' when avg_bid_depth is null or avg_ask_depth is null then 'missing_depth_data'
            when avg_bid_depth / avg_ask_depth between 1 / 1.5 and 1.5 then 'imbalance_below_threshold' when sp > 0.03 then 'spread_too_wide'
            when avg_daily_volume is null or avg_daily_volume < 100 then 'insufficient_volume'
            when least(0.05, (greatest(avg_bid_depth / avg_ask_depth, avg_ask_depth / avg_bid_depth) - 1)
                 / greatest(avg_bid_depth / avg_ask_depth, avg_ask_depth / avg_bid_depth) * 0.1) - sp <= 0 then 'no_edge_after_spread' end as rule_reason,
       case when avg_bid_depth > avg_ask_depth then 'buy' else 'sell' end as direction,
       least(1, greatest(avg_bid_depth / avg_ask_depth, avg_ask_depth / avg_bid_depth) / 10) as strength, price as entry_price,
       case when avg_bid_depth > avg_ask_depth then least(0.95, price + 0.03) else greatest(0.05, price - 0.03) end as target_price,
       least(0.05, (greatest(avg_bid_depth / avg_ask_depth, avg_ask_depth / avg_bid_depth) - 1)
            / greatest(avg_bid_depth / avg_ask_depth, avg_ask_depth / avg_bid_depth) * 0.1) - sp as edge,
       avg_daily_volume as vol, num_points as pts from g_frame""")
cte("g_eval", """
select signal, asset_id, market_id, primary_tag, not wide as considered, case when wide then 'spread_too_wide' else rule_reason end as reason,
       direction, round_even(greatest(0, least(0.8, greatest(0, strength)) * least(1, coalesce(vol / 500, 1)) * least(1, pts / 100.0)), 4) as confidence,
       entry_price, target_price, edge
from (select * from g_conv union all select * from g_mom union all select * from g_obi) as u""")
cte("g_fired", """
select case signal when 'convergence' then 'resolution_convergence' when 'momentum' then 'momentum_breakout' else signal end as signal_name,
       asset_id, market_id, cast(1706659200 as bigint) as ts, direction, confidence, entry_price, target_price, edge from g_eval where reason is null""")
cte("b_spread", "select asset_id, median(spread) as ms from t_books where spread is not null group by 1")
cte("b_first", """
select s.*, r.resolution_outcome, r.resolution_ts, coalesce(b.ms, 0.03) as sp, case when r.resolution_outcome = 'Yes' then 1.0 else 0.0 end as ex
from (select s.* from t_signal_log s join t_resolutions r on s.market_id = r.market_id where r.resolution_outcome in ('Yes', 'No')
      qualify row_number() over (partition by s.market_id, signal_name order by ts, s.asset_id, entry_price, confidence) = 1) s
join t_resolutions r on s.market_id = r.market_id left join b_spread b on s.asset_id = b.asset_id""")
cte("b_trades", """
select signal_name, asset_id, market_id, case when direction = 'buy' then 'long' else 'short' end as direction, ts as entry_ts, entry_price,
       case when direction = 'buy' then entry_price else 1 - entry_price end + sp / 2 as entry_cost,
       case when resolution_ts > ts + 864000 then ts + 864000 else resolution_ts end as exit_ts, ex as exit_price,
       case when resolution_ts > ts + 864000 then 'timeout' else 'resolution' end as exit_reason,
       (case when direction = 'buy' then ex - entry_price else entry_price - ex end - sp) * 100 as pnl,
       (case when direction = 'buy' then ex - entry_price else entry_price - ex end - sp)
         / (case when direction = 'buy' then entry_price else 1 - entry_price end + sp / 2) as return_pct,
       (case when resolution_ts > ts + 864000 then ts + 864000 else resolution_ts end - ts) / 86400.0 as hold_days,
       cast(0 as double) as kelly_fraction, cast(100 as double) as position_size, cast(10000 as double) as bankroll_at_entry from b_first""")
cte("b_rows", """
select 0 as level, signal_name, pnl, hold_days, exit_ts // 86400 as day from b_trades
union all select 1, null, pnl, hold_days, exit_ts // 86400 from b_trades""")
cte("b_days", "select level, signal_name, day, sum(pnl) as p from b_rows group by 1, 2, 3")
cte("b_equity", "select *, sum(p) over (partition by level, signal_name order by day) as eq from b_days")
cte("b_draw", "select *, eq - max(eq) over (partition by level, signal_name order by day) as dd from b_equity")
cte("b_path", """
select level, signal_name, min(dd) as max_drawdown,
       case when stddev_pop(p) > 0 then avg(p) / stddev_pop(p) * sqrt(365) else 0 end as sharpe_ratio from b_draw group by 1, 2""")
cte("b_stats", """
select level, signal_name, count(*) as total_trades, avg(case when pnl > 0 then 1.0 else 0.0 end) as win_rate, avg(pnl) as avg_pnl,
       median(pnl) as median_pnl, sum(pnl) as total_pnl, avg(hold_days) as avg_hold_days,
       sum(pnl) filter (pnl > 0) / abs(sum(pnl) filter (pnl < 0)) as profit_factor from b_rows group by 1, 2""")
cte("m_targets", """
select s.*, h.h as horizon_hours, s.ts + h.h * 3600 as target_ts from t_signal_log s, (values (1), (6), (24), (72), (168)) as h(h)""")
cte("m_marked", """
select t.signal_name, t.asset_id, t.market_id, t.direction, t.confidence, t.edge, t.ts as entry_ts, t.entry_price, p.ts as exit_ts,
       p.price as exit_price, t.horizon_hours, case when direction = 'buy' then p.price - entry_price else entry_price - p.price end as price_move,
       (case when direction = 'buy' then p.price - entry_price else entry_price - p.price end - coalesce(b.ms, 0.03)) * 100 as pnl,
       (case when direction = 'buy' then p.price - entry_price else entry_price - p.price end - coalesce(b.ms, 0.03))
         / (case when direction = 'buy' then entry_price else 1 - entry_price end + coalesce(b.ms, 0.03) / 2) as return_pct,
       cast(100 as double) as position_size
from m_targets t asof join s_ticks p on t.asset_id = p.asset_id and t.target_ts <= p.ts left join b_spread b on t.asset_id = b.asset_id""")
cte("m_levels", """
select 'by_horizon' as level, null as name, horizon_hours, price_move, pnl, return_pct from m_marked
union all select 'by_signal_horizon', signal_name, horizon_hours, price_move, pnl, return_pct from m_marked
union all select 'by_signal', signal_name, horizon_hours, price_move, pnl, return_pct from m_marked where horizon_hours = 1
union all select 'aggregate', null, horizon_hours, price_move, pnl, return_pct from m_marked where horizon_hours = 1""")
cte("h_enough", "select asset_id from t_prices group by 1 having count(*) >= 60")
cte("h_obs", "select s.* from s_ticks s join h_enough e on s.asset_id = e.asset_id")
cte("h_targets", """
select o.asset_id, o.ts, o.price, h.h, o.ts + h.h * 3600 as target_ts from h_obs o, (values (-24), (1), (6), (24), (72), (168)) as h(h)""")
cte("h_hits", """
select t.asset_id, t.ts, t.price, t.h, case when p.ts - t.target_ts < 7200 then p.price - t.price end as move
from h_targets t asof left join h_obs p on t.asset_id = p.asset_id and t.target_ts <= p.ts""")
cte("h_returns", """
select asset_id, ts, any_value(price) as price, -max(move) filter (h = -24) as return_1d, max(move) filter (h = 1) as fwd_1h,
       max(move) filter (h = 6) as fwd_6h, max(move) filter (h = 24) as fwd_24h, max(move) filter (h = 72) as fwd_72h,
       max(move) filter (h = 168) as fwd_168h from h_hits group by 1, 2""")
cte("h_long", """
select r.price, r.return_1d, m.h as horizon_hours, m.move from h_returns r join h_hits m on r.asset_id = m.asset_id and r.ts = m.ts
where m.h > 0 and m.move is not null""")
