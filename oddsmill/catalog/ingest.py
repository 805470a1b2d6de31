"""Queries on raw documents, token selection, resolutions, upserts and load plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsmill.catalog.registry import query
from oddsmill.catalog.sqltext import sql
from oddsmill.functions import scalars as S
from oddsmill.operators import bars, loadplan, normalize
from oddsmill.sources import landing
from oddsmill.sources.adapters import AS_OF, EPOCH_START, Canon
from oddsmill.sources.tables import merge_keep_last


def docs(c: Canon):
    return normalize.parse_documents(c.documents)


@query("extract_events", sql("select * from d_events"))
def extract_events(c: Canon):
    return normalize.extract_events(docs(c))


@query("extract_markets", sql("select * from d_markets", "liquidity"))
def extract_markets(c: Canon):
    return normalize.extract_markets(docs(c))


@query("extract_tokens", sql("select * from d_tokens"))
def extract_tokens(c: Canon):
    return normalize.extract_tokens(docs(c))


@query("extract_resolutions", sql(
    "select market_id, condition_id, resolution_outcome, resolution_ts from d_markets where resolved or resolution_ts is not null"))
def extract_resolutions(c: Canon):
    return normalize.extract_resolutions(docs(c))


@query("recent_event_documents", sql(
    "select k as seq from d_raw where 1706659200 + (k % 5 - 1) * 86400 >= 1706745600"))
def recent_event_documents(c: Canon):
    return landing.recent_events(docs(c), AS_OF + 86_400).select("seq")


@query("unwrapped_markets", sql("select k as seq, id, name as question from d_raw"))
def unwrapped_markets(c: Canon):
    from oddsmill.functions import raw

    wrapped = landing.unwrap(docs(c), wrappers=("markets",), out="m")
    return wrapped.select("seq", raw.pick_text(F.col("m"), "id").alias("id"), raw.pick_text(F.col("m"), "question").alias("question"))


@query("normalized_history", sql("select asset_id, ts, price, '1h' as interval, cast(7 as bigint) as ingested_at from s_ticks", "price"))
def normalized_history(c: Canon):
    at = F.when(F.col("seq") % 2 == 0, F.col("ts"))
    point = F.to_json(F.struct(
        at.alias("t"),
        F.when(F.col("seq") % 2 == 1, (F.col("ts") * 1000).cast("string")).alias("timestamp"),
        F.when(F.col("seq") % 3 == 0, F.col("price").cast("string")).alias("p"),
        F.when(F.col("seq") % 3 != 0, F.col("price")).alias("price"),
    ))
    points = c.prices.select("asset_id", "seq", F.try_parse_json(point).alias("point"))
    return normalize.normalize_history(points, "1h", 7)


@query("normalized_trade_bars", sql("select * from t_bars", "volume buy_volume sell_volume vwap"))
def normalized_trade_bars(c: Canon):
    t = c.trades
    odd = F.col("ts") % 2 == 1
    doc = F.to_json(F.struct(
        F.when(odd, F.col("ts") * 1000).alias("timestamp"),
        F.when(~odd, F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("createdAt"),
        F.when(odd, F.col("price")).alias("price"), F.when(~odd, F.col("price").cast("string")).alias("p"),
        F.when(odd, F.col("size")).alias("amount"), F.when(~odd, F.col("size").cast("string")).alias("shares"),
        F.upper("side").alias("side"),
    ))
    return bars.trade_bars(normalize.normalize_trades(t.select("asset_id", F.try_parse_json(doc).alias("trade"))), "1h")


@query("normalized_books", sql(
    """select l_orderkey as asset_id, l_linenumber as snapshot_ts, 1 as bids, case when l_quantity > 0 then 1 else 0 end as asks,
              0.5 - l_discount / 5 as bid, 0.5 + l_tax / 5 as ask from (
       select cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_quantity, l_discount, l_tax from lineitem) x""",
    "bid ask"))
def normalized_books(c: Canon):
    level = F.to_json(F.struct(F.struct(
        F.array(F.struct((0.5 - F.col("l_discount") / 5).alias("p"), F.col("l_quantity").alias("q")),
                F.struct(F.lit(-1.0).alias("p"), F.lit(1).alias("q"))).alias("buyOrders"),
        F.array(F.array((0.5 + F.col("l_tax") / 5).cast("string"), F.col("l_quantity").cast("string"))).alias("asks"),
    ).alias("book")))
    payloads = c.table("lineitem").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").cast("bigint").alias("snapshot_ts"), F.try_parse_json(level).alias("doc"))
    out = normalize.normalize_books(payloads)
    return out.select("asset_id", "snapshot_ts", F.size("bids").alias("bids"), F.size("asks").alias("asks"),
                      F.col("bids")[0]["price"].alias("bid"), F.col("asks")[0]["price"].alias("ask"))


@query("book_metrics_from_arrays", sql(
    """select cast(l_orderkey as varchar) as asset_id, l_linenumber as snapshot_ts, greatest(b1, b2) as best_bid, least(a1, a2) as best_ask,
              case when b1 > b2 then l_quantity when b1 = b2 then greatest(l_quantity, 3) else 3 end as bid_size,
              case when a1 < a2 then l_quantity when a1 = a2 then greatest(l_quantity, 5) else 5 end as ask_size,
              least(a1, a2) - greatest(b1, b2) as spread,
              case when b1 >= 0.95 * m then l_quantity else 0 end + case when b2 >= 0.95 * m then 3 else 0 end as bid_depth_5pct,
              case when a1 <= 1.05 * m then l_quantity else 0 end + case when a2 <= 1.05 * m then 5 else 0 end as ask_depth_5pct
       from (select *, (greatest(b1, b2) + least(a1, a2)) / 2 as m from (
               select l_orderkey, l_linenumber, cast(l_quantity as double) as l_quantity, 0.5 - l_discount / 5 as b1, 0.491 - l_tax as b2,
                      0.5 + l_tax / 5 as a1, 0.507 + l_discount / 2 as a2 from lineitem) x) y""",
    "best_bid best_ask bid_size ask_size spread bid_depth_5pct ask_depth_5pct"))
def book_metrics_from_arrays(c: Canon):
    def level(price, size):
        return F.struct(price.alias("price"), size.cast("double").alias("size"))

    quantity, discount, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    books = c.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("asset_id"), F.col("l_linenumber").alias("snapshot_ts"),
        F.array(level(0.5 - discount / 5, quantity), level(0.491 - tax, F.lit(3))).alias("bids"),
        F.array(level(0.5 + tax / 5, quantity), level(0.507 + discount / 2, F.lit(5))).alias("asks"))
    return bars.book_metrics_from_arrays(books).select(
        "asset_id", "snapshot_ts", "best_bid", "best_ask", "bid_size", "ask_size", "spread", "bid_depth_5pct", "ask_depth_5pct")


@query("event_props", sql("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events"))
def event_props(c: Canon):
    return c.table("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("primary_tags", sql("select event_id, tag as by_json, tag as by_pattern from t_events"))
def primary_tags(c: Canon):
    return c.events.select("event_id", S.tag_from_json("tags").alias("by_json"), S.tag_from_pattern("tags").alias("by_pattern"))


@query("coerced_scalars", sql(
    """select o_orderkey, o_orderkey % 4 = 0 as flag, cast(epoch(o_orderdate) as bigint) as from_text,
              cast(epoch(o_orderdate) as bigint) as from_millis, o_totalprice as amount,
              case o_orderstatus when 'F' then 'Yes' when 'O' then 'No' end as outcome,
              case when o_orderkey % 3 = 0 then o_orderpriority else 'a|b' end as items,
              case when o_orderkey % 3 = 0 then o_orderpriority else o_orderstatus end as first_text from orders""", "amount"))
def coerced_scalars(c: Canon):
    key = F.col("o_orderkey")
    word = F.when(key % 4 == 0, " Yes ").otherwise("n")
    status = F.create_map(F.lit("F"), F.lit("winner_yes"), F.lit("O"), F.lit("Resolved_No"), F.lit("P"), F.lit("odd"))[F.col("o_orderstatus")]
    listed = F.when(key % 3 == 0, F.to_json(F.array("o_orderpriority"))).otherwise(F.concat_ws(",", F.lit("a"), F.lit("'b'")))
    return c.table("orders").select(
        "o_orderkey",
        S.to_bool(word).alias("flag"),
        S.seconds_from_text(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("from_text"),
        S.seconds_from_number(F.unix_timestamp("o_orderdate") * 1000).alias("from_millis"),
        S.to_double(F.col("o_totalprice").cast("string")).alias("amount"),
        S.canonical_outcome(status).alias("outcome"),
        F.concat_ws("|", S.list_items(listed)).alias("items"),
        S.first_present(F.when(key % 3 == 0, F.lit("")), F.when(key % 3 == 0, F.col("o_orderpriority")), F.col("o_orderstatus")).alias("first_text"),
    )


@query("position_sizes", sql(
    """with s as (select seq, confidence as p, least(0.999999, greatest(0.000001, case when direction = 'buy' then entry_price else 1 - entry_price end)) as c from t_signal_log),
            k as (select seq, least(1, greatest(0, (p * ((1 - c) / c) - (1 - p)) / ((1 - c) / c))) as kelly from s)
       select seq, kelly, case when kelly > 0 and least(10000 * kelly * 0.25, 500) >= 1 then least(10000 * kelly * 0.25, 500) else 0 end as size,
              cast(100 as double) as flat from k""", "kelly size flat"))
def position_sizes(c: Canon):
    cash, confidence = F.lit(10_000.0), F.col("confidence")
    entry = F.when(F.col("direction") == "buy", F.col("entry_price")).otherwise(1.0 - F.col("entry_price"))
    kelly, size = S.position_size("kelly", cash, confidence, entry)
    _, flat = S.position_size("flat", cash, confidence, entry)
    return c.signal_log.select("seq", kelly.alias("kelly"), size.alias("size"), flat.alias("flat"))


@query("anchor_tokens", sql("select * from t_anchors"))
def anchor_tokens(c: Canon):
    return normalize.anchor_tokens(c.tokens)


@query("target_tokens_yes_only", sql(
    """select t.market_id, t.asset_id, t.outcome, m.market_type from t_tokens t join t_markets m on t.market_id = m.market_id
       where m.market_type <> 'binary' or t.outcome = 'Yes'"""))
def target_tokens_yes_only(c: Canon):
    return normalize.select_tokens(c.tokens, c.markets, yes_only_binary=True).drop("seq")


@query("target_tokens_all", sql(
    "select t.market_id, t.asset_id, t.outcome, m.market_type from t_tokens t join t_markets m on t.market_id = m.market_id"))
def target_tokens_all(c: Canon):
    return normalize.select_tokens(c.tokens, c.markets, yes_only_binary=False).drop("seq")


@query("market_context", sql(
    """select t.asset_id, t.market_id, m.event_id, e.start_ts, e.end_ts from t_tokens t
       join t_markets m on t.market_id = m.market_id join t_events e on m.event_id = e.event_id"""))
def market_context(c: Canon):
    return normalize.market_context(c.tokens, c.markets, c.events)


@query("resolution_prices", sql(
    """with w as (select r.*, a.asset_id from t_resolutions r left join t_anchors a on r.market_id = a.market_id),
            b as (select w.*, p.price as before from w asof left join s_ticks p on w.asset_id = p.asset_id and w.resolution_ts >= p.ts),
            l as (select asset_id, arg_max(price, ts) as last from s_ticks group by 1)
       select market_id, condition_id, resolution_outcome, resolution_ts, coalesce(before, last) as final_price, cast(5 as bigint) as ingested_at
       from b left join l on b.asset_id = l.asset_id""", "final_price"))
def resolution_prices(c: Canon):
    return normalize.enrich_resolutions(c.resolutions, c.tokens, c.prices, 5)


@query("refreshed_markets", sql(
    """select m.market_id, m.event_id, m.condition_id, m.question, m.active, m.closed, r.market_id is not null as resolved,
              r.resolution_outcome, r.resolution_ts, m.market_type, m.liquidity
       from t_markets m left join t_resolutions r on m.market_id = r.market_id""", "liquidity"))
def refreshed_markets(c: Canon):
    return normalize.refresh_markets(c.markets, c.resolutions)


@query("upsert_keep_last", sql(
    """with u as (select asset_id, ts // 86400 as ts, '1d' as interval, price, 0 as batch, seq from t_prices where seq % 3 <> 0
                  union all select asset_id, ts // 86400, '1d', price + 1, 1, seq from t_prices where seq % 3 = 0)
       select asset_id, ts, interval, price from u qualify row_number() over (partition by asset_id, ts order by batch desc, seq desc) = 1""", "price"))
def upsert_keep_last(c: Canon):
    day = c.prices.withColumn("ts", F.floor(F.col("ts") / 86_400)).withColumn("interval", F.lit("1d"))
    keys = ("asset_id", "ts", "interval")
    old = merge_keep_last(None, day.where("seq % 3 <> 0"), keys, "seq")
    new = day.where("seq % 3 = 0").withColumn("price", F.col("price") + 1)
    return merge_keep_last(old, new, keys, "seq").select("asset_id", "ts", "interval", "price")


@query("trades_sample", sql(
    """select o_orderkey, 'c' || o_custkey as condition_id from orders where 'c' || o_custkey in (
         select condition_id from t_markets order by cast(market_id as bigint) limit 10)"""))
def trades_sample(c: Canon):
    trades = c.table("orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("condition_id"))
    markets = c.markets.withColumn("seq", F.col("market_id").cast("bigint"))
    return landing.trades_sample(trades, markets, 10)


@query("latest_price_ts", sql("select * from p_latest"))
def latest_price_ts(c: Canon):
    return loadplan.latest_ts(c.prices)


def metadata(c: Canon):
    return loadplan.load_metadata(c.tokens, c.markets, c.events, loadplan.latest_ts(c.prices), AS_OF)


def plan(c: Canon):
    return loadplan.mark_plan(metadata(c), interval="6h", global_start_ts=EPOCH_START + 15 * 86_400)


@query("load_metadata", sql("select * from p_meta", "tag_coverage"))
def load_metadata(c: Canon):
    return metadata(c)


@query("load_plan", sql("select * from p_plan", "tag_coverage"))
def load_plan(c: Canon):
    return plan(c)


@query("load_order", sql(
    """select asset_id, bucket, fetch_start_ts, row_number() over (order by bucket_rank, case when bucket_rank = 0 then latest_ts end,
              case when bucket_rank > 0 then tag_coverage end, case when bucket_rank > 0 then primary_tag end, asset_id) as position from p_ranked"""))
def load_order(c: Canon):
    return loadplan.order_plan(plan(c)).select("asset_id", "bucket", "fetch_start_ts", "position")


@query("load_order_round_robin", sql(
    """with t as (select *, row_number() over (partition by bucket_rank, primary_tag order by asset_id) as turn,
                         min(tag_coverage) over (partition by bucket_rank, primary_tag) as tag_order from p_ranked)
       select asset_id, bucket, row_number() over (order by bucket_rank, case when bucket_rank = 0 then latest_ts end,
              case when bucket_rank > 0 then turn end, case when bucket_rank > 0 then tag_order end,
              case when bucket_rank > 0 then primary_tag end, asset_id) as position from t"""))
def load_order_round_robin(c: Canon):
    return loadplan.order_plan(plan(c), "category_round_robin").select("asset_id", "bucket", "position")


@query("load_plan_counts", sql("select bucket, count(*) as assets from p_plan group by 1"))
def load_plan_counts(c: Canon):
    return loadplan.plan_counts(plan(c))


@query("bar_backfill_plan", sql(
    """with l as (select asset_id, max(ts) as latest from t_bars group by 1),
            s as (select m.condition_id, a.asset_id, greatest(1705363200, coalesce(l.latest - 7200, 1705363200)) as s
                  from t_markets m join t_anchors a on m.market_id = a.market_id left join l on a.asset_id = l.asset_id)
       select condition_id, asset_id, cast(s - s % 3600 as bigint) as start_ts from s"""))
def bar_backfill_plan(c: Canon):
    return loadplan.backfill_plan(c.markets, c.tokens, c.bars, interval="1h", global_start_ts=EPOCH_START + 15 * 86_400)
