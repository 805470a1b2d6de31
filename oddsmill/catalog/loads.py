"""Load runs over payload files made of the test tables: two landings that overlap, each loaded when it has landed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.catalog.registry import query
from oddsmill.catalog.sqltext import cte, sql
from oddsmill.plans import loads
from oddsmill.session import shared_folder
from oddsmill.sources import tables
from oddsmill.sources.adapters import DAY, EPOCH_START, Canon

BOOK_DOUBLES = "best_bid best_ask bid_size ask_size mid_price spread spread_pct bid_depth_5pct ask_depth_5pct"


def _listed(rows: DataFrame, keys: list[str], item: Column) -> DataFrame:
    """One payload per key and day: the items in order of their number."""
    days = rows.withColumn("day", F.floor(F.col("ts") / DAY))
    return days.groupBy(*keys, "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", item.alias("item")))), lambda x: x["item"]).alias("items"))


def history_files(c: Canon, part: int) -> DataFrame:
    """Points of an asset and a day; the second landing reads some of the first one's points again and has broken lines."""
    seq = F.col("seq") % 4
    rows = c.prices.where(seq != 3 if part == 1 else seq.isin(0, 3))
    point = F.struct(F.when(F.col("seq") % 2 == 0, F.col("ts")).alias("t"), F.when(F.col("seq") % 2 == 1, F.col("ts") * 1000).alias("timestamp"),
                     F.col("price").cast("string").alias("p"))
    lines = _listed(rows, ["asset_id"], point).select("day", F.to_json(F.struct("asset_id", F.col("items").alias("history"))).alias("value"))
    if part == 1:
        return lines.select("value")
    broken = lines.where("day % 7 = 0").select(F.expr("left(value, length(value) - 5)").alias("value"))
    return lines.select("value").unionByName(broken)


def trade_files(c: Canon, part: int) -> DataFrame:
    """Trades of a condition and a day; the first landing lacks some, the second holds odd days whole, from half an hour after midnight on."""
    t = c.trades_with_seq()
    odd = F.col("day") % 2 == 1
    rows = t.where(F.col("seq") % 5 != 0) if part == 1 else t
    item = F.struct(F.col("ts").alias("timestamp"), "price", F.col("size").alias("amount"), F.upper("side").alias("side"))
    lists = _listed(rows, ["asset_id"], item).where(F.lit(part == 1) | odd)
    doc = F.struct(F.concat(F.lit("c"), F.col("asset_id")).alias("conditionId"), F.when(F.lit(part == 2), F.col("day") * DAY + 1800).alias("min_ts"),
                   F.when(odd, F.col("items")).alias("trades"), F.when(~odd, F.col("items")).alias("data"))
    return lists.select(F.to_json(doc).alias("value"))


def book_files(c: Canon, part: int) -> DataFrame:
    """A book per order, every 29th empty; sizes at the top double in the second landing."""
    k = F.col("o_orderkey")
    rows = c.table("orders").where(k % 3 != (0 if part == 1 else 1))

    def level(price: Column, size: Column) -> Column:
        return F.struct(price.cast("string").alias("price"), size.alias("s"))

    bid, ask = F.lit(0.48) - (k % 7) / 100, F.lit(0.5) + (k % 11) / 100
    some = k % 29 != 0
    doc = F.struct(
        (k % 50).cast("string").alias("token_id"), (EPOCH_START + F.floor(k / 50) * 3600 + 1020).alias("timestamp"),
        F.when(some, F.array(level(bid, (k % 13 + 1) * part), level(bid - 0.02, F.lit(5).cast("bigint")))).alias("bids"),
        F.when(some, F.array(level(ask + 0.03, F.lit(7).cast("bigint")), level(ask, (k % 17 + 1) * part))).alias("asks"))
    return rows.select(F.to_json(doc).alias("value"))


def landed_twice(c: Canon, files: Callable[[Canon, int], DataFrame], load: Callable[[str, str], DataFrame], root: str) -> DataFrame:
    """The stored table after each of the two landings has been loaded, and once more when nothing new has landed."""
    for part in (1, 2):
        files(c, part).write.mode("append").text(f"{root}/landed")
        load(root, f"{root}/landed")
    return load(root, f"{root}/landed")


def loaded_prices_under(c: Canon, root: str) -> DataFrame:
    return landed_twice(c, history_files, lambda to, path: loads.load_prices(c.spark, to, path, interval="1h", ingested_at=7), root)


@query("loaded_prices", sql(
    """select asset_id, ts, arg_max(price, case when seq % 4 in (0, 3) then 1000000000000 else 0 end + seq) as price, '1h' as interval,
              cast(7 as bigint) as ingested_at from t_prices group by 1, 2""", "price"))
def loaded_prices(c: Canon):
    return loaded_prices_under(c, shared_folder(c.spark)).drop("dt")


cte("t_lines", """
select 1 as part, asset_id, ts // 86400 as day from t_prices where seq % 4 <> 3 group by all
union all select 2, asset_id, ts // 86400 from t_prices where seq % 4 in (0, 3) group by all""")


@query("load_lineage", sql(
    """select count(*) + count(*) filter (part = 2 and day % 7 = 0) as lines, count(*) filter (part = 2 and day % 7 = 0) as quarantined from t_lines"""))
def load_lineage(c: Canon):
    root = shared_folder(c.spark)
    loaded_prices_under(c, root)
    return loads.lineage(c.spark, root, "price_history").agg(F.sum("lines").alias("lines"), F.sum("quarantined").alias("quarantined"))


@query("quarantined_lines", sql("select 'not JSON' as reason, asset_id, count(*) as lines from t_lines where part = 2 and day % 7 = 0 group by 2"))
def quarantined_lines(c: Canon):
    root = shared_folder(c.spark)
    loaded_prices_under(c, root)
    asset = F.regexp_extract("value", '^\\{"asset_id":"([^"]*)"', 1)
    return loads.quarantined(c.spark, root, "price_history").groupBy("reason", asset.alias("asset_id")).agg(F.count(F.lit(1)).alias("lines"))


@query("loaded_bars", sql(
    """select asset_id, ts - ts % 3600 as ts, '1h' as interval, sum(size) as volume, count(*) as trade_count,
              coalesce(sum(size) filter (side = 'buy'), 0) as buy_volume, coalesce(sum(size) filter (side = 'sell'), 0) as sell_volume,
              sum(price * size) / sum(size) as vwap
       from (select cast(user_id as varchar) as asset_id, cast(floor(epoch(ts)) as bigint) as ts, least(value / 200, 1.0) as price, value as size, event_id,
               case when event_type in ('click', 'purchase') then 'buy' when event_type in ('view', 'error') then 'sell' else 'other' end as side from events) t
       where price > 0 and size > 0 and (ts // 86400 % 2 = 1 or event_id % 5 <> 0) and asset_id in (select market_id from t_markets) group by 1, 2""",
    "volume buy_volume sell_volume vwap"))
def loaded_bars(c: Canon):
    root = shared_folder(c.spark)
    tables.replace(c.markets, f"{root}/markets.parquet")
    tables.replace(c.tokens.drop("seq"), f"{root}/tokens.parquet")
    return landed_twice(c, trade_files, lambda to, path: loads.load_bars(c.spark, to, path), root).drop("dt")


@query("loaded_books", sql(
    """select cast(k % 50 as varchar) as asset_id, 1704067200 + (k // 50) * 3600 as snapshot_ts, b as best_bid, a as best_ask,
              cast((k % 13 + 1) * part as double) + 0 * b as bid_size, cast((k % 17 + 1) * part as double) + 0 * b as ask_size,
              (a + b) / 2 as mid_price, a - b as spread, (a - b) / ((a + b) / 2) as spread_pct,
              case when b >= 0.95 * (a + b) / 2 then (k % 13 + 1) * part else 0 end + case when b - 0.02 >= 0.95 * (a + b) / 2 then 5 else 0 end + 0 * b as bid_depth_5pct,
              case when a <= 1.05 * (a + b) / 2 then (k % 17 + 1) * part else 0 end + case when a + 0.03 <= 1.05 * (a + b) / 2 then 7 else 0 end + 0 * b as ask_depth_5pct
       from (select o_orderkey as k, case when o_orderkey % 3 = 1 then 1 else 2 end as part,
               case when o_orderkey % 29 <> 0 then cast(0.48 as double) - (o_orderkey % 7) / 100 end as b,
               case when o_orderkey % 29 <> 0 then cast(0.5 as double) + (o_orderkey % 11) / 100 end as a from orders) o""", BOOK_DOUBLES))
def loaded_books(c: Canon):
    return landed_twice(c, book_files, lambda to, path: loads.load_books(c.spark, to, path), shared_folder(c.spark)).drop("dt")
