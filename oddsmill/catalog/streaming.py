"""Queries that read the test tables as streams and return what the sinks hold afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from oddsmill.catalog.registry import query
from oddsmill.catalog.sqltext import cte, sql
from oddsmill.session import shared_folder
from oddsmill.sources import tables
from oddsmill.sources.adapters import DAY, EPOCH_START, Canon, declared
from oddsmill.streaming import streams


class Landed(Canon):
    """The canonical tables over the events file read as a stream."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        return streams.read_files(self.spark, self.path, declared(name), names="events.parquet")


def into_table(stream: DataFrame, folder: str) -> DataStreamWriter:
    return stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)


def drained(stream: DataFrame) -> DataFrame:
    """Runs the stream over what is there into a table and reads it back."""
    folder = shared_folder(stream.sparkSession)
    into_table(stream, folder).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_volume_bars", sql(
    # Bars still open at the watermark (two hours behind the newest trade) are not final and not there.
    "select * from t_bars where (ts + 3600) * 1000000 <= (select floor(max(epoch(ts))) * 1000000 - 7200000000 from events)",
    "volume buy_volume sell_volume vwap"))
def stream_volume_bars(c: Canon):
    return drained(streams.volume_bars(Landed(c.spark, c.path).trades, "1h", "2 hours"))


@query("stream_distinct_ticks", sql("select distinct asset_id, ts - ts % 3600 as ts from t_prices"))
def stream_distinct_ticks(c: Canon):
    ticks = Landed(c.spark, c.path).prices.select(
        "asset_id", F.expr("ts - pmod(ts, 3600)").alias("ts"), "price", F.lit("1h").alias("interval"))
    return drained(streams.distinct_ticks(ticks, "60 days")).select("asset_id", "ts")


@query("stream_upserts", sql(
    """select asset_id, ts - ts % 86400 as ts, arg_max(price, seq) as price, cast(max(seq) as bigint) as ingested_at from t_prices group by 1, 2""", "price"))
def stream_upserts(c: Canon):
    folder = shared_folder(c.spark)
    days = Landed(c.spark, c.path).prices.select(
        "asset_id", F.expr("ts - pmod(ts, 86400)").alias("ts"), "price", F.lit("1d").alias("interval"), F.col("seq").alias("ingested_at"))
    streams.keep_last_into(days, f"{folder}/price_history.parquet", "price_history", f"{folder}/checkpoint", "ingested_at").start().awaitTermination()
    return c.spark.read.parquet(f"{folder}/price_history.parquet").select("asset_id", "ts", "price", "ingested_at")


# Three landings by day: rows of the tenth day that come with the second one are late, rows of the third day that come with
# the third one are too late (lateness is two days), and that one repeats rows of the twentieth day with another price.
cte("t_landed", """
select *, case when day < 10 and not (day = 9 and seq % 5 = 2) and not (day = 2 and seq % 5 = 3) then 1 when day < 20 and not (day = 2 and seq % 5 = 3) then 2 else 3 end as landing,
       day = 2 and seq % 5 = 3 as too_late
from (select t.*, cast(floor((epoch(e.ts) - 1704067200) / 86400) as bigint) as day from t_prices t join events e on e.event_id = t.seq) x""")
cte("t_arrived", """
select asset_id, ts, price, seq, landing, too_late from t_landed
union all select asset_id, ts, price / 2, seq + 1000000000, 3, false from t_landed where day = 19 and seq % 3 = 0""")


def drained_by_landing(c: Canon, rows: DataFrame, repeats: bool, folder: str, sink: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Rows (with ts and seq) land three times; after each landing the stream is run over what is new and stops.

    A landing is as many files as it has tasks; the run after it reads them whole in one trigger.
    """
    day, seq = F.floor((F.col("ts") - EPOCH_START) / DAY), F.col("seq")
    late, too_late = (day == 9) & (seq % 5 == 2), (day == 2) & (seq % 5 == 3)
    number = F.when((day < 10) & ~late & ~too_late, 1).when((day < 20) & ~too_late, 2).otherwise(3)
    again = rows.where((day == 19) & (seq % 3 == 0)).withColumn("price", F.col("price") / 2).withColumn("seq", seq + 1_000_000_000)
    schema = rows.schema
    rows = rows.withColumn("_landing", number)
    if repeats:
        rows = rows.unionByName(again.withColumn("_landing", F.lit(3)))
    for k in (1, 2, 3):
        rows.where(F.col("_landing") == k).drop("_landing").write.mode("append").parquet(f"{folder}/landed")
        sink(streams.read_files(c.spark, f"{folder}/landed", schema)).start().awaitTermination()


@query("stream_corrected_bars", sql(
    """select asset_id, ts - ts % 3600 as ts, '1h' as interval, sum(size) as volume, count(*) as trade_count,
              coalesce(sum(size) filter (side = 'buy'), 0) as buy_volume, coalesce(sum(size) filter (side = 'sell'), 0) as sell_volume,
              sum(price * size) / sum(size) as vwap
       from (select t.*, e.value as size, case when event_type in ('click', 'purchase') then 'buy' when event_type in ('view', 'error') then 'sell' else 'other' end as side
             from t_landed t join events e on e.event_id = t.seq) x where price > 0 and size > 0 and not too_late group by 1, 2""",
    "volume buy_volume sell_volume vwap"))
def stream_corrected_bars(c: Canon):
    folder = shared_folder(c.spark)
    drained_by_landing(c, c.trades_with_seq(), False, folder, lambda stream: streams.corrected_bars_into(
        stream, f"{folder}/volume_bars.parquet", f"{folder}/checkpoint", "1h", "2 days"))
    return c.spark.read.parquet(f"{folder}/volume_bars.parquet").drop("dt")


@query("stream_last_ticks", sql(
    """select asset_id, h as ts, arg_max(price, seq) as price from (select *, ts - ts % 3600 as h from t_arrived where not too_late) x
       where h <= (select max(ts - ts % 3600) from t_arrived) - 172800 group by 1, 2""", "price"))
def stream_last_ticks(c: Canon):
    folder = shared_folder(c.spark)

    def sink(stream: DataFrame) -> DataStreamWriter:
        ticks = stream.select("asset_id", F.expr("ts - pmod(ts, 3600)").alias("ts"), "price", F.lit("1h").alias("interval"), "seq")
        return into_table(streams.last_ticks(ticks, "2 days"), folder)

    drained_by_landing(c, c.prices, True, folder, sink)
    return c.spark.read.schema("asset_id string, ts bigint, price double").parquet(f"{folder}/out")


@query("stream_upserts_present", sql(
    """select asset_id, ts - ts % 86400 as ts, arg_max(price, landing * 10000000000 + seq) as price, cast(arg_max(seq, landing * 10000000000 + seq) as bigint) as ingested_at
       from t_arrived group by 1, 2""", "price"))
def stream_upserts_present(c: Canon):
    """Three micro-batches into a table that is there already; late rows replace what was stored before."""
    folder = shared_folder(c.spark)
    table = f"{folder}/price_history.parquet"
    stored = c.prices.select("asset_id", F.expr("ts - pmod(ts, 86400)").alias("ts"), F.lit(0.0).alias("price"), F.lit("1d").alias("interval"), F.lit(-1).cast("bigint").alias("ingested_at"))
    tables.upsert(c.spark, table, stored.distinct(), "price_history")

    def sink(stream: DataFrame) -> DataStreamWriter:
        days = stream.select("asset_id", F.expr("ts - pmod(ts, 86400)").alias("ts"), "price", F.lit("1d").alias("interval"), F.col("seq").alias("ingested_at"))
        return streams.keep_last_into(days, table, "price_history", f"{folder}/checkpoint", "ingested_at")

    drained_by_landing(c, c.prices, True, folder, sink)
    return c.spark.read.parquet(table).select("asset_id", "ts", "price", "ingested_at")
