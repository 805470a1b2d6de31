"""Structured Streaming forms of the bars, tick de-duplication and upserts, over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from oddsmill.functions.scalars import to_double
from oddsmill.schemas import interval_seconds
from oddsmill.sources.tables import upsert


def read_files(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", per_trigger: int | None = None, names: str | None = None
) -> DataFrame:
    """New files of a folder, all of them or those whose name matches the glob ``names``."""
    reader = spark.readStream.format(fmt).schema(schema)
    if names:
        reader = reader.option("pathGlobFilter", names)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def volume_bars(trades: DataFrame, interval: str = "1h", lateness: str = "2 hours") -> DataFrame:
    """Tumbling bars over an unbounded trade feed (append mode): a bar is final once the watermark has passed its end, later
    trades are dropped. The state holds open bars only."""
    n = interval_seconds(interval)
    zero = F.lit(0.0)
    rows = (
        trades.withColumn("at", F.timestamp_seconds("ts"))
        .withWatermark("at", lateness)
        .select(
            F.col("asset_id").cast("string").alias("asset_id"), "at", to_double("price").alias("p"), to_double("size").alias("v"),
            F.lower(F.trim(F.coalesce("side", F.lit("")))).alias("side"),
        )
        .where("p > 0 and v > 0")
    )
    bars = rows.groupBy("asset_id", F.window("at", f"{n} seconds")).agg(
        F.sum("v").alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(F.col("side") == "buy", F.col("v")).otherwise(zero)).alias("buy_volume"),
        F.sum(F.when(F.col("side") == "sell", F.col("v")).otherwise(zero)).alias("sell_volume"),
        (F.sum(F.col("p") * F.col("v")) / F.sum("v")).alias("vwap"),
    )
    return bars.select(
        "asset_id", F.unix_timestamp("window.start").alias("ts"), F.lit(interval).alias("interval"), "volume", "trade_count",
        "buy_volume", "sell_volume", "vwap",
    )


def corrected_bars_into(
    trades: DataFrame, path: str, checkpoint: str, interval: str = "1h", lateness: str = "2 hours"
) -> DataStreamWriter:
    """Bars of an unbounded trade feed in a stored table, open ones included (update mode).

    A trade that comes late, but before the watermark has passed its bar, gives a corrected bar, which replaces the stored
    one; later trades are dropped. The state holds the bars the watermark has not passed. A replayed batch merges the same bars.
    """
    def merge(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, path, batch, "volume_bars")

    bars = volume_bars(trades, interval, lateness)
    return bars.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def last_ticks(ticks: DataFrame, lateness: str = "2 hours", seq: str = "seq") -> DataFrame:
    """Price per (asset, second, interval) as the row with the largest ``seq`` gave it before the watermark passed (append mode).

    A tick is final and leaves the state once the watermark has passed its second; until then late and repeated rows count.
    """
    rows = ticks.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", lateness)
    last = rows.groupBy("asset_id", "interval", "at").agg(F.max_by("price", seq).alias("price"))
    return last.select("asset_id", F.unix_timestamp("at").alias("ts"), "price", "interval")


def distinct_ticks(ticks: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """First arrival per (asset, second, interval); for feeds whose repeats are exact. Where a repeat may carry another price,
    ``keep_last_into`` decides by arrival instead."""
    return (
        ticks.withColumn("at", F.timestamp_seconds("ts"))
        .withWatermark("at", lateness)
        .dropDuplicatesWithinWatermark(["asset_id", "ts", "interval"])
        .drop("at")
    )


def keep_last_into(stream: DataFrame, path: str, table: str, checkpoint: str, seq: str | None = None) -> DataStreamWriter:
    """Every micro-batch is merged keep-last into a stored table. Replaying a batch gives the same table, so a restart from the
    checkpoint is safe; late data arrives as rows re-read with an overlap."""
    def merge(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, path, batch, table, seq)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
