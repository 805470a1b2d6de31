"""Load runs: landed payload files into price_history, volume_bars and orderbook_snapshots.

The file source of Structured Streaming is the ledger: its checkpoint under ``_ledger`` remembers which files were read, so
a run takes only what landed since the last one and a run that broke off is finished by the next. Each batch is merged
keep-last by touched day; a batch that is replayed gives the same table. Lines that cannot be used go to ``_quarantine``
with the reason, and ``_lineage`` says what became of the lines of every file; both are written per batch, so a replay
replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddsmill.functions import raw
from oddsmill.functions.scalars import floor_to
from oddsmill.operators import bars, normalize
from oddsmill.plans.keep import keep_last
from oddsmill.schemas import MARKETS, TABLES, TOKENS, interval_seconds
from oddsmill.session import tune
from oddsmill.sources import landing, tables

# Names a payload gives its asset, its condition and its own time by.
ASSET_KEYS = ("asset_id", "assetId", "token_id", "tokenId")
CONDITION_KEYS = ("condition_id", "conditionId", "market")
TIME_KEYS = ("timestamp", "ts", "time")


def landed_lines(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Lines of new files: value, and file, landed_at and place of each for lineage and order."""
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_block_start").alias("place"))


def _checked(lines: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds doc (VARIANT), seq (a later file is newer) and reason: why a line cannot be used, or null."""
    rows = lines.where(F.trim("value") != "").withColumn("doc", F.try_parse_json("value"))
    rows = rows.withColumn("seq", F.struct("landed_at", "file", "place", F.monotonically_increasing_id().alias("row")))
    reason = F.when(F.col("doc").isNull(), "not JSON").when(~raw.is_object(F.col("doc")), "not an object")
    for name, bad in reasons:
        reason = reason.when(bad, name)
    return rows.withColumn("reason", reason)


def _missing(*keys: str) -> Column:
    return raw.pick_text(F.col("doc"), *keys).isNull()


def _no_list(wrappers: tuple[str, ...]) -> Column:
    return F.coalesce(*[raw.items(raw.field(F.col("doc"), k)) for k in wrappers]).isNull()


def _run(
    spark: SparkSession, root: str, path: str, kind: str, reasons: list[tuple[str, Column]], rows_of: Callable[[DataFrame], DataFrame],
    per_trigger: int | None, prepare: Callable[[DataFrame], DataFrame] = lambda checked: checked,
) -> DataFrame:
    tune(spark)
    table = f"{root}/{kind}.parquet"

    def merge(batch: DataFrame, number: int) -> None:
        # Three writes read the batch; what an executor loses is read again from the landed files.
        checked = prepare(_checked(batch, reasons)).persist()
        try:
            bad = F.col("reason").isNotNull()
            tables.upsert(batch.sparkSession, table, rows_of(checked.where(~bad)), kind)
            checked.where(bad).select("value", "file", "landed_at", "reason").write.mode("overwrite").parquet(f"{root}/_quarantine/{kind}/batch={number}")
            files = checked.groupBy("file", "landed_at").agg(F.count(F.lit(1)).alias("lines"), F.count_if(bad).alias("quarantined"))
            files.write.mode("overwrite").parquet(f"{root}/_lineage/{kind}/batch={number}")
        finally:
            checked.unpersist()

    lines = landed_lines(spark, path, per_trigger)
    lines.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/_ledger/{kind}").trigger(availableNow=True).start().awaitTermination()
    return tables.read_optional(spark, table, TABLES[kind].schema)


def load_prices(
    spark: SparkSession, root: str, path: str, *, interval: str = "1h", ingested_at: int, per_trigger: int | None = None, raw_path: str | None = None,
) -> DataFrame:
    """Landed histories (an asset and its points under ``history``) into price_history; a point that landed later replaces an earlier one.

    Points without a usable time or price are left out. ``raw_path`` also keeps the rows of this load in a folder per asset.
    """

    def rows_of(good: DataFrame) -> DataFrame:
        points = landing.unwrap(good, wrappers=landing.HISTORY_WRAPPERS, out="point").select(
            raw.pick_text(F.col("kept"), *ASSET_KEYS).alias("asset_id"), F.struct("seq", "pos").alias("seq"), "point")
        rows = normalize.normalize_history(points, interval, ingested_at)
        if raw_path:
            tables.write_raw_by(rows, raw_path, "asset_id")
        return rows

    reasons = [("no asset", _missing(*ASSET_KEYS)), ("no history", _no_list(landing.HISTORY_WRAPPERS))]
    return _run(spark, root, path, "price_history", reasons, rows_of, per_trigger, lambda c: c.withColumn("kept", F.col("doc")))


def load_bars(spark: SparkSession, root: str, path: str, *, interval: str = "1h", per_trigger: int | None = None) -> DataFrame:
    """Landed trades of conditions (with the time ``min_ts`` they begin at) into volume_bars of the market's anchor token.

    A payload holds all trades of a condition from the start of the interval of its ``min_ts`` on, so its bars are whole and
    replace those of payloads that landed earlier. Conditions of no stored market are quarantined.
    """
    n = interval_seconds(interval)

    def prepare(checked: DataFrame) -> DataFrame:
        markets, tokens = (tables.read_optional(spark, f"{root}/{t}.parquet", s) for t, s in (("markets", MARKETS), ("tokens", TOKENS)))
        anchors = normalize.anchor_tokens(tokens, "asset_id").select("market_id", "asset_id")
        known = markets.where("condition_id is not null").join(anchors, "market_id").groupBy("condition_id").agg(F.min("asset_id").alias("asset_id"))
        rows = checked.withColumn("condition_id", raw.pick_text(F.col("doc"), *CONDITION_KEYS)).join(known, "condition_id", "left")
        return rows.withColumn("reason", F.coalesce("reason", F.when(F.col("asset_id").isNull(), "unknown condition"))).withColumn(
            "min_ts", raw.seconds_of(raw.field(F.col("doc"), "min_ts")))

    def rows_of(good: DataFrame) -> DataFrame:
        trades = landing.unwrap(good, wrappers=landing.TRADE_WRAPPERS, out="trade")
        priced = normalize.normalize_trades(trades, keep=("seq", "min_ts")).where(
            F.col("min_ts").isNull() | (F.col("ts") >= floor_to("min_ts", n)))
        return keep_last(bars.trade_bars(priced, interval, by=("seq",)), ["asset_id", "ts", "interval"], ["seq"]).drop("seq")

    reasons = [("no condition", _missing(*CONDITION_KEYS)), ("no trades", _no_list(landing.TRADE_WRAPPERS))]
    return _run(spark, root, path, "volume_bars", reasons, rows_of, per_trigger, prepare)


def load_books(spark: SparkSession, root: str, path: str, *, per_trigger: int | None = None) -> DataFrame:
    """Landed order books into orderbook_snapshots, one per asset and hour of the payload's own time (else of its landing).

    An asset whose book is empty or unusable gets a snapshot without figures.
    """

    def rows_of(good: DataFrame) -> DataFrame:
        own = F.coalesce(*[raw.seconds_of(raw.field(F.col("doc"), k)) for k in TIME_KEYS])
        books = good.select(
            raw.pick_text(F.col("doc"), *ASSET_KEYS).alias("asset_id"),
            bars.snapshot_hour(F.coalesce(own, F.unix_timestamp("landed_at"))).alias("snapshot_ts"), "doc", "seq")
        last = keep_last(books, ["asset_id", "snapshot_ts"], ["seq"])
        return bars.book_metrics_from_arrays(normalize.normalize_books(last))

    return _run(spark, root, path, "orderbook_snapshots", [("no asset", _missing(*ASSET_KEYS))], rows_of, per_trigger)


def lineage(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """file, landed_at, lines, quarantined, batch of every file read so far."""
    return spark.read.parquet(f"{root}/_lineage/{kind}")


def quarantined(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """value, file, landed_at, reason, batch of every line that could not be used."""
    return spark.read.parquet(f"{root}/_quarantine/{kind}")
