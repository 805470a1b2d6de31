"""As-of lookups on per-asset ticks without a window over a whole asset.

Ticks are unique per (asset, second) after ``canonical_ticks``. Cutting time into chunks of ``chunk`` seconds therefore
bounds every window partition by the chunk length, whatever share of the rows one asset holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from oddsmill.functions.scalars import to_double, to_long


def canonical_ticks(prices: DataFrame) -> DataFrame:
    """(asset_id, ts, price): numeric, no nulls, the last row per (asset, second) by ``seq`` (else the largest price)."""
    clean = clean_ticks(prices)
    # Primitive buffers keep this a hash aggregate with map-side combine, hashed on (asset, ts).
    return clean.groupBy("asset_id", "ts").agg(F.max_by("price", "seq").alias("price"))


def clean_ticks(prices: DataFrame) -> DataFrame:
    """(asset_id, ts, price, seq): numeric, no nulls, repeats of a second still there."""
    # An alias over a column that already is a string would keep two uses of the ticks from sharing one exchange.
    text = isinstance(prices.schema["asset_id"].dataType, StringType)
    return prices.select(
        F.col("asset_id") if text else F.col("asset_id").cast("string").alias("asset_id"),
        to_long("ts").alias("ts"),
        to_double("price").alias("price"),
        F.col("seq") if "seq" in prices.columns else to_double("price").alias("seq"),
    ).dropna(subset=["asset_id", "ts", "price"])


def order_key(ticks: DataFrame) -> Column:
    """Time and seq of ``clean_ticks`` in one value that orders like the two; a decimal where seq is whole, so that aggregates
    by it stay hash aggregates (a struct in the buffer would have Spark sort all ticks)."""
    if not isinstance(ticks.schema["seq"].dataType, (LongType, IntegerType)):
        return F.struct("ts", "seq")
    return F.expr("cast(ts as decimal(18,0)) * cast(18446744073709551616 as decimal(20,0)) + cast(seq as decimal(19,0))")


def last_price(ticks: DataFrame, until: Column | None = None) -> Column:
    """Price of the last tick of ``clean_ticks`` (of those with ``until``), of equal times the one with the largest seq, in one map-side aggregate."""
    key = order_key(ticks)
    return F.max_by("price", key if until is None else F.when(until, key))


def next_tick(targets: DataFrame, ticks: DataFrame, chunk: int = 86_400) -> DataFrame:
    """First tick at or after each distinct (asset_id, target_ts): adds exit_ts, exit_price (null if none).

    ``targets`` are made distinct, so callers join the answer back on (asset_id, target_ts).
    """
    step = F.lit(chunk).cast("bigint")
    wanted = (
        targets.select("asset_id", "target_ts")
        .distinct()
        .withColumn("_chunk", F.floor(F.col("target_ts") / step))
    )
    cut = ticks.withColumn("_chunk", F.floor(F.col("ts") / step))

    # Where a chunk has no later tick, the answer is the first tick of the next non-empty chunk.
    heads = cut.groupBy("asset_id", "_chunk").agg(
        F.min("ts").alias("_ts"), F.min_by("price", "ts").alias("_price")
    )
    keys = heads.select("asset_id", "_chunk", "_ts", "_price", F.lit(False).alias("_want")).unionByName(
        wanted.select("asset_id", "_chunk").distinct().withColumn("_want", F.lit(True)), allowMissingColumns=True
    )
    # rangeBetween over the chunk number: strictly later chunks only, both kinds of rows may share a chunk.
    later = Window.partitionBy("asset_id").orderBy(F.col("_chunk").desc()).rangeBetween(Window.unboundedPreceding, -1)
    after = (
        keys.select(
            "asset_id",
            "_chunk",
            "_want",
            F.last("_ts", ignorenulls=True).over(later).alias("_next_ts"),
            F.last("_price", ignorenulls=True).over(later).alias("_next_price"),
        )
        .where("_want")
        .drop("_want")
    )
    rows = wanted.join(after, ["asset_id", "_chunk"], "left").select(
        "asset_id", "_chunk", F.col("target_ts").alias("_t"), F.lit(1).alias("_kind"), "_next_ts", "_next_price"
    ).unionByName(
        cut.select("asset_id", "_chunk", F.col("ts").alias("_t"), F.lit(0).alias("_kind"), "price"),
        allowMissingColumns=True,
    )
    # Descending time; at equal time the tick (_kind 0) precedes the target.
    down = Window.partitionBy("asset_id", "_chunk").orderBy(F.col("_t").desc(), F.col("_kind"))
    seen_ts = F.last(F.when(F.col("_kind") == 0, F.col("_t")), ignorenulls=True).over(down)
    seen_price = F.last("price", ignorenulls=True).over(down)
    return (
        rows.withColumn("_seen_ts", seen_ts)
        .withColumn("_seen_price", seen_price)
        .where("_kind = 1")
        .select(
            "asset_id",
            F.col("_t").alias("target_ts"),
            F.coalesce("_seen_ts", "_next_ts").alias("exit_ts"),
            F.when(F.col("_seen_ts").isNotNull(), F.col("_seen_price")).otherwise(F.col("_next_price")).alias("exit_price"),
        )
    )


def haloed(ticks: DataFrame, before: int, after: int, chunk: int) -> DataFrame:
    """Ticks cut into time chunks, each with copies of its neighbours' rows ``before``/``after`` seconds around it.

    Adds _chunk and _core (true for the one copy that belongs to the chunk), so range frames reaching at most that far
    are exact inside (asset_id, _chunk).
    """
    step = F.lit(chunk).cast("bigint")
    home = F.floor(F.col("ts") / step)
    first = F.floor((F.col("ts") - after) / step)
    last = F.floor((F.col("ts") + before) / step)
    return (
        ticks.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_core", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )
