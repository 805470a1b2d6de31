"""Landed raw files: JSON lines, wrapped payloads and recency filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from oddsmill.functions import raw


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """value (text of one document) and seq (file order, then position in the file).

    seq only orders rows; it is unique because a file split starts at its own offset.
    """
    return (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("seq"))
    )


def write_json_lines(docs: DataFrame, path: str, mode: str = "overwrite", text: str = "value") -> None:
    docs.select(F.col(text).alias("value")).write.mode(mode).text(path)


# Names under which a payload wraps its list.
EVENT_WRAPPERS = ("events", "data", "items", "results")
TRADE_WRAPPERS = ("trades", "data", "items", "results")
HISTORY_WRAPPERS = ("history",)


def unwrap(payloads: DataFrame, doc: str = "doc", wrappers: tuple[str, ...] = EVENT_WRAPPERS, out: str = "item") -> DataFrame:
    """One row per element of a payload that is a list, or an object holding the list under a known name."""
    v = F.col(doc)
    inner = [raw.items(raw.field(v, k)) for k in wrappers]
    return payloads.withColumn("_items", F.coalesce(raw.items(v), *inner)).select(
        *[c for c in payloads.columns if c != doc], F.posexplode("_items").alias("pos", out)
    )


# Fields that date an event, in order of preference.
EVENT_TIME = ("resolutionDate", "resolvedAt", "endDate", "end_ts", "endTs")


def recent_events(docs: DataFrame, cutoff_ts: int, doc: str = "doc") -> DataFrame:
    """Keeps events dated at or after the cutoff and events without a usable date."""
    at = F.coalesce(*[raw.seconds_of(raw.field(F.col(doc), k)) for k in EVENT_TIME])
    return docs.where(at.isNull() | (at >= cutoff_ts))


def trades_sample(trades: DataFrame, markets: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """All trades of the first ``n`` distinct condition ids (the feature is this limit)."""
    first = (
        markets.where("condition_id is not null")
        .groupBy("condition_id")
        .agg(F.min(seq).alias("_s"))
        .orderBy("_s")
        .limit(n)
        .select("condition_id")
    )
    return trades.join(first, "condition_id", "left_semi")
