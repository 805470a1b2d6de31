"""Fixed projections from the driver's test tables to the canonical market tables.

Every projection reads the given parquet tables whole; nothing is sampled or cut.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from oddsmill.operators.bars import book_metrics, trade_bars
from oddsmill.plans.keep import keep_last

# Fixed values of the projections: 2024-01-01 and 2024-01-31 UTC.
EPOCH_START = 1_704_067_200
AS_OF = 1_706_659_200
DAY = 86_400
BOOK_ASSETS = 20
NO_OFFSET = 1_000_000
TASKS_A_CORE = 4  # tasks the documents are dealt over

_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "time": T.TimestampNTZType(),
    "floats": T.ArrayType(T.FloatType()),
}
# Declared schemas spare the job that would read file footers to find them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate time, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate time",
    "events": "event_id bigint, ts time, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding floats, label int",
}


def declared(name: str) -> T.StructType:
    pairs = [c.split() for c in SCHEMAS[name].split(",")]
    return T.StructType([T.StructField(c, _TYPES[t], True) for c, t in pairs])


class Canon:
    """Canonical tables over one data directory, each built on first use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(declared(name)).parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def prices(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").cast("string").alias("asset_id"),
            F.unix_timestamp("ts").alias("ts"),
            F.least(F.col("value") / 200, F.lit(1.0)).alias("price"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        return self.trades_with_seq().drop("seq")

    def trades_with_seq(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("user_id").cast("string").alias("asset_id"),
            F.unix_timestamp("ts").alias("ts"),
            F.least(F.col("value") / 200, F.lit(1.0)).alias("price"),
            F.col("value").alias("size"),
            F.when(kind.isin("click", "purchase"), "buy").when(kind.isin("view", "error"), "sell").otherwise("other").alias("side"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def events(self) -> DataFrame:
        key = F.col("n_nationkey").cast("bigint")
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                key.alias("event_id"),
                F.lower("n_name").alias("slug"),
                F.col("n_name").alias("title"),
                (EPOCH_START - key * DAY).alias("start_ts"),
                (AS_OF + (key % 5 - 1) * DAY).alias("end_ts"),
                F.concat(F.lit('["'), F.col("r_name"), F.lit('"]')).alias("tags"),
            )
        )

    @cached_property
    def markets(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.cast("string").alias("market_id"),
            F.col("c_nationkey").cast("bigint").alias("event_id"),
            F.concat(F.lit("c"), key.cast("string")).alias("condition_id"),
            F.col("c_name").alias("question"),
            (key % 11 != 0).alias("active"),
            (key % 7 == 0).alias("closed"),
            (key % 13 == 0).alias("resolved"),
            F.lit(None).cast("string").alias("resolution_outcome"),
            F.lit(None).cast("bigint").alias("resolution_ts"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "multi").otherwise("binary").alias("market_type"),
            F.col("c_acctbal").alias("liquidity"),
        )

    @cached_property
    def tokens(self) -> DataFrame:
        """Two tokens per market; seq is the arrival order (the No token arrives first on every third market)."""
        key = F.col("c_custkey")
        side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
        return self.table("customer").select("c_custkey", side).select(
            key.cast("string").alias("market_id"),
            F.when(F.col("side") == 0, "Yes").otherwise("No").alias("outcome"),
            (key + F.col("side") * NO_OFFSET).cast("string").alias("asset_id"),
            (key * 2 + F.when(key % 3 == 0, 1 - F.col("side")).otherwise(F.col("side"))).alias("seq"),
        )

    @cached_property
    def resolutions(self) -> DataFrame:
        status = F.col("o_orderstatus")
        rows = self.table("orders").select(
            F.col("o_custkey").cast("string").alias("market_id"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("condition_id"),
            F.when(status == "F", "Yes").when(status == "O", "No").otherwise("Invalid").alias("resolution_outcome"),
            (EPOCH_START + (F.col("o_orderkey") * 7919 % 30) * DAY).alias("resolution_ts"),
            F.col("o_orderkey").alias("seq"),
        )
        return keep_last(rows, ["market_id"], ["seq"]).drop("seq")

    @cached_property
    def levels(self) -> DataFrame:
        flag = F.col("l_returnflag")
        ask = flag == "R"
        return self.table("lineitem").select(
            (F.col("l_partkey") % BOOK_ASSETS).cast("string").alias("asset_id"),
            F.unix_timestamp(F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))).alias("snapshot_ts"),
            F.when(ask, "ask").otherwise("bid").alias("side"),
            F.when(ask, 0.5 + F.col("l_tax") / 5).otherwise(0.5 - F.col("l_discount") / 5).alias("price"),
            F.col("l_quantity").cast("double").alias("size"),
        )

    @cached_property
    def books(self) -> DataFrame:
        return book_metrics(self.levels)

    @cached_property
    def bars(self) -> DataFrame:
        return trade_bars(self.trades, "1h")

    @cached_property
    def signal_log(self) -> DataFrame:
        """An accumulated signal table derived from the orders, one row per order."""
        key = F.col("o_orderkey")
        return self.table("orders").select(
            F.lower(F.col("o_orderpriority")).alias("signal_name"),
            F.col("o_custkey").cast("string").alias("asset_id"),
            F.col("o_custkey").cast("string").alias("market_id"),
            (EPOCH_START + (key * 31 % 30) * DAY + (key % 24) * 3600).alias("ts"),
            F.when(key % 2 == 0, "buy").otherwise("sell").alias("direction"),
            ((key % 100) / 100.0).alias("confidence"),
            (0.05 + (key * 17 % 90) / 100.0).alias("entry_price"),
            ((key % 20) / 100.0).alias("edge"),
            key.alias("seq"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        """Raw event documents as JSON text, one per customer, in the loose shapes the feeds use."""
        k, nation, name = F.col("c_custkey"), F.col("c_nationkey").cast("bigint"), F.col("c_name")
        text, other = k.cast("string"), (k + NO_OFFSET).cast("string")
        even, m3, m5 = k % 2 == 0, k % 3, k % 5

        def quoted(*cols):
            return F.concat(F.lit('["'), F.concat_ws('","', *cols), F.lit('"]'))

        stamp = F.lit(EPOCH_START) + (k % 30) * DAY
        market = F.struct(
            text.alias("id"),
            F.when(even, F.concat(F.lit("c"), text)).alias("conditionId"),
            F.when(~even, F.concat(F.lit("c"), text)).alias("condition_id"),
            name.alias("question"),
            (k % 11 != 0).alias("active"),
            F.when(even, F.when(k % 7 == 0, "yes").otherwise("no")).alias("closed"),
            F.when(~even, (k % 7 == 0).cast("int")).alias("isClosed"),
            F.when(m5.isin(0, 3), True).alias("resolved"),
            F.when(m5 == 1, "no").alias("isResolved"),
            F.when(m5 == 0, "1").alias("winningOutcome"),
            F.when(m5 == 1, "Yes").alias("outcome"),
            F.when(m5 == 2, "void").alias("result"),
            F.when(m5.isin(0, 2), stamp * 1000).alias("resolutionDate"),
            F.when(m5.isin(1, 3), F.date_format(F.timestamp_seconds(stamp), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("endDate"),
            F.when(
                m3 == 0,
                F.array(
                    F.struct(text.alias("token_id"), F.lit(None).cast("bigint").alias("tokenId"), F.lit("Yes").alias("outcome"), F.lit(None).cast("string").alias("name")),
                    F.struct(F.lit(None).cast("string").alias("token_id"), (k + NO_OFFSET).alias("tokenId"), F.lit(None).cast("string").alias("outcome"), F.lit("No").alias("name")),
                ),
            ).alias("tokens"),
            F.when(m3 == 1, quoted(text, other)).when(m3 == 2, F.concat_ws(", ", text, other, F.concat(F.lit("x"), text))).alias("clobTokenIds"),
            F.when(m3 == 1, quoted(F.lit("Yes"), F.lit("No"))).when(m3 == 2, "Yes").alias("outcomes"),
            F.when(even, F.col("c_acctbal").cast("string")).alias("liquidity"),
            F.when(~even, F.col("c_acctbal")).alias("liquidityNum"),
        )
        doc = F.struct(
            F.when(even, nation.cast("string")).alias("id"),
            F.when(~even, nation).alias("eventId"),
            F.concat(F.lit("Event "), nation.cast("string")).alias("title"),
            F.concat(F.lit("event-"), nation.cast("string")).alias("slug"),
            F.when(m3 == 0, F.lit("2024-01-01T00:00:00Z")).alias("startDate"),
            F.when(m3 != 0, (EPOCH_START - nation * DAY) * 1000).alias("startTs"),
            (AS_OF + (k % 5 - 1) * DAY).alias("end_ts"),
            F.when(even, F.array(F.concat(F.lit(" "), F.col("c_mktsegment")), F.lit(""), F.lit("all"))).alias("tags"),
            F.when(~even, F.array(F.struct(F.lit("").alias("label"), F.col("c_mktsegment").alias("slug")))).alias("categories"),
            F.array(market).alias("markets"),
        )
        # The rows become long texts that are costly to read, and a small file is one task's: they are dealt out first.
        rows = self.table("customer")
        dealt = rows.repartition(TASKS_A_CORE * self.spark.sparkContext.defaultParallelism, "c_custkey")
        return dealt.select(F.to_json(doc).alias("value"), k.alias("seq"))
