"""Nested event documents to relational tables; token selection and resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.functions import raw
from oddsmill.functions.scalars import canonical_outcome, is_anchor, market_type, once, resolution_state, to_double, to_long
from oddsmill.plans.asof import canonical_ticks, clean_ticks, last_price
from oddsmill.plans.keep import keep_first, keep_last

# Field names the feeds use for one and the same thing, in order of preference.
EVENT_ID = ("id", "eventId", "event_id")
EVENT_TITLE = ("title", "name", "question")
EVENT_START = ("startDate", "start_ts", "startTs", "startTime")
EVENT_END = ("endDate", "end_ts", "endTs", "endTime")
EVENT_TAGS = ("tags", "categories")
MARKET_ID = ("id", "marketId", "market_id")
CONDITION_ID = ("conditionId", "condition_id")
QUESTION = ("question", "title", "name")
CLOSED = ("closed", "isClosed")
RESOLVED = ("resolved", "isResolved", "is_resolved")
OUTCOME = ("winningOutcome", "winning_outcome", "outcome", "resolutionOutcome", "resolution_outcome", "result")
RESOLVED_AT = ("resolutionDate", "resolvedTime", "resolvedAt", "resolution_ts", "resolutionTs", "endDate")
MARKET_TYPE = ("marketType", "type")
LIQUIDITY = ("liquidity", "liquidityNum")
TOKEN_ID = ("token_id", "tokenId", "asset_id", "assetId", "id")
TOKEN_OUTCOME = ("outcome", "name", "title")
OUTCOME_NAMES = ("outcomes", "outcomeNames", "answers")
TOKEN_LIST = ("clobTokenIds", "clob_token_ids")


def parse_documents(lines: DataFrame, text: str = "value", seq: str = "seq") -> DataFrame:
    """One VARIANT document per line with its arrival number; lines that are no JSON object are dropped."""
    # Filters are not moved below a generator, so going through one keeps the optimizer from parsing once per condition.
    doc = F.explode_outer(F.array(F.try_parse_json(text)))
    return lines.select(F.col(seq).alias("seq"), doc.alias("doc")).where(raw.is_object(F.col("doc")))


def _event_id(doc: Column) -> Column:
    v = raw.pick(doc, *EVENT_ID)
    return F.coalesce(raw.text(v).try_cast("bigint"), F.when(raw.is_number(v), raw.number(v).cast("bigint")))


def _tokens(listed: Column, names: Column, ids: Column) -> Column:
    """array<struct<asset_id, outcome>> from token objects, else from parallel id and outcome lists."""
    def from_object(t: Column) -> Column:
        return F.struct(raw.pick_text(t, *TOKEN_ID).alias("asset_id"), raw.pick_text(t, *TOKEN_OUTCOME).alias("outcome"))

    objects = F.transform(F.filter(raw.items(listed), raw.is_object), from_object)
    objects = F.filter(objects, lambda t: t["asset_id"].isNotNull())

    def from_lists(asset: Column, i: Column) -> Column:
        name = F.get(names, i)
        return F.struct(asset.alias("asset_id"), F.when(name != "", name).alias("outcome"))

    lists = F.filter(
        F.transform(ids, from_lists),
        lambda t: t["asset_id"].isNotNull() & (t["asset_id"] != ""),
    )
    return once(objects, lambda found: F.when(F.size(found) > 0, found).otherwise(lists))


def _market_docs(docs: DataFrame) -> DataFrame:
    """One row per market object: seq, pos, event_id, market. Markets that are no objects are skipped."""
    return (
        docs.select("seq", _event_id(F.col("doc")).alias("event_id"), raw.items_at(F.col("doc"), "markets").alias("ms"))
        .select("seq", "event_id", F.posexplode_outer("ms").alias("pos", "market"))
        .where(raw.is_object(F.col("market")))
    )


def extract_events(docs: DataFrame) -> DataFrame:
    doc = F.col("doc")
    rows = docs.select(
        "seq",
        _event_id(doc).alias("event_id"),
        raw.pick_text(doc, "slug").alias("slug"),
        raw.pick_text(doc, *EVENT_TITLE).alias("title"),
        raw.seconds_of(raw.pick(doc, *EVENT_START)).alias("start_ts"),
        raw.seconds_of(raw.pick(doc, *EVENT_END)).alias("end_ts"),
        F.to_json(raw.tags_of(raw.pick(doc, *EVENT_TAGS))).alias("tags"),
    )
    return keep_last(rows, ["event_id"], ["seq"]).drop("seq")


def _market_fields(docs: DataFrame) -> DataFrame:
    """Picked fields of every market object, in stages so that no lookup is evaluated twice."""
    m = F.col("market")
    picked = _market_docs(docs).select(
        "seq",
        "pos",
        "event_id",
        "market",
        raw.pick_text(m, *MARKET_ID).alias("market_id"),
        raw.pick_text(m, *CONDITION_ID).alias("condition_id"),
        raw.pick(m, *RESOLVED).alias("_flag"),
        canonical_outcome(raw.pick_text(m, *OUTCOME)).alias("_outcome"),
        raw.pick(m, *RESOLVED_AT).alias("_at"),
    )
    typed = picked.withColumn("_flag", raw.bool_of(F.col("_flag"))).withColumn("resolution_ts", raw.seconds_of(F.col("_at")))
    resolved, outcome = resolution_state(F.col("_flag"), F.col("_outcome"))
    return typed.withColumn("resolved", resolved).withColumn("resolution_outcome", outcome)


def _with_tokens(docs: DataFrame) -> DataFrame:
    m = F.col("market")
    return (
        docs.withColumn("_listed", raw.pick(m, "tokens"))
        .withColumn("_names", raw.pick(m, *OUTCOME_NAMES))
        .withColumn("_ids", raw.pick(m, *TOKEN_LIST))
        .withColumn("_names", raw.strings_of(F.col("_names")))
        .withColumn("_ids", raw.strings_of(F.col("_ids")))
        .withColumn("_tokens", _tokens(F.col("_listed"), F.col("_names"), F.col("_ids")))
    )


def extract_markets(docs: DataFrame) -> DataFrame:
    m = F.col("market")
    rows = (
        _with_tokens(_market_fields(docs))
        .withColumn("_active", raw.pick(m, "active"))
        .withColumn("_closed", raw.pick(m, *CLOSED))
        .withColumn("_liquidity", raw.pick(m, *LIQUIDITY))
        .withColumn("_count", F.when(F.size("_tokens") > 0, F.size("_tokens")).otherwise(F.size("_names")))
        .select(
            "seq",
            "pos",
            "market_id",
            "event_id",
            "condition_id",
            raw.pick_text(m, *QUESTION).alias("question"),
            raw.bool_of(F.col("_active")).alias("active"),
            raw.bool_of(F.col("_closed")).alias("closed"),
            "resolved",
            "resolution_outcome",
            "resolution_ts",
            market_type(raw.pick_text(m, *MARKET_TYPE), F.col("_count")).alias("market_type"),
            raw.float_of(F.col("_liquidity")).alias("liquidity"),
        )
    )
    return keep_last(rows, ["market_id"], ["seq", "pos"]).drop("seq", "pos")


def extract_tokens(docs: DataFrame) -> DataFrame:
    rows = (
        _with_tokens(_market_docs(docs))
        .select("seq", "pos", raw.pick_text(F.col("market"), *MARKET_ID).alias("market_id"), F.posexplode("_tokens").alias("tpos", "t"))
        .select("seq", "pos", "tpos", "market_id", F.col("t.outcome").alias("outcome"), F.col("t.asset_id").alias("asset_id"))
    )
    return keep_last(rows, ["market_id", "asset_id"], ["seq", "pos", "tpos"]).drop("seq", "pos", "tpos")


def extract_resolutions(docs: DataFrame) -> DataFrame:
    rows = (
        _market_fields(docs)
        .where(F.col("resolved") | F.col("resolution_outcome").isNotNull() | F.col("resolution_ts").isNotNull())
        .select("seq", "pos", "market_id", "condition_id", "resolution_outcome", "resolution_ts")
    )
    return keep_last(rows, ["market_id"], ["seq", "pos"]).drop("seq", "pos")


def normalize_history(points: DataFrame, interval: str, ingested_at: int) -> DataFrame:
    """points: asset_id, seq, point (VARIANT) -> price rows, the last point per (asset, second)."""
    p = F.col("point")
    at = F.coalesce(*[raw.field(p, k) for k in ("t", "ts", "timestamp")])
    price = F.coalesce(*[raw.field(p, k) for k in ("p", "price")])
    whole = raw.float_of(at).cast("bigint")
    rows = points.where(raw.is_object(p)).select(
        F.col("asset_id").cast("string").alias("asset_id"),
        F.when(whole > 10_000_000_000, F.floor(whole / 1000)).otherwise(whole).alias("ts"),
        raw.float_of(price).alias("price"),
        "seq",
    )
    return canonical_ticks(rows).select(
        "asset_id", "ts", "price", F.lit(interval).alias("interval"), F.lit(ingested_at).cast("bigint").alias("ingested_at")
    )


def normalize_levels(v: Column) -> Column:
    """array<struct<price,size>> from level objects or pairs, keeping price > 0 and size >= 0."""
    def one(x: Column) -> Column:
        obj = raw.is_object(x)
        price = F.when(obj, F.coalesce(*[raw.field(x, k) for k in ("price", "p")])).otherwise(F.try_variant_get(x, "$[0]", "variant"))
        size = F.when(obj, F.coalesce(*[raw.field(x, k) for k in ("size", "s", "quantity", "q")])).otherwise(
            F.try_variant_get(x, "$[1]", "variant")
        )
        return F.struct(raw.float_of(price).alias("price"), raw.float_of(size).alias("size"))

    none = F.array().cast("array<struct<price:double,size:double>>")
    return F.coalesce(F.filter(F.transform(raw.items(v), one), lambda x: (x["price"] > 0) & (x["size"] >= 0)), none)


# Names of the two sides of a book.
BID_KEYS = ("bids", "buyOrders", "buy")
ASK_KEYS = ("asks", "sellOrders", "sell")


def normalize_books(payloads: DataFrame) -> DataFrame:
    """payloads: asset_id, snapshot_ts, doc (VARIANT) -> bids/asks arrays; a nested ``book`` is the fallback."""
    def side(doc: Column, keys: tuple[str, ...]) -> Column:
        return normalize_levels(F.coalesce(*[raw.field(doc, k) for k in keys]))

    doc, inner = F.col("doc"), raw.field(F.col("doc"), "book")
    outer = payloads.withColumn("_b", side(doc, BID_KEYS)).withColumn("_a", side(doc, ASK_KEYS))
    empty = (F.size("_b") == 0) & (F.size("_a") == 0)
    return outer.select(
        F.col("asset_id").cast("string").alias("asset_id"),
        "snapshot_ts",
        F.when(empty, side(inner, BID_KEYS)).otherwise(F.col("_b")).alias("bids"),
        F.when(empty, side(inner, ASK_KEYS)).otherwise(F.col("_a")).alias("asks"),
    )


# Trade fields in order of preference.
TRADE_TIME = ("timestamp", "ts", "time", "createdAt")
TRADE_SIZE = ("size", "amount", "volume", "shares")


def normalize_trades(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """payloads: asset_id, trade (VARIANT) -> asset_id, ts, price, size, side (bad values null), and the columns ``keep``."""
    t = F.col("trade")
    return payloads.where(raw.is_object(t)).select(
        F.col("asset_id").cast("string").alias("asset_id"),
        F.coalesce(*[raw.seconds_of(raw.field(t, k)) for k in TRADE_TIME]).alias("ts"),
        raw.float_of(F.coalesce(*[raw.field(t, k) for k in ("price", "p")])).alias("price"),
        raw.float_of(F.coalesce(*[raw.field(t, k) for k in TRADE_SIZE])).alias("size"),
        F.lower(F.trim(F.coalesce(raw.text(raw.field(t, "side")), F.lit("")))).alias("side"),
        *keep,
    )


def anchor_tokens(tokens: DataFrame, seq: str = "seq") -> DataFrame:
    """One token per market: the first yes/true outcome, else the first token."""
    best = keep_first(tokens, ["market_id"], [is_anchor("outcome").desc(), F.col(seq)])
    return best.select("market_id", "asset_id", "outcome")


def select_tokens(tokens: DataFrame, markets: DataFrame, *, yes_only_binary: bool, seq: str = "seq") -> DataFrame:
    """Tokens to load prices for. Without ``yes_only_binary`` every token is kept as it is."""
    typed = tokens.join(markets.select("market_id", "market_type"), "market_id", "left").withColumn(
        "market_type", F.coalesce("market_type", F.lit("unknown"))
    )
    if not yes_only_binary:
        return typed
    binary = F.lower("market_type") == "binary"
    # Split into two branches so that the keep-first filter is planned with a map-side group limit.
    one = keep_first(typed.where(binary), ["market_id"], [is_anchor("outcome").desc(), F.col(seq)])
    return keep_first(one.unionByName(typed.where(~binary)), ["asset_id"], [F.col("market_id"), F.col(seq)])


def enrich_resolutions(resolutions: DataFrame, tokens: DataFrame, prices: DataFrame, ingested_at: int, seq: str = "seq") -> DataFrame:
    """Adds the anchor token's final price: the last one at or before the resolution, else the last one of all."""
    anchors = anchor_tokens(tokens, seq).select("market_id", "asset_id")
    wanted = resolutions.join(anchors, "market_id", "left")
    ticks = clean_ticks(prices)
    # One row per market leaves a map task: the ticks meet the wanted assets first and are aggregated where they are.
    hit = ticks.join(wanted.select("market_id", "asset_id", to_long("resolution_ts").alias("_at")), "asset_id")
    final = hit.groupBy("market_id").agg(F.coalesce(last_price(ticks, F.col("ts") <= F.col("_at")), last_price(ticks)).alias("final_price"))
    return wanted.join(final, "market_id", "left").select(
        "market_id", "condition_id", "resolution_outcome", "resolution_ts", "final_price",
        F.lit(ingested_at).cast("bigint").alias("ingested_at"),
    )


RESOLVED_OUTCOMES = ("Yes", "No", "Invalid", "Unresolved")


def refresh_markets(markets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Takes the three resolution columns from the resolutions table; a market without a row there is not resolved."""
    update = resolutions.select(
        "market_id", "resolution_outcome", "resolution_ts",
        F.col("resolution_outcome").isin(*RESOLVED_OUTCOMES).alias("resolved"),
    )
    kept = markets.drop("resolved", "resolution_outcome", "resolution_ts")
    out = kept.join(update, "market_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    return out.select(*markets.columns)


def market_context(tokens: DataFrame, markets: DataFrame, events: DataFrame) -> DataFrame:
    """Event start and end per asset; the last market wins where an asset has several."""
    rows = (
        tokens.select("asset_id", "market_id").distinct()
        .join(markets.select("market_id", "event_id"), "market_id", "left")
        .join(events.select("event_id", "start_ts", "end_ts"), "event_id", "left")
    )
    return keep_last(rows, ["asset_id"], ["market_id"]).select("asset_id", "market_id", "event_id", to_double("start_ts").cast("bigint").alias("start_ts"), to_double("end_ts").cast("bigint").alias("end_ts"))
