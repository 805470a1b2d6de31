"""Pairwise relations: overround inside a market and price correlation inside a tag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from oddsmill.functions.scalars import tag_from_pattern
from oddsmill.operators.normalize import anchor_tokens
from oddsmill.operators.quality import market_tags
from oddsmill.plans.asof import clean_ticks, last_price
from oddsmill.plans.keep import keep_last
from oddsmill.schemas import DAY
from oddsmill.session import stored

BLOCK = 1024  # assets per block of the correlation matrix
CELLS = 4 << 20  # most assets x days of a block
STRIP = 256  # rows of a block compared at a time
ROWS = 50_000  # pairs sent on at a time
PAIRS_A_TASK = 8  # block pairs a task takes on average


def latest_prices(prices: DataFrame) -> DataFrame:
    """One exchange: every map task sends one row per asset."""
    ticks = clean_ticks(prices)
    return ticks.groupBy("asset_id").agg(last_price(ticks).alias("price"), F.max("ts").alias("ts"))


def daily_closes(prices: DataFrame) -> DataFrame:
    """Last price per asset and UTC day; at most one row per day, whatever the tick rate."""
    ticks = clean_ticks(prices)
    return ticks.groupBy("asset_id", F.floor(F.col("ts") / DAY).alias("day")).agg(last_price(ticks).alias("close"))


def market_overround(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per market with at least two priced tokens: market_id, priced, overround. Linear in the tokens."""
    return (
        tokens.select("market_id", "asset_id")
        .join(latest_prices(prices).select("asset_id", "price"), "asset_id")
        .groupBy("market_id")
        .agg(F.count(F.lit(1)).alias("priced"), (F.sum("price") - 1.0).alias("overround"))
        .where("priced >= 2")
    )


def overround_pairs(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """The overround of a market on each unordered pair of its priced tokens; the pairs are the result itself.

    Where a pair sits in several markets, the last market's value is kept.
    """
    legs = tokens.select("market_id", "asset_id").distinct().join(latest_prices(prices).select("asset_id"), "asset_id")
    overround = market_overround(tokens, prices)
    a = legs.join(overround, "market_id").select("market_id", "overround", F.col("asset_id").alias("asset_id_a"))
    b = legs.select("market_id", F.col("asset_id").alias("asset_id_b"))
    pairs = a.join(b, "market_id").where("asset_id_a < asset_id_b")
    return keep_last(pairs, ["asset_id_a", "asset_id_b"], ["market_id"]).select(
        "asset_id_a",
        "asset_id_b",
        F.lit("intra_event").alias("relationship_type"),
        F.lit(None).cast("double").alias("correlation"),
        "overround",
        F.lit(None).cast("bigint").alias("overlap_days"),
    )


def _block_correlations(threshold: float, min_overlap: int):
    """Both sides of a block pair as value and mask matrices; all pair sums are six matrix products, taken in strips of rows."""

    def side(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        days, closes = (rows[c].combine_chunks() for c in ("days", "closes"))
        at = np.repeat(np.arange(rows.num_rows), days.value_lengths().to_numpy(zero_copy_only=False))
        return rows["asset_id"].combine_chunks(), at, days.flatten().to_numpy(), closes.flatten().to_numpy()

    def matrix(series: tuple, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, at, day, close = series
        value = np.zeros((len(ids), len(days)))
        mask = np.zeros_like(value)
        col = np.searchsorted(days, day)
        value[at, col] = close
        mask[at, col] = 1.0
        # A shift per asset leaves correlations alone and makes constant series exactly zero.
        first = value[np.arange(len(ids)), mask.argmax(axis=1)]
        return (value - first[:, None]) * mask, mask

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, tag = pa.Table.from_batches(list(batches)), key[0].as_py()
        left, right = rows.filter(pc.equal(rows["side"], 0)), rows.filter(pc.equal(rows["side"], 1))
        same = key[1].as_py() == key[2].as_py()  # a block against itself
        if same:
            right = left
        if not left.num_rows or not right.num_rows:
            return
        a, b = side(left), side(right)
        days = np.unique(np.concatenate([a[2], b[2]]))
        (x, mx), (y, my) = matrix(a, days), matrix(b, days)
        shared = [t["tags"].to_pylist() for t in (left, right)]
        several = [np.array([t is not None for t in ts]) for ts in shared]
        ids = pa.concat_arrays([a[0], b[0]])
        rank = np.unique(ids.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        yy = y * y
        for at in range(0, len(x), STRIP):
            xs, ms = x[at : at + STRIP], mx[at : at + STRIP]
            n, sx, sy = ms @ my.T, xs @ my.T, ms @ y.T
            sxx, syy, sxy = (xs * xs) @ my.T, ms @ yy.T, xs @ y.T
            enough = n >= min_overlap
            if same:
                enough &= np.arange(len(y)) > np.arange(at, at + len(xs))[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                vx, vy = sxx - sx * sx / n, syy - sy * sy / n
                flat = (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy)
                r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
                good = enough & ~flat & np.isfinite(r) & (np.abs(r) >= threshold)
            i, j = np.nonzero(good)
            value, overlap, i = r[i, j], n[i, j].astype("int64"), i + at
            # A pair that meets under several tags is given by the smallest of them.
            twice = np.nonzero(several[0][i] & several[1][j])[0]
            drop = [k for k in twice if min(set(shared[0][i[k]]) & set(shared[1][j[k]])) != tag]
            if drop:
                i, j, value, overlap = (np.delete(c, drop) for c in (i, j, value, overlap))
            j = j + len(x)
            swap = rank[i] > rank[j]
            lo, hi = np.where(swap, j, i), np.where(swap, i, j)
            for k in range(0, len(lo), ROWS):
                cut = slice(k, k + ROWS)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(lo[cut])), ids.take(pa.array(hi[cut])), pa.array(value[cut]), pa.array(overlap[cut])],
                    ["asset_id_a", "asset_id_b", "correlation", "overlap_days"],
                )

    return pairs


def correlated_pairs(
    closes: DataFrame, tags: DataFrame, *, threshold: float = 0.5, min_overlap: int = 30, block: int = BLOCK
) -> DataFrame:
    """Correlation of daily closes between anchors of one tag; closes: asset_id, day, close; tags: asset_id, primary_tag.

    The exact matrix is computed in blocks of about ``block`` x ``block`` assets, fewer where series are long. A series is sent once
    per block pair, not once per partner, so a tag that holds a third of all assets becomes many equal tasks. Pairs past the
    threshold leave a task strip by strip and are never shuffled or gathered, so a task's memory depends neither on the number of
    assets nor on that of the pairs found.
    """
    # One row per asset; a series has at most one point per day.
    series = (
        closes.groupBy("asset_id")
        .agg(F.sort_array(F.collect_list(F.struct("day", "close"))).alias("_s"))
        .where(F.size("_s") >= min_overlap)
        .select("asset_id", F.col("_s.day").alias("days"), F.col("_s.close").alias("closes"))
    )
    # An anchor of several markets may meet a partner under several tags; it carries them all, most carry none.
    tagged = tags.groupBy("asset_id").agg(F.sort_array(F.collect_set("primary_tag")).alias("_tags"))
    members = stored(
        tagged.join(series, "asset_id").select(
            "asset_id", F.when(F.size("_tags") > 1, F.col("_tags")).alias("tags"), F.explode("_tags").alias("primary_tag"), "days", "closes"
        )
    )
    width = members.select("primary_tag", F.explode("days").alias("day")).distinct().groupBy("primary_tag").agg(F.count(F.lit(1)).alias("width"))
    blocks = F.ceil(F.col("assets") * F.greatest(F.lit(1 / block), F.col("width") / CELLS)).cast("int")
    sizes = members.groupBy("primary_tag").agg(F.count(F.lit(1)).alias("assets")).join(width, "primary_tag").select(
        "primary_tag", blocks.alias("blocks"))
    tasks = sizes.agg(F.sum(F.col("blocks").cast("bigint") * (F.col("blocks") + 1) / 2)).head()[0] or 1
    # Blocks are hashed, so their sizes are equal up to chance.
    placed = members.join(sizes, "primary_tag").withColumn("mine", F.pmod(F.xxhash64("asset_id"), F.col("blocks")).cast("int"))
    sent = (
        placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "primary_tag",
            "asset_id",
            "tags",
            F.least("mine", "other").alias("bi"),
            F.greatest("mine", "other").alias("bj"),
            (F.col("mine") > F.col("other")).cast("int").alias("side"),
            "days",
            "closes",
        )
    )
    # Some block pairs a task, however many there are.
    dealt = sent.repartition(max(1, -int(-tasks // PAIRS_A_TASK)), "primary_tag", "bi", "bj")
    found = dealt.groupBy("primary_tag", "bi", "bj").applyInArrow(
        _block_correlations(threshold, min_overlap),
        "asset_id_a string, asset_id_b string, correlation double, overlap_days bigint",
    )
    return found.select(
        "asset_id_a",
        "asset_id_b",
        F.lit("cross_event").alias("relationship_type"),
        "correlation",
        F.lit(None).cast("double").alias("overround"),
        "overlap_days",
    )


def market_relationships(
    events: DataFrame,
    markets: DataFrame,
    tokens: DataFrame,
    prices: DataFrame,
    *,
    threshold: float = 0.5,
    min_overlap: int = 30,
    seq: str = "seq",
) -> DataFrame:
    tags = anchor_tokens(tokens, seq).join(market_tags(markets, events, tag_from_pattern), "market_id", "left").select(
        "asset_id", F.coalesce("primary_tag", F.lit("unknown")).alias("primary_tag")
    )
    return overround_pairs(tokens, prices).unionByName(
        correlated_pairs(daily_closes(prices), tags, threshold=threshold, min_overlap=min_overlap)
    )
