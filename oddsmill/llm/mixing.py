"""Mixing sources to target weights: every source is cut at its exact budget of words.

Documents get a hash-random key. Inside a source they are ranged by that key, prefix sums of their sizes run over the
ranges first and inside each range after, and the order is cut where the budget ends. A budget above the source's size
repeats whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from oddsmill.llm.common import WORD, checkpointed, n_words

RANGES = 4096  # hex digits of the key that form a range: 16 ** 3


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds target to (source, source_size).

    Sources by code point, null last, weigh ``weights``, repeating, and share the sum of all sizes. A target stops at
    ``cap`` times its source's size; the excess goes to the others by weight. In closed form: in ascending order of
    cap / weight the first sources take their caps as long as what is left would give them more.
    The rows are one per source, so a window over all of them is small.
    """
    everything, in_order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    shared = weighed.withColumn("_rate", left / weight).withColumn("_full", F.col("_cap") <= F.col("_rate") * F.col("_w"))
    # The rate of the first source that is not full holds for all that follow it.
    rate = F.first(F.when(~F.col("_full"), F.col("_rate")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return shared.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(rate * F.col("_w"))).drop(
        "_w", "_cap", "_rate", "_full")


def mix(
    docs: DataFrame,
    key: Column,
    size: Column | None = None,
    source: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """(keep..., source, size, source_size, target, taken): how many words of each document the mix takes.

    ``key`` is a hex text that orders the documents of a source at random; rows with equal keys follow by size, and rows
    equal in key and size change places without effect on the sums. Each source's taken words are its target rounded
    to whole words; the last document of a pass may be taken in part. Null and empty texts have size 0 and are taken 0
    times. Without rows the result is empty.
    """
    sized = checkpointed(docs.select(
        *keep, F.col(source).alias("source"), (n_words(F.col("text")) if size is None else size).alias("size"), key.alias("_key")
    ).withColumn("_range", F.substring("_key", 1, 3)))
    parts = sized.groupBy("source", "_range").agg(F.sum("size").alias("_part"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("_part").over(earlier), F.lit(0)))
    budgets = targets(parts.groupBy("source").agg(F.sum("_part").alias("source_size")), weights, cap)
    planned = offsets.join(budgets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_part")
    planned = planned.withColumnRenamed("source", "_s").withColumnRenamed("_range", "_r")
    rows = sized.join(planned, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    return (
        rows.withColumn("_start", start)
        .withColumn("_whole", whole)
        .withColumn("_rest", budget - F.col("_whole") * F.col("source_size"))
        .withColumn("taken", F.col("_whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start"))))
        .select(*keep, "source", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))
    )


def random_key(*values: Column, seed: int = 8) -> Column:
    """Hex text, evenly spread and the same in every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("")) for v in values]).cast("binary"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, spaces as they are."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")
