"""Positions and running sums in an order over groups of any size.

Rows are range-partitioned on the group and the whole order, so the boundaries come from a sample of the full sort key: a
group, a time or a prefix that holds many rows is spread over as many ranges as its rows need. The sorted ranges are stored
once, with every row's place in its range; sums per range are small, and their prefix sums place each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from oddsmill.session import stored

PLACE = (1 << 33) - 1  # monotonically_increasing_id holds the range above these bits and the place in it below


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """``df`` sorted by group and order in stored ranges, with _range and _place; AQE joins small ranges unless ``ranges`` is given."""
    keys = [*[F.col(c) for c in group], *order]
    cut = df.repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys)
    kept = stored(cut.withColumn("_id", F.monotonically_increasing_id()))
    return kept.withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(PLACE)).drop("_id")


def _offsets(rows: DataFrame, group: Sequence[str], amount: Column) -> DataFrame:
    """Per group and range: _first (its first place there), _offset (the sum before the range) and _total (of the group)."""
    parts = rows.groupBy(*group, "_range").agg(F.min("_place").alias("_first"), amount.alias("_part"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        *[F.col(c).alias(f"_g_{c}") for c in group], F.col("_range").alias("_r"), "_first",
        F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_offset"), F.sum("_part").over(Window.partitionBy(*group)).alias("_total"))


def _placed(rows: DataFrame, group: Sequence[str], amount: Column) -> DataFrame:
    same = F.col("_range") == F.col("_r")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return rows.join(_offsets(rows, group, amount), same).drop("_r", *[f"_g_{c}" for c in group])


def row_numbers(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rn", total: str | None = None, ranges: int | None = None
) -> DataFrame:
    """1-based position in the group and, as ``total``, its rows; ``order`` must be total. No window runs over rows."""
    rows = _placed(ranged(df, group, order, ranges), group, F.count(F.lit(1)))
    rows = rows.withColumn(name, F.col("_offset") + F.col("_place") - F.col("_first") + 1)
    if total:
        rows = rows.withColumn(total, F.col("_total"))
    return rows.drop("_range", "_place", "_first", "_offset", "_total")


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Sum of ``value`` up to each row; the window inside a range is as small as a range."""
    rows = _placed(ranged(df, group, order, ranges), group, F.sum(value))
    inside = Window.partitionBy(*group, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.col("_offset") + F.sum(value).over(inside)).drop("_range", "_place", "_first", "_offset", "_total")
