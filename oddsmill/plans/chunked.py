"""Ordered computations over groups of any size.

A window over a whole group would put a hot group in one task. Here the order is cut into chunks by an expression that
never decreases along it (an hour of a timestamp, a prefix of an id). Each chunk is summarised, prefix sums run over the
small summaries, and the exact result is put together inside the chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _same(a: str, b: str, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def _with_offset(df: DataFrame, group: Sequence[str], summary: Column) -> DataFrame:
    """Adds _offset: the sum of ``summary`` over the earlier chunks of the group; also _total over the group."""
    per_chunk = df.groupBy(*group, "_chunk").agg(summary.alias("_part"))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *group,
        "_chunk",
        F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_part").over(Window.partitionBy(*group)).alias("_total"),
    )
    joined = df.alias("d").join(offsets.alias("o"), _same("d", "o", [*group, "_chunk"]))
    return joined.select("d.*", "o._offset", "o._total")


def row_numbers(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], chunk: Column, name: str = "rn", total: str | None = None
) -> DataFrame:
    """1-based position in the group; ``order`` must refine ``chunk`` and be a total order."""
    parts = _with_offset(df.withColumn("_chunk", chunk), group, F.count(F.lit(1)))
    inside = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(*order))
    out = parts.withColumn(name, F.col("_offset") + inside)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_chunk", "_offset", "_total")


def running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], chunk: Column, value: str, name: str
) -> DataFrame:
    parts = _with_offset(df.withColumn("_chunk", chunk), group, F.sum(value))
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn(name, F.col("_offset") + F.sum(value).over(inside)).drop("_chunk", "_offset", "_total")
