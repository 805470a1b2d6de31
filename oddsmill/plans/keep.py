"""Keep-first and keep-last per key.

``row_number() = 1`` is planned with a partial group limit in every map task, so at most one row per key and map
task is shuffled and a key that holds a large share of the rows does not pile up in one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc() for c in seq])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group (n is small: a report or a sample), limited in the map tasks as above."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)
