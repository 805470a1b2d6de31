"""Registration of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from oddsmill.session import tune
from oddsmill.sources.adapters import Canon

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Means and ratios of prices often lie on a rounding tie, where the order of summation would decide the digit.
NUDGE = 1.000000000001


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, ties away from zero, -0.0 as 0.0, so that results compare across engines."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`") * NUDGE, 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Canon], DataFrame]):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return rounded(build(Canon(tune(spark), path)))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register
