"""Exact quantiles of a whole column by narrowing histograms.

No row is sorted or moved. The first pass counts values in bins of the logarithm, which suit any spread; each further pass
cuts the bins that hold a wanted rank into equal steps between their own least and greatest value, until a bin holds one
value. A pass returns at most a fixed number of bins, each with its count, least and greatest value, so neither a task nor
the driver holds anything that grows with the data. Every cut is a function that never decreases, so ranks add up exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

STEPS = 4096  # bins a bin is cut into
PER_E = 20  # bins of the first pass per factor of e
TOP = 1 << 20  # bins of infinite values and of NaN, which sorts above all


def _log_bin(v: Column) -> Column:
    """Bin of a double: by sign, then by the logarithm of its size; every step of it never decreases with the value."""
    size = F.floor(F.log(F.abs(v)) * PER_E) + 16_000  # from 1,100 for the least double up to 31,000
    finite = F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))
    return F.when(F.isnan(v), TOP + 1).when(v == float("inf"), TOP).when(v == float("-inf"), -TOP).otherwise(finite)


def global_quantiles(df: DataFrame, value: str, wanted: Mapping[str, float]) -> dict[str, float | None]:
    """The wanted quantiles, interpolated between neighbouring ranks; nulls are ignored, None where there is no value."""
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    stats = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    bins = [(r.n, r.lo, r.hi) for r in rows.groupBy(_log_bin(F.col("v")).alias("b")).agg(*stats).orderBy("b").collect()]
    total = sum(n for n, _, _ in bins)
    if not total:
        return dict.fromkeys(wanted)
    places = {name: q * (total - 1) for name, q in wanted.items()}
    ranks = {r for p in places.values() for r in (math.floor(p), math.ceil(p))}
    found: dict[int, float] = {}
    open_ = [(0, bins)]  # for each bin that was cut: how many values lie below it, and its parts
    while open_:
        narrower: dict[tuple[float, float], int] = {}
        for start, parts in open_:
            for n, lo, hi in parts:
                for r in [r for r in ranks if start <= r < start + n]:
                    if lo == hi or math.isnan(lo):
                        found[r] = lo
                    else:
                        narrower[lo, hi] = start
                start += n
        if not narrower:
            break
        v, which, step = F.col("v"), F.lit(None).cast("int"), F.lit(None).cast("bigint")
        cuts = list(narrower)
        for k, (lo, hi) in enumerate(cuts):
            inside = v.between(lo, hi)
            # Halves keep the width of the widest bin finite; least and greatest value have steps of their own, so every pass narrows.
            width = hi / 2 - lo / 2
            part = F.floor((v / 2 - lo / 2) / width * STEPS) if width else F.lit(0)
            which, step = F.when(inside, k).otherwise(which), F.when(inside, F.when(v == hi, STEPS + 1).when(v == lo, -1).otherwise(part)).otherwise(step)
        got = rows.select("v", which.alias("k"), step.alias("b")).where("k is not null").groupBy("k", "b").agg(*stats).orderBy("k", "b").collect()
        open_ = [(narrower[cut], [(r.n, r.lo, r.hi) for r in got if r.k == k]) for k, cut in enumerate(cuts)]
    out = {}
    for name, p in places.items():
        a, b = found[math.floor(p)], found[math.ceil(p)]
        out[name] = a if a == b else a + (b - a) * (p - math.floor(p))
    return out
