"""Exact quantiles of groups that may hold any share of the rows.

``percentile`` keeps every distinct value of a group in one task. It is used in this package only where the number of
distinct values is bounded (counts, slots of a grid). Everywhere else a mergeable sketch first brackets each wanted rank;
each bracket is widened to the next value on both sides; rows outside the brackets are only counted, in the map tasks; the
few values inside them are sorted. Groups of every size take this path. The answer is exact: the sketch decides what is
sorted, never what is returned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

ACCURACY = 50_000  # rank error of the sketch is at most rows / ACCURACY
MARGIN = 5.0 / ACCURACY  # brackets are five times as wide: about 0.02 % of a group's rows per quantile


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """One row per group with a column per wanted quantile, e.g. ``{"median": 0.5}``; nulls are ignored.

    Quantiles interpolate linearly between the two neighbouring ranks.
    """
    keys = [*group, "_g"]
    rows = df.where(F.col(value).isNotNull()).select(*group, F.lit(0).alias("_g"), F.col(value).cast("double").alias("_v"))
    low = [max(0.0, q - MARGIN) for q in wanted.values()]
    high = [min(1.0, q + MARGIN) for q in wanted.values()]
    cuts = F.percentile_approx("_v", F.array(*[F.lit(x) for x in (*low, *high)]), ACCURACY)
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), cuts.alias("_cuts"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    k, v = len(wanted), F.col("_v")
    # A rank that falls between two values needs the one before or after what the sketch names; NaN sorts above all.
    found = rows.alias("l").join(sketch.alias("r"), same).select("l.*", "r._n", "r._cuts")
    beside = found.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[F.coalesce(F.max(F.when(v < F.col("_cuts")[i], v)), F.min(F.col("_cuts")[i])).alias(f"_lo{i}") for i in range(k)],
        *[F.coalesce(F.min(F.when(v > F.col("_cuts")[k + i], v)), F.max(F.col("_cuts")[k + i])).alias(f"_hi{i}") for i in range(k)])
    lo, hi = [F.col(f"_lo{i}") for i in range(k)], [F.col(f"_hi{i}") for i in range(k)]
    inside = F.lit(False)
    following = [F.lit(None).cast("double"), F.lit(None).cast("double")]
    for a, b in zip(lo, hi):
        inside = inside | ((v >= a) & (v <= b))
        following.append(F.when(v < a, a))
    # A value between brackets counts towards the start of the next one; values above all of them do not matter.
    placed = (
        rows.alias("l").join(beside.alias("r"), same)
        .select("l.*", "r._n", *[f"r.{c}{i}" for i in range(k) for c in ("_lo", "_hi")])
        .select(*keys, "_n", F.when(inside, v).otherwise(F.least(*following)).alias("_at"), (~inside).alias("_gap"))
        .where("_at is not null")
        .groupBy(*keys, "_at", "_gap")
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    )
    before = Window.partitionBy(*keys).orderBy(F.col("_at"), F.col("_gap").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    outs = []
    for name, q in wanted.items():
        position = F.lit(float(q)) * (F.col("_n") - 1)

        def at(rank):
            hit = ~F.col("_gap") & (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_c"))
            # The brackets hold every wanted rank; a miss would be an error of this module and never a null.
            return F.coalesce(F.max(F.when(hit, F.col("_at"))), F.raise_error(F.lit("quantile outside its bracket")).cast("double"))

        a, b = at(F.floor(position)), at(F.ceil(position))
        outs.append((a + (b - a) * F.max(position - F.floor(position))).alias(name))
    return ranked.groupBy(*keys).agg(*outs).drop("_g")
