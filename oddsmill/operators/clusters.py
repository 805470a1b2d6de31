"""Clustering of feature vectors and the shapes of cluster curves."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from oddsmill.plans.quantiles import exact_quantiles
from oddsmill.session import stored
from oddsmill.schemas import FEATURE_COLUMNS


def cluster_input(targets: DataFrame, features: DataFrame, tags: DataFrame, quality: DataFrame, minimum: int = 3) -> DataFrame:
    """Target assets with features and tag; only those passing quality if there are at least ``minimum`` of them."""
    rows = (
        targets.select("asset_id", "market_id").distinct()
        .join(features, "asset_id")
        .join(tags, "market_id", "left")
        .withColumn("primary_tag", F.coalesce("primary_tag", F.lit("unknown")))
        .join(quality.select("asset_id", "quality_pass").distinct(), "asset_id", "left")
        .withColumn("quality_pass", F.coalesce("quality_pass", F.lit(False)))
    )
    enough = rows.agg((F.count_if("quality_pass") >= minimum).alias("_enough"))  # one row
    return rows.join(F.broadcast(enough), F.col("quality_pass") | ~F.col("_enough")).drop("_enough", "quality_pass")


def standardise(rows: DataFrame, columns: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Null to 0, then zero mean and unit population deviation; a constant column becomes 0."""
    filled = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    moments = filled.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )  # one row
    scaled = filled.join(F.broadcast(moments))
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return scaled.select(*[z[c].alias(c) if c in z else F.col(c) for c in rows.columns])


def vectors(rows: DataFrame, columns: list[str] = FEATURE_COLUMNS, out: str = "vector") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(rows)


def fit_kmeans(rows: DataFrame, k: int = 8, seed: int = 42, restarts: int = 10, vector: str = "vector") -> KMeansModel | None:
    """Best of several k-means runs by training cost; None below three rows (every row is its own cluster then).

    The vectors are cached, one row per asset, since every restart passes over them.
    """
    rows = rows.select(vector).persist()
    try:
        n = rows.count()
        if n < 3:
            return None
        size = min(max(2, k), n - 1)
        best = None
        for i in range(restarts):
            model = KMeans(k=size, seed=seed + i, featuresCol=vector, predictionCol="cluster_id", initSteps=2).fit(rows)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
        return best
    finally:
        rows.unpersist()


def assign(rows: DataFrame, model: KMeansModel | None, vector: str = "vector") -> DataFrame:
    if model is None:
        # At most two rows.
        return rows.withColumn("cluster_id", F.row_number().over(Window.orderBy("asset_id")) - 1)
    return model.transform(rows)


def squared_silhouette(assigned: DataFrame, vector: str = "vector") -> float:
    """Silhouette on squared Euclidean distance, computed from cluster sums in one pass (not pair by pair)."""
    return ClusteringEvaluator(featuresCol=vector, predictionCol="cluster_id", distanceMeasure="squaredEuclidean").evaluate(assigned)


def assignment_check(assigned: DataFrame, model: KMeansModel, label: Column, vector: str = "vector") -> DataFrame:
    """What holds for any good clustering, whatever its labels; one row.

    rows, clusters (non-empty), nearest: every row is in the cluster of its nearest centre; no_worse: its cost does not exceed
    that of the given ``label`` grouping; silhouette_in_range. The centres are few and go into the plan as literals.
    """
    x = vector_to_array(vector)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in centre]) for centre in model.clusterCenters()])
    apart = F.transform(centres, lambda c: F.aggregate(F.zip_with(F.col("_x"), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    rows = assigned.select("cluster_id", label.alias("_label"), x.alias("_x")).withColumn("_apart", apart)
    own = F.element_at("_apart", F.col("cluster_id") + 1)
    fitted = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("cluster_id").alias("clusters"),
        F.every(own <= F.array_min("_apart") + 1e-9).alias("nearest"),
        F.sum(own).alias("_cost"),
    )
    # Squared distances to the means of the labels, from sums per label and dimension.
    parts = rows.select("_label", F.posexplode("_x").alias("_dim", "v")).groupBy("_label", "_dim").agg(F.var_pop("v").alias("_var"), F.count("v").alias("_n"))
    given = parts.agg(F.sum(F.col("_var") * F.col("_n")).alias("_given"))
    score = squared_silhouette(assigned, vector)
    return fitted.join(F.broadcast(given)).select(  # one row each
        "rows", "clusters", "nearest", (F.col("_cost") <= F.col("_given") * (1 + 1e-9)).alias("no_worse"),
        F.lit(-1.0 <= score <= 1.0).alias("silhouette_in_range"),
    )


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def cluster_tags(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id", "primary_tag").agg(F.count(F.lit(1)).alias("count"))


def curve_bands(curves: DataFrame, clusters: DataFrame) -> DataFrame:
    """Median and quartiles of the member curves per cluster and relative index; empty indexes are left out."""
    rows = curves.join(clusters.select("asset_id", "cluster_id"), "asset_id").where("price is not null")
    bands = exact_quantiles(stored(rows.select("cluster_id", "idx", "price")), ["cluster_id", "idx"], "price", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # Indexes with values are numbered on; a curve has a bounded number of slots.
    return bands.withColumn("pos", F.row_number().over(Window.partitionBy("cluster_id").orderBy("idx")) - 1)


def describe_curves(bands: DataFrame) -> DataFrame:
    """A shape word per cluster from its median curve."""
    whole = Window.partitionBy("cluster_id")
    rows = bands.withColumn("_top", F.max("median").over(whole))
    stats = rows.groupBy("cluster_id").agg(
        F.max("median").alias("hi"),
        F.min("median").alias("lo"),
        F.count("median").alias("n"),
        F.min(F.when(F.col("median") == F.col("_top"), F.col("pos"))).alias("peak"),
        F.min_by("median", "pos").alias("first"),
        F.max_by("median", "pos").alias("last"),
        F.coalesce(F.regr_slope("median", F.col("pos").cast("double")), F.lit(0.0)).alias("slope"),
    )
    peak = F.col("peak") / F.greatest(F.lit(1), F.col("n") - 1)
    change = F.col("last") - F.col("first")
    shape = (
        F.when(F.col("n") == 0, "no data")
        .when((peak < 0.35) & (F.col("hi") - F.col("last") > 0.05), "early pump then fade")
        .when((change > 0.05) & (F.col("slope") > 0), "monotonic drift up")
        .when((change < -0.05) & (F.col("slope") < 0), "monotonic drift down")
        .when(F.col("hi") - F.col("lo") < 0.05, "mostly flat")
        .otherwise("range-bound and choppy")
    )
    return stats.select("cluster_id", shape.alias("description"))
