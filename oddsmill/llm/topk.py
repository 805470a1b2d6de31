"""Exact top-k inner products by aggregating sorted lists without random access.

Each dimension is a list of the candidates sorted by their component. Lists are read from the end that favours the query,
a share of their length at a time. A component that has been read counts exactly; one that has not lies between the last
value read and the far end of its list. These give every candidate a lower and an upper bound. Candidates whose upper bound
is below the k-th lower bound are out; when few are left their scores are completed from the rest of the lists.
Candidates are worked on in blocks, so queries meet each block once and only k rows per query leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.llm.common import checkpointed
from oddsmill.plans.keep import top_per_group

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 8192
DEPTHS = (0.7, 0.9, 1.0)  # shares of the lists that have been read after each step
FEW = 1 / 32  # share of the pairs still open that is finished pair by pair


def integers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) per component as longs; null for vectors that are null or hold null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def block_top(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) rows of at least the k best candidates of each query, ties at the k-th score included.

    ``own`` marks pairs that may not match. Scores are integers and exact: products are summed in the smallest float type
    that holds them all, in int64 beyond that.
    """
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    q, c = queries.astype(kind), candidates.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    lists = np.sort(c, axis=0)
    n = len(c)
    low_end, high_end = lists[0], lists[-1]
    k = min(k, n)
    for depth in DEPTHS:
        reach = min(n, math.ceil(depth * n)) - 1
        top, bottom = lists[n - 1 - reach], lists[reach]
        if reach == n - 1:
            lower = upper = q @ c.T
        else:
            # Read from above for positive weights, from below for negative ones.
            seen_up, seen_down = c >= top, c <= bottom
            upper = up @ np.where(seen_up, c, top).T + down @ np.where(seen_down, c, bottom).T
            lower = up @ np.where(seen_up, c, low_end).T + down @ np.where(seen_down, c, high_end).T
        least = np.iinfo(np.int64).min // 2 if kind is np.int64 else -np.inf
        lower = np.where(own, least, lower)
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        open_ = (upper >= kth[:, None]) & ~own
        if reach == n - 1 or open_.mean() <= FEW:
            break
    i, j = np.nonzero(open_)
    score = upper[i, j] if reach == n - 1 else np.einsum("ij,ij->i", q[i], c[j])
    return i, j, score.astype(np.int64)


def _best(i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, ties to smaller ids."""
    order = np.lexsort((ids[j], -score, i))
    query = i[order]
    start = np.searchsorted(query, query, side="left")
    return order[np.arange(len(order)) - start < k]


def _matrix(blob: list[int], dims: int) -> np.ndarray:
    return np.asarray(blob, np.int64).reshape(-1, dims)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with every other row.

    Components become floor(64 * x). Vectors that are null or hold null or non-finite components take no part; shorter
    vectors count as filled with zeros. Ties go to the smaller id. A row never matches its own id; repeated ids are rows of
    their own on both sides. Rows with a null id take no part. Without queries or candidates the result is empty.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), integers(F.col(embedding)).alias("v"), is_query.alias("q"))
    rows = checkpointed(rows.where("id is not null and v is not null"))
    schema = "query_id long, vec_id long, score long"
    seen = rows.agg(F.max(F.size("v")), F.count(F.when(F.col("q"), 1)), F.count(F.lit(1))).first()
    dims, n_queries, n_rows = seen[0] or 0, seen[1], seen[2]
    if not dims or not n_queries:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(1), batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            out = np.zeros((len(sizes), dims), np.int64)
            out[np.arange(dims) < sizes[:, None]] = flat
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(0, 1), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([out.ravel()], pa.list_(pa.int64()))],
                ["block", "ids", "flat"])

    def blocks(df: DataFrame, n: int, size: int) -> DataFrame:
        count = max(1, math.ceil(n / size))
        dealt = df.select(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("block"), "id", "v")
        return dealt.groupBy("block").applyInArrow(
            lambda t: pa.Table.from_batches(list(blocked(iter(t.combine_chunks().to_batches())))), "block int, ids array<bigint>, flat array<bigint>")

    asked = blocks(rows.where("q"), n_queries, QUERY_BLOCK).select(F.col("block").alias("qb"), F.col("ids").alias("qi"), F.col("flat").alias("qf"))
    n_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    # Every block of candidates meets every block of the stated queries.
    there = blocks(rows, n_rows, CANDIDATE_BLOCK).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = there.join(asked, "qb").select("qi", "qf", "ids", "flat").repartition(F.xxhash64(F.element_at("qi", 1), F.element_at("ids", 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qf, ci, cf in zip(*batch.columns):
                query_ids, ids = qi.values.to_numpy(), ci.values.to_numpy()
                q, c = qf.values.to_numpy().reshape(-1, dims), cf.values.to_numpy().reshape(-1, dims)
                i, j, score = block_top(q, c, query_ids[:, None] == ids[None, :], k)
                at = _best(i, j, score, ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[i[at]]), pa.array(ids[j[at]]), pa.array(score[at])], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, schema)
    return top_per_group(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
