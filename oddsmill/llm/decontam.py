"""Benchmark decontamination by spaced seeds.

A mask keeps some word positions of a span and ignores the others, so a hash of the kept words survives substitutions at
the ignored ones. Every position of the benchmark and of the documents is hashed under masks of which at least one fits
inside a window whatever words of it are substituted; equal hashes give a diagonal (position in the document minus position
in the item). Around each hit the aligned words are compared one by one: a window of ``window`` words with at most
``tolerance`` substitutions is contamination.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.llm.common import checkpointed, words

# One of the two fits somewhere in 13 words for each of the 78 places of two substitutions. First and last are kept.
MASKS = ("11101011", "110100111")
WINDOW = 13
TOLERANCE = 2
BROADCAST_ROWS = 1_000_000  # rows of hashes or keys, about 40 bytes each, up to which a side is broadcast


def masks_of(n: int, allowed: int) -> tuple[str, ...]:
    """Masks of which one fits inside n words wherever ``allowed`` of them are substituted."""
    if (n, allowed) == (WINDOW, TOLERANCE):
        return MASKS
    # Substitutions meet at most ``allowed`` of the residue classes, and every such choice of classes is ignored by a mask.
    classes = allowed + 2
    ignoring = ("".join("0" if i % classes in out else "1" for i in range(n)).strip("0") for out in combinations(range(classes), allowed))
    return tuple(sorted(set(ignoring) - {""}))


def _seeds(w: Column, masks: tuple[str, ...]) -> Column:
    """struct(p, h) of every position and mask: hashes of the kept words."""

    def under(mask: str) -> Column:
        def at(i: Column) -> Column:
            kept = [F.get(w, i + o) for o, c in enumerate(mask) if c == "1"]
            return F.struct(i.alias("p"), F.xxhash64(F.lit(int(mask, 2)), *kept).alias("h"))

        found = F.transform(F.sequence(F.lit(0), F.size(w) - len(mask)), at)
        return F.when(F.size(w) >= len(mask), found).otherwise(F.array().cast("array<struct<p:int,h:bigint>>"))

    return F.concat(*[under(m) for m in masks])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, tolerance: int = TOLERANCE) -> DataFrame:
    """(text_key, n_items, item_id, overlap) of every distinct document text that overlaps an item.

    n_items counts distinct item texts, item_id is the smallest id of one of them, overlap the most words that agree in a
    window. An item shorter than a window is compared whole, with tolerance in proportion (none under seven words). Null,
    empty and wordless texts and items match nothing; copies of a text share its row; without rows the result is empty.
    """
    keyed = docs.select(text_key(F.col("text")).alias("text_key"), F.lower("text").alias("_t"))
    items = (
        benchmark.select("item_id", words(F.lower("text")).alias("_iw"))
        .where(F.size("_iw") > 0)
        .groupBy("_iw").agg(F.min("item_id").alias("item_id"))
        .withColumn("_ik", F.xxhash64("_iw"))
    )
    items = checkpointed(items)
    size = F.least(F.lit(window), F.size("_iw"))
    families = {r.n: masks_of(r.n, r.n * tolerance // window) for r in items.select(size.alias("n")).distinct().collect()}
    masks = tuple(sorted({m for family in families.values() for m in family})) or MASKS
    own = reduce(lambda c, n: c.when(size == n, _seeds(F.col("_iw"), families[n])), families, F) if families else _seeds(F.col("_iw"), masks)
    item_seeds = items.select("_ik", F.inline(own).alias("_j", "_h"))
    small = item_seeds.count() <= BROADCAST_ROWS
    doc_seeds = keyed.select("text_key", words(F.col("_t")).alias("_w")).select(
        "text_key", F.inline(_seeds(F.col("_w"), masks)).alias("_p", "_h"))
    hits = (
        doc_seeds.join(F.broadcast(item_seeds) if small else item_seeds, "_h")
        .select("text_key", "_ik", (F.col("_p") - F.col("_j")).alias("_d"))
        .distinct()
    )
    hits = checkpointed(hits)
    # Words only of texts with a hit; copies of a text meet in one row.
    hit_keys = checkpointed(hits.select("text_key").distinct())
    few = hit_keys.count() <= BROADCAST_ROWS
    hit_words = (
        keyed.join(F.broadcast(hit_keys) if few else hit_keys, "text_key", "left_semi")
        .groupBy("text_key").agg(F.first("_t").alias("_t"))
        .select("text_key", words(F.col("_t")).alias("_w"))
    )
    aligned = hits.join(hit_words, "text_key").join(items, "_ik")
    iw, w, d = F.col("_iw"), F.col("_w"), F.col("_d")
    same = F.transform(iw, lambda x, j: F.coalesce((x == F.get(w, F.when(j + d >= 0, j + d))).cast("int"), F.lit(0)))
    length = F.least(F.lit(window), F.size(iw))
    checked = aligned.select("text_key", "_ik", "item_id", same.alias("_m"), length.alias("_n"))
    m, n = F.col("_m"), F.col("_n")
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size(m) - n), lambda s: F.aggregate(F.slice(m, s + 1, n), F.lit(0), lambda a, x: a + x)))
    return (
        checked.select("text_key", "_ik", "item_id", best.alias("_best"), (n - F.floor(n * tolerance / window)).alias("_need"))
        .where("_best >= _need")
        .groupBy("text_key", "_ik").agg(F.min("item_id").alias("item_id"), F.max("_best").alias("_best"))
        .groupBy("text_key")
        .agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("item_id"), F.max("_best").cast("bigint").alias("overlap"))
    )


def text_key(text: Column) -> Column:
    """Key of a text: 64 bits of its bytes. Two texts share one by chance in about one of 10^19 pairs."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without overlap, all columns as they were."""
    found = contaminated(docs, benchmark).select(F.col("text_key").alias("_found"))
    return docs.join(found, text_key(docs["text"]) == F.col("_found"), "left_anti")
