"""Near-duplicates by 64-bit SimHash fingerprints and a self-join of their binary trie.

The trie's top is cut by Spark: pairs of nodes of equal depth are followed down two bits at a time, with the bits in which
their prefixes differ, and dropped when these exceed the budget. A pair whose nodes hold few enough fingerprints becomes one
row, and a task follows the rest of the two subtries in numpy. Nodes that stay large are followed deeper, so dense groups
split where their bits differ.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.llm.common import checkpointed, likely
from oddsmill.llm.components import components

NODE = 4096  # fingerprints of a node that one task takes at once
TEXTS = 8192  # the same for texts with sketches
FIRST = 8  # times as many while one forest is kept of a node pair: the larger the nodes, the fewer of them a text is sent to
STRIDE = 2  # bits by which the distributed part goes down
DIRECT = 64  # pairs of two nodes that are compared at once instead of going deeper
FRONTIER = 16_384  # node pairs followed at a time inside a task; each may become DIRECT pairs


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text whose A-Z become small; a shorter text is one shingle, none has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(width)])) if len(words) > width else [b" ".join(words)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), ">u8").astype(np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set where more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """64 bits as a long; 0 for null and for texts without words."""

    def of(texts: pa.Array) -> pa.Array:
        out = [fingerprint_of(shingle_hashes(t or b"", width)) for t in texts.cast(pa.large_binary()).to_pylist()]
        return pa.array(out, pa.int64())

    return F.arrow_udf(of, "bigint")(F.coalesce(text, F.lit("")))


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


@dataclass(frozen=True)
class Budget:
    """At most ``total`` differing bits in all and ``lead_total`` among the first ``lead`` bits."""

    total: int = 2
    lead: int = 64
    lead_total: int = 2

    def at(self, depth: int) -> int:
        return min(self.lead_total, self.total) if depth <= self.lead else self.total


def trie_pairs(x: np.ndarray, y: np.ndarray, same: bool, depth: int, budget: Budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted x and y within the budget; both share a prefix of ``depth`` bits each.

    Equal fingerprints are further apart in the trie by position only: their rows are halved until few enough are left. ``same`` says that x and y are one node: each pair then comes once. Node pairs wait on a stack in blocks, so memory is
    bounded by the block size times the depth, whatever the number of results.
    """
    if not len(x) or not len(y):
        return
    err = int(np.bitwise_count((x[0] ^ y[0]) >> np.uint64(64 - depth))) if depth else 0
    stack = [(depth, np.array([[0, len(x), 0, len(y), err]], np.int64))]
    while stack:
        d, nodes = stack.pop()
        if len(nodes) > FRONTIER:
            stack.append((d, nodes[FRONTIER:]))
            nodes = nodes[:FRONTIER]
        xl, xh, yl, yh, e = nodes.T
        p, q = xh - xl, yh - yl
        small = p * q <= DIRECT
        if small.any():
            a, b, n, m = xl[small], yl[small], p[small], q[small]
            count = n * m
            owner = np.repeat(np.arange(len(count)), count)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            i, j = a[owner] + k // m[owner], b[owner] + k % m[owner]
            bits = x[i] ^ y[j]
            ok = np.bitwise_count(bits) <= budget.total
            if budget.lead < 64:
                ok &= np.bitwise_count(bits >> np.uint64(64 - budget.lead)) <= budget.lead_total
            if same:
                ok &= (i < j)
            if ok.any():
                yield i[ok], j[ok]
        rest = ~small
        if not rest.any():
            continue
        xl, xh, yl, yh, e = nodes[rest].T
        if d < 64:
            bit = np.uint64(1 << (63 - d))
            keep = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - d)) - 1)) if d else np.uint64(0)
            xm = np.clip(np.searchsorted(x, (x[xl] & keep) | bit), xl, xh)
            ym = np.clip(np.searchsorted(y, (y[yl] & keep) | bit), yl, yh)
        else:
            xm, ym = (xl + xh) // 2, (yl + yh) // 2
        one = same & (xl == yl) & (xh == yh)
        off = e + int(d < 64)
        down = np.concatenate([
            np.stack([xl, xm, yl, ym, e], 1), np.stack([xm, xh, ym, yh, e], 1),
            np.stack([xl, xm, ym, yh, off], 1), np.stack([xm, xh, yl, ym, off], 1)[~one]])
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget.at(d + 1))]
        if len(down):
            stack.append((d + 1, down))


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the classes of i and j; labels are the smallest index of a class."""
    while True:
        a, b = label[i], label[j]
        if (apart := a != b).any():
            a, b = a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (up := label[label]).tolist() != label.tolist():
                label[:] = up
        else:
            return


def _forest(x: np.ndarray, y: np.ndarray, same: bool, depth: int, budget: Budget) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the links between x and y connect: one per fingerprint at most."""
    every = x if same else np.concatenate([x, y])
    shift = 0 if same else len(x)
    label = np.arange(len(every))
    for i, j in trie_pairs(x, y, same, depth, budget):
        merge(label, i, j + shift)
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def _spanning(edges: np.ndarray) -> np.ndarray:
    """Positions of the sorted edges (class, class, ...) that form a spanning forest, earlier edges first."""
    names, ends = np.unique(edges[:, :2], return_inverse=True)
    ends = ends.reshape(-1, 2)
    label, kept, open_ = np.arange(len(names)), [], np.arange(len(edges))
    while len(open_):
        # Of a block of the shortest edges left, one at a time; what they connect leaves the rest in one step.
        block, open_ = open_[:4096], open_[4096:]
        root = {}

        def top(k: int) -> int:
            while (up := root.get(k, k)) != k:
                root[k] = root.get(up, up)
                k = up
            return k

        a, b = label[ends[block, 0]].tolist(), label[ends[block, 1]].tolist()
        for e, u, v in zip(block.tolist(), a, b):
            u, v = top(u), top(v)
            if u != v:
                root[max(u, v)] = min(u, v)
                kept.append(e)
        if root:
            moved = np.arange(len(names))
            for k in root:
                moved[k] = top(k)
            label = moved[label]
        open_ = open_[label[ends[open_, 0]] != label[ends[open_, 1]]]
    return np.array(kept, np.int64)


def _candidates(fps: list[np.ndarray], names: list[np.ndarray], sketches: list[np.ndarray], known: list[np.ndarray],
                tried: np.ndarray, same: bool, depth: int, budget: Budget, forests: int) -> np.ndarray:
    """(text, text, matching sketch places): edge-disjoint spanning forests, most matches first, of all alike texts of two nodes.

    A list has one array per node, or one for both where they are the same. ``known`` is the class a text is already in, and
    ``tried`` are pairs (smaller text, larger text) that are not to come again. Pairs inside a class, or inside what matches of STRONG places have
    joined so far, are passed over before their sketches are looked at.
    """
    x, y = fps[0], fps[-1]
    shift = 0 if same else len(x)
    every, rows, of = (np.concatenate(part) for part in (names, sketches, known))
    classes_, at = np.unique(of, return_inverse=True)
    first = np.full(len(classes_), len(every))
    np.minimum.at(first, at, np.arange(len(every)))
    base = first[at]
    strong, pool, held = base.copy(), [], 0
    refused = {(int(a), int(b)) for a, b in tried}

    def reduced(edges: np.ndarray) -> np.ndarray:
        # Edges between known classes; the classes are the ends of the forests.
        # Ties go by the ends' names, so that a group met in several rotations gives the same forest.
        p, q = every[edges[:, 0]], every[edges[:, 1]]
        edges = edges[np.lexsort((np.maximum(p, q), np.minimum(p, q), -edges[:, 2]))]
        kept = []
        for _ in range(forests):
            if not len(edges):
                break
            ends = edges.copy()
            ends[:, 0], ends[:, 1] = base[edges[:, 0]], base[edges[:, 1]]
            spanning = _spanning(ends)
            kept.append(edges[spanning])
            edges = np.delete(edges, spanning, axis=0)
        return np.concatenate(kept) if kept else np.empty((0, 3), np.int64)

    for i, j in trie_pairs(x, y, same, depth, budget):
        j = j + shift
        for start in range(0, len(i), SLICE):
            u, v = i[start : start + SLICE], j[start : start + SLICE]
            apart = strong[u] != strong[v]
            u, v = u[apart], v[apart]
            if not len(u):
                continue
            differing = rows[u] ^ rows[v]
            matches = MINS - np.bitwise_count(differing[:, 0] | differing[:, 1]).astype(np.int64)
            good = matches >= FLOOR
            u, v, matches = u[good], v[good], matches[good]
            if refused and len(u):
                p, q = every[u], every[v]
                fresh = np.array([(a, b) not in refused for a, b in zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist())], bool)
                u, v, matches = u[fresh], v[fresh], matches[fresh]
            if not len(u):
                continue
            pool.append(np.stack([u, v, matches], 1).astype(np.int64))
            held += len(u)
            sure = matches >= STRONG
            if sure.any() and forests == 1:
                merge(strong, u[sure], v[sure])
            if held > 4 * len(every) * forests + SLICE:
                pool = [reduced(np.concatenate(pool))]
                held = len(pool[0])
    if not pool:
        return np.empty((0, 3), np.int64)
    edges = reduced(np.concatenate(pool))
    p, q = every[edges[:, 0]], every[edges[:, 1]]
    return np.stack([np.minimum(p, q), np.maximum(p, q), edges[:, 2]], 1)


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), 64 - depth) if depth else F.lit(0).cast("bigint")


def node_pairs(fps: DataFrame, budgets: Sequence[Budget], node: int = NODE) -> DataFrame | None:
    """Rows (depth, turn, x, y, same) of node pairs left to follow: x and y are the sorted rows of two nodes, at most ``node`` each.

    ``fps`` has ``fp``, ``turn`` and whatever else each row carries. Every turn is a trie of its own with the budget at that place; all go
    down together, so their number adds no steps. One fingerprint with more rows than a node takes is dealt into parts by the hash of
    ``name``, a column that then has to be there. None if there are no rows.
    """
    totals = fps.groupBy("turn").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per turn
    if not totals:
        return None
    carried = F.struct("fp", *[c for c in fps.columns if c not in ("fp", "turn")])
    spark, depth, fits = fps.sparkSession, 0, F.greatest("na", "nb") <= node
    open_ = spark.createDataFrame([(r.turn, 0, 0, r.n, r.n) for r in totals], "turn int, a long, b long, na long, nb long")
    some, more = any(r.n <= node for r in totals), any(r.n > node for r in totals)
    ready, depths, parted = [], [], None
    while True:
        if some:
            ready.append(open_.where(fits).select(F.lit(depth).alias("depth"), "turn", "a", "b"))
            depths.append(depth)
        if not more:
            break
        wide = open_.where(~fits).select("turn", "a", "b")
        if depth == 64:
            sizes = fps.groupBy("turn", F.col("fp").alias("p")).agg(F.count(F.lit(1)).alias("n"))
            large = checkpointed(sizes.select("turn", "p", F.ceil(F.col("n") / node).cast("int").alias("parts")))
            part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            a = large.select("turn", F.col("p").alias("a"), part.alias("i"))
            b = large.select("turn", F.col("p").alias("b"), part.alias("j"))
            cut = wide.join(a, ["turn", "a"]).join(b, ["turn", "b"]).where("a != b or i <= j")
            ready.append(cut.select(F.lit(65).alias("depth"), "turn", F.xxhash64("a", "i").alias("a"), F.xxhash64("b", "j").alias("b")))
            mine = F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")
            parted = fps.join(large.withColumnRenamed("p", "fp"), ["turn", "fp"]).withColumn("depth", F.lit(65))
            parted = parted.withColumn("p", F.xxhash64("fp", mine)).drop("parts")
            break
        depth += STRIDE
        child = fps.groupBy("turn", _prefix(depth).alias("c")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.shiftright("c", STRIDE))
        if depth == 64:
            child = child.withColumn("p", F.shiftrightunsigned("c", STRIDE))
        left = child.select("turn", F.col("p").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"))
        right = child.select("turn", F.col("p").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"))
        allowed = F.get(F.array(*[F.lit(b.at(depth)) for b in budgets]), F.col("turn"))
        near = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= allowed
        down = wide.join(left, ["turn", "a"]).join(right, ["turn", "b"]).where(near & ((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))))
        open_ = checkpointed(down.select("turn", F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb"))
        some, more = open_.agg(F.bool_or(fits), F.bool_or(~fits)).first()
    pairs = checkpointed(reduce(DataFrame.union, ready))
    keys = ["depth", "turn", "p"]
    used = pairs.select("depth", "turn", F.col("a").alias("p")).union(pairs.select("depth", "turn", F.col("b").alias("p"))).distinct()
    # Rows are gathered once, for the depths and nodes that a pair has.
    at = fps.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]).cast("array<int>")))
    at = at.withColumn("p", F.expr("if(depth = 0, 0L, shiftrightunsigned(fp, 64 - depth))"))
    at = at if parted is None else at.unionByName(parted)
    rows = checkpointed(at.join(used, keys, "left_semi").groupBy(*keys).agg(F.collect_list(carried).alias("rows")))
    x = rows.select("depth", "turn", F.col("p").alias("a"), F.col("rows").alias("x"))
    y = rows.select("depth", "turn", F.col("p").alias("b"), F.col("rows").alias("y"))
    return pairs.join(x, ["depth", "turn", "a"]).join(y, ["depth", "turn", "b"]).select("depth", "turn", "x", "y", (F.col("a") == F.col("b")).alias("same"))


def _columns(rows: pa.ListScalar, names: tuple[str, ...]) -> list[np.ndarray]:
    values = rows.values
    out = [values.field(n).to_numpy(zero_copy_only=False) for n in names]
    order = np.argsort(out[0].view(np.uint64), kind="stable")
    return [out[0].view(np.uint64)[order], *[c[order] for c in out[1:]]]


def link_forest(fps: DataFrame, budget: Budget = Budget(), node: int = NODE) -> DataFrame:
    """(a, b): links between distinct fingerprints within the budget, as many as it takes to connect what they connect."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for depth, _, x, y, same in zip(*batch.columns):
                (a,), (b,) = _columns(x, ("fp",)), _columns(y, ("fp",))
                u, v = _forest(a, b, same.as_py(), depth.as_py(), budget)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    pairs = node_pairs(fps.select("fp", F.lit(0).alias("turn")), (budget,), node)
    schema = "a long, b long"
    return fps.sparkSession.createDataFrame([], schema) if pairs is None else pairs.mapInArrow(follow, schema)


def candidates(texts: DataFrame, budget: Budget | Sequence[Budget], forests: int = 1, node: int = TEXTS) -> DataFrame:
    """(a, b) from distinct (name, fp, low, high), with cls and tried or without: pairs of texts to compare, a below b.

    With several budgets a row also has ``turn``, the place of its own, and a text has a row per turn.
    Every pair of trie nodes gives ``forests`` spanning forests over the classes of its alike texts, so whatever is within the budget and
    alike is connected by what comes out, unless pairs turn out not to be links.
    """
    schema = "a long, b long"
    budgets = (budget,) if isinstance(budget, Budget) else tuple(budget)
    texts = texts if "turn" in texts.columns else texts.withColumn("turn", F.lit(0))
    columns = [c for c in ("fp", "turn", "name", "low", "high", "cls", "tried") if c in texts.columns]

    def side(rows: pa.ListScalar) -> tuple:
        values = rows.values
        name, low, high = (values.field(c).to_numpy(zero_copy_only=False) for c in ("name", "low", "high"))
        fp = values.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.argsort(fp, kind="stable")
        cls, pairs = name, np.empty((0, 2), np.int64)
        if "tried" in columns:
            cls, lists = values.field("cls").to_numpy(zero_copy_only=False), values.field("tried")
            partner, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(name, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            pairs = np.stack([np.minimum(owner, partner), np.maximum(owner, partner)], 1)
        return fp[order], name[order], np.stack([low, high], 1).view(np.uint64)[order], cls[order], pairs

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for depth, turn, x, y, same in zip(*batch.columns):
                sides = [side(x)] if same.as_py() else [side(x), side(y)]
                fp, name, sketch, cls, tried = zip(*sides)
                found = _candidates(list(fp), list(name), list(sketch), list(cls), np.concatenate(tried),
                                    same.as_py(), min(depth.as_py(), 64), budgets[turn.as_py()], forests)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], ["a", "b"])

    pairs = node_pairs(texts.select(*columns), budgets, node)
    if pairs is None:
        return texts.sparkSession.createDataFrame([], schema)
    return pairs.mapInArrow(follow, schema).distinct()


def classes(fps: DataFrame, budget: Budget = Budget(), node: int = NODE) -> DataFrame:
    """(fp, cls) of every distinct fingerprint: cls is the smallest fingerprint it can reach over links."""
    roots = components(link_forest(fps, budget, node))
    joined = fps.join(roots, fps["fp"] == roots["node"], "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("cls"))


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable over links of ``bits`` bits.

    Null, empty and wordless texts have fingerprint 0, linked like any other. Rows may repeat; a null doc_id is never the
    smallest unless there is no other. Without rows the result is empty.
    """
    rows = checkpointed(docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp")))
    first = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    grouped = classes(first.select("fp"), Budget(bits, 64, bits))
    least = first.join(grouped, "fp").groupBy("cls").agg(F.min("first").alias("component_id"))
    named = grouped.join(least, "cls").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


# The stage over word shingles of five words looks further than two bits: three rotations put each third of the bits first,
# and three errors are allowed there, so every pair within 11 bits is met, and most within TOTAL. Pairs are verified.
TURNS = ((0, 21), (21, 21), (42, 22))
LEAD = 3
TOTAL = 16
SIMILARITY = 0.8
SHINGLE = 5
MINS = 64  # places of a sketch: two bits each of the least shingle hash under so many permutations
FLOOR = 42  # matching places below which a pair is not compared; at a similarity of 0.8, 54 match, fewer than 42 in about one pair of 30,000
STRONG = 62  # matching places of pairs that can be taken for links until they are compared
MORE = 16  # times as many forests whenever groups are searched again
SLICE = 65_536  # pairs whose sketches are compared at once
MULTIPLIERS = np.random.default_rng(5).integers(1 << 32, 1 << 63, MINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of the words of a text whose A-Z become small."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, text.lower().split())), np.uint64)


def joined_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the shingles of so many word hashes; fewer words are one shingle, none has none."""
    n = max(min(1, len(words)), len(words) - width + 1)
    h = words[:n].copy()
    for m in range(1, min(width, len(words))):
        h *= np.uint64(0x9E3779B97F4A7C13)
        h += words[m : m + n]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def sketch_of(hashes: np.ndarray) -> tuple[int, int]:
    """Two words with a bit each of MINS places; two sets share about as large a part of them as their Jaccard similarity, and a quarter of the rest."""
    if not len(hashes):
        return 0, 0
    least = np.full(MINS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[None, at : at + 4096] * MULTIPLIERS[:, None]).min(axis=1), out=least)
    low, high = (int(np.packbits((least >> np.uint64(k) & np.uint64(1)).astype(bool)).view("<i8")[0]) for k in (8, 9))
    return low, high


def set_fingerprint(text: Column, width: int) -> Column:
    """fp: fingerprint of the distinct shingles of three words, so a line that repeats counts once; low, high: sketch of those of ``width`` words."""

    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.cast(pa.large_binary()):
            whole = text.as_py() or b""
            rows.append((fingerprint_of(np.unique(shingle_hashes(whole, 3))), *sketch_of(joined_hashes(word_hashes(whole), width))))
        columns = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["fp", "low", "high"])

    return F.arrow_udf(of, "struct<fp: bigint, low: bigint, high: bigint>")(F.coalesce(text, F.lit("")))


def alike(a: Column, b: Column, similarity: float, width: int) -> Column:
    """Whether the sets of word shingles of two texts have this Jaccard similarity or more."""

    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out, last, s = [], None, None
        for a, b in zip(left.cast(pa.large_binary()), right.cast(pa.large_binary())):
            a, b = a.as_py() or b"", b.as_py() or b""
            if s is None or b != last:
                last, s = b, np.unique(joined_hashes(word_hashes(b), width))
            r = np.unique(joined_hashes(word_hashes(a), width))
            both = len(np.intersect1d(r, s, assume_unique=True))
            out.append(both >= similarity * (len(r) + len(s) - both))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(of, "boolean")(a, b)


def _turned(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def _text_name(text: Column) -> Column:
    """Hash of a text; null, empty and wordless texts share one."""
    return F.xxhash64(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit("")))


def _unused(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def links(docs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, node: int = TEXTS) -> DataFrame:
    """(a, b): verified links that connect whatever the links between distinct texts within the budget connect.

    ``texts`` has a row per distinct text: name, fp, low, high and id, one of the doc_ids it has in ``docs``. Spanning forests over the alike
    texts of every rotation are compared by their whole shingle sets. Only groups in which a comparison fails can still lack a
    link: these are searched again without the pairs already compared, with MORE times as many forests, until none is left to compare.
    """
    spark = docs.sparkSession
    own = docs.select(docs["doc_id"].alias("id"), docs["text"].alias("t"))
    compared = spark.createDataFrame([], "a long, b long, ok boolean")
    stars = spark.createDataFrame([], "a long, b long")
    turns = F.array(*[F.struct(F.lit(k).alias("turn"), _turned(F.col("fp"), by).alias("fp")) for k, (by, _) in enumerate(TURNS)])
    open_, forests = texts.select("name", "fp", "low", "high"), 1
    while True:
        turned = open_.withColumn("at", F.explode(turns)).withColumn("turn", F.col("at.turn")).withColumn("fp", F.col("at.fp")).drop("at")
        near = checkpointed(candidates(turned, [Budget(TOTAL, lead, LEAD) for _, lead in TURNS], forests, node * FIRST if forests == 1 else node))
        if near.isEmpty():
            break
        wanted = near.select(F.col("a").alias("name")).union(near.select(F.col("b").alias("name"))).distinct()
        wanted = checkpointed(texts.join(wanted, "name").select(F.col("name").alias("n"), F.col("id").alias("i")))
        bodies = likely(own, "id", wanted, "i").withColumn("name", _text_name(F.col("t")))
        bodies = bodies.join(wanted, (F.col("name") == F.col("n")) & F.col("id").eqNullSafe(F.col("i"))).select("n", "t").dropDuplicates(["n"])
        pairs = near.join(bodies.select(F.col("n").alias("a"), F.col("t").alias("ta")), "a").join(
            bodies.select(F.col("n").alias("b"), F.col("t").alias("tb")), "b")
        new = checkpointed(pairs.select("a", "b", alike(F.col("ta"), F.col("tb"), similarity, width).alias("ok")))
        compared = compared.union(new)
        failed = new.where("not ok")
        if failed.isEmpty():
            break
        # What a failed pair held together may have other links: its whole tentative group is searched again.
        groups = components(new.select("a", "b").union(stars)).select(F.col("node").alias("m"), F.col("root").alias("r"))
        doubtful = groups.join(failed.select(F.col("a").alias("m")), "m", "left_semi").select("r").distinct()
        again = groups.join(doubtful, "r", "left_semi").select(F.col("m").alias("again"))
        linked = new.where("ok").select("a", "b").union(stars)
        stars = checkpointed(components(linked).where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        misses = compared.where("not ok").groupBy(F.col("a").alias("m")).agg(F.collect_list("b").alias("misses"))
        rows = texts.join(again, F.col("name") == F.col("again"), "left_semi").join(stars.withColumnRenamed("b", "r"), F.col("name") == F.col("a"), "left")
        rows = rows.join(misses, F.col("name") == F.col("m"), "left")
        open_ = checkpointed(rows.select("name", "fp", "low", "high", F.coalesce("r", "name").alias("cls"),
                                         F.coalesce("misses", F.array().cast("array<bigint>")).alias("tried")))
        forests *= MORE
    return compared.where("ok").select("a", "b")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """One document of each group of near-duplicates, all columns as they were.

    Equal texts are one text. Two texts are linked if the sets of their ``width``-word shingles have a Jaccard similarity of ``similarity`` or
    more, which is always verified, and their fingerprints (of distinct three-word shingles) differ in at most 16 bits, at most
    three of them in one third; every pair within 11 bits is met. Nothing limits the links of a text (see ``links``). Of each component stays the row with
    the smallest doc_id (null last), ties by the hash of the text; of rows equal in both one. Null, empty and wordless texts are
    one text. Other columns may have any names. Without rows the result is empty.
    """
    rows = checkpointed(docs.select(docs["doc_id"].alias("id"), _text_name(docs["text"]).alias("name"), set_fingerprint(docs["text"], width).alias("s")))
    each = rows.groupBy("name", "id").agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("least")
    texts = checkpointed(each.groupBy("name").agg(least, F.first("s").alias("s")).select("name", "least", "least.id", "s.fp", "s.low", "s.high"))
    roots = components(links(docs, texts, similarity, width)).select(F.col("node").alias("m"), "root")
    grouped = texts.join(roots, texts["name"] == roots["m"], "left").withColumn("g", F.coalesce("root", "name"))
    first = grouped.groupBy("g").agg(F.min(F.struct("least.none", "least.id", "name", "least.n")).alias("f"))
    name, other, own, n = (_unused(c, docs.columns) for c in ("text_name", "kept_name", "kept_id", "kept_n"))
    kept = checkpointed(first.select(F.col("f.name").alias(other), F.col("f.id").alias(own), F.col("f.n").alias(n)))

    def rows_of(part: DataFrame) -> DataFrame:
        near = likely(docs, "doc_id", part, own).withColumn(name, _text_name(docs["text"]))
        return near.join(part, (near[name] == part[other]) & near["doc_id"].eqNullSafe(part[own]))

    once, repeated = rows_of(kept.where(F.col(n) == 1)), rows_of(kept.where(F.col(n) > 1)).dropDuplicates([name])
    return once.unionByName(repeated).drop(name, other, own, n)
