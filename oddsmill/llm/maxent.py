"""Language-model scoring by a maximum-entropy model with hashed features and a class-factored softmax.

A word's probability is that of its class in its context times its share of the class. The frequent words are classes of
their own; all others fall, by a hash of their ending, into classes made of endings that follow the same frequent words.
The softmax over classes has a weight row for the class before (n-gram), one for the class before that (skip) and one for a
hash of both. Its sufficient statistics, counts of (context, class), come from all training texts and are reduced by Spark;
the weights are fitted by gradients that the tasks compute on their share of the contexts. Words beyond the dictionary that
travels with the tasks are counted exactly as well: they join the corpus's counts by hash.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.llm.common import checkpointed, split_of

SINGLE = 64  # classes 0..63: the end of a text and the 63 most frequent words
GROUPS = 64  # classes of endings
CLASSES = SINGLE + GROUPS
ENDINGS = 2048  # hash buckets of the last three bytes of a word
PAIRS = 4096  # hash buckets of two classes before
DICTIONARY = 131_072  # most frequent words, known to every task
STEPS, RATE, DECAY = 15, 0.1, 1.0
CHUNK = 300_000  # tokens worked on at a time
FLUSH = 500_000  # distinct words a task counts before it hands them on


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def pair_row(context: np.ndarray) -> np.ndarray:
    """Hash bucket of a context (class before last * CLASSES + last class)."""
    return (context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)


def _batches(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    chunk, total = [], 0
    for t in texts.cast(pa.large_binary()).to_pylist():
        words = t.lower().split() if t else []
        chunk.append(words)
        total += len(words) + 1
        if total >= CHUNK:
            yield chunk
            chunk, total = [], 0
    if chunk:
        yield chunk


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of the single column ``texts``; words lose A-Z, ends are not counted here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for words in _batches(batch.column(0)):
                seen.update(chain.from_iterable(words))
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Dictionary:
    """The frequent words with their counts, and the class of every other word by its ending."""

    counts: dict[bytes, int]
    single: dict[bytes, int]
    group: np.ndarray  # ending -> class
    ends: int  # count of ends

    def flatten(self, chunk: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, token ids with -1 for ends, starts of the texts, classes of the distinct words and, last, of the end."""
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        sizes = np.array([len(w) + 1 for w in chunk])
        flat = np.fromiter(map(index.__getitem__, chain.from_iterable(chunk)), np.int64, int(sizes.sum()) - len(chunk))
        ends = np.cumsum(sizes) - 1
        ids = np.full(int(sizes.sum()), -1, np.int64)
        there = np.ones(len(ids), bool)
        there[ends] = False
        ids[there] = flat
        words = list(index)
        single, group = self.single, self.group
        classes = np.fromiter((single[w] if w in single else group[ending(w)] for w in words), np.int64, len(words))
        return words, ids, ends - sizes + 1, np.append(classes, 0)


def _contexts(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class before last * CLASSES + last class for every token; before a text stand ends (class 0)."""
    one, two = np.zeros_like(classes), np.zeros_like(classes)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[starts] = 0
    two[starts] = 0
    second = starts + 1
    two[second[second < len(classes)]] = 0
    return two * CLASSES + one


def _tallied(texts: DataFrame, dictionary: Dictionary, key_of, size: int) -> DataFrame:
    """(k, n): counts of key_of(words, ids, starts, classes) over all tokens, added up per task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for chunk in _batches(batch.column(0)):
                keys = key_of(*dictionary.flatten(chunk))
                total += np.bincount(keys, minlength=size)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    return texts.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _clusters(vectors: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Weighted k-means on rows; starts from the heaviest rows that are furthest apart."""
    centres = [int(weight.argmax())]
    far = ((vectors - vectors[centres[0]]) ** 2).sum(axis=1)
    for _ in range(1, k):
        centres.append(int((far * np.sqrt(weight)).argmax()))
        far = np.minimum(far, ((vectors - vectors[centres[-1]]) ** 2).sum(axis=1))
    centre = vectors[centres].copy()
    for _ in range(rounds):
        near = ((vectors[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in np.unique(near):
            own = near == c
            centre[c] = np.average(vectors[own], axis=0, weights=weight[own] + 1e-9)
    return near


def learn_dictionary(texts: DataFrame, counts: DataFrame, ends: int) -> Dictionary:
    # Sixteenths of powers of two: the lowest step from which on at most DICTIONARY words are as frequent.
    step = F.floor(F.log2(F.col("c").cast("double")) * 16)
    room, lowest = DICTIONARY, None
    for s, n in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("s").desc()).collect():
        room -= n
        if room < 0:
            break
        lowest = s
    frequent = counts.where(step >= lowest) if lowest is not None else counts.limit(0)
    top = frequent.select("word", "c").toArrow().to_pydict()
    ranked = sorted(zip(top["c"], map(bytes, top["word"])), key=lambda x: (-x[0], x[1]))
    words = {w: c for c, w in ranked}
    single = {w: k + 1 for k, w in enumerate(list(words)[: SINGLE - 1])}
    plain = Dictionary(words, single, np.full(ENDINGS, SINGLE), ends)

    def key(words_, ids, starts, classes):
        tails = np.fromiter((ending(w) for w in words_), np.int64, len(words_))
        one = np.zeros(len(ids), np.int64)
        one[1:] = classes[ids[:-1]]
        one[starts] = 0
        other = (classes[ids] == SINGLE) & (ids >= 0)
        return tails[ids[other]] * (SINGLE + 1) + one[other]

    tally = _tallied(texts, plain, key, ENDINGS * (SINGLE + 1)).toArrow().to_pydict()
    table = np.zeros(ENDINGS * (SINGLE + 1))
    table[np.array(tally["k"], np.int64)] = tally["n"]
    table = table.reshape(ENDINGS, SINGLE + 1)
    weight = table.sum(axis=1)
    vectors = np.sqrt((table + 0.5 * table.sum(axis=0) / max(1.0, table.sum())) / (weight[:, None] + 0.5))
    near = _clusters(vectors, weight, GROUPS)
    return Dictionary(words, single, SINGLE + near, ends)


@dataclass
class Weights:
    bias: np.ndarray
    last: np.ndarray
    skip: np.ndarray
    pair: np.ndarray

    def logp(self, context: np.ndarray) -> np.ndarray:
        z = self.bias + self.last[context % CLASSES] + self.skip[context // CLASSES] + self.pair[pair_row(context)]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def learn_weights(tally: DataFrame, steps: int = STEPS) -> Weights:
    """Adam on the log-likelihood, from gradients of the contexts that the tasks hold.

    A task sends one row per weight row it touches; rows of hashed pairs are dealt by that hash, so each leaves one task.
    """
    rows = tally.select(F.floor(F.col("k") / CLASSES).alias("context"), (F.col("k") % CLASSES).alias("cls"), "n")
    held = rows.groupBy("context").agg(F.collect_list(F.struct("cls", "n")).alias("cells"))  # at most CLASSES cells

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pair_row(b.column(0).to_numpy()))], ["context", "cells", "bucket"])

    kind = "context long, cells array<struct<cls:long,n:long>>, bucket long"
    held = checkpointed(held.mapInArrow(dealt, kind).repartition("bucket"))

    def dense(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        context, cells = batch.column(0).to_numpy(), batch.column(1)
        n = np.zeros((len(context), CLASSES))
        owner = np.repeat(np.arange(len(context)), cells.value_lengths().to_numpy())
        n[owner, cells.flatten().field("cls").to_numpy()] = cells.flatten().field("n").to_numpy()
        return context, n

    def totals(batches):
        last, skip = np.zeros((CLASSES, CLASSES)), np.zeros((CLASSES, CLASSES))
        for b in batches:
            context, n = dense(b)
            np.add.at(last, context % CLASSES, n)
            np.add.at(skip, context // CLASSES, n)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([last.ravel(), skip.ravel()], pa.list_(pa.float64()))], ["row", "grad"])

    schema = "row long, grad array<double>"

    def added(df: DataFrame) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for batch in df.toArrow().to_batches():
            for r, g in zip(batch.column(0).to_pylist(), batch.column(1)):
                g = g.values.to_numpy()
                out[r] = out[r] + g if r in out else g.copy()
        return out

    got = added(held.mapInArrow(totals, schema))
    last, skip = [got.get(k, np.zeros(CLASSES**2)).reshape(CLASSES, CLASSES) for k in (0, 1)]
    total = max(1.0, last.sum())
    bias = np.log((last.sum(axis=0) + 0.5) / (total + 0.5 * CLASSES))
    # Start from the bigram's conditional shares; the skip and pair rows start from nothing.
    share = (last + 20 * np.exp(bias)) / (last.sum(axis=1, keepdims=True) + 20)
    model = Weights(bias, np.log(share) - bias, np.zeros((CLASSES, CLASSES)), np.zeros((PAIRS, CLASSES)))
    sizes = {"last": last.sum(axis=1), "skip": skip.sum(axis=1)}
    moment = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in ("last", "skip", "pair")}
    base = {"last": 0, "skip": CLASSES, "pair": 2 * CLASSES}

    def step(weights: Weights) -> DataFrame:
        def gradient(batches):
            for b in batches:
                context, n = dense(b)
                wrong = np.exp(weights.logp(context)) * n.sum(axis=1, keepdims=True) - n
                at = np.concatenate([context % CLASSES, CLASSES + context // CLASSES, 2 * CLASSES + pair_row(context)])
                rows_, inverse = np.unique(at, return_inverse=True)
                total_ = np.zeros((len(rows_), CLASSES))
                np.add.at(total_, inverse, np.concatenate([wrong] * 3))
                yield pa.RecordBatch.from_arrays([pa.array(rows_), pa.array(list(total_), pa.list_(pa.float64()))], ["row", "grad"])

        return held.mapInArrow(gradient, schema)

    for t in range(1, steps + 1):
        got = added(step(model))
        for name, (m, v) in moment.items():
            w = getattr(model, name)
            g = DECAY * w
            for k in range(len(w)):
                if base[name] + k in got:
                    g[k] += got[base[name] + k]
            m += 0.1 * (g - m)
            v += 0.05 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1.0)
    return model


def scored(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    ``learn`` is a condition on doc_id: rows for which it holds are learned from. Words lose A-Z; a text ends in one end
    token; null texts are empty. base_score is the unigram model with half a count for every word and for an unknown one;
    score is this module's model, in which every class keeps half a count for unknown words of its own. Repeated rows are
    scored alike. With no training rows every count is zero and the classes are equally likely.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), learn.alias("learned"))
    texts = rows.where("learned").select("text")
    ends = texts.count()
    counts = checkpointed(word_counts(texts).select("word", "c", F.xxhash64(F.col("word")).alias("h")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_tokens, kinds = n + ends, v + (ends > 0)
    dictionary = learn_dictionary(texts, counts, ends)

    def context_key(words, ids, starts, classes):
        of = classes[ids]
        return _contexts(of, starts) * CLASSES + of

    weights = learn_weights(checkpointed(_tallied(texts, dictionary, context_key, CLASSES**3)))
    # Count and number of words of every class; classes of one word come from the dictionary.
    tail = F.crc32(F.substring(F.col("word"), -3, 3)) % ENDINGS
    by_ending = counts.groupBy(tail.alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow().to_pydict()
    size, words_in = np.zeros(CLASSES), np.zeros(CLASSES)
    for e, c, k in zip(by_ending["e"], by_ending["c"], by_ending["v"]):
        size[dictionary.group[e]] += c
        words_in[dictionary.group[e]] += k
    for w, k in dictionary.single.items():
        size[dictionary.group[ending(w)]] -= dictionary.counts[w]
        words_in[dictionary.group[ending(w)]] -= 1
        size[k], words_in[k] = dictionary.counts[w], 1
    size[0], words_in[0] = ends, float(ends > 0)
    spread = np.log10(size + 0.5 * (words_in + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.counts
        for batch in batches:
            at = 0
            for chunk in _batches(batch.column("text")):
                words, ids, starts, classes = dictionary.flatten(chunk)
                of = classes[ids]
                context, inverse = np.unique(_contexts(of, starts), return_inverse=True)
                logp = weights.logp(context)[inverse, of] / np.log(10) - spread[of]
                c = np.append(np.fromiter((known.get(w, 0) for w in words), np.int64, len(words)), dictionary.ends)
                here = c[ids]
                # Words beyond the dictionary are settled by the join; the end always is settled here.
                open_ = (here == 0) & (ids >= 0)
                local = np.where(open_, 0.0, np.log10(here + 0.5))
                sizes = np.add.reduceat(np.ones(len(ids), np.int64), starts)
                text = np.repeat(np.arange(len(starts)), sizes)
                rare = np.array([xxhash.xxh64_intdigest(w, 42) if known.get(w) is None else 0 for w in words] + [0], np.uint64).view(np.int64)
                cells, tf = np.unique(text[open_] * len(c) + ids[open_], return_counts=True)
                owner, word = cells // len(c), cells % len(c)
                offsets = pa.array(np.searchsorted(owner, np.arange(len(starts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(chunk)), batch.column("learned").slice(at, len(chunk)), batch.column("key").slice(at, len(chunk)),
                    pa.array(sizes), pa.array(np.add.reduceat((here > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(local, starts)), pa.array(np.add.reduceat(logp, starts)),
                    pa.ListArray.from_arrays(offsets, pa.array(rare[word])), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))],
                    ["doc_id", "learned", "key", "n", "known", "logs", "model", "h", "tf"])
                at += len(chunk)

    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", "learned", F.xxhash64("doc_id", "text").alias("key"), "text")
    local = checkpointed(keyed.mapInArrow(
        score, f"doc_id {kind}, learned boolean, key long, n long, known long, logs double, model double, h array<bigint>, tf array<int>"))
    # Equal rows share a key; their rare words are looked up once.
    cells = local.groupBy("key").agg(F.first("h").alias("h"), F.first("tf").alias("tf")) if _repeats(local) else local.select("key", "h", "tf")
    cells = cells.select("key", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("key", "x.h", "x.tf")
    found = cells.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = found.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 0.5)).alias("logs2"))
    joined = local.drop("h", "tf").join(sums, "key", "left")
    logs = F.col("logs") + F.coalesce("logs2", F.lit(0.0))
    return joined.select(
        "doc_id", "learned", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (logs - F.col("n") * float(np.log10(n_tokens + 0.5 * (kinds + 1)))).alias("base_score"), (logs + F.col("model")).alias("score"))


def _repeats(local: DataFrame) -> bool:
    return not local.groupBy("key").count().where("count > 1").isEmpty()


def held_out(doc_id: Column) -> Column:
    return split_of(doc_id, 5) == 1
