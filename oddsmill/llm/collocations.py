"""Collocations by Toivonen's sampling: phrases that are frequent in a sample and their negative border are counted in full.

The border holds what is not frequent in the sample although all its parts are. Words are counted in all texts along with the
sample's pairs. Fixed sets of bits (Bloom filters) of the frequent words and the sample's frequent pairs tell a task which
phrases to count: a phrase is counted if its parts are in a filter, which covers sample-frequent phrases and border alike; a
false hit only counts one more phrase. The full pass counts 64-bit hashes; a sum of hashes is never below the count of a phrase, so those that reach the least count are all the phrases worth
an exact count, and the next pass counts them as text. Words and pairs of the border that turn out frequent make a further
filter, and what they open is counted in further passes until none is left outside. All counts that are reported are exact
counts of whole passes, so sample and hashes decide the work and never the result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.llm.common import checkpointed

# Upper-case letters, what ends a piece, and the tab (fixed). Ends become full stops, which no word holds then.
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz......... ")
LEAST = 10  # occurrences of a phrase
HELD = 50  # a phrase is dropped if a longer one has so many per cent of its occurrences
SAMPLE = 4  # one text in so many proposes phrases
TEXTS = 1_000  # rows of a batch that goes to Python; texts can be long
PENDING = 4 << 20  # bytes of text of a language that are counted together
STEP = 1 << 18  # words that are numbered and counted together
BITS = range(20, 30)  # a filter has 2**20 to 2**29 bits (64 MB), about 16 for each phrase in it

OF_WORD = "h & 3 = 1"  # the lowest bits of a hash: its words
COUNTS = "lang string, k int, phrase string, c long"
ARROW = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("c", pa.int64())])


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of texts in lower case; a full stop stands between pieces and between texts."""
    return b".".join(texts).translate(CLEAN).replace(b".", b" . ").split()


def _marked(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes whose two lowest bits say of how many words they are."""
    return (hashes & ~np.uint64(3)) | np.uint64(k)


def _pair_hash(x: np.ndarray, y: np.ndarray, k: int = 2) -> np.ndarray:
    z = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y + np.uint64(0x632BE59BD9B4E019))
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return _marked(z ^ (z >> np.uint64(32)), k)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return _marked(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words)), 1)


def _slots(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The two bits, of ``size`` (a power of two), that stand for each hash."""
    return [(h & np.uint64(size - 1)).astype(np.int64) for h in (hashes >> np.uint64(2), hashes >> np.uint64(34))]


def _held(filters: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Which hashes one of the filters holds."""
    out = np.zeros(len(hashes), bool)
    for bits in filters:
        a, b = ((bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 for s in _slots(hashes, 8 * len(bits)))
        out |= (a & b).astype(bool)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, bool], list[bytes]]]:
    """Texts of one language, sampled or not, at a time; about PENDING bytes."""
    pending, size, held = defaultdict(list), defaultdict(int), 0
    for batch in batches:
        keys = zip(batch.column("lang").to_pylist(), batch.column("sampled").to_pylist())
        for key, text in zip(keys, batch.column("text")):
            data = (text.as_py() or "").encode()
            pending[key].append(data)
            size[key] += len(data) + 1
            held += len(data) + 1
            if held > PENDING:
                key = max(size, key=size.get)
                held -= size.pop(key)
                yield key, pending.pop(key)
    yield from pending.items()


class Part:
    """Up to STEP words of a language; phrases begin in them and may reach two words further."""

    def __init__(self, lang: str, tokens: list[bytes], sampled: bool = True):
        code = defaultdict(count(1).__next__, {b".": 0})
        self.lang, self.sampled, self.n = lang, sampled, min(STEP, len(tokens))
        self.w = np.fromiter(map(code.__getitem__, tokens), np.int64, len(tokens))
        self.names = list(code)
        self.h = _word_hashes(lang, self.names)
        self.x, self.y = self.w[:-1], self.w[1:]
        self.pair = (self.x > 0) & (self.y > 0)
        self.triple = self.pair[:-1] & self.pair[1:]
        self.ph = _pair_hash(self.h[self.x], self.h[self.y])

    def known(self, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of words that the filters hold, and triples of pairs of such words that they hold."""
        words = _held(filters, self.h)
        pair = self.pair & words[self.x] & words[self.y]
        at, held = np.flatnonzero(pair), np.zeros(len(pair), bool)
        held[at] = _held(filters, self.ph[at])
        return pair, self.triple & held[:-1] & held[1:]

    def opened(self, old: list[np.ndarray], new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``known`` finds with one more filter, and did not without."""
        before = _held(old, self.h)
        words = before | _held([new], self.h)
        fresh = words & ~before
        pair = self.pair & words[self.x] & words[self.y]
        at, touched = np.flatnonzero(pair), np.zeros(len(pair), bool)
        touched[at] = _held([new], self.ph[at])
        first = pair & (fresh[self.x] | fresh[self.y])
        changed = touched | first
        triple = np.zeros(len(self.triple), bool)
        at = np.flatnonzero(self.triple & pair[:-1] & pair[1:] & (changed[:-1] | changed[1:]))
        was = now = True
        for i in (at, at + 1):
            held = _held(old, self.ph[i])
            was, now = was & held & before[self.x[i]] & before[self.y[i]], now & (held | touched[i])
        triple[at] = now & ~was
        return first, triple

    def triple_hash(self, at: np.ndarray) -> np.ndarray:
        return _pair_hash(self.ph[at], self.h[self.w[at + 2]], 3)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for (lang, sampled), texts in _texts(batches):
        words = tokens(texts)
        for at in range(0, len(words), STEP):
            yield Part(lang, words[at : at + STEP + 2], sampled)


def _hash_counts(part: Part, pairs: bool, filters: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Hashes of phrases (h, c): words and, if asked for, pairs; with filters, pairs and triples whose parts they hold instead."""
    found = []
    if filters is None:
        c = np.bincount(part.w[: part.n], minlength=len(part.names))
        c[0] = 0
        found.append((part.h[c > 0], c[c > 0]))
    if pairs:
        pair, triple = part.known(filters) if filters is not None else (part.pair, None)
        found.append(np.unique(part.ph[np.flatnonzero(pair[: part.n])], return_counts=True))
        if triple is not None:
            found.append(np.unique(part.triple_hash(np.flatnonzero(triple[: part.n])), return_counts=True))
    for h, c in found:
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["h", "c"])


def _phrase_counts(part: Part, words: np.ndarray | None, pair: np.ndarray, triple: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of phrases as text (lang, k, phrase, c): the words asked for with the sum of all under k = 0, and pairs and triples at these positions."""
    strings = pa.array(part.names, pa.binary())
    wide = len(part.names)

    def batch(k: int, keys: list[np.ndarray], c: np.ndarray) -> pa.RecordBatch:
        phrase = [strings.take(pa.array(x)) for x in keys]
        phrase = pc.binary_join_element_wise(*phrase, pa.scalar(b" ", pa.binary())) if k > 1 else phrase[0]
        lang = pa.array([part.lang], pa.string()).take(pa.array(np.zeros(len(c), np.int32)))
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(c), k, np.int32)), phrase.cast(pa.string()), pa.array(c, pa.int64())], schema=ARROW)

    if words is not None:
        c = np.bincount(part.w[: part.n], minlength=wide)
        c[0] = 0
        used = np.flatnonzero(words & (c > 0))
        yield batch(1, [used], c[used])
        yield pa.RecordBatch.from_pylist([{"lang": part.lang, "k": 0, "phrase": "", "c": int(c.sum())}], ARROW)
    keys, c = np.unique(part.x[pair] * wide + part.y[pair], return_counts=True)
    yield batch(2, [keys // wide, keys % wide], c)
    keys, c = np.unique((part.x[triple] * wide + part.y[triple]) * wide + part.w[triple + 2], return_counts=True)
    yield batch(3, [keys // wide // wide, keys // wide % wide, keys % wide], c)


def _hash_sums(texts: DataFrame, least: Column, filters: list | None = None) -> DataFrame:
    """(h, c) of the hashes that occur ``least`` times; filters are broadcast variables of at most 64 MB.

    Without filters: words of all texts and pairs of those ``sampled``. With filters: pairs and triples whose parts they hold.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield from _hash_counts(part, part.sampled, filters and [f.value for f in filters])

    return texts.mapInArrow(of, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)


def _phrase_sums(texts: DataFrame, least: int, old: list, new, worth=None) -> DataFrame:
    """(lang, k, phrase, c) of phrases that occur ``least`` times: those that ``new`` opens, and with ``worth`` all it holds of what ``old`` knows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [f.value for f in old]
        for part in _parts(batches):
            words = None
            pair, triple = (np.flatnonzero(m[: part.n]) for m in part.opened(before, new.value))
            if worth is not None:
                words = _held([worth.value], part.h)
                at, at3 = (np.flatnonzero(m[: part.n]) for m in part.known(before))
                pair = np.concatenate([pair, at[_held([worth.value], part.ph[at])]])
                triple = np.concatenate([triple, at3[_held([worth.value], part.triple_hash(at3))]])
            yield from _phrase_counts(part, words, pair, triple)

    counts = texts.mapInArrow(of, COUNTS).groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c"))
    return counts.where((F.col("c") >= least) | (F.col("k") == 0))


def _outside(hashes: DataFrame, filters: list) -> DataFrame:
    """Hashes that no filter holds."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~_held([f.value for f in filters], b.column("h").to_numpy().view(np.uint64))))

    return hashes.select("h").mapInArrow(of, "h long")


def _hashed(phrases: DataFrame) -> DataFrame:
    """Hashes (h) of words and pairs (lang, phrase)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows, np.uint64)
            for n, (lang, phrase) in enumerate(zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist())):
                h = _word_hashes(lang, phrase.encode().split(b" "))
                out[n] = h[0] if len(h) == 1 else _pair_hash(h[:1], h[1:])[0]
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])

    return phrases.select("lang", "phrase").mapInArrow(of, "h long")


def _filter(hashes: DataFrame) -> np.ndarray:
    """A filter of hashes (h); the bits are set in a distributed aggregate."""
    power = min(max(BITS.start, (16 * hashes.count()).bit_length()), BITS.stop - 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = np.concatenate(_slots(b.column("h").to_numpy().view(np.uint64), 1 << power))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots))], names=["slot"])

    slot = F.col("slot") + 1  # bits of the built-in bitmaps are numbered from 1
    rows = hashes.select("h").mapInArrow(of, "slot long").groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << power >> 3, np.uint8)
    for r in rows.collect():  # at most 64 MB in all
        part = np.frombuffer(r.bits, np.uint8)
        out[(r.bucket - 1) * len(part) : r.bucket * len(part)] = part
    return out


def frequent(texts: DataFrame, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(lang, k, phrase, c) of all phrases of one to three words with at least ``least`` occurrences; k = 0 holds all words of a language."""
    conf, key = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(TEXTS))
    try:
        return _frequent(texts, least, sample)
    finally:
        conf.set(key, before)


def _frequent(texts: DataFrame, least: int, sample: int) -> DataFrame:
    context = texts.sparkSession.sparkContext
    chosen = texts.withColumn("sampled", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(sample)) == 0)
    texts = texts.withColumn("sampled", F.lit(True))
    # All words count: they are the border of the empty phrase. Pairs are proposed with a lower bar in proportion.
    proposed = checkpointed(_hash_sums(chosen, F.when(F.expr(OF_WORD), least).otherwise(max(2, 4 * least // (5 * sample)))))
    filters = [context.broadcast(_filter(proposed))]
    sums = checkpointed(proposed.where(OF_WORD).unionByName(_hash_sums(texts, F.lit(least), filters)))
    worth = context.broadcast(_filter(sums))
    failed = checkpointed(_outside(sums.where("h & 3 < 3"), filters))
    new = context.broadcast(_filter(failed))
    found = passes = checkpointed(_phrase_sums(texts, least, filters, new, worth))
    while True:
        filters = [*filters, new]
        failed = checkpointed(_outside(_hashed(passes.where("k in (1, 2)")), filters))
        if failed.isEmpty():
            return found
        new = context.broadcast(_filter(failed))
        passes = checkpointed(_phrase_sums(texts, least, filters, new))
        found = found.unionByName(passes)


def _cut(freq: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every frequent phrase of two or three words at its lowest-scoring cut."""

    def part(n: int) -> Column:
        return F.substring_index("phrase", " ", n)

    def at_cuts(k: int) -> DataFrame:
        cuts = [F.struct(F.lit(n).alias("cut"), part(n).alias("left"), part(n - k).alias("right")) for n in range(1, k)]
        return freq.where(F.col("k") == k).select("lang", "phrase", F.col("c").alias("a"), F.inline(F.array(*cuts)))

    counts = freq.where("k in (1, 2)")
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r"))
    # l and r are at least a, so no score exceeds 1000000; the products pass 64 bits and stay exact up to 10**15 occurrences.
    score = F.expr("cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    pairs, triples = (at_cuts(k).join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score) for k in (2, 3))
    best = triples.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    out = ["lang", "phrase", "a", "l", "r", "score"]
    return pairs.select(*out).unionByName(best.select("lang", "phrase", "a", "s.l", "s.r", "s.score"))


def collocations(docs: DataFrame, least: int = LEAST, held: int = HELD, sample: int = SAMPLE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two or three words of ``docs`` that are collocations of their language.

    Texts are put in lower case (A-Z), cut into pieces at punctuation and line ends and these into words. a counts the phrase,
    l and r the parts at its lowest-scoring cut (the earliest of equals), n all words; score is floor(1000000 * a * a / (l * r)).
    A pair inside a triple that has ``held`` per cent of its occurrences is left out. A null text is empty, a null lang is
    ``und``; repeated rows count every time; without words the result is empty. Other columns are not read.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    freq = frequent(texts, least, sample)
    inside = freq.where("k = 3").select("lang", "c", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("c").alias("longer"))
    kept = _cut(freq).join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * held))
    totals = freq.where("k = 0").select("lang", F.col("c").alias("n"))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")
