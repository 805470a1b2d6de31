"""Convolutional text classifier in numpy, with thresholds by language.

A word's embedding is the sum of hashed rows for the word and its beginnings. Filters one, two and three words wide run over
the text, each keeps its largest response, and a logistic layer weighs them. The classifier is fitted on all labelled rows:
they are dealt into shards, tasks go on from the same numbers with a shard each, and the mean of what they come to is where the
next round starts. A fifth of the rows sets one threshold per language, which is guessed from the words of a text; scores are
stretched so that every threshold lies at DECISION.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.llm.common import checkpointed, likely, split_of

SHARD = 32 << 20  # bytes of labelled text that a task fits on at a time, about
PIECE = 1024  # numbers of the model that are averaged at a time
BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
BEGINNINGS = (4, 5)
ROUNDS, EPOCHS, BATCH, RATE = 3, 2, 64, 0.05  # a round is so many epochs in every shard
BINS = 256  # steps of a logit by which the rows that set the thresholds are counted
CHUNK = 200_000  # words worked on at a time
DECISION = 0.3

WORD = re.compile(r"[^\W\d_]+")
# Frequent words that tell the languages apart.
COMMON = {
    "en": "the of and to in that it is was for with as on be are this by from or",
    "de": "der die und das den von zu mit ist im dem nicht ein eine als auf sich für des",
    "fr": "le la les et des du un une que qui dans pour par sur est au avec en de pas",
    "es": "el los las y que del se por con una su para al lo como más o en de la no",
}
LANGUAGES = ("", *COMMON)
VOTES = {w: np.array([0.0, *[float(w in text.split()) for text in COMMON.values()]]) / sum(w in t.split() for t in COMMON.values())
         for w in {w for text in COMMON.values() for w in text.split()}}
NO_VOTE = np.zeros(len(LANGUAGES))


def rows_of(word: str) -> list[int]:
    """Rows of the embedding table that make up a word; row 0 stands between texts."""
    return table_of([word])[0].tolist()


def table_of(words: list[str]) -> np.ndarray:
    """Embedding rows of words, of the word and of its beginnings with their lengths; the empty word is the gap between texts, row 0."""
    columns = [[zlib.crc32(w.encode()) for w in words]]
    for n in BEGINNINGS:
        named = zlib.crc32(f"{n}:".encode())
        columns.append([zlib.crc32(w[:n].encode(), named) for w in words])
    table = (1 + np.array(columns, np.int64).T % (BUCKETS - 1)).astype(np.int32)
    table[[k for k, w in enumerate(words) if not w]] = 0
    return table


@dataclass
class Flat:
    """Texts as one array of word numbers, with gaps (0) after each text, in which windows that start in it may end."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray  # start of the gaps


def flatten(texts: list[np.ndarray]) -> Flat:
    gap = max(WIDTHS) - 1
    sizes = np.array([max(1, len(t)) for t in texts])
    starts = np.cumsum(sizes + gap) - sizes - gap
    ids = np.zeros(int(sizes.sum()) + gap * len(texts), np.int32)
    for at, t in zip(starts, texts):
        ids[at : at + len(t)] = t
    return Flat(ids, starts, starts + sizes)


def numbering() -> defaultdict[str, int]:
    """Numbers for words as they come; the gap is number 0."""
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__
    index[""] = 0
    return index


def numbered(texts: Iterable[str], index: defaultdict[str, int]) -> list[np.ndarray]:
    """Texts as arrays of word numbers; new words are added to the index."""
    found = (WORD.findall(t.lower()) for t in texts)
    return [np.fromiter(map(index.__getitem__, words), np.int32, len(words)) for words in found]


# The numbers of a model one after the other: embedding, filters, their biases, output layer and its bias.
SHAPES = [(BUCKETS, DIM), *[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS], (FILTERS * len(WIDTHS),), (1,)]
ENDS = np.cumsum([np.prod(shape) for shape in SHAPES]).tolist()


def parts(numbers: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Views of them: embedding, filters, biases, output layer, its bias."""
    emb, *rest = [numbers[end - np.prod(shape) : end].reshape(shape) for end, shape in zip(ENDS, SHAPES)]
    return emb, rest[: len(WIDTHS)], rest[len(WIDTHS) : 2 * len(WIDTHS)], rest[-2], rest[-1]


@dataclass
class Model:
    emb: np.ndarray
    conv: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None  # where there is nothing to learn

    @classmethod
    def of(cls, numbers: np.ndarray) -> Model:
        *layers, out_bias = parts(numbers)
        return cls(*layers, float(out_bias[0]))

    def pooled(self, flat: Flat, table: np.ndarray) -> np.ndarray:
        """Largest response of every filter per text; convolution is linear, so words are projected once and added up along the text."""
        e = self.emb[table].sum(axis=1)
        pooled = []
        for w, weights, bias in zip(WIDTHS, self.conv, self.bias):
            n = len(flat.ids) - w + 1
            act = (e @ weights[0])[flat.ids[:n]]
            for m in range(1, w):
                act += (e @ weights[m])[flat.ids[m : m + n]]
            edges = np.stack([flat.starts, np.minimum(flat.ends, n)], 1).ravel()
            best = np.maximum.reduceat(np.concatenate([act, np.full((1, FILTERS), -np.inf, act.dtype)]), edges, axis=0)[::2]
            pooled.append(np.maximum(best + bias, 0))
        return np.concatenate(pooled, axis=1)

    def logits(self, flat: Flat, table: np.ndarray) -> np.ndarray:
        return self.pooled(flat, table) @ self.out + self.out_bias

    def score(self, logit: np.ndarray, language: list[str]) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        t = np.array([self.thresholds.get(x, self.thresholds[""]) for x in language])
        return np.where(p < t, DECISION * p / t, DECISION + (1 - DECISION) * (p - t) / (1 - t))

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1 per text, 0 for texts without words; long texts are worked on in pieces, over which the filters keep their maximum."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            index = numbering()
            first, total, chunk = at, 0, []
            while at < len(texts) and total < CHUNK:
                chunk += numbered(texts[at : at + 1], index)
                total += len(chunk[-1])
                at += 1
            words = list(index)
            table, votes = table_of(words), votes_of(words)
            if max(map(len, chunk)) <= CHUNK:
                logit = self.logits(flatten(chunk), table)
            else:
                logit = np.array([self.long_logit(ids, table) for ids in chunk])
            worded = np.array([len(ids) > 0 for ids in chunk])
            out[first:at] = np.where(worded, self.score(logit, [language_of(ids, votes) for ids in chunk]), 0.0)
        return out

    def long_logit(self, ids: np.ndarray, table: np.ndarray) -> float:
        """The logit of one text of any length: pieces lap over, so that every window is met once, and are pooled together."""
        best = np.zeros(self.out.shape, self.out.dtype)  # no response is below zero
        for s in range(0, max(1, len(ids)), CHUNK):
            piece = flatten([ids[s : s + CHUNK + max(WIDTHS) - 1]])
            if s + CHUNK < len(ids):
                piece.ends = np.minimum(piece.ends, CHUNK)
            best = np.maximum(best, self.pooled(piece, table)[0])
        return float(best @ self.out + self.out_bias)


def votes_of(words: list[str]) -> np.ndarray:
    return np.array([VOTES.get(w, NO_VOTE) for w in words])


def language_of(ids: np.ndarray, votes: np.ndarray) -> str:
    total = votes[ids].sum(axis=0)
    return LANGUAGES[int(total.argmax())] if total.any() else ""


@dataclass
class Labelled:
    """Labelled texts as word numbers; every fifth is held back for the thresholds and has its language."""

    tokens: list[np.ndarray]
    labels: np.ndarray
    table: np.ndarray
    languages: np.ndarray  # of every fifth, as places in LANGUAGES

    @classmethod
    def of(cls, texts: Iterable[str], labels: np.ndarray) -> Labelled:
        index = numbering()
        tokens = numbered(texts, index)
        votes = votes_of(list(index))
        return cls(tokens, np.asarray(labels, np.int8), table_of(list(index)),
                   np.array([LANGUAGES.index(language_of(t, votes)) for t in tokens[4::5]], np.int8))

    def packed(self) -> bytes:
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        arrays = [np.array([len(sizes), int(sizes.sum()), len(self.table)], np.int64), sizes, np.concatenate([*self.tokens, np.empty(0, np.int32)]),
                  self.table, self.labels, self.languages]
        raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, body: bytes) -> Labelled:
        raw, at = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True), 0

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return np.frombuffer(raw, kind, n, at - n * np.dtype(kind).itemsize)

        texts, words, kinds = take(np.int64, 3).tolist()
        sizes, ids = take(np.int64, texts), take(np.int32, words)
        table = take(np.int32, kinds * (1 + len(BEGINNINGS))).reshape(kinds, -1)
        return cls(np.split(ids, np.cumsum(sizes)[:-1]) if texts else [], take(np.int8, texts), table, take(np.int8, texts // 5))

    def learned(self) -> np.ndarray:
        return np.flatnonzero(np.arange(len(self.labels)) % 5 != 4)


def start(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first numbers of a model and Adagrad's sums of squares."""
    rng = np.random.default_rng(seed)
    numbers = np.zeros(ENDS[-1], np.float32)
    emb, conv, _, out, _ = parts(numbers)
    emb[1:] = rng.normal(0, 0.1, (BUCKETS - 1, DIM))
    for w, weights in zip(WIDTHS, conv):
        weights[:] = rng.normal(0, (1 / (w * DIM)) ** 0.5, weights.shape)
    out[:] = rng.normal(0, 0.3, out.shape)
    return numbers, np.full_like(numbers, 1e-3)


def epoch(numbers: np.ndarray, squares: np.ndarray, rows: Labelled, weights_of: tuple[float, float], order: np.ndarray) -> None:
    """One pass of Adagrad on the logistic loss over the rows in this order; ``weights_of`` are those of the two labels."""
    emb, conv, bias, out, out_bias = parts(numbers)
    emb2, conv2, bias2, out2, out_bias2 = parts(squares)
    for at in range(0, len(order), BATCH):
        batch = order[at : at + BATCH]
        labels = rows.labels[batch].astype(np.float32)
        flat = flatten([rows.tokens[r] for r in batch])
        distinct, ids = np.unique(flat.ids, return_inverse=True)
        hashed = rows.table[distinct]
        e = emb[hashed].sum(axis=1)
        places, pooled = [], []
        for w, weights, b in zip(WIDTHS, conv, bias):
            n = len(ids) - w + 1
            act = (e @ weights[0])[ids[:n]]
            for m in range(1, w):
                act += (e @ weights[m])[ids[m : m + n]]
            place = np.stack([act[s:t].argmax(axis=0) + s for s, t in zip(flat.starts, flat.ends)])
            places.append(place)
            pooled.append(np.maximum(np.take_along_axis(act, place, 0) + b, 0))
        hidden = np.concatenate(pooled, axis=1)
        logit = hidden @ out + out_bias[0]
        weight = np.where(labels == 1, weights_of[1], weights_of[0])
        wrong = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) * weight).astype(np.float32) / len(batch)
        back = wrong[:, None] * out * (hidden > 0)
        moved_rows, moved = [], []
        for k, (w, weights) in enumerate(zip(WIDTHS, conv)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            gw = np.empty_like(weights)
            for m in range(w):
                word = ids[places[k] + m]
                gw[m] = np.einsum("bf,bfd->df", g, e[word])
                moved_rows.append(hashed[word].reshape(-1, hashed.shape[1]))
                moved.append((g[..., None] * weights[m].T).reshape(-1, DIM))
            conv2[k] += gw**2
            weights -= RATE * gw / np.sqrt(conv2[k])
            gb = g.sum(axis=0)
            bias2[k] += gb**2
            bias[k] -= RATE * gb / np.sqrt(bias2[k])
        go = hidden.T @ wrong
        out2 += go**2
        out -= RATE * go / np.sqrt(out2)
        out_bias2 += wrong.sum() ** 2
        out_bias -= RATE * wrong.sum() / np.sqrt(out_bias2)
        at_rows, grads = np.concatenate(moved_rows), np.concatenate(moved)
        touched, inverse = np.unique(at_rows.ravel(), return_inverse=True)
        total = np.zeros((len(touched), DIM), np.float32)
        np.add.at(total, inverse, np.repeat(grads, at_rows.shape[1], axis=0))
        total[touched == 0] = 0
        emb2[touched] += total**2
        emb[touched] -= RATE * total / np.sqrt(emb2[touched])


def one_round(numbers: np.ndarray, squares: np.ndarray, rows: Labelled, weights_of: tuple[float, float], seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """What a round on these rows alone leads to."""
    numbers, squares = numbers.copy(), squares.copy()
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        epoch(numbers, squares, rows, weights_of, rng.permutation(rows.learned()))
    return numbers, squares


def weights_by_label(n: int, ones: int) -> tuple[float, float]:
    """Classes are weighed alike."""
    share = ones / max(n, 1)
    return 0.5 / max(1 - share, 1e-6), 0.5 / max(share, 1e-6)


def tallied(model: Model, rows: Labelled) -> list[tuple[int, int, int, int, float, float]]:
    """(place of the language, bin, ones, zeros, least and largest probability) of the rows held back."""
    held = range(4, len(rows.tokens), 5)
    logit = np.empty(len(held))
    for at in range(0, len(held), BATCH):
        flat = flatten([rows.tokens[r] for r in held[at : at + BATCH]])
        distinct, flat.ids = np.unique(flat.ids, return_inverse=True)
        logit[at : at + BATCH] = model.logits(flat, rows.table[distinct])
    logit = np.clip(logit, -30, 30)
    p, bins = 1 / (1 + np.exp(-logit)), np.floor(logit * BINS).astype(np.int64)
    keys, own = np.unique(np.stack([rows.languages, bins], 1), axis=0, return_inverse=True)
    ones = np.bincount(own, rows.labels[4::5], len(keys)).astype(np.int64)
    least, most = np.full(len(keys), np.inf), np.zeros(len(keys))
    np.minimum.at(least, own, p)
    np.maximum.at(most, own, p)
    n = np.bincount(own, minlength=len(keys))
    return list(zip(*keys.T.tolist(), ones.tolist(), (n - ones).tolist(), least.tolist(), most.tolist()))


def thresholds_of(tally: list[tuple[int, int, int, int, float, float]]) -> dict[str, float]:
    """A threshold of all rows held back and one of every language with 20 toxic ones."""
    out = {"": _threshold(tally)}
    for k, language in enumerate(LANGUAGES):
        own = [row for row in tally if row[0] == k]
        if language and sum(row[2] for row in own) >= 20:
            out[language] = _threshold(own)
    return out


def _threshold(tally: list[tuple[int, int, int, int, float, float]]) -> float:
    """Where F1 is largest, counted as if toxic rows were a tenth; in the middle of the gap between two bins."""
    by_bin: dict[int, list] = {}
    for _, place, ones, zeros, least, most in tally:
        known = by_bin.setdefault(place, [0, 0, least, most])
        by_bin[place] = [known[0] + ones, known[1] + zeros, min(known[2], least), max(known[3], most)]
    rows = [by_bin[place] for place in sorted(by_bin, reverse=True)]
    ones, zeros = (np.array([row[k] for row in rows], float) for k in (0, 1))
    if not ones.sum() or not zeros.sum():
        return 0.5
    hit, miss = np.cumsum(ones) / ones.sum(), np.cumsum(zeros) / zeros.sum()
    f1 = 2 * 0.1 * hit / (0.1 * hit + 0.9 * miss + 0.1)
    k = int(f1.argmax())
    below = rows[k + 1][3] if k + 1 < len(rows) else 0.0
    return float(np.clip((rows[k][2] + below) / 2, 0.02, 0.98))


def _constant(n: int, ones: int) -> Model | None:
    """The model where all labels are one, or none is there."""
    return None if 0 < ones < n else Model(*parts(np.zeros(ENDS[-1], np.float32))[:4], 0.0, constant=float(ones > 0))


def fit(texts: list[str], labels: np.ndarray, seed: int = 1) -> Model:
    """A model of one shard of texts; see ``fitted``."""
    rows = Labelled.of(texts, labels)
    if model := _constant(len(texts), int(rows.labels.sum())):
        return model
    own = rows.labels[rows.learned()]
    numbers, squares = start(seed)
    for k in range(ROUNDS):
        numbers, squares = one_round(numbers, squares, rows, weights_by_label(len(own), int(own.sum())), (seed, k, 0))
    model = Model.of(numbers)
    model.thresholds = thresholds_of(tallied(model, rows))
    return model


def _shards(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(shard, n, ones, learned, learned_ones, body): the texts of ``docs`` with the labels of ``named``, dealt by a hash of doc_id.

    ``named`` has a row per doc_id; docs without a label mostly stay behind, the rest is told in the shard.
    """
    rows = likely(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), "doc_id", named, "doc_id")
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(-(-size // SHARD) or 1)).cast("int").alias("shard")
    both = rows.select(shard, "doc_id", F.xxhash64("doc_id", "_text").alias("h"), "_text").unionByName(
        named.select(shard, "doc_id", "_label"), allowMissingColumns=True)

    def encode(group: pa.Table) -> pa.Table:
        named_ = group.select(["doc_id", "_label"]).filter(pc.is_valid(group["_label"])).combine_chunks()
        at = pc.index_in(group["doc_id"], value_set=pa.array(named_["doc_id"].to_pylist(), group.schema.field("doc_id").type))
        there = pc.and_(pc.is_valid(at), pc.is_null(group["_label"])).to_numpy()
        rows_at = np.flatnonzero(there)
        rows_at = rows_at[np.argsort(group["h"].filter(pa.array(there)).to_numpy(), kind="stable")]
        labels = named_["_label"].to_numpy()[at.fill_null(0).to_numpy()[rows_at]] if len(rows_at) else np.empty(0, np.int8)
        # Texts are read one by one; copies of a shard's texts would add up in the workers.
        rows_ = Labelled.of((group["_text"][k].as_py() for k in rows_at.tolist()), labels)
        own = rows_.labels[rows_.learned()]
        columns = [group["shard"][:1], [len(labels)], [int(labels.sum())], [len(own)], [int(own.sum())], [rows_.packed()]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c.to_pylist() if isinstance(c, pa.ChunkedArray) else c, kind) for c, kind in zip(columns, kinds)],
                        ["shard", "n", "ones", "learned", "learned_ones", "body"])

    schema = "shard int, n long, ones long, learned long, learned_ones long, body binary"
    return both.groupBy("shard").applyInArrow(encode, schema)


def _averaged(shards: DataFrame, numbers: np.ndarray, squares: np.ndarray, weights_of: tuple[float, float], seed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A round in every shard; a number becomes the mean over the shards that moved it, by their rows."""
    starts = np.arange(0, len(numbers), PIECE)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                got = one_round(numbers, squares, Labelled.unpacked(body.as_py()), weights_of, (seed, k, shard))
                offsets = pa.array(np.append(starts, len(numbers)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(starts), pa.array([shard] * len(starts), pa.int32()), pa.array([n] * len(starts), pa.int64()),
                     *[pa.ListArray.from_arrays(offsets, pa.array(v)) for v in got]], ["start", "shard", "n", "numbers", "squares"])

    def mean(group: pa.Table) -> pa.Table:
        # In the order of the shards, so that sums do not depend on how they arrive.
        group = group.sort_by("shard").combine_chunks()
        first = group["start"][0].as_py()
        v, s = (np.stack([x.values.to_numpy() for x in group[c]]).astype(np.float64) for c in ("numbers", "squares"))
        old, old2 = numbers[first : first + v.shape[1]], squares[first : first + v.shape[1]]
        n = group["n"].to_numpy()[:, None] * ((s != old2) | (v != old))
        total = n.sum(axis=0)
        v, s = (np.where(total > 0, (n * x).sum(axis=0) / np.maximum(total, 1), o) for x, o in ((v, old), (s, old2)))
        return pa.table([pa.array([first]), *[pa.array([x.astype(np.float32)], pa.list_(pa.float32())) for x in (v, s)]], ["start", "numbers", "squares"])

    pieces = shards.where("learned > 0").select("shard", "learned", "body").mapInArrow(
        follow, "start long, shard int, n long, numbers array<float>, squares array<float>")
    got = pieces.groupBy("start").applyInArrow(mean, "start long, numbers array<float>, squares array<float>").toArrow().sort_by("start")
    return tuple(got[c].combine_chunks().flatten().to_numpy().copy() for c in ("numbers", "squares"))


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", seed: int = 1) -> Model:
    """A model of all labelled rows for which ``learn`` (a condition on doc_id) holds.

    Texts stay with the tasks; the driver holds the model and a count per shard and per bin of the logits. A doc_id labelled
    twice counts with its larger label, null labels count for nothing.
    """
    named = labels.where(F.col(label).isin(0, 1) & learn & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    named = checkpointed(named.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "_label"))
    shards = checkpointed(_shards(docs, named))
    n, ones, learned, learned_ones = (x or 0 for x in shards.agg(*[F.sum(c) for c in ("n", "ones", "learned", "learned_ones")]).first())
    if model := _constant(n, ones):
        return model
    numbers, squares = start(seed)
    for k in range(ROUNDS):
        numbers, squares = _averaged(shards, numbers, squares, weights_by_label(learned, learned_ones), seed, k)
    model = Model.of(numbers)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                columns = zip(*tallied(model, Labelled.unpacked(body.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["language", "bin", "ones", "zeros", "least", "most"])

    counted = shards.where("n >= 5").select("body").mapInArrow(held, "language long, bin long, ones long, zeros long, least double, most double")
    sums = counted.groupBy("language", "bin").agg(F.sum("ones"), F.sum("zeros"), F.min("least"), F.max("most"))
    model.thresholds = thresholds_of([tuple(r) for r in sums.collect()])
    return model


def toxicity(text: Column, model: Model) -> Column:
    """Score from 0 to 1; null counts as empty and scores 0. Texts with a score of DECISION or more are rejected."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()), pa.float64())

    return F.arrow_udf(of, "double")(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    return split_of(doc_id, 4) == 2
