"""The pipeline's near-duplicate stage against all pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from oddsmill.llm import common, simhash

WORDS = [f"w{k}" for k in range(4000)]


def edited(rng: random.Random, words: list[str], share: float) -> list[str]:
    out = list(words)
    if rng.random() < 0.5:  # a block at the end
        n = max(1, int(share * len(out) / 2))
        out[-n:] = rng.choices(WORDS, k=n)
    else:  # single words
        for k in rng.sample(range(len(out)), max(1, int(share * len(out) / 11))):
            out[k] = rng.choice(WORDS)
    return out


def corpus() -> list[str | None]:
    rng = random.Random(31)
    texts: list[str | None] = []
    for _ in range(90):
        base = rng.choices(WORDS, k=rng.choice((8, 40, 120, 400)))
        texts += [" ".join(edited(rng, base, s)) for s in (0.02, 0.1, 0.2, 0.25, 0.3)]
    chain = rng.choices(WORDS, k=200)
    for _ in range(60):  # each close to the one before, the ends far apart
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 0.15)
    base = rng.choices(WORDS, k=300)  # a group in which most comparisons fail
    texts += [" ".join(edited(rng, edited(rng, base, 0.35), 0.3)) for _ in range(60)]
    texts += [" ".join(base[:k] + rng.choices(WORDS, k=1) + base[k + 1 :]) for k in range(0, 300, 5)]
    lines = " " + " ".join(["-"] * 900)
    texts += [" ".join(rng.choices(WORDS, k=200)) + lines for _ in range(3)]
    return texts + [None, "", " \n", texts[0], texts[0].replace(" ", "\n"), texts[0].upper()]


def shingles(text: str | None) -> frozenset[str]:
    w = (text or "").lower().split()
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_of(n: int, pairs: list[tuple[int, int]]) -> set[int]:
    root = list(range(n))

    def top(k: int) -> int:
        return k if root[k] == k else top(root[k])

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {top(k) for k in range(n)}


def within(f: int, g: int) -> bool:
    bits = (f ^ g) & (1 << 64) - 1
    thirds = (bits >> 43, bits >> 22 & (1 << 21) - 1, bits & (1 << 22) - 1)
    return bits.bit_count() <= simhash.TOTAL and min(t.bit_count() for t in thirds) <= simhash.LEAD


def test_every_link_within_the_budget(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    fps = [simhash.fingerprint_of(np.unique(simhash.shingle_hashes((t or "").encode(), 3))) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    band = [(a, b) for a, b in near if jaccard(sets[a], sets[b]) < 0.86]
    met = [p for p in near if within(fps[p[0]], fps[p[1]])]
    assert len(band) > 150 and len(set(band) & set(met)) >= 0.9 * len(band)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(frame).collect()}
    assert kept == kept_of(len(texts), met)
    assert len(kept & set(range(len(texts) - 9, len(texts) - 6))) == 3  # texts that share only a long line of dashes


def test_small_nodes_and_equal_fingerprints(spark):
    """Nodes far smaller than the groups, and forty texts of one fingerprint."""
    rng = random.Random(7)
    base = rng.choices(WORDS, k=400)
    texts = [" ".join([*base[:k], "x", *base[k:]]) for k in range(40)] + [" ".join(rng.choices(WORDS, k=50)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("id"), simhash._text_name(F.col("text")).alias("name"), simhash.set_fingerprint(F.col("text"), 5).alias("s"))
    fp = F.when(F.col("id") < 40, F.lit(5).cast("bigint")).otherwise(F.col("s.fp"))
    rows = rows.select("id", "name", fp.alias("fp"), "s.low", "s.high")
    ids = {r.name: r.id for r in rows.collect()}
    found = [(ids[r.a], ids[r.b]) for r in simhash.candidates(rows.drop("id"), simhash.Budget(16, 21, 3), node=16).collect()]
    assert kept_of(50, found) == {0, *range(40, 50)}


def test_rows_nulls_and_clashing_names(spark):
    schema = "doc_id long, text string, kept_id long, Text_Name string, kept_n int, kept_name int, n int, id int, name string, a int, s int"
    rows = [(2, "one two three four five six", 1, "x", 1, 1, 1, 1, "y", 1, 1), (2, "one two three four five six", 2, "z", 1, 1, 1, 1, "y", 1, 1),
            (None, "one two three four five six", 3, "x", 1, 1, 1, 1, "y", 1, 1), (None, "only here", 4, "x", 1, 1, 1, 1, "y", 1, 1),
            (None, None, 5, None, None, None, None, None, None, None, None), (9, " ", 6, "x", 1, 1, 1, 1, "y", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = simhash.deduplicated(docs)
    assert got.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, rows[0][1]), (None, "only here"), (9, " ")], key=str)
    assert simhash.deduplicated(docs.where("false")).count() == 0


def test_rotations_go_down_together(spark):
    """All rotations in one pass give the pairs of a pass for each, and the driver's jobs don't grow with their number."""
    rng = random.Random(3)
    bases = [rng.choices(WORDS, k=120) for _ in range(6)]
    texts = [" ".join(edited(rng, base, 0.1)) for base in bases for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(simhash._text_name(F.col("text")).alias("name"), simhash.set_fingerprint(F.col("text"), 5).alias("s")).select("name", "s.fp", "s.low", "s.high")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    budgets = [simhash.Budget(simhash.TOTAL, lead, simhash.LEAD) for _, lead in simhash.TURNS]
    turned = [rows.withColumn("fp", simhash._turned(F.col("fp"), by)) for by, _ in simhash.TURNS]
    apart = {tuple(r) for t, budget in zip(turned, budgets) for r in simhash.candidates(t, budget, node=8).collect()}
    every = turned[0].withColumn("turn", F.lit(0)).union(turned[1].withColumn("turn", F.lit(1))).union(turned[2].withColumn("turn", F.lit(2)))
    assert apart and {tuple(r) for r in simhash.candidates(every, budgets, node=8).collect()} == apart
    spark.sparkContext.setJobGroup("near-copies", "")
    assert simhash.deduplicated(docs).count() < len(texts)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-copies"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 95


def test_likely_keeps_wanted_rows_of_any_columns(spark):
    """All wanted rows, nulls too, and hardly another; helper columns clash with none."""
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.col("id").alias("_word"), F.col("id").alias("__bits"))
    wanted = spark.createDataFrame([(None,), *[(k,) for k in range(7, 20_000, 100)]], "name long")
    got = common.likely(rows, "doc_id", wanted, "name")
    assert got.columns == rows.columns
    found = {r["_word"] for r in got.collect()}
    assert {0, *range(7, 20_000, 100)} <= found and len(found) < 300
    assert common.likely(rows, "doc_id", wanted.limit(0), "name").count() == 0


def test_shingles_by_word_hashes():
    """As many distinct shingles as by their text, the same ones equal; texts of fewer words are one shingle."""
    rng = random.Random(4)
    words = [rng.choice("abcdefgh") for _ in range(3000)]
    for n in (0, 1, 4, 5, 6, 200, 3000):
        text = " ".join(words[:n]).encode()
        plain, joined = simhash.shingle_hashes(text, 5), simhash.joined_hashes(simhash.word_hashes(text), 5)
        assert len(plain) == len(joined) and len(set(plain.tolist())) == len(set(joined.tolist())) == len(set(zip(plain.tolist(), joined.tolist())))


def test_first_round_sends_texts_to_few_nodes(spark, monkeypatch):
    """Texts of one round fit eight times as many to a node pair as those that keep many forests."""
    sizes, whole = [], simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda texts, budgets, forests, node: sizes.append((forests, node)) or whole(texts, budgets, forests, node))
    docs = spark.createDataFrame([(k, " ".join(f"w{k * 7 + j}" for j in range(30))) for k in range(40)], "doc_id long, text string")
    assert simhash.deduplicated(docs).count() == 40
    assert sizes[0] == (1, 8 * simhash.TEXTS) and all(node == simhash.TEXTS for _, node in sizes[1:])
