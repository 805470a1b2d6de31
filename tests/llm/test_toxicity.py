"""The classifier's logits against a direct convolution, for texts in one piece and in many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsmill.llm import toxicity


def direct_logit(model, words):
    """Every window of every width written out; windows at the end run into the gap, whose embedding is row 0."""
    def embedded(w):
        return sum(model.emb[r].astype(float) for r in (toxicity.rows_of(w) if w else [0] * 3))

    e = [embedded(w) for w in words] + [embedded("")] * max(toxicity.WIDTHS)
    pooled = []
    for width, weights, bias in zip(toxicity.WIDTHS, model.conv, model.bias):
        windows = [sum(e[i + m] @ weights[m].astype(float) for m in range(width)) + bias for i in range(len(words))]
        pooled.append(np.maximum(np.max(windows, axis=0), 0))
    return float(np.concatenate(pooled) @ model.out + model.out_bias)


@pytest.mark.parametrize("chunk", [5, 7, 200_000])
def test_scores_by_direct_convolution(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)]
    texts = [" ".join(rng.choices(words, k=rng.choice((1, 2, 5, 6, 7, 8, 14, 40)))) for _ in range(60)]
    labels = np.array(["wac" in t or "wbb" in t for t in texts], float)
    model = toxicity.fit(texts, labels)
    want = np.array([direct_logit(model, t.split()) for t in texts])
    got = model.scores(["", "123 !", *texts])
    assert got[:2].tolist() == [0.0, 0.0]
    assert np.allclose(got[2:], model.score(want, [""] * len(texts)), atol=1e-4)


@pytest.mark.parametrize("size", [1 << 25, 100_000])
def test_all_labelled_rows_are_learned(spark, monkeypatch, size):
    """Of 7,000 toxic rows those that come last by the hash of doc_id have a word of their own; in one shard and in several."""
    monkeypatch.setattr(toxicity, "SHARD", size, raising=False)
    rng = random.Random(7)
    words = [f"w{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)]
    ids = spark.range(14_000).select("id", F.xxhash64(F.col("id").cast("int")).alias("h")).orderBy("h").toPandas()["id"].tolist()
    toxic = {d: ("alpha" if k < 5_000 else "omega") for k, d in enumerate(d for d in ids if d % 2)}
    texts = [" ".join(rng.choices(words, k=6) + ([toxic[d]] if d in toxic else [])) for d in range(14_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(14_000)], "doc_id int, toxic int")
    model = toxicity.fitted(docs, labels, F.lit(True))
    scores = model.scores([" ".join(rng.choices(words, k=6) + [w]) for w in ("alpha", "omega", words[0]) for _ in range(50)])
    assert [(part >= toxicity.DECISION).mean() for part in scores.reshape(3, 50)] == [1.0, 1.0, 0.0]


def test_one_shard_is_fit(spark):
    """The tasks' rounds give what the same rows give in one process."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["red", "green", "blue", "grobian", "stone"], k=5)) for _ in range(300)]
    rows = spark.createDataFrame([(d, t, int("grobian" in t)) for d, t in enumerate(texts)], "doc_id long, text string, toxic int")
    model = toxicity.fitted(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.lit(True))
    by_hash = rows.orderBy(F.xxhash64("doc_id", "text")).toPandas()
    want = toxicity.fit(by_hash["text"].tolist(), by_hash["toxic"].to_numpy())
    assert np.array_equal(model.emb, want.emb) and np.array_equal(model.out, want.out) and model.thresholds == want.thresholds
