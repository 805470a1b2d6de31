"""Collocations, periodic runs and secrets against brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import compare
from oddsmill.llm import collocations, periodic, queries, secretscan

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, phrase string, a long, hash string, owner string, found string"
ODD = [None, "", " \n", "one", "same text here", "same text here", "x " * 30_000, "x. " * 300, "é" * 40 + " ünd"]


def docs_of(spark, texts, langs=("en", "de", None)):
    rows = [(k if k % 5 else None, t, langs[k % len(langs)], f"s{k % 7}" if k % 4 else None, 1, "x", "x", 2, "x", "x", "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def table(tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def phrases_by_hand(rows, least=10):
    """{lang: [(score, a, phrase, l, r, n)]} counted with plain loops."""
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 2 * c >= a and c >= least for q, c in f.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r, words[lang]))
        out[lang] = sorted(rows)
    return out


def phrase_texts(rng, n=120):
    base = ["new york city", "Of the", "in spite of", "ice cream", "à la carte"]
    texts = []
    for _ in range(n):
        w = [rng.choice(base) if rng.random() < 0.3 else f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(60)]
        texts.append(" ".join(x + rng.choice(["", "", "", ",", ".\n", "\t", "\x0b"]) for x in w))
    return texts


@pytest.mark.parametrize("sample", [1, 4, 10**9])
def test_collocations_by_hand_whatever_the_sample_proposes(spark, sample):
    """A sample of nothing proposes nothing: every phrase then comes in by the border, in further passes."""
    docs = docs_of(spark, [*phrase_texts(random.Random(5)), *ODD])
    got = defaultdict(list)
    for r in collocations.collocations(docs, sample=sample).collect():
        got[r.lang].append((-r.score, -r.a, r.phrase.encode(), r.l, r.r, r.n))
    want = phrases_by_hand([(r.text, r.lang) for r in docs.collect()])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert sum(map(len, got.values())) > 20


def test_collocation_counts_reach_over_steps_and_texts(spark, monkeypatch):
    texts = [t.encode() for t in phrase_texts(random.Random(6), 20)]

    def total():
        c, batch = Counter(), pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": [t.decode() for t in texts], "sampled": [True] * len(texts)})
        for part in collocations._parts([batch]):
            pair, triple = np.flatnonzero(part.pair[: part.n]), np.flatnonzero(part.triple[: part.n])
            for b in collocations._phrase_counts(part, np.ones(len(part.names), bool), pair, triple):
                for r in b.to_pylist():
                    c[r["k"], r["phrase"]] += r["c"]
        return c

    whole = total()
    monkeypatch.setattr(collocations, "STEP", 37)
    assert total() == whole


def test_collocation_filter_has_no_false_misses(spark):
    rows = [("en", f"w{k}") for k in range(500)] + [("en", f"w{k} v{k % 7}") for k in range(500)]
    hashes = collocations._hashed(spark.createDataFrame(rows, "lang string, phrase string"))
    bits = collocations._filter(hashes)
    held = lambda lang: collocations._held([bits], np.concatenate([collocations._word_hashes(lang, [p.encode()]) for _, p in rows[:500]]))
    assert held("en").all() and held("de").mean() < 0.05
    assert collocations._outside(hashes, [spark.sparkContext.broadcast(bits)]).count() == 0


def test_opened_phrases_are_the_difference_of_two_filters(spark):
    rng = random.Random(12)
    part = collocations.Part("en", collocations.tokens([t.encode() for t in phrase_texts(rng, 30)]))
    hashes = np.unique(np.concatenate([part.h[1:], part.ph[part.pair]]))

    def bits(share):
        out = np.zeros(1 << 12 >> 3, np.uint8)  # few bits, so that false hits occur
        for s in collocations._slots(hashes[np.random.default_rng(share).random(len(hashes)) < share / 10], 1 << 12):
            np.bitwise_or.at(out, s >> 3, np.left_shift(1, s & 7).astype(np.uint8))
        return out

    old, new = bits(6), bits(5)
    after, before, opened = part.known([old, new]), part.known([old]), part.opened([old], new)
    for a, b, o in zip(after, before, opened):
        assert (o == (a & ~b)).all() and o.any() and b.any()


def test_collocation_query_equals_sql_and_scores_stay_exact(spark, tmp_path):
    docs = docs_of(spark, [*phrase_texts(random.Random(7), 200), *ODD])
    path = table(tmp_path, docs)
    assert compare.diff(queries.op11_collocations(spark, path), queries.ORACLES["op11_collocations"], path) is None
    big = spark.createDataFrame(
        [("en", 2, "a b", 3_037_000_500_000), ("en", 1, "a", 3_037_000_500_001), ("en", 1, "b", 4_000_000_000_000)], "lang string, k int, phrase string, c long")
    row = collocations._cut(big).first()
    assert row.score == 10**6 * 3_037_000_500_000**2 // (3_037_000_500_001 * 4_000_000_000_000)
    empty = table(tmp_path / "empty", docs.where("false"))
    assert queries.op11_collocations(spark, empty).count() == 0


def runs_by_hand(w):
    out = []
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1 if j > i else i + 1
    return sorted(out)


def texts_with_runs(rng, n):
    texts = []
    for _ in range(n):
        w = []
        while len(w) < rng.randrange(1, 90):
            part = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 7))]
            w += part * rng.choice([1, 1, 2, 4, 5, 9])
            w += w[-rng.randrange(1, 4) :] if rng.random() < 0.3 else []
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    return texts


def test_runs_by_hand():
    rng = random.Random(8)
    words = [t.encode().split() for t in texts_with_runs(rng, 400)] + [[], [b"x"], [b"x"] * 5, [b"x"] * 6, [b"x"] * 4000, [b"a", b"b"] * 4]
    got = periodic.runs_of(words)
    assert got == [runs_by_hand(w) if len(w) < 1000 else [(0, 4000, 1)] for w in words]
    assert sum(map(len, got)) > 300


def test_positions_are_a_sorted_set(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 4)
    rng = random.Random(9)
    xs = rng.sample(range(1000), 200)
    p = periodic.Positions(xs[0])
    for k, x in enumerate(xs[1:], 1):
        have = sorted(xs[:k])
        before, after = [y for y in have if y < x], [y for y in have if y > x]
        assert p.around(x) == (before[-1] if before else -1, after[0] if after else -1)
        p.add(x)
    assert list(p) == sorted(xs) and p.size == 200 and len(p.blocks) > 40


def test_run_query_by_hand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 200)
    docs = docs_of(spark, [*texts_with_runs(random.Random(10), 150), *ODD, "a b c " * 100])
    path = table(tmp_path, docs)
    text_of = docs.collect()
    got = queries.op12_periodic_runs(spark, path).collect()
    want = []
    for r in text_of:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h = zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"")
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(w) if n < 5000 else periodic.runs_of([[x.encode() for x in w]])[0]
        gone = {i for s, l, q in runs for i in range(s + q, s + l)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     sha("".join(f"{s},{l},{q}\n" for s, l, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert queries.op12_periodic_runs(spark, table(tmp_path / "empty", docs.where("false"))).count() == 0


def secret_texts(rng):
    key = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(a) for _ in range(n))
    shared, own, bare = key(32), key(32), "Zk" + key(30) + "9a"
    texts = [f"é𝄞 Password: '{shared}' and ünd" for _ in range(6)] + [f"the key {shared} again", f"api_key={own}", f"bare {own} here", f"look {bare}"]
    texts += ["secret: token: abcdefgh", "token=ab token==abcdef", "SECRET = x", "apikey:'12345' passwd:\"123456\"", "AKIA" + "A1" * 8, "AKIAAKIA12 AKIA" + "Z" * 30, "f" * 23, "f" * 24 + "é" + "0" * 40]
    texts += [f"token = \"{key(40, '0123456789abcdef')}\" " * 300, key(16), "thanonontioniner 1234567890123456", "x" * 50 + "1"]
    return texts + ODD


def spans_by_hand(text):
    found = []
    for k, (name, pattern, group, least) in enumerate([
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]):
        found += [(m.start(), k, m.end(), m[group]) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def test_secrets_by_hand(spark, tmp_path):
    docs = docs_of(spark, secret_texts(random.Random(11)))
    docs = docs.union(docs.limit(4))  # repeated rows
    path = table(tmp_path, docs)
    rows = docs.collect()
    owners, labelled, everything = defaultdict(set), set(), []
    for r in rows:
        base = spans_by_hand(r.text or "")
        extra = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", r.text or "")
                 if re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0]) and all(b[0] >= m.end() or m.start() >= b[2] for b in base)]
        labelled |= {s[3] for s in base}
        for s in base + extra:
            owners[s[3]].add(r.source)
        everything.append((r.doc_id, base, extra))
    random_looking = lambda v: len(v) >= 20 and len(set(v)) >= 10 and all(re.search(c, v) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    want = []
    for doc_id, base, extra in everything:
        spans = sorted(base + [s for s in extra if len(owners[s[3]]) < 3 and (s[3] in labelled or random_looking(s[3]))])
        texts = lambda spans: ",".join(f"{secretscan.NAMES[s[1]]}:{s[0]}:{s[2]}" for s in spans)
        want.append((doc_id, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(texts(base).encode()).hexdigest(), texts(spans), sum(len(owners[s[3]]) >= 3 for s in spans)))
    got = queries.op13_secrets(spark, path)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(w[4] for w in want) > 1 and sum(w[7] for w in want) > 5
    assert compare.diff(got, queries.ORACLES["op13_secrets"], path) is None
    assert queries.op13_secrets(spark, table(tmp_path / "empty", docs.where("false"))).count() == 0


def test_secrets_of_very_many_texts_are_looked_up_in_a_broadcast_table(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"{k} token = abcdef123456 and zz{k:020d}Zz" + "abcdefghij" * (k % 2), "s") for k in range(60)], "doc_id long, text string, source string")
    cold = sorted(map(repr, secretscan.secrets(docs).collect()))
    monkeypatch.setattr(secretscan, "HOT", 5)
    assert sorted(map(repr, secretscan.secrets(docs).collect())) == cold


def test_running_sums(spark):
    from oddsmill.llm.common import prefix_sums

    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 255, 256, 257, 1000)], "x array<bigint>")
    for r in df.select("x", prefix_sums(F.col("x")).alias("s"), prefix_sums(F.col("x"), 3).alias("t")).collect():
        want = [sum(r.x[: k + 1]) for k in range(len(r.x))]
        assert r.s == want and r.t == want
