"""Periodic runs of words: stretches that repeat a short period, found by uniting suffix classes.

Suffixes of a text that share a prefix of l words form a class. Going down in l (the LCP of neighbours in the suffix array),
classes are united, each an ordered set of positions. When two positions at distance d become neighbours in the united set
and d is within l, the words from the first on repeat with period d over d + l words, and no smaller period does: a position
between them that shares as much would have been united before. A seed that no word before it extends is a run; the word
after it differs because l is exact.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

EXPONENT = 4  # a run repeats its period at least so often
LENGTH = 6  # and has at least so many words
CHUNK = 1 << 18  # words whose suffixes are sorted together; a longer text is taken alone
BLOCK = 1024  # positions in a block of an ordered set

RUNS = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
RUNS_ARROW = pa.struct([("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])


class Positions:
    """An ordered set of positions in sorted blocks."""

    def __init__(self, x: int):
        self.blocks, self.size = [[x]], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def _block(self, x: int) -> int:
        return max(0, bisect_left(self.blocks, x, key=lambda b: b[0]) - 1) if len(self.blocks) > 1 else 0

    def around(self, x: int) -> tuple[int, int]:
        """The positions next to x, which is not in the set; -1 where there is none."""
        k = self._block(x)
        block = self.blocks[k]
        i = bisect_left(block, x)
        after = block[i] if i < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return block[i - 1] if i else -1, after

    def add(self, x: int) -> None:
        k = self._block(x)
        block = self.blocks[k]
        insort(block, x)
        self.size += 1
        if len(block) > BLOCK:
            self.blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]


def neighbours(a: Positions, b: Positions) -> tuple[Positions, list[tuple[int, int]]]:
    """The union, and the pairs that are neighbours in it but in neither set; the smaller set goes into the larger."""
    small, large = (a, b) if a.size <= b.size else (b, a)
    xs, pairs = list(small), []
    for k, x in enumerate(xs):
        before, after = large.around(x)
        if before >= 0 and (k == 0 or xs[k - 1] < before):
            pairs.append((before, x))
        if after >= 0 and (k + 1 == len(xs) or xs[k + 1] > after):
            pairs.append((x, after))
    for x in xs:
        large.add(x)
    return large, pairs


def _starts(changed: np.ndarray) -> np.ndarray:
    """For every place the last place up to it where a group starts."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


def _changes(sorted_keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every key (how many are smaller) and the order."""
    order = np.argsort(keys)
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = _starts(_changes(keys[order]))
    return ranks, order


def _in_groups(groups: np.ndarray) -> np.ndarray:
    """Which of the sorted entries share their group with another one."""
    changed = _changes(groups)
    return ~(changed & np.append(changed[1:], True))


def suffix_pairs(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours (i, j, lcp) in the suffix arrays of texts laid end to end, lcp falling, for lcp of at least four words.

    ``text`` numbers the text of each word; code 0 ends a text, other codes are its words. Ranks by 1, 2, 4 ... words are
    refined only where they are still shared, so usual prose costs three sorts. The last array tells words apart.
    """
    n = len(codes)
    later = lambda r, m: np.append(r[m:], np.zeros(min(m, n), np.int64))[:n]
    one, _ = _ranks(text * (codes.max() + 1) + codes)
    two, _ = _ranks(one * n + later(one, 1))
    rank, order = _ranks(two * n + later(two, 2))
    levels = [(1, one), (2, two), (4, rank)]
    open_ = shared = order[_in_groups(rank[order])]
    m = 4
    while len(open_):
        keys = rank[open_] * n + rank[np.minimum(open_ + m, n - 1)]
        place = np.argsort(keys)
        open_, keys = open_[place], keys[place]
        refined = rank.copy()
        refined[open_] += _starts(_changes(keys)) - _starts(_changes(rank[open_]))
        rank, m = refined, 2 * m
        levels.append((m, rank.astype(np.int32) if n < 2**31 else rank))
        open_ = open_[_in_groups(rank[open_])]
    shared = shared[np.argsort(rank[shared])]
    four = levels[2][1]
    near = np.flatnonzero(four[shared[1:]] == four[shared[:-1]])
    i, j = shared[near], shared[near + 1]
    lcp = np.zeros(len(i), np.int64)
    for m, r in reversed(levels):
        lcp += m * (r[np.minimum(i + lcp, n - 1)] == r[np.minimum(j + lcp, n - 1)])
    down = np.argsort(-lcp, kind="stable")
    return i[down], j[down], lcp[down], one


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text given as words, by start, then period."""
    code = defaultdict(count(1).__next__)
    sizes = np.array([len(w) + 1 for w in texts], np.int64)
    codes = np.fromiter((c for w in texts for c in (*map(code.__getitem__, w), 0)), np.int64, int(sizes.sum()))
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    text = np.repeat(np.arange(len(texts)), sizes)
    i, j, lcp, word = suffix_pairs(codes, text)
    least = max(LENGTH - 1, EXPONENT - 1)  # a run of period d has an LCP of its length less d
    enough = lcp >= least
    sets: dict[int, Positions] = {}
    seeds = []
    for a, b, l in zip(i[enough].tolist(), j[enough].tolist(), lcp[enough].tolist()):
        united, pairs = neighbours(sets.get(a) or Positions(a), sets.get(b) or Positions(b))
        other = sets.get(b) if united is sets.get(a) else sets.get(a)
        for x in (a, b) if other is None else other:
            sets[x] = united
        sets[a] = sets[b] = united
        seeds.extend((x, y - x, l) for x, y in pairs if l >= (EXPONENT - 1) * (y - x) and l + y - x >= LENGTH)
    found = [[] for _ in texts]
    for x, d, l in sorted(seeds):
        t = int(text[x])
        if x == first[t] or word[x - 1] != word[x + d - 1]:
            found[t].append((x - int(first[t]), d + l, d))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space."""
    if runs:
        dropped = bytearray(len(words))
        for start, length, period in runs:
            dropped[start + period : start + length] = b"\1" * (length - period)
        words = [w for w, gone in zip(words, dropped) if not gone]
    return b" ".join(words)


def periodic_runs(text: Column) -> Column:
    """struct(runs: array of (start, length, period) by start, then period; collapsed: the text without repeats) of a text.

    A run has at least six words and four periods, cannot be extended and has no smaller period. Words are numbered from 0.
    In ``collapsed`` the words of a run after its first period are left out and the others joined by one space. A null, empty
    or wordless text has no runs and an empty rest. Texts of any length are taken whole.
    """

    def of(texts: pa.Array) -> pa.Array:
        out, chunk, size = [], [], 0

        def flush():
            for words, runs in zip(chunk, runs_of(chunk)):
                out.append({"runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "collapsed": collapsed(words, runs).decode()})
            chunk.clear()

        for t in texts:
            words = (t.as_py() or "").encode().split()
            if chunk and size + len(words) > CHUNK:
                flush()
                size = 0
            chunk.append(words)
            size += len(words)
        if chunk:
            flush()
        return pa.array(out, RUNS_ARROW)

    return F.arrow_udf(of, RUNS)(F.coalesce(text, F.lit("")))
