"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once on the driver, by encoding each of them. In the tasks a
text is cut into pre-tokens; those in the proven set count as one, and only the rest goes through the merges.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F
from tokenizers import Tokenizer

# The pattern of the byte-level pre-tokeniser (fixed).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blocks in which the pattern's classes here and in the tokenizer's own Unicode tables agree; tests check every character.
AGREED = r"\x00-\u0557\u1e00-\u2069\u3000-\ua6ff\uac00-\ud7a3\uff00-\uffef"
REMEMBERED = 200_000  # merged pre-tokens a worker remembers before it starts again


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 as it is, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


def single_tokens(spec: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    tokenizer, symbols, pattern = Tokenizer.from_str(spec), byte_symbols(), regex.compile(PATTERN)
    texts = []
    for token in json.loads(spec)["model"]["vocab"]:
        try:
            text = bytes(symbols[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if pattern.fullmatch(text) and not regex.search(f"[^{AGREED}]", text):
            texts.append(text)
    encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded) if len(e.ids) == 1)


@lru_cache(maxsize=1)
def opened(spec: str) -> tuple[Tokenizer, regex.Pattern | None, dict[str, int]]:
    """Tokenizer, pattern of its added tokens and merged pre-tokens so far, opened once per worker and not once per task."""
    added = [t["content"] for t in json.loads(spec)["added_tokens"]]
    pattern = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
    return Tokenizer.from_str(spec), pattern, {}


class Counting:
    """Counts tokens of texts as the tokenizer does, special strings inside a text being its special tokens."""

    def __init__(self, spec: str, single: frozenset[str]):
        self.spec, self.single = spec, single
        self.tokenizer = None

    def __getstate__(self):
        return {"spec": self.spec, "single": self.single, "tokenizer": None}

    def _open(self):
        self.tokenizer, self.added, self.merged = opened(self.spec)
        self.pattern = regex.compile(PATTERN)
        self.unsure = regex.compile(f"[^{AGREED}]")

    def count(self, text: str) -> int:
        if self.tokenizer is None:
            self._open()
        if self.unsure.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        n, parts = 0, [text]
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
            n = len(parts) - 1
        for part in parts:
            found = self.pattern.findall(part)
            n += len(found)
            rest = [p for p in found if p not in self.single]
            if rest:
                n += sum((self._merge(p) - 1) * k for p, k in Counter(rest).items())
        return n

    def _merge(self, piece: str) -> int:
        n = self.merged.get(piece)
        if n is None:
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            n = self.merged[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text as a long by the byte-level tokenizer file at ``path`` (read on the driver); null counts as empty: 0."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    counting = Counting(spec, single_tokens(spec))

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([counting.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(of, "bigint")(F.coalesce(text, F.lit("")))
