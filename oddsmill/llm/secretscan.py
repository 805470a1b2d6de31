"""Secret scan with corpus-wide ownership.

Patterns find labelled secrets. Every found value, and every bare token that could be one, is hashed; how many owners and
how many repositories (texts of an owner, copies counted once) hold a hash tells a widely copied example from a credential
of one owner. Bare tokens that only few owners hold are reported too, if they are labelled as a secret elsewhere or look random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.llm.common import checkpointed, let, prefix_sums

# Kinds, patterns, group of the value and its least length (fixed). The last two name their least length in the pattern:
# the characters before a match too short for it cannot begin a longer one, so nothing else changes.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
# A whole token that holds a letter and a digit.
BARE = ("owned", r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}", 0, 16)
NAMES = [k[0] for k in (*KINDS, BARE)]
BASE = len(KINDS)  # kinds are numbered in this order; the bare tokens come last

EXAMPLE_OWNERS = 3  # a value that so many owners hold is an example
RANDOM_LENGTH, RANDOM_CHARACTERS = 20, 10  # a bare token of three classes looks random from this length and so many different characters on
HOT = 1_000  # repositories from which on a hash is looked up in a broadcast table
BROADCAST_ROWS = 1_000_000  # hot hashes, about 100 bytes each, up to which that table is broadcast

SPANS = "array<struct<start:bigint,kind:int,end:bigint,hash:string,random:boolean>>"


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of all matches, leftmost first; those whose value is too short are left out. Positions are code points."""

    def spans(found: Column) -> Column:
        # What lies between the matches and each match: the running sums of their lengths are the positions.
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = prefix_sums(F.zip_with(gaps, found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("bigint")))
        rows = F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), e.alias("e"), F.regexp_extract(m, pattern, group).alias("v")))
        kept = F.filter(rows, lambda r: F.char_length(r["v"]) >= least)
        return F.transform(kept, lambda r: F.struct(
            (r["e"] - F.char_length(r["m"])).alias("start"), F.lit(kind).alias("kind"), r["e"].alias("end"),
            F.sha2(r["v"], 256).alias("hash"), _random(r["v"]).alias("random")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) == 0, F.array().cast(SPANS)).otherwise(spans(f).cast(SPANS)))


def _random(token: Column) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[A-Z]") & token.rlike("[a-z]")
    return mixed & (F.char_length(token) >= RANDOM_LENGTH) & (F.size(F.array_distinct(F.split(token, ""))) >= RANDOM_CHARACTERS)


def _spans(text: Column) -> Column:
    """Spans of the base kinds, and bare tokens outside of them."""
    base = F.concat(*[_matches(text, k, pattern, group, least) for k, (_, pattern, group, least) in enumerate(KINDS)])
    apart = lambda s, b: (b["start"] >= s["end"]) | (s["start"] >= b["end"])
    return let(base, lambda found: F.concat(found, F.filter(_matches(text, BASE, *BARE[1:]), lambda s: F.forall(found, lambda b: apart(s, b)))))


def _ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, labelled) of every found value."""
    held = found.groupBy("hash", "owner", "repository").agg(F.max(F.col("kind") < BASE).alias("labelled"))
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("labelled").alias("labelled"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"), F.max("labelled").alias("labelled"))


def _judged(found: DataFrame) -> DataFrame:
    """``found`` with the ownership of each hash; hashes of very many texts are looked up without moving their rows."""
    known = checkpointed(_ownership(found))
    hot = known.where(F.col("repositories") > HOT)
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return found.join(known, "hash")
    return found.join(F.broadcast(hot), "hash").unionByName(
        found.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(known.where(F.col("repositories") <= HOT), "hash"))


def secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, spans) of every row of ``docs``: struct(start, kind, end, owners, repositories, verdict) by start, then kind.

    Kinds are numbered as in NAMES; positions count code points, the end is exclusive; verdict is ``example`` or ``owned``.
    Base spans are all there; a bare token is there if its verdict is ``owned`` and it is labelled elsewhere or looks random.
    A null text is empty and has no spans, a null owner is an owner of its own, copies of a text of one owner count once, rows
    with equal doc_id and text have equal spans. Only doc_id, text and the owner are read, so other columns can have any name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col(owner).alias("owner"), F.xxhash64(text, F.char_length(text)).alias("repository"), _spans(text).alias("spans"))
    rows = checkpointed(rows)
    found = rows.where(F.size("spans") > 0).select("doc_id", "owner", "repository", F.inline("spans"))
    verdict = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").otherwise("owned")
    judged = _judged(found).withColumn("verdict", verdict).where((F.col("kind") < BASE) | ((F.col("verdict") == "owned") & (F.col("labelled") | F.col("random"))))
    span = F.struct("start", "kind", "end", "owners", "repositories", "verdict")
    spans = judged.groupBy("doc_id", "repository").agg(F.sort_array(F.collect_set(span)).alias("all")).select(
        F.col("doc_id").alias("d"), F.col("repository").alias("r"), "all")
    with_spans = rows.where(F.size("spans") > 0).join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("repository") == F.col("r")), "left")
    none = F.array().cast(spans.schema["all"].dataType)
    return with_spans.select("doc_id", F.coalesce("all", none).alias("spans")).unionByName(
        rows.where(F.size("spans") == 0).select("doc_id", none.alias("spans")))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
