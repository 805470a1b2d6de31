"""The operators of this subpackage over the test tables, with the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddsmill.llm import collocations, decontam, htmltext, maxent, mixing, periodic, pii, secretscan, simhash, tokencount, toolcalls, topk, toxicity
from oddsmill.llm.common import let, read, words
from oddsmill.llm.sqltext import ORACLES as ORACLES  # noqa: F401
from oddsmill.plans.keep import top_per_group

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
KEY = "pseudonyms-2"  # a deployment passes its own secret
TOKEN_LIMIT = 1024
COLLOCATIONS = 2000  # reported per language

TOOLS = {
    "lookup": {
        "query": {"type": "string", "required": True},
        "words": {"type": "integer", "required": True, "minimum": 1},
        "after": {"type": "array"},
        "mode": {"type": "string", "enum": ["short", "long"]},
    },
    "list": {"words": {"type": "integer", "required": True}, "after": {"type": "array"}},
}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_toxicity(spark: SparkSession, path: str) -> DataFrame:
    docs, labels = read(spark, path, "documents"), read(spark, path, "labels")
    model = toxicity.fitted(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    rows = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.toxicity(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= toxicity.DECISION).cast("int"))


@query
def op2_token_counts(spark: SparkSession, path: str) -> DataFrame:
    text = F.col("text")
    rows = read(spark, path, "documents").select(
        "doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), tokencount.token_count(text, TOKENIZER).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op3_pseudonyms(spark: SparkSession, path: str) -> DataFrame:
    rows = pii.pseudonymised(read(spark, path, "documents").select("doc_id", "text"), KEY, counts="kinds")
    n = F.aggregate(F.map_values("kinds"), F.lit(0), lambda a, x: a + x).cast("bigint")
    return rows.select("doc_id", "text", n.alias("n_values"), F.array_join(F.sort_array(F.map_keys("kinds")), ",").alias("kinds"))


def calls_and_results(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every assistant turn read as a call whose arguments depend on its text, and the user turn after it as its result."""

    def name_of(turn):
        return F.concat(F.lit("call_"), F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")).cast("binary")))

    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \n]+")).cast("bigint")
    after = F.when(F.col("turn") >= 2, F.array(name_of(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    tool = F.when(words % 7 == 0, "search").when(words % 3 == 0, "list").otherwise("lookup")
    arguments = F.to_json(F.struct(
        words.alias("words"), F.col("text").alias("query"), after.alias("after"),
        F.when(words % 5 == 0, "wide").when(words % 5 == 1, "short").alias("mode")))
    calls = turns.where("role = 'assistant'").select("conv_id", "turn", name_of(F.col("turn")).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = turns.where("role = 'user' and turn > 0").select("conv_id", "turn", name_of(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query
def op4_tool_calls(spark: SparkSession, path: str) -> DataFrame:
    calls, results = calls_and_results(read(spark, path, "conversations"))
    return toolcalls.linked(calls, results, TOOLS)


@query
def op5_top_k(spark: SparkSession, path: str) -> DataFrame:
    return topk.top_k(read(spark, path, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op6_simhash(spark: SparkSession, path: str) -> DataFrame:
    rows = simhash.near_duplicates(read(spark, path, "documents"))
    return rows.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_maxent(spark: SparkSession, path: str) -> DataFrame:
    rows = maxent.scored(read(spark, path, "documents"), ~maxent.held_out(F.col("doc_id")))
    return rows.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_mixing(spark: SparkSession, path: str) -> DataFrame:
    mixed = mixing.mix(read(spark, path, "documents"), mixing.random_key(F.col("doc_id")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_main_text(spark: SparkSession, path: str) -> DataFrame:
    rows = read(spark, path, "pages").select("page_id", "url", htmltext.extracted(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))


@query
def op10_decontamination(spark: SparkSession, path: str) -> DataFrame:
    docs = read(spark, path, "documents")
    found = decontam.contaminated(docs, read(spark, path, "benchmark"))
    rows = docs.select("doc_id", decontam.text_key(F.col("text")).alias("text_key")).join(found, "text_key", "left")
    return rows.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id",
                       F.coalesce("overlap", F.lit(0)).alias("overlap"))


@query
def op11_collocations(spark: SparkSession, path: str) -> DataFrame:
    phrases = collocations.collocations(read(spark, path, "documents"))
    return top_per_group(phrases, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], COLLOCATIONS).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def planted(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts, chosen by the id, made to repeat its own words from some word on."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeating(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), F.slice(tail, 1, n - a)), " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words(text), repeating)).otherwise(text)


@query
def op12_periodic_runs(spark: SparkSession, path: str) -> DataFrame:
    rows = read(spark, path, "documents").select("doc_id", periodic.periodic_runs(planted(F.col("text"), F.col("doc_id"))).alias("found"))
    runs = F.col("found.runs")
    # Greatest length first, ties by smallest start, then period.
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    rows = rows.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                       F.sha2(F.col("found.collapsed"), 256).alias("collapsed_sha256"))
    length, period = -F.col("best.length"), F.col("best.period")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(length * 1000 / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op13_secrets(spark: SparkSession, path: str) -> DataFrame:
    rows = secretscan.secrets(read(spark, path, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < secretscan.BASE)

    def n(field: str, value) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("bigint")

    return rows.select(
        "doc_id", *[n("kind", k).alias(f"n_{name}") for k, name in enumerate(secretscan.NAMES)],
        F.sha2(secretscan.span_text(base), 256).alias("base_sha256"), secretscan.span_text(F.col("spans")).alias("spans"),
        n("verdict", "example").alias("n_example"))
