"""Tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on (conversation, identifier). A call may name calls it builds on; its level is the
longest chain of them below it, found by joins that double the steps along chains, so (level, turn, call_id) is an order in which every call comes
after what it needs. Arguments are checked against the tool's schema. Canonical JSON has sorted keys and no spaces.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from oddsmill.llm.common import checkpointed

TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def canonical(json: Column) -> Column:
    """Keys sorted, no spaces; null for texts that are not JSON."""
    return F.to_json(F.try_parse_json(json))


def problems(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, Mapping]]) -> Column:
    """What is wrong with a call's arguments, as a sorted array of texts; empty if nothing is.

    ``schemas``: tool -> parameter -> {"type": one of TYPES, "required": bool, "minimum": number, "enum": [texts]}.
    """
    value = F.try_parse_json(arguments)
    keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
    found = F.array(F.when(~name.isin(*schemas) | name.isNull(), F.lit("unknown tool")))
    for tool, parameters in schemas.items():
        checks = [F.when(value.isNull(), "not json"), F.when(value.isNotNull() & ~F.schema_of_variant(value).startswith("OBJECT"), "not an object")]
        for p, rule in sorted(parameters.items()):
            at = F.try_variant_get(value, f"$.{p}", "variant")
            there = at.isNotNull() & ~F.is_variant_null(at)
            if rule.get("required"):
                checks.append(F.when(value.isNotNull() & ~F.coalesce(there, F.lit(False)), f"{p}: missing"))
            checks.append(F.when(there & ~F.schema_of_variant(at).rlike(f"^({TYPES[rule['type']]})$"), f"{p}: not {rule['type']}"))
            if "minimum" in rule:
                checks.append(F.when(F.try_variant_get(value, f"$.{p}", "double") < rule["minimum"], f"{p}: below minimum"))
            if "enum" in rule:
                checks.append(F.when(~F.try_variant_get(value, f"$.{p}", "string").isin(*rule["enum"]), f"{p}: not allowed"))
        extra = F.transform(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: ~k.isin(*parameters)), lambda k: F.concat(k, F.lit(": unknown")))
        found = F.when(name == tool, F.concat(F.array(*checks), extra)).otherwise(found)
    return F.sort_array(F.array_compact(found))


def _chains(needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, end, steps) of the calls with exactly one need: the end of their chain, by doubling the steps.

    The end is a call with no or several needs, or, on a cycle or behind one, another call of the chain. Every round settles
    some calls unless all that are left hang on a cycle, so the rounds grow with the logarithm of the longest chain.
    """
    one = needs.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("end")).where("n = 1")
    hops = checkpointed(one.select("conv_id", "call_id", "end", F.lit(1).cast("bigint").alias("steps")))
    left = None
    while True:
        onward = hops.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("_end"), F.col("steps").alias("_steps"))
        joined = hops.select("conv_id", "call_id", "end", "steps").join(onward, ["conv_id", "end"], "left")
        moved = checkpointed(joined.select(
            "conv_id", "call_id", F.coalesce("_end", "end").alias("end"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.col("_end").isNotNull().alias("open")))
        before, left = left, moved.where("open").count()
        hops = moved.drop("open")
        if not left or left == before:
            return hops


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of distinct calls with the array ``after``; null level on a cycle or behind one.

    Names of calls that do not exist are ignored, and a call that names itself is a cycle. Chains of calls with one need are
    shortened to their ends first; then every round settles the calls with several needs all of whose needs are settled,
    until a round settles nothing. No length is too long: the rounds grow with the logarithm of the longest chain plus the
    largest number of calls with several needs on one path.
    """
    known = calls.select("conv_id", "call_id").distinct()
    needs = calls.select("conv_id", "call_id", F.explode("after").alias("need")).distinct()
    needs = checkpointed(needs.join(known.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi"))
    hops = _chains(needs)
    settled = known.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    forks = needs.join(hops, ["conv_id", "call_id"], "left_anti")
    to_end = hops.select("conv_id", F.col("call_id").alias("need"), "end", "steps")
    edges = checkpointed(forks.join(to_end, ["conv_id", "need"], "left").select(
        "conv_id", "call_id", F.coalesce("end", "need").alias("end"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
    if not edges.isEmpty():
        roots = settled = checkpointed(settled)
        count = 0
        while True:
            below = edges.join(settled.select("conv_id", F.col("call_id").alias("end"), "level"), ["conv_id", "end"], "left")
            up = below.groupBy("conv_id", "call_id").agg(
                F.max(F.col("level") + F.col("steps")).alias("level"), F.count(F.when(F.col("level").isNull(), 1)).alias("open"))
            nexts = checkpointed(up.where("open = 0").select("conv_id", "call_id", "level"))
            settled = roots.unionByName(nexts)
            before, count = count, nexts.count()
            if count == before:
                break
    ends = known.join(hops, ["conv_id", "call_id"], "left").select(
        "conv_id", "call_id", F.coalesce("end", "call_id").alias("end"), F.coalesce("steps", F.lit(0)).alias("steps"))
    at_end = settled.select("conv_id", F.col("call_id").alias("end"), "level")
    return ends.join(at_end, ["conv_id", "end"], "left").select("conv_id", "call_id", (F.col("level") + F.col("steps")).cast("int").alias("level"))


def linked(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Mapping]]) -> DataFrame:
    """One row per call: (conv_id, turn, call_id, level, name, linked, valid, errors, message).

    calls: conv_id, turn, call_id, name, arguments (JSON), after (array of call_ids). results: conv_id, turn, call_id, content.
    Of calls with the same identifier the earliest counts (then the smallest name and arguments), of results likewise the
    first after its call. A call without result has linked false and a null result; results without call are dropped, as they
    answer nothing. errors joins the problems by "; ", valid says there are none. Null identifiers take no part.
    """
    one = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", "after")).alias("c")).select("conv_id", "call_id", "c.*")
    one = checkpointed(one)
    # Repeated results of a call are one row per turn before they travel.
    answers = results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(
        "conv_id", "call_id", F.col("turn").alias("_t")).agg(F.min("content").alias("content"))
    after = one.select("conv_id", "call_id", "turn").join(answers, ["conv_id", "call_id"]).where("_t > turn")
    first = after.groupBy("conv_id", "call_id").agg(F.min(F.struct("_t", "content")).alias("r"))
    rows = one.join(first, ["conv_id", "call_id"], "left").join(levels(one.select("conv_id", "call_id", "after")), ["conv_id", "call_id"])
    wrong = problems(F.col("name"), F.col("arguments"), schemas)
    message = F.to_json(F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("call_id"), F.col("name").alias("name"), F.col("r.content").alias("result")
    ), {"ignoreNullFields": "false"})
    return rows.withColumn("_wrong", wrong).select(
        "conv_id", "turn", "call_id", "level", "name", F.col("r").isNotNull().alias("linked"), (F.size("_wrong") == 0).alias("valid"),
        F.array_join("_wrong", "; ").alias("errors"), message.alias("message"))
