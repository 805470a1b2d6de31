import duckdb
import pytest
from pyspark.sql import functions as F

from oddsmill.functions import raw, scalars as S


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [(" TRUE ", True), ("1", True), ("y", True), ("No", False), ("0", False), ("maybe", None), (None, None)])
def test_bool_words(spark, text, want):
    assert one(spark, S.to_bool(F.lit(text).cast("string"))) is want


@pytest.mark.parametrize(
    "doc,want",
    [("true", True), ("2", True), ("0", False), ("0.0", False), ('"yes"', True), ('"2"', None), ("null", None), ("[1]", None)],
)
def test_bool_of_json(spark, doc, want):
    assert one(spark, raw.bool_of(F.try_parse_json(F.lit(doc)))) is want


@pytest.mark.parametrize(
    "doc,want",
    [("1700000000", 1700000000), ("1700000000999", 1700000000), ("1700000000.7", 1700000000), ('"2024-01-02T03:04:05Z"', 1704164645),
     ('"2024-01-02"', 1704153600), ('"soon"', None), ("null", None)],
)
def test_seconds_of_json(spark, doc, want):
    assert one(spark, raw.seconds_of(F.try_parse_json(F.lit(doc)))) == want


@pytest.mark.parametrize(
    "text,want",
    [('["a", "b"]', ["a", "b"]), ("a, 'b' ,\"c\",,", ["a", "b", "c"]), ('"a","b"', ["a", "b"]), ("5", ["5"]), ('"x"', ["x"]), ("null", []),
     ("", []), ('""', []), ('["1", 2]', ["1", "2"])],
)
def test_list_items(spark, text, want):
    assert one(spark, S.list_items(F.lit(text))) == want


@pytest.mark.parametrize(
    "doc,want",
    [('["a", " b ", "", {"label": "", "slug": "c"}, {"id": 7}, 3]', ["a", "b", "c", "7"]), ('"solo"', ["solo"]), ("{}", []), ("null", [])],
)
def test_tags(spark, doc, want):
    assert one(spark, raw.tags_of(F.try_parse_json(F.lit(doc)))) == want


@pytest.mark.parametrize(
    "text,by_json,by_pattern",
    [('["politics", "x"]', "politics", "politics"), ("[]", "unknown", "unknown"), ("plain text", "plain text", "unknown"),
     ('a"b', 'a"b', "unknown"), ("", "unknown", "unknown"), (None, "unknown", "unknown"), ("nan", "unknown", "unknown"), ('[""]', "unknown", "unknown")],
)
def test_primary_tags(spark, text, by_json, by_pattern):
    c = F.lit(text).cast("string")
    assert (one(spark, S.tag_from_json(c)), one(spark, S.tag_from_pattern(c))) == (by_json, by_pattern)


@pytest.mark.parametrize("text,want", [("YES", "Yes"), ("winner_no", "No"), ("canceled", "Invalid"), ("pending", "Unresolved"), ("?", None), (None, None)])
def test_outcomes(spark, text, want):
    assert one(spark, S.canonical_outcome(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "flag,outcome,want",
    [(None, "Yes", (True, "Yes")), (None, "Invalid", (True, "Invalid")), (None, "Unresolved", (False, "Unresolved")), (None, None, (False, None)),
     (True, None, (True, "Unresolved")), (False, "Yes", (False, None)), (False, "Unresolved", (False, "Unresolved"))],
)
def test_resolution_state(spark, flag, outcome, want):
    a, b = S.resolution_state(F.lit(flag).cast("boolean"), F.lit(outcome).cast("string"))
    row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (row["a"], row["b"]) == want


@pytest.mark.parametrize("given,n,want", [("Scalar", 2, "scalar"), (None, 2, "binary"), (None, 3, "multi"), (None, 0, "unknown"), (None, 1, "unknown")])
def test_market_type(spark, given, n, want):
    assert one(spark, S.market_type(F.lit(given).cast("string"), F.lit(n))) == want


def kelly(p, c):
    c = min(0.999999, max(1e-6, c))
    b = (1 - c) / c
    return min(1.0, max(0.0, (p * b - (1 - p)) / b))


@pytest.mark.parametrize("p,c", [(0.6, 0.5), (0.5, 0.6), (1.2, 0.3), (0.9, 0.0), (0.7, 1.0)])
def test_kelly(spark, p, c):
    assert one(spark, S.kelly_fraction(F.lit(p), F.lit(c))) == pytest.approx(kelly(min(1, p), c))


@pytest.mark.parametrize(
    "mode,cash,p,c,want",
    [("kelly", 10_000.0, 0.6, 0.5, 500.0), ("kelly", 10_000.0, 0.51, 0.5, 50.0), ("kelly", 10_000.0, 0.4, 0.5, 0.0), ("kelly", 0.0, 0.9, 0.5, 0.0),
     ("kelly", 100.0, 0.501, 0.5, 0.0), ("flat", 10_000.0, 0.1, 0.5, 100.0), ("flat", 1000.0, 0.1, 0.5, 50.0)],
)
def test_position_size(spark, mode, cash, p, c, want):
    _, size = S.position_size(mode, F.lit(cash), F.lit(p), F.lit(c))
    assert one(spark, size) == pytest.approx(want)


@pytest.mark.parametrize(
    "strength,volume,points,want",
    [(0.9, 1000.0, 500, 0.8), (0.5, 250.0, 50, 0.125), (0.5, None, None, 0.5), (-1.0, 100.0, 100, 0.0), (0.5, 100.0, 100, 0.1)],
)
def test_confidence(spark, strength, volume, points, want):
    assert one(spark, S.damped_confidence(F.lit(strength), F.lit(volume).cast("double"), F.lit(points).cast("int"))) == want


@pytest.mark.parametrize("direction,exit_,cost,profit", [("buy", 1.0, 0.615, 0.37), ("sell", 1.0, 0.415, -0.43), ("sell", 0.0, 0.415, 0.57)])
def test_unit_trade(spark, direction, exit_, cost, profit):
    a, b, r = S.unit_trade(F.lit(direction), F.lit(0.6), F.lit(exit_), F.lit(0.03))
    row = spark.range(1).select(a.alias("a"), b.alias("b"), r.alias("r")).first()
    assert row["a"] == pytest.approx(cost) and row["b"] == pytest.approx(profit) and row["r"] == pytest.approx(profit / cost)


def test_first_present_and_numbers(spark):
    row = spark.createDataFrame([("", "0", "abc", float("nan"))], "a string, b string, c string, d double")
    got = row.select(S.first_present("a", "b").alias("p"), S.to_double("c").alias("c"), S.to_double("d").alias("d"), S.to_double("b").alias("b")).first()
    assert (got["p"], got["c"], got["d"], got["b"]) == ("0", None, None, 0.0)
    assert [one(spark, S.usable_spread(F.lit(v).cast("double"))) for v in (0.02, 0.0, None)] == [0.02, 0.03, 0.03]


@pytest.mark.parametrize("digits", [0, 2, 4])
def test_round_even_as_in_sql(spark, digits):
    """Doubles at decimal ties, where scaling decides: 0.63455 is no tie, 2.675 is one."""
    values = [0.63455, 0.63445, -0.63455, 2.675, 1.005, 0.5, 1.5, 1e306, 0.0, *[k / 1e5 for k in range(5, 100_000, 310)], *[k / 1e3 for k in range(5, 30_000, 70)]]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.round_even(F.col("x"), digits).alias("r")).collect()
    con = duckdb.connect()
    want = {v: con.execute(f"select round_even(cast(? as double), {digits})", [v]).fetchall()[0][0] for v in values}
    assert {r["x"]: r["r"] for r in rows} == want
