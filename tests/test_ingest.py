import json

import pytest
from pyspark.sql import functions as F

from oddsmill.functions import raw
from oddsmill.operators import loadplan, normalize
from oddsmill.schemas import PRICES
from oddsmill.sources import landing, tables

DAY = 86_400


def docs_of(spark, *docs):
    rows = [(json.dumps(d) if not isinstance(d, str) else d, i) for i, d in enumerate(docs)]
    return normalize.parse_documents(spark.createDataFrame(rows, "value string, seq bigint"))


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_events_keep_last_and_synonyms(spark):
    docs = docs_of(
        spark,
        {"id": "1", "title": "old", "startDate": "2024-01-01", "tags": "solo"},
        {"eventId": 1, "title": "", "name": "new", "endTs": 1_700_000_000_000, "categories": [{"name": "x"}, " "]},
        {"id": "n/a", "slug": "s"},
        "not json",
        "[1]",
    )
    got = rows_of(normalize.extract_events(docs), "event_id", "slug", "title", "start_ts", "end_ts", "tags")
    assert got == [(1, None, "new", None, 1_700_000_000, '["x"]'), (None, "s", None, None, None, "[]")]


def test_markets_tokens_resolutions(spark):
    markets = [
        {"id": 7, "conditionId": "c7", "question": "q", "active": 1, "isClosed": "no", "outcomes": '["Yes","No"]', "clobTokenIds": ["a", "b", "c"], "liquidity": "12.5"},
        {"marketId": "8", "type": "Scalar", "tokens": [{"token_id": "t1", "outcome": "Yes"}, {"id": "", "outcome": "No"}, 5, {"assetId": 9}], "resolved": True},
        {"id": "9", "outcome": "No", "endDate": "2024-01-02"},
        {"id": "10", "endDate": 1_700_000_000},
        {"id": "11", "outcomes": "Up,Down", "liquidityNum": 3},
        "junk",
    ]
    docs = docs_of(spark, {"id": 1, "markets": markets}, {"id": 2, "markets": {"id": "no list"}}, {"id": 3, "markets": [{"id": "7", "question": "newer"}]})
    m = {r["market_id"]: r for r in normalize.extract_markets(docs).collect()}
    assert set(m) == {"7", "8", "9", "10", "11"}
    assert (m["7"]["question"], m["7"]["event_id"], m["7"]["market_type"]) == ("newer", 3, "unknown")
    assert (m["8"]["market_type"], m["8"]["resolved"], m["8"]["resolution_outcome"]) == ("scalar", True, "Unresolved")
    assert (m["9"]["resolved"], m["9"]["resolution_outcome"], m["9"]["resolution_ts"]) == (True, "No", 1_704_153_600)
    assert (m["11"]["market_type"], m["11"]["liquidity"], m["11"]["resolved"]) == ("binary", 3.0, False)
    assert rows_of(normalize.extract_tokens(docs), "market_id", "outcome", "asset_id") == [
        ("7", "No", "b"), ("7", "Yes", "a"), ("7", None, "c"), ("8", "Yes", "t1"), ("8", None, "9")]
    assert [r[0] for r in rows_of(normalize.extract_resolutions(docs), "market_id")] == ["10", "8", "9"]


def test_history_books_and_trades(spark):
    points = ['{"t": 100, "p": 0.5}', '{"t": 100, "price": "0.6"}', '{"ts": 1700000000000, "p": 0.1}', '{"t": 5}', '{"t": "x", "p": 1}', "3"]
    frame = spark.createDataFrame([("a", i, p) for i, p in enumerate(points)], "asset_id string, seq bigint, p string")
    got = normalize.normalize_history(frame.select("asset_id", "seq", F.try_parse_json("p").alias("point")), "1h", 9)
    assert rows_of(got, "ts", "price", "interval", "ingested_at") == [(100, 0.6, "1h", 9), (1_700_000_000, 0.1, "1h", 9)]

    books = ['{"bids": [{"price": "0.4", "size": 1}, [0.3, "2"], [0.2], {"p": 0, "s": 1}, {"p": 0.1, "q": -1}], "sell": [{"p": 0.5, "quantity": 3}]}',
             '{"bids": [], "book": {"buy": [["0.1", "1"]], "asks": []}}', '{}']
    frame = spark.createDataFrame([(str(i), 0, b) for i, b in enumerate(books)], "asset_id string, snapshot_ts bigint, b string")
    out = {r["asset_id"]: ([tuple(x) for x in r["bids"]], [tuple(x) for x in r["asks"]]) for r in normalize.normalize_books(frame.select("asset_id", "snapshot_ts", F.try_parse_json("b").alias("doc"))).collect()}
    assert out == {"0": ([(0.4, 1.0), (0.3, 2.0)], [(0.5, 3.0)]), "1": ([(0.1, 1.0)], []), "2": ([], [])}

    trades = ['{"timestamp": null, "ts": 1700000000000, "p": "0.5", "shares": 2, "side": " BUY "}', '{"createdAt": "2024-01-02", "price": 1, "size": "x"}', "[]"]
    frame = spark.createDataFrame([("a", t) for t in trades], "asset_id string, t string")
    got = normalize.normalize_trades(frame.select("asset_id", F.try_parse_json("t").alias("trade")))
    assert rows_of(got, "ts", "price", "size", "side") == [(1_700_000_000, 0.5, 2.0, "buy"), (1_704_153_600, 1.0, None, "")]


def test_token_selection(spark):
    tokens = spark.createDataFrame(
        [("m1", "No", "a", 0), ("m1", " YES ", "b", 1), ("m2", "Up", "c", 2), ("m2", "Down", "d", 3), ("m3", "x", "e", 4), ("m3", "y", "f", 5), ("m4", None, "e", 6)],
        "market_id string, outcome string, asset_id string, seq bigint")
    markets = spark.createDataFrame([("m1", "Binary"), ("m2", "binary"), ("m3", "multi")], "market_id string, market_type string")
    one = normalize.select_tokens(tokens, markets, yes_only_binary=True)
    assert rows_of(one, "market_id", "asset_id", "market_type") == [("m1", "b", "Binary"), ("m2", "c", "binary"), ("m3", "e", "multi"), ("m3", "f", "multi")]
    assert normalize.select_tokens(tokens, markets, yes_only_binary=False).count() == 7
    assert rows_of(normalize.anchor_tokens(tokens), "market_id", "asset_id") == [("m1", "b"), ("m2", "c"), ("m3", "e"), ("m4", "e")]


def test_final_price_and_refresh(spark):
    tokens = spark.createDataFrame([(m, "Yes", "a" + m, 0) for m in "1234"], "market_id string, outcome string, asset_id string, seq bigint")
    prices = spark.createDataFrame([("a1", 10, 0.1), ("a1", 20, 0.2), ("a2", 50, 0.5), ("a2", 60, 0.6), ("a3", 5, 0.3)], "asset_id string, ts bigint, price double")
    res = spark.createDataFrame([("1", "c", "Yes", 20), ("2", "c", "No", 40), ("3", "c", None, None), ("4", "c", "Yes", 1)],
                                "market_id string, condition_id string, resolution_outcome string, resolution_ts bigint")
    out = normalize.enrich_resolutions(res, tokens, prices, 1)
    assert rows_of(out, "market_id", "final_price") == [("1", 0.2), ("2", 0.6), ("3", 0.3), ("4", None)]
    markets = spark.createDataFrame([("1", True, "x", 1), ("9", True, "Yes", 1)], "market_id string, resolved boolean, resolution_outcome string, resolution_ts bigint")
    assert rows_of(normalize.refresh_markets(markets, out), "market_id", "resolved", "resolution_outcome", "resolution_ts") == [("1", True, "Yes", 20), ("9", False, None, None)]


def test_upsert_keeps_last(spark, tmp_path):
    path = str(tmp_path / "markets.parquet")
    first = spark.createDataFrame([("m1", "a", 0), ("m1", "b", 1), (None, "n", 2)], "market_id string, question string, n bigint")
    assert rows_of(tables.upsert(spark, path, first, "markets", "n"), "market_id", "question") == [("m1", "b"), (None, "n")]
    second = spark.createDataFrame([("m2", "c", 5.0), (None, "o", 6.0)], "market_id string, question string, liquidity double")
    got = rows_of(tables.upsert(spark, path, second, "markets"), "market_id", "question", "n", "liquidity")
    assert got == [("m1", "b", 1, None), ("m2", "c", None, 5.0), (None, "o", None, 6.0)]
    assert tables.upsert(spark, path, second.limit(0), "markets").count() == 3
    assert tables.read_optional(spark, str(tmp_path / "none"), PRICES).count() == 0


def test_upsert_by_day_rewrites_only_touched_days(spark, tmp_path):
    path = str(tmp_path / "price_history.parquet")
    cols = "asset_id string, ts bigint, price double, interval string"
    tables.upsert(spark, path, spark.createDataFrame([("a", 1, 0.1, "1h"), ("a", DAY + 1, 0.2, "1h")], cols), "price_history")
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "price_history.parquet" / "dt=1970-01-01").glob("*.parquet")}
    out = tables.upsert(spark, path, spark.createDataFrame([("a", DAY + 1, 0.3, "1h"), ("b", DAY + 2, 0.4, "1h")], cols), "price_history")
    assert rows_of(out, "asset_id", "ts", "price") == [("a", 1, 0.1), ("a", DAY + 1, 0.3), ("b", DAY + 2, 0.4)]
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "price_history.parquet" / "dt=1970-01-01").glob("*.parquet")}


def test_upsert_by_day_of_many_days(spark, tmp_path):
    path = str(tmp_path / "price_history.parquet")
    cols = "asset_id string, ts bigint, price double, interval string"
    days = [d * DAY for d in range(40) if d != 20]
    tables.upsert(spark, path, spark.createDataFrame([("a", t, 0.1, "1h") for t in days] + [("n", None, 0.1, "1h")], cols), "price_history")
    before = (tmp_path / "price_history.parquet" / "dt=1970-01-01").stat().st_ino
    out = tables.upsert(spark, path, spark.createDataFrame([("a", t, 0.2, "1h") for t in days[1:]] + [("m", None, 0.3, "1h")], cols), "price_history")
    got = {(r["asset_id"], r["ts"]): r["price"] for r in out.collect()}
    assert got == {("a", t): 0.2 if t else 0.1 for t in days} | {("n", None): 0.1, ("m", None): 0.3}  # rows without a day are kept too
    assert before == (tmp_path / "price_history.parquet" / "dt=1970-01-01").stat().st_ino
    assert tables.upsert(spark, path, out.limit(0), "price_history").count() == len(got)
    import datetime

    known = [datetime.date(1970, 1, 1) + datetime.timedelta(days=d) for d in range(5000) if d != 20]
    condition = tables._day_runs(known)._jc.toString()
    assert condition.count("1970-") + condition.count("1983-") <= 4  # two runs, whatever the number of days


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(tables.MissingInputs, match="events.parquet, markets.parquet, price_history.parquet, tokens.parquet"):
        tables.check_inputs(spark, str(tmp_path))


def test_landed_lines_recency_and_wrappers(spark, tmp_path):
    path = str(tmp_path / "lines")
    docs = [{"id": 1, "endDate": "2024-01-10"}, {"id": 2, "resolvedAt": 1_700_000_000_000}, {"id": 3}, {"id": 4, "resolutionDate": None, "endTs": 1_704_900_000}]
    landing.write_json_lines(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string"), path)
    parsed = normalize.parse_documents(landing.read_json_lines(spark, path))
    recent = landing.recent_events(parsed, 1_704_844_800)
    assert sorted(r["e"] for r in recent.select(raw.pick_text(F.col("doc"), "id").alias("e")).collect()) == ["1", "3", "4"]
    payloads = spark.createDataFrame([('[{"id": 1}]',), ('{"data": [{"id": 2}, {"id": 3}]}',), ('{"x": 1}',)], "t string").select(F.try_parse_json("t").alias("doc"))
    assert landing.unwrap(payloads).count() == 3


def plan_inputs(spark):
    tokens = spark.createDataFrame(
        [("a_existing_sports", "m1"), ("a_existing_legacy", "m2"), ("a_new_politics", "m3"), ("a_new_sports", "m4"), ("a_new_legacy", "m5")], "asset_id string, market_id string")
    markets = spark.createDataFrame([(f"m{i}", i, i in (1, 3, 4), i in (2, 5), i in (2, 5)) for i in range(1, 6)],
                                    "market_id string, event_id bigint, active boolean, closed boolean, resolved boolean")
    tags = ["sports", "elections", "politics", "sports", "elections"]
    events = spark.createDataFrame([(i + 1, 2_000_000, json.dumps([t])) for i, t in enumerate(tags)], "event_id bigint, end_ts bigint, tags string")
    latest = spark.createDataFrame([("a_existing_sports", 980_000), ("a_existing_legacy", 970_000)], "asset_id string, latest_ts bigint")
    return loadplan.load_metadata(tokens, markets, events, latest, 1_000_000)


def test_load_plan_order(spark):
    plan = loadplan.mark_plan(plan_inputs(spark), interval="1h", global_start_ts=1_000_000 - 30 * DAY)
    ordered = sorted(loadplan.order_plan(plan).collect(), key=lambda r: r["position"])
    assert [(r["asset_id"], r["bucket"]) for r in ordered] == [
        ("a_existing_sports", "existing"), ("a_new_politics", "new_active"), ("a_new_sports", "new_active"), ("a_new_legacy", "new_inactive")]
    assert ordered[0]["fetch_start_ts"] == 980_000 - 7200
    assert {r["bucket"]: r["assets"] for r in loadplan.plan_counts(plan).collect()}["skipped_inactive"] == 1
    skip = loadplan.mark_plan(plan_inputs(spark), interval="1h", global_start_ts=0, mode="skip", skip_inactive_priced=False)
    assert {r["bucket"]: r["assets"] for r in loadplan.plan_counts(skip).collect()} == {"skipped_existing": 2, "new_active": 2, "new_inactive": 1}


def test_round_robin(spark):
    rows = spark.createDataFrame([("a1", "alpha", 0.0), ("a2", "alpha", 0.0), ("b1", "beta", 0.0), ("b2", "beta", 0.0)], "asset_id string, primary_tag string, tag_coverage double")
    got = loadplan.round_robin(rows).orderBy("turn", "tag_order", "primary_tag").collect()
    assert [r["asset_id"] for r in got] == ["a1", "b1", "a2", "b2"]


def test_documents_of_a_small_file_are_read_by_many_tasks(spark):
    from oddsmill.sources.adapters import Canon

    docs = Canon(spark, "/root/testdata/sf0.001").documents
    assert docs.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    tokens = normalize.extract_tokens(normalize.parse_documents(docs))
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    assert "json" in plan.lower().split("repartitionbyexpression")[0] and "json" not in plan.lower().split("repartitionbyexpression")[1]  # dealt before they are parsed
    assert tokens.count() == 2 * docs.count() + docs.where("seq % 3 = 2").count()


def test_market_lists_are_read_whole_from_the_document(spark):
    lines = ['{"markets": [{"id": "a"}, {"id": 2}, 3]}', '{"markets": []}', '{"markets": ""}', '{"markets": "x"}', '{"markets": null}', '{"markets": {"id": "a"}}', "{}", "[]", "1", "null"]
    docs = spark.createDataFrame(list(enumerate(lines)), "seq int, value string").select("seq", F.try_parse_json("value").alias("doc"))
    doc = F.col("doc")
    rows = docs.orderBy("seq").select(
        F.transform(raw.items_at(doc, "markets"), raw.text).alias("at"), F.transform(raw.items(raw.pick(doc, "markets")), raw.text).alias("pick"), raw.is_object(doc).alias("object")).collect()
    assert [r["at"] for r in rows] == [r["pick"] for r in rows] and rows[0]["at"] == ['{"id":"a"}', '{"id":2}', "3"]
    assert [r["object"] for r in rows] == [True] * 7 + [False] * 3
    markets = normalize.extract_markets(normalize.parse_documents(spark.createDataFrame(list(enumerate(lines)), "seq int, value string")))
    assert sorted(r["market_id"] for r in markets.collect()) == ["2", "a"]
