"""Load runs from landed payload files: ledger, quarantine, lineage, keep-last and the analysis of what was loaded."""

import json

import pytest
from pyspark.sql import functions as F

from oddsmill.catalog import loads as files
from oddsmill.plans import loads, workflows
from oddsmill.schemas import MARKETS, TOKENS
from oddsmill.sources import tables
from oddsmill.sources.adapters import Canon

SF = "/root/testdata/sf0.001"


def land(folder, name, docs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs) + "\n")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_later_history_replaces_points_and_files_are_read_once(spark, tmp_path):
    root, landed = str(tmp_path / "store"), tmp_path / "landed"
    land(landed, "a.jsonl", [
        {"asset_id": "x", "history": [{"t": 100, "p": 0.1}, {"t": 100, "p": 0.2}, {"ts": 200_000_000_000, "price": "0.3"}, {"t": None, "p": 1}, 7]},
        '{"asset_id": "x", "history"', "[1]", {"asset_id": "", "history": []}, {"asset_id": "y"}, "", {"tokenId": 5, "history": []}])
    got = loads.load_prices(spark, root, str(landed), ingested_at=1)
    assert rows(got, "asset_id", "ts", "price", "interval", "ingested_at") == [("x", 100, 0.2, "1h", 1), ("x", 200_000_000, 0.3, "1h", 1)]
    assert rows(loads.quarantined(spark, root, "price_history"), "reason") == [("no asset",), ("no history",), ("not JSON",), ("not an object",)]
    land(landed, "b.jsonl", [{"asset_id": "x", "history": [{"t": 100, "p": 0.9}]}, {"asset_id": "z", "history": [{"t": 86_400, "p": 0.5}]}])
    got = loads.load_prices(spark, root, str(landed), ingested_at=2, raw_path=f"{root}/raw")
    want = [("x", 100, 0.9, 2), ("x", 200_000_000, 0.3, 1), ("z", 86_400, 0.5, 2)]
    assert rows(got, "asset_id", "ts", "price", "ingested_at") == want
    assert rows(loads.load_prices(spark, root, str(landed), ingested_at=3), "asset_id", "ts", "price", "ingested_at") == want
    lines = loads.lineage(spark, root, "price_history")
    assert sorted((r.file.split("/")[-1], r.lines, r.quarantined, r.batch) for r in lines.collect()) == [("a.jsonl", 6, 4, 0), ("b.jsonl", 2, 0, 1)]
    assert rows(spark.read.parquet(f"{root}/raw"), "asset_id", "ts") == [("x", 100), ("z", 86_400)]


def test_a_load_that_broke_off_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    root, landed = str(tmp_path / "store"), tmp_path / "landed"
    land(landed, "a.jsonl", [{"asset_id": "x", "history": [{"t": 100, "p": 0.1}]}, "{"])
    upsert = tables.upsert

    def lost(*args, **kwargs):
        upsert(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(tables, "upsert", lost)
    with pytest.raises(Exception, match="lost"):
        loads.load_prices(spark, root, str(landed), ingested_at=1)
    monkeypatch.setattr(tables, "upsert", upsert)
    got = loads.load_prices(spark, root, str(landed), ingested_at=2)
    assert rows(got, "asset_id", "ts", "price", "ingested_at") == [("x", 100, 0.1, 2)]
    assert loads.quarantined(spark, root, "price_history").count() == 1


def test_a_later_payload_replaces_whole_bars_only(spark, tmp_path):
    root, landed = str(tmp_path / "store"), tmp_path / "landed"
    tables.replace(spark.createDataFrame([("m", 1, "c1", "q", True, False, False, None, None, "binary", 1.0)], MARKETS), f"{root}/markets.parquet")
    tables.replace(spark.createDataFrame([("m", "No", "n"), ("m", "Yes", "y")], TOKENS), f"{root}/tokens.parquet")
    trade = lambda ts, size, side="buy": {"timestamp": ts, "price": 0.5, "size": size, "side": side}
    land(landed, "a.jsonl", [{"condition_id": "c1", "trades": [trade(0, 1), trade(3600, 2), trade(7300, 4, "SELL")]}, {"condition_id": "c9", "trades": []}, {"trades": []}])
    loads.load_bars(spark, root, str(landed))
    # From 5000 on means from 3600 on; the trade before that is not whole data of its bar and is left out.
    land(landed, "b.jsonl", [{"market": "c1", "min_ts": 5000, "items": [trade(3500, 8), trade(3700, 16), trade(3800, 0), trade(7300, 4)]}])
    got = loads.load_bars(spark, root, str(landed))
    assert rows(got, "asset_id", "ts", "volume", "trade_count", "buy_volume") == [("y", 0, 1.0, 1, 1.0), ("y", 3600, 16.0, 1, 16.0), ("y", 7200, 4.0, 1, 4.0)]
    assert rows(loads.quarantined(spark, root, "volume_bars"), "reason") == [("no condition",), ("unknown condition",)]


def test_books_are_stamped_by_the_hour(spark, tmp_path):
    root, landed = str(tmp_path / "store"), tmp_path / "landed"
    side = lambda p: [{"price": str(p), "size": 3}, [p, 1]]
    land(landed, "a.jsonl", [{"asset_id": "x", "timestamp": 7300, "bids": side(0.4), "asks": side(0.6)}, {"asset_id": "x", "ts": 7201_000_000_000 // 1000 // 1000 * 1000, "bids": []}])
    land(landed, "b.jsonl", [{"asset_id": "w", "timestamp": 3600, "book": {"buy": side(0.2), "sell": side(0.3)}}, {"asset_id": "e", "timestamp": 1}])
    got = loads.load_books(spark, root, str(landed), per_trigger=1)
    assert ("w", 3600, 0.2, 0.3) in rows(got, "asset_id", "snapshot_ts", "best_bid", "best_ask")
    assert ("e", 0, None, None) in [tuple(r) for r in got.select("asset_id", "snapshot_ts", "best_bid", "best_ask").collect()]
    assert got.where("snapshot_ts % 3600 = 0").count() == got.count() == got.select("asset_id", "snapshot_ts").distinct().count()


def test_analysis_of_loaded_tables(spark, tmp_path):
    c, root = Canon(spark, SF), str(tmp_path / "store")
    c.documents.select("value").write.text(f"{root}/raw/events")
    workflows.load_documents(spark, root, [f"{root}/raw/events"])
    for kind, make, load in (("history", files.history_files, lambda p: loads.load_prices(spark, root, p, ingested_at=1)),
                             ("trades", files.trade_files, lambda p: loads.load_bars(spark, root, p)),
                             ("books", files.book_files, lambda p: loads.load_books(spark, root, p))):
        for part in (1, 2):
            make(c, part).write.mode("append").text(f"{root}/landed/{kind}")
        assert load(f"{root}/landed/{kind}").count() > 0
    workflows.resolve(spark, root, [f"{root}/raw/events"], 5)
    out = workflows.analyze(spark, root, 1_706_659_200, workflows.Settings(quality_min_points=5, min_overlap_days=10, cluster_k=3))
    assert out["warnings"] == [] and out["features"].where("avg_daily_volume is not null").count() > 0
