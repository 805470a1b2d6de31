"""Bucketed upserts: the stored rows stay where they are, whatever happens to a run."""

import random

import pytest

from oddsmill.sources import tables

COLS = "market_id string, asset_id string, outcome string, n long"


def rows_of(df):
    return sorted(((r.market_id, r.asset_id, r.outcome) for r in df.collect()), key=repr)


def batch(spark, rows):
    return spark.createDataFrame(rows, COLS)


def exchanges_over(plan: str, marker: str) -> int:
    """Exchanges on the way from the scan that names the marker to the root."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if marker in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-*")), 0
    for line in reversed(lines[:at]):
        here = len(line) - len(line.lstrip(" :+-*"))
        if here < depth:
            depth = here
            found += "Exchange" in line
    return found


def test_upserts_equal_keep_last(spark, tmp_path):
    rng, path, want = random.Random(4), str(tmp_path / "tokens.parquet"), {}
    for step in range(4):
        rows = [(rng.choice([None, *map(str, range(40))]), rng.choice([None, "a", "b", "c"]), f"{step}-{i}", i) for i in range(150)]
        want.update({(m, a): o for m, a, o, _ in rows})
        got = tables.upsert(spark, path, batch(spark, rows), "tokens", "n")
        assert rows_of(got) == sorted(((m, a, o) for (m, a), o in want.items()), key=repr)
        assert tables.bucket_count(spark, path) == 1
    assert rows_of(tables.upsert(spark, path, batch(spark, []), "tokens", "n")) == rows_of(spark.read.parquet(path))


def test_a_table_that_outgrows_its_buckets_is_dealt_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "tokens.parquet")
    monkeypatch.setattr(tables, "BUCKET_BYTES", 4096)
    counts, want = [], {}
    for step in range(3):
        rows = [(str(i), str(step if i % 2 else 0), f"{step}-{i}", i) for i in range(700 * (step + 1))]
        want.update({(m, a): o for m, a, o, _ in rows})
        got = tables.upsert(spark, path, batch(spark, rows), "tokens", "n")
        counts.append(tables.bucket_count(spark, path))
        assert rows_of(got) == sorted((m, a, o) for (m, a), o in want.items())
    assert counts[0] > 1 and counts == sorted(counts) and counts[-1] > counts[0]


def test_stored_rows_do_not_move(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "tokens.parquet")
    monkeypatch.setattr(tables, "BUCKET_BYTES", 4096)
    tables.upsert(spark, path, batch(spark, [(str(i), "a", "x", i) for i in range(2000)]), "tokens", "n")
    keys = ("market_id", "asset_id")
    n = tables.bucket_count(spark, path)
    assert n > 1
    new = batch(spark, [("5", "a", "y", 1), ("new", "a", "z", 2)]).withColumnRenamed("n", "_order")
    with tables.bucketed(spark, path, keys) as old:
        merged = tables.merged_in_place(old, new, keys, "_order", n)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        # The first scan of the table feeds the join; the second one holds rows with a null key only.
        assert "Bucketed: true" in plan and exchanges_over(plan, "Bucketed: true") == 0
        second = [line for line in plan.splitlines() if "FileScan" in line][1]
        assert "Or(IsNull(market_id),IsNull(asset_id))" in second
        assert merged.count() == 2001


@pytest.mark.parametrize("swapped", [False, True])
def test_an_interrupted_swap_ends_whole(spark, tmp_path, monkeypatch, swapped):
    path = str(tmp_path / "tokens.parquet")
    tables.upsert(spark, path, batch(spark, [("1", "a", "old", 1), ("2", "a", "old", 2)]), "tokens", "n")
    swap = tables._swap

    def lost(session, target, staged):
        if swapped:  # the old table is out of the way, the new one not yet in its place
            fs, p = tables._fs(session, target)
            fs.rename(p, tables._fs(session, target + "._old")[1])
        raise RuntimeError("driver lost")

    second = batch(spark, [("2", "a", "new", 1), ("3", "a", "new", 2)])
    monkeypatch.setattr(tables, "_swap", lost)
    with pytest.raises(RuntimeError):
        tables.upsert(spark, path, second, "tokens", "n")
    monkeypatch.setattr(tables, "_swap", swap)
    assert rows_of(tables.read_optional(spark, path, spark.read.parquet(path if not swapped else path + "._old").schema)) == [("1", "a", "old"), ("2", "a", "old")]
    assert rows_of(tables.upsert(spark, path, second, "tokens", "n")) == [("1", "a", "old"), ("2", "a", "new"), ("3", "a", "new")]
