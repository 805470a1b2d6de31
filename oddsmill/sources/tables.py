"""Stored tables: optional reads, keep-last upserts, input checks and document sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from oddsmill.plans.keep import keep_last
from oddsmill.schemas import DAY, FEATURES, TABLES, TableSpec


BUCKET_BYTES = 256 << 20  # stored bytes a bucket is made for; a table is dealt anew when its buckets hold twice as much


class MissingInputs(FileNotFoundError):
    pass


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def recover(spark: SparkSession, path: str) -> None:
    """Finishes or undoes a swap that a lost driver left half done."""
    fs, p = _fs(spark, path)
    old = _fs(spark, path + "._old")[1]
    if not fs.exists(p) and fs.exists(old):
        fs.rename(old, p)


def read_optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or an empty one with the declared schema where there is none yet."""
    recover(spark, path)
    if exists(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def merge_keep_last(old: DataFrame | None, new: DataFrame, keys: tuple[str, ...], seq: str | None = None) -> DataFrame:
    """Old rows followed by new ones, the later row per key kept. Null keys equal each other; missing keys are ignored.

    ``seq`` orders rows inside the new batch; without it rows of one batch with one key are taken in plan order.
    """
    order = F.col(seq) if seq and seq in new.columns else F.monotonically_increasing_id()
    rows = new.withColumn("_seq", order).withColumn("_batch", F.lit(1))
    if old is not None:  # stored rows are unique per key, so they need no order of their own
        rows = old.withColumn("_batch", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    usable = [k for k in keys if k in rows.columns]
    if usable:
        rows = keep_last(rows, usable, ["_batch", "_seq"])
    return rows.drop("_batch", "_seq")


def _own(path: str, kind: str) -> str:
    """A name beside a table that no other run uses; what a lost driver leaves under it is never read."""
    return f"{path}._{kind}-{uuid.uuid4().hex}"


def _swap(spark: SparkSession, path: str, staged: str) -> None:
    fs, target = _fs(spark, path)
    old = _fs(spark, path + "._old")[1]
    if fs.exists(old):
        fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(_fs(spark, staged)[1], target)
    if fs.exists(old):
        fs.delete(old, True)


def replace(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Writes next to the table and swaps by rename, so the path being read is never overwritten."""
    staged = _own(path, "new")
    df.write.partitionBy(*partition_by).parquet(staged)
    _swap(df.sparkSession, path, staged)


def _bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def bucket_count(spark: SparkSession, path: str) -> int | None:
    """Buckets of a stored table, from its marker file; none for a table that was written without."""
    fs, p = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return next((int(n.removeprefix("_buckets_")) for n in names if n.startswith("_buckets_")), None)


@contextmanager
def bucketed(spark: SparkSession, path: str, keys: tuple[str, ...]) -> Iterator[DataFrame]:
    """A stored table as Spark's bucketed source, so that joins on its keys leave its rows where they are."""
    n, schema = bucket_count(spark, path), spark.read.parquet(path).schema
    if n is None:
        yield spark.read.parquet(path)
        return
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(f"`{k}`" for k in keys)
    where = path.replace("'", "\\'")
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({by}) into {n} buckets location '{where}'")
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table {name}")  # the name only: the files lie outside the warehouse


def write_bucketed(df: DataFrame, path: str, keys: tuple[str, ...], sort: tuple[str, ...], n: int) -> None:
    """Replaces a table by n buckets on its keys, sorted inside; rows that are dealt by the keys already do not move."""
    spark, staged, name = df.sparkSession, _own(path, "new"), f"bucketed_{uuid.uuid4().hex}"
    order = [c for c in sort if c in df.columns] or list(keys)
    df.write.bucketBy(n, *keys).sortBy(*order).option("path", staged).saveAsTable(name)
    spark.sql(f"drop table {name}")
    fs, marker = _fs(spark, f"{staged}/_buckets_{n}")
    fs.create(marker).close()
    _swap(spark, path, staged)


def merged_in_place(old: DataFrame, batch: DataFrame, keys: tuple[str, ...], seq: str, n: int) -> DataFrame:
    """Keep-last of a bucketed table and a batch: the batch is dealt like the table, whose rows stay in their buckets.

    Rows with a null key meet nothing in a join; the few a table can hold are merged apart. Columns only one side has are
    null in the other's rows.
    """
    columns = [*old.columns, *[c for c in batch.columns if c not in old.columns and c != seq]]
    types = dict(old.dtypes)
    batch = batch.withColumns({k: F.col(k).cast(types[k]) for k in keys})
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    last = keep_last(batch.where(whole).repartition(n, *keys), keys, [seq]).drop(seq)
    new = last.select(*[F.col(f"`{c}`").alias(f"new_{i}") for i, c in enumerate(columns) if c in last.columns], F.lit(True).alias("_hit"))
    place = {c: i for i, c in enumerate(columns)}
    on = F.lit(True)
    for k in keys:
        on = on & (old[k] == F.col(f"new_{place[k]}"))
    hit = F.col("_hit").isNotNull()

    def value(c: str, i: int) -> Column:
        there = F.col(f"new_{i}") if c in last.columns else F.lit(None)
        return (F.when(hit, there).otherwise(old[c]) if c in old.columns else there).alias(c)

    joined = old.where(whole).join(new, on, "full_outer").select(*[value(c, i) for i, c in enumerate(columns)])
    rest = merge_keep_last(old.where(~whole), batch.where(~whole), keys, seq)
    return joined.unionByName(rest.drop(seq), allowMissingColumns=True)


def upsert(spark: SparkSession, path: str, new: DataFrame, name: str, seq: str | None = None) -> DataFrame:
    """Keep-last upsert of one registered table; an empty batch leaves an existing table as it is.

    Tables without days are stored in buckets on their keys: the batch is computed once, dealt by the keys and merged bucket
    by bucket. The stored rows move only when the table has outgrown its buckets, that is once per doubling.
    """
    spec = TABLES[name]
    recover(spark, path)
    present = exists(spark, path)
    if spec.partition_by == ("dt",):
        return _upsert_by_day(spark, path, new, spec, seq, present)
    order = F.col(seq) if seq and seq in new.columns else F.monotonically_increasing_id()
    staged = _own(path, "batch")
    new.withColumn("_order", order).write.parquet(staged)
    try:
        batch = spark.read.parquet(staged)
        if present and batch.isEmpty():
            return spark.read.parquet(path)
        keys = tuple(k for k in spec.keys if k in batch.columns)
        size = _bytes(spark, staged) + (_bytes(spark, path) if present else 0)
        n = bucket_count(spark, path) if present else None
        if n is not None and size <= 2 * n * BUCKET_BYTES and keys == spec.keys:
            with bucketed(spark, path, keys) as old:
                write_bucketed(merged_in_place(old, batch, keys, "_order", n), path, keys, spec.sort, n)
        else:
            merged = merge_keep_last(spark.read.parquet(path) if present else None, batch, spec.keys, "_order").drop("_order")
            if keys != spec.keys or batch.isEmpty():  # a bucketed write of no rows leaves no file with the columns
                replace(merged, path)
            else:
                n = 1 << max(0, -(-size // BUCKET_BYTES) - 1).bit_length()
                write_bucketed(merged.repartition(n, *keys), path, keys, spec.sort, n)
    finally:
        fs, p = _fs(spark, staged)
        fs.delete(p, True)
    return spark.read.parquet(path)


def _day_runs(days: list[date | None]) -> Column:
    """Condition on dt that is as long as the days have gaps, not as there are days."""
    runs: list[list[date]] = []
    for day in sorted(d for d in days if d is not None):
        if runs and day - runs[-1][1] <= timedelta(days=1):
            runs[-1][1] = day
        else:
            runs.append([day, day])
    return reduce(lambda a, b: a | b, [F.col("dt").between(lo, hi) for lo, hi in runs], F.col("dt").isNull() if None in days else F.lit(False))


def _write_days(df: DataFrame, path: str, spec: TableSpec) -> None:
    """Replaces the days of ``df``; days of any size are cut into files by their bytes. Tasks put their files under the job's
    staging folder themselves, so that the driver only moves whole days into place."""
    df.hint("rebalance", F.col("dt")).sortWithinPartitions("dt", *spec.sort).write.mode("overwrite").options(
        **{"partitionOverwriteMode": "dynamic", "mapreduce.fileoutputcommitter.algorithm.version": "2"}
    ).partitionBy("dt").parquet(path)


def _upsert_by_day(spark: SparkSession, path: str, new: DataFrame, spec: TableSpec, seq: str | None, present: bool) -> DataFrame:
    """Only the days the batch touches are read, merged and rewritten."""
    dated = new.withColumn("dt", F.to_date(F.timestamp_seconds((F.floor(F.col(spec.time) / DAY) * DAY).cast("bigint"))))
    if not present:  # nothing stored is read, so an interrupted write can simply be repeated
        _write_days(merge_keep_last(None, dated, spec.keys, seq), path, spec)
        return spark.read.parquet(path)
    order = F.col(seq) if seq and seq in new.columns else F.monotonically_increasing_id()
    computed, stage = _own(path, "batch"), _own(path, "stage")
    dated.withColumn("_order", order).write.parquet(computed)
    batch = spark.read.parquet(computed)
    touched = [r["dt"] for r in batch.select("dt").distinct().collect()]  # one value per day of the batch
    if touched:
        old = spark.read.parquet(path).where(_day_runs(touched))
        # The staged rows are complete on disk, so an interrupted copy can simply be repeated. They are not laid out by day yet:
        # a folder per day is made once only.
        merge_keep_last(old, batch, spec.keys, "_order").drop("_order").write.parquet(stage)
        _write_days(spark.read.parquet(stage), path, spec)
    for done in (computed, stage):
        fs, p = _fs(spark, done)
        fs.delete(p, True)
    return spark.read.parquet(path)


REQUIRED = ("events", "markets", "tokens", "price_history")
OPTIONAL = ("resolutions", "volume_bars")


def check_inputs(spark: SparkSession, root: str) -> list[str]:
    """Warnings for optional tables that are absent or empty; raises if a base table is missing."""
    missing = [f"{n}.parquet" for n in REQUIRED if not exists(spark, f"{root}/{n}.parquet")]
    if missing:
        raise MissingInputs(f"analysis needs stored base tables in {root}: {', '.join(sorted(missing))}")
    notes = {"resolutions": "without resolution data", "volume_bars": "without volume data"}
    warnings = []
    for name in OPTIONAL:
        path = f"{root}/{name}.parquet"
        if not exists(spark, path) or spark.read.parquet(path).isEmpty():
            warnings.append(f"{name}.parquet missing or empty; continuing {notes[name]}.")
    return warnings


def write_raw_by(df: DataFrame, path: str, key: str) -> None:
    """Raw rows in one folder per key; a key that holds many bytes is cut into several files, small ones share a task."""
    df.hint("rebalance", F.col(key)).write.mode("append").partitionBy(key).parquet(path)


def feature_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEATURES, "name string, type string, window string, description string")


def write_document(df: DataFrame, path: str) -> None:
    """A small result as one JSON document per row in a single file."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
