"""Words, stored intermediate results and seeds shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from oddsmill.session import shared_folder, tune

MARKS = 1 << 23  # bits by which ``likely`` tells rows apart
WORD = r"[^\x20\x09-\x0D]+"  # bytes.split() cuts UTF-8 at the same six characters


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{path}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def checkpointed(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the folder of spark.checkpoint.dir; a folder of its own only on one machine that sets none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def likely(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """The rows whose ``key`` is a ``name`` of ``wanted`` (null is a name too), and some others: a bit of the key's hash decides.

    What is broadcast is bounded by MARKS, whatever the number of names. It keeps texts that no join will take from being moved.
    Columns of ``rows`` may have any names.
    """
    def hashed(c: Column) -> tuple[Column, Column]:
        mark = F.pmod(F.xxhash64(c), F.lit(MARKS))
        return F.shiftright(mark, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), mark.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))

    pad = "_" * max(map(len, rows.columns))  # longer than any name there
    word, bit = hashed(F.col(name))
    marks = wanted.groupBy(word.alias(f"{pad}word")).agg(F.bit_or(bit).alias(f"{pad}bits"))
    word, bit = hashed(rows[key])
    marked = rows.join(F.broadcast(marks), word == F.col(f"{pad}word"))
    return marked.where(F.col(f"{pad}bits").bitwiseAND(bit) != 0).drop(f"{pad}word", f"{pad}bits")


def split_of(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def prefix_sums(numbers: Column, block: int = 256) -> Column:
    """Running sums of an array of longs, each with its own number; summed in blocks, so that long arrays are not copied per entry."""
    none = F.array().cast("array<bigint>")

    def running(a: Column, start: Column) -> Column:
        step = F.aggregate(a, F.struct(start.alias("at"), none.alias("sums")),
                           lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["sums"], s["at"] + x).alias("sums")))
        return step["sums"]

    def sums(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(a), F.lit(block)), lambda i: F.slice(a, i, block))
        return let(blocks, lambda b: let(
            running(F.transform(b, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda t, n: t + n)), F.lit(0).cast("bigint")),
            lambda ends: F.flatten(F.transform(b, lambda x, k: running(x, F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0).cast("bigint")))))))

    return let(numbers, lambda a: F.when(F.size(a) == 0, none).otherwise(sums(a)))
