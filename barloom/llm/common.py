"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import job_tables, materialize, outer_tables

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
_GAP_CHARS = " \t\n\x0b\f\r"

#: Rows of a frame that may be sent to every executor. Beyond it the operators shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; any path that Spark's readers can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array (null and blank texts: empty)."""
    parts = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(_GAP_CHARS)), GAP)
    return F.filter(parts, lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_hashes(text: Column) -> Column:
    """The words as 64-bit hashes, which Arrow hands to NumPy as one flat array."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if its counted rows are few, else left to a shuffle.

    Counts the frame, so hand in a stored table.
    """
    return F.broadcast(df) if df.count() <= rows else df


def stored(df: DataFrame, batch_rows: int = 1_000) -> DataFrame:
    """A durable cut: written below spark.checkpoint.dir and read again.

    `batch_rows` go to Python at once while it is written: rows here are texts or groups,
    so a batch stays small.
    """
    spark = df.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch_rows))
    try:
        return materialize(df)
    finally:
        spark.conf.set(name, before)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """`stored(make())`; the tables that `make` stored on its way are removed then."""
    with job_tables(spark):
        df = make()
        with outer_tables():
            return stored(df)
