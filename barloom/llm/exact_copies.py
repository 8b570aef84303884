"""Exact dedup with the frequent digests split off.

A text is its SHA-256; (row, doc_id, digest) is stored once and is all that moves. Each task
keeps a Misra-Gries summary of `counters` digests, summaries are merged `FAN_IN` at a time, and
what is left names every digest with more than one row in `counters` + 1. These few are counted
exactly; the ones that are truly above the bar are the winners: they, with their size and the
row that stays, are broadcast (at most `counters` rows) and settle their copies where they lie.
All other digests are grouped by an ordinary shuffle, which now has no heavy group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored

#: Digests a summary holds, and so the rows of the broadcast at most.
COUNTERS = 256
#: Summaries that one task merges.
FAN_IN = 64


def trimmed(counts: Counter, counters: int) -> Counter:
    """At most `counters` counts, all lowered by the largest one that has to go."""
    if len(counts) <= counters:
        return counts
    bar = sorted(counts.values(), reverse=True)[counters]
    return Counter({d: n - bar for d, n in counts.items() if n > bar})


def _summary(counters: int):
    def summarise(batches):
        held: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                for digest, n in zip(part.column("digest").to_pylist(), part.column("n").to_pylist()):
                    held[digest] += n
                held = trimmed(held, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "n"])

    return summarise


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, n): every digest with more than 1 / (`counters` + 1) of the rows is among these.

    `n` is a lower bound of its rows. At most `counters` rows; stored.
    """
    task = F.spark_partition_id().alias("task")
    held = stored(digests.select("digest", F.lit(1).cast("long").alias("n"))
                  .mapInArrow(_summary(counters), "digest binary, n long").select("digest", "n", task))
    while True:
        tasks = (held.agg(F.max("task")).first()[0] or 0) + 1
        merged = -(-tasks // FAN_IN)
        held = stored(held.repartition(merged, F.floor(F.col("task") / FAN_IN)).select("digest", "n")
                      .mapInArrow(_summary(counters), "digest binary, n long").select("digest", "n", task))
        if merged == 1:
            # Repartitioning by a key may use more tasks than were asked for; only one has rows.
            return held.select("digest", "n")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"),
                                      F.max(F.struct("id", "row")).alias("stays"))


def _judged(rows: DataFrame, counters: int) -> DataFrame:
    """(row, id, digest, group_size, stays) of stored rows (row, id, digest)."""
    total = rows.count()
    winners = stored(_groups(rows.join(F.broadcast(frequent_digests(rows, counters).select("digest")), "digest"))
                     .where(F.col("group_size") * (counters + 1) > total))
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = rest.join(_groups(rest), "digest")
    columns = ["row", "id", "digest", "group_size", "stays"]
    return heavy.select(*columns).unionAll(rest.select(*columns))


def _digest(text: Column, normalise: Callable[[Column], Column] | None) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(normalise(text) if normalise else text, 256))


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 normalise: Callable[[Column], Column] | None = None, counters: int = COUNTERS) -> DataFrame:
    """One row per row of `docs`: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal if `normalise` (a function of a string column; nothing by default) makes
    them identical; a null text is an empty one. Of equal texts the row with the largest id
    stays (a null id is the smallest); of rows that repeat an id and a text one stays. Long
    texts are digested whole; an empty table gives an empty one; other columns of `docs`,
    whatever their names, stay outside.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"),
                              _digest(F.col(text), normalise).alias("digest")))
    return _judged(rows, counters).select(
        F.col("id").alias(doc_id), F.col("stays.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   normalise: Callable[[Column], Column] | None = None, counters: int = COUNTERS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; rules as in `exact_copies`."""
    whole = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"),
                               F.col(doc_id).alias("id"), _digest(F.col(text), normalise).alias("digest")))
    gone = stored(_judged(whole.select("row", "id", "digest"), counters)
                  .where(F.col("row") != F.col("stays.row")).select("row"))
    return whole.join(gone, "row", "left_anti").select("doc.*")
