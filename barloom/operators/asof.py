"""Backward as-of join per symbol."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
              by: str = "symbol", payload=None, tie_break=None, bucket: str = None) -> DataFrame:
    """Left rows with the payload of the latest right row at or before them.

    Right rows that share (by, right_on) are first reduced to the one with the
    greatest `tie_break`, map-side. Both sides then hold one row per key and day,
    are merged by one exchange on the key and filled forward; no pairs are formed.

    Where times are finer than days a key may hold any number of rows. Name a `bucket`
    then (a unit of `date_trunc`): rows are filled forward inside (key, bucket), and what
    a bucket starts with is carried over one row per (key, bucket). A hot key is thus as
    many groups as it has buckets, and only its buckets are put in order in one task.
    """
    payload = [c for c in right.columns if c not in (by, right_on)] if payload is None \
        else list(payload)
    packed = F.struct(F.col(right_on), *payload)
    rank = F.struct(*[F.col(c) for c in (tie_break or payload)])
    one = (right.where(F.col(right_on).isNotNull())
           .groupBy(by, right_on).agg(F.max_by(packed, rank).alias("_r"))
           .select(by, F.col(right_on).alias("_ts"), F.lit(0).alias("_side"), "_r"))
    lcols = left.columns
    stacked = left.withColumns({"_ts": F.col(left_on), "_side": F.lit(1)}).unionByName(
        one, allowMissingColumns=True)
    fill = _forward(stacked, by) if bucket is None else _forward_in_buckets(stacked, by, bucket)
    return (fill.where("_side = 1")
            .select(*lcols, *[F.col(f"_r.{c}").alias(c) for c in [right_on, *payload]]))


def _forward(stacked: DataFrame, *keys: str) -> DataFrame:
    order = (Window.partitionBy(*keys).orderBy("_ts", "_side")
             .rowsBetween(Window.unboundedPreceding, 0))
    return stacked.withColumn("_r", F.last("_r", ignorenulls=True).over(order))


def _forward_in_buckets(stacked: DataFrame, by: str, unit: str) -> DataFrame:
    """`_forward` by key, in tasks of one bucket of one key."""
    rows = stacked.withColumn("_bucket", F.date_trunc(unit, "_ts"))
    at = F.when(F.col("_side") == 0, F.col("_ts"))
    last = rows.groupBy(by, "_bucket").agg(F.max_by("_r", at).alias("_last"))
    before = (Window.partitionBy(by).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = last.select(F.col(by).alias("_key"), F.col("_bucket").alias("_start"),
                        F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    filled = _forward(rows, by, "_bucket").where("_side = 1")
    joined = filled.join(carry, F.col(by).eqNullSafe(F.col("_key"))
                         & F.col("_bucket").eqNullSafe(F.col("_start")), "left")
    return joined.withColumn("_r", F.coalesce("_r", "_carry"))
