"""Data-quality checks as one aggregation per symbol and long findings tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import lag_by, ratio_change, timeline
from barloom.operators.cross_section import with_row
from barloom.schema import MIN_HISTORY_ROWS

CHECKED = ["open", "high", "low", "close", "volume"]


def bad_ohlc():
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (h < l) | (c > h) | (c < l) | (o > h) | (o < l)


def structural(bars: DataFrame) -> DataFrame:
    """Per symbol: NULLs, duplicate dates, OHLC logic, prices and volumes.

    Rows are combined per (symbol, date) on the map side first, so neither the
    distinct-date count nor a hot symbol gathers raw rows in one task.
    """
    low = F.least("open", "high", "low", "close")
    parts = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in CHECKED}
    parts.update({
        "bad_ohlc": F.count_if(bad_ohlc()), "non_positive_price": F.count_if(low <= 0),
        "negative_volume": F.count_if(F.col("volume") < 0),
        "zero_volume": F.count_if(F.col("volume") == 0)})
    daily = bars.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in parts.items()])
    return daily.groupBy("symbol").agg(
        F.sum("rows").alias("rows"),
        (F.sum("rows") - F.count(F.lit(1))).alias("duplicate_dates"),
        *[F.sum(k).alias(k) for k in parts])


def findings(wide: DataFrame, keys=("symbol",)) -> DataFrame:
    """(symbol, check, n) for the checks that found something."""
    checks = [c for c in wide.columns if c not in (*keys, "rows")]
    items = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n"))
                      for c in checks])
    return (wide.select(*keys, F.explode(items).alias("_i"))
            .select(*keys, "_i.check", "_i.n").where("n > 0"))


def jumps_and_gaps(bars: DataFrame, jump: float = 0.25, gap_days: int = 10) -> DataFrame:
    """Per symbol: large close moves, and calendar gaps with the longest one.

    Takes one row per (symbol, date): repeated days are a finding of `structural`,
    and `cleaning.unique_bars` folds them before anything is ordered by date.
    """
    d = bars.select("symbol", "date",
                    ratio_change("close", lag_by("close", 1)).alias("_r"),
                    F.datediff("date", lag_by("date", 1)).alias("_gap"))
    return d.groupBy("symbol").agg(
        F.count_if(F.abs("_r") > jump).alias("big_moves"),
        F.count_if(F.col("_gap") > gap_days).alias("gaps"),
        F.max(F.when(F.col("_gap") > gap_days, F.col("_gap"))).alias("max_gap_days"))


def _moves(bars: DataFrame) -> DataFrame:
    return bars.where("volume > 0").select(
        "symbol", "date", ratio_change("close", lag_by("close", 1)).alias("close_return"),
        ratio_change("adj_close", lag_by("adj_close", 1)).alias("adj_return"))


def unadjusted_splits(bars: DataFrame, jump: float = 0.25) -> DataFrame:
    """Traded days on which both prices jump together in the same direction."""
    return _moves(bars).where(
        (F.abs("close_return") > jump) & (F.abs("adj_return") > jump)
        & (F.signum("close_return") == F.signum("adj_return")))


def price_jumps(bars: DataFrame, jump: float = 0.25) -> DataFrame:
    return (_moves(bars).where(F.abs("adj_return") > jump)
            .select("symbol", "date", "adj_return"))


def unordered_files(landed: DataFrame) -> DataFrame:
    """Symbols whose dates descend somewhere in file order.

    `landed` carries file, row_no (increasing along a file) and date, as the landing
    reader adds them. Lines are compared inside each scan split; across splits only
    their first and last lines are, so a huge file is never one task.
    """
    keys = ["symbol", "file", "_split"]
    d = landed.withColumn("_split", F.shiftright("row_no", 33))
    inside = Window.partitionBy(*keys).orderBy("row_no")
    steps = d.withColumn("_prev", F.lag("date").over(inside))
    parts = steps.groupBy(*keys).agg(
        F.count_if(F.col("date") < F.col("_prev")).alias("_n"),
        F.min_by("date", "row_no").alias("_first"), F.max_by("date", "row_no").alias("_last"))
    chain = Window.partitionBy("symbol", "file").orderBy("_split")
    cut = (F.col("_first") < F.lag("_last").over(chain)).cast("int")
    return (parts.withColumn("_cut", F.coalesce(cut, F.lit(0)))
            .groupBy("symbol").agg(F.sum(F.col("_n") + F.col("_cut")).alias("descents"))
            .where("descents > 0"))


def missing_columns(columns, required) -> list:
    return sorted(set(required) - set(columns))


def landing_findings(heads: DataFrame, landed: DataFrame, required) -> DataFrame:
    """(symbol, check, n): required columns that a file's header lacks, and files without rows.

    `heads` lists (file, columns), `landed` has the files' rows with `file`.
    """
    stem = F.regexp_extract("file", r"([^/]+)\.csv$", 1)
    lacking = F.array_except(F.array(*[F.lit(c) for c in required]), F.col("columns"))
    missing = heads.select(stem.alias("symbol"), F.explode(lacking).alias("c")).select(
        "symbol", F.concat(F.lit("missing_column "), "c").alias("check"), F.lit(1).cast("long").alias("n"))
    empty = heads.join(landed.select("file").distinct(), "file", "left_anti").select(
        stem.alias("symbol"), F.lit("empty_file").alias("check"), F.lit(1).cast("long").alias("n"))
    return missing.unionByName(empty)


def coverage(master: DataFrame, bars: DataFrame, min_rows: int = MIN_HISTORY_ROWS) -> DataFrame:
    """Rows per listed symbol, tagged missing / short / ok."""
    have = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    rows = F.coalesce("rows", F.lit(0))
    return master.select("symbol").join(have, "symbol", "left").select(
        "symbol", rows.alias("rows"),
        F.when(rows == 0, "missing").when(rows < min_rows, "short").otherwise("ok")
        .alias("status"))


def reconcile(a: DataFrame, b: DataFrame, names=("a", "b")) -> DataFrame:
    """Symbols present on one side only."""
    a, b = a.select("symbol").distinct(), b.select("symbol").distinct()
    only = [x.join(y, "symbol", "left_anti").withColumn("only_in", F.lit(n))
            for x, y, n in ((a, b, names[0]), (b, a, names[1]))]
    return only[0].unionByName(only[1])


def universe_summary(bars: DataFrame) -> DataFrame:
    """Symbols, date range, rows, and whether every structural check passed."""
    per = structural(bars)
    bad = sum((F.col(c) for c in per.columns if c not in ("symbol", "rows", "zero_volume")),
              F.lit(0))
    issues = per.withColumn("_bad", bad).agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("rows").alias("rows"),
        F.sum((F.col("_bad") > 0).cast("int")).alias("symbols_with_issues"))
    span = bars.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return with_row(issues, span).withColumn(
        "status", F.when(F.col("symbols_with_issues") == 0, "PASS").otherwise("FAIL"))


def break_rows(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count_if("corp_action_break").alias("break_rows"),
                     F.count_if(F.col("nifty_close").isNull()).alias("rows_without_index"))


def split_integrity(tagged: DataFrame, purge_days: int, target: str) -> DataFrame:
    """One row of checks over a table with a `split` column."""
    keys = tagged.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("split").alias("_s"))
    dup = keys.agg(F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
                   F.count_if(F.col("_s") > 1).alias("shared_keys"))

    def edge(agg, split):
        return agg(F.when(F.col("split") == split, F.col("date")))

    spans = tagged.agg(
        F.count_if(F.col(target).isNull()).alias("null_targets"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")],
        F.datediff(edge(F.min, "val"), edge(F.max, "train")).alias("train_val_gap"),
        F.datediff(edge(F.min, "test"), edge(F.max, "val")).alias("val_test_gap"))
    ok = ((F.col("duplicate_keys") == 0) & (F.col("shared_keys") == 0)
          & (F.col("null_targets") == 0) & (F.col("train_rows") > 0)
          & (F.col("val_rows") > 0) & (F.col("test_rows") > 0)
          & (F.col("train_val_gap") >= purge_days) & (F.col("val_test_gap") >= purge_days))
    return with_row(spans, dup).withColumn("passed", F.coalesce(ok, F.lit(False)))


def target_audit(features: DataFrame, bars: DataFrame, h: int = 30) -> DataFrame:
    """Recompute the forward return from bars: missing rows and largest difference."""
    col = f"fwd_return_{h}d"
    again = bars.select("symbol", "date", ratio_change(
        F.lead("adj_close", h).over(timeline()), "adj_close").alias("_again"))
    return features.select("symbol", "date", col).join(again, ["symbol", "date"], "left").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_again").isNull()).alias("missing"),
        F.max(F.abs(F.col(col) - F.col("_again"))).alias("max_abs_diff"))


def split_inventory(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def feature_bound(scaled: DataFrame, features, bound: float = 5.0) -> DataFrame:
    top = F.greatest(*[F.abs(F.col(c)) for c in features]) if len(features) > 1 \
        else F.abs(F.col(features[0]))
    return scaled.agg(F.max(top).alias("max_abs")).withColumn(
        "within_bound", F.col("max_abs") <= bound)


def price_column_count(columns_by_file: DataFrame) -> DataFrame:
    """Files that carry both price columns, from a (file, columns) listing."""
    both = F.array_contains("columns", "Close") & F.array_contains("columns", "Adj Close")
    return columns_by_file.agg(F.count_if(both).alias("with_both"),
                               F.count(F.lit(1)).alias("files"))
