"""Purged time splits, date folds, walk-forward windows and sliding sequences."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import timeline
from barloom.operators.cross_section import by_day, with_row

# --- fixed values: published split boundaries and purges ---
TRAIN_END, VAL_END = "2022-12-31", "2024-06-30"
PURGE_ALL_HORIZONS, PURGE_PRIMARY = 150, 50
LOOKBACK = 60
# --- end of fixed values ---


def day(x):
    return F.lit(x).cast("date")


def purged_split(df: DataFrame, train_end=TRAIN_END, val_end=VAL_END,
                 purge_days: int = PURGE_ALL_HORIZONS, train_purge_days: int = None) -> DataFrame:
    """Adds `split`; rows within the purge of either boundary are dropped.

    `train_purge_days` sets the purge before the first boundary apart from the others (0:
    the train rows reach up to it).
    """
    d = F.col("date")
    before = purge_days if train_purge_days is None else train_purge_days
    split = (F.when(d <= F.date_sub(day(train_end), before), "train")
             .when((d > F.date_add(day(train_end), purge_days))
                   & (d <= F.date_sub(day(val_end), purge_days)), "val")
             .when(d > F.date_add(day(val_end), purge_days), "test"))
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def date_index(df: DataFrame) -> DataFrame:
    """(date, day_no, days): 1-based position of each distinct date."""
    dates = df.select("date").distinct()
    return dates.select("date", F.row_number().over(by_day()).alias("day_no"),
                        F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("days"))


def time_folds(df: DataFrame, n_splits: int, gap_days: int = 0) -> DataFrame:
    """(date, fold, role) of an expanding-window split over distinct dates.

    Fold k validates on its block of dates and fits on every date that ends more
    than `gap_days` positions earlier. Block length is days // (n_splits + 1).
    """
    idx = date_index(df).withColumn("_len", F.floor(F.col("days") / (n_splits + 1)))
    folds = idx.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    start = F.col("days") - (n_splits - F.col("fold") + 1) * F.col("_len")
    pos = F.col("day_no") - 1
    role = (F.when((pos >= start) & (pos < start + F.col("_len")), "validate")
            .when(pos < start - gap_days, "fit"))
    return (folds.withColumn("role", role).where(F.col("role").isNotNull())
            .select("date", "fold", "role"))


def rebalance_dates(df: DataFrame, start=None, step: int = 60) -> DataFrame:
    """Every `step`-th distinct date from `start` on."""
    d = df if start is None else df.where(F.col("date") >= day(start))
    return (date_index(d).where((F.col("day_no") - 1) % step == 0)
            .select("date", F.floor((F.col("day_no") - 1) / step).alias("period")))


def yearly_window(df: DataFrame, year: int, purge_days: int = PURGE_ALL_HORIZONS):
    """(train, test) of one calendar year with an expanding, purged train set."""
    first = day(f"{year}-01-01")
    return (df.where(F.col("date") <= F.date_sub(first, purge_days)),
            df.where((F.col("date") >= first) & (F.col("date") <= day(f"{year}-12-31"))))


def sequences(df: DataFrame, features, labels=(), lookback: int = LOOKBACK,
              stride: int = 1, block_rows: int = 256) -> DataFrame:
    """Sliding windows per symbol: (symbol, date, x: array<array<float>>, labels).

    The frame holds `lookback` rows and is dated by its last; windows start at the
    symbol's first row and advance by `stride`. A symbol's rows are packed in blocks of
    `block_rows`, each with the `lookback` - 1 rows before it, and windows are slices of
    a block: arrays are made only for the windows that are returned, and a row is stored
    twice at most, whatever the overlap of the windows.
    """
    block_rows = max(block_rows, lookback)
    row = F.array(*[F.col(c).cast("float") for c in features])
    rows = df.select("symbol", "date", F.row_number().over(timeline()).cast("long").alias("_rn"), row.alias("_x"),
                     *[F.col(c).cast("float").alias(c) for c in labels])
    own = F.expr(f"(_rn - 1) div {block_rows}")
    ahead = F.col("_rn") % block_rows
    ahead = (ahead == 0) | (ahead > block_rows - lookback + 1)
    dealt = rows.withColumn("_block", F.explode(F.when(
        ahead & F.lit(lookback > 1), F.array(own, own + 1)).otherwise(F.array(own))))
    packed = dealt.groupBy("symbol", "_block").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "date", *labels, "_x"))).alias("_rows"))
    first = F.element_at("_rows", 1)["_rn"]
    ends = F.filter("_rows", lambda r: (r["_rn"] > F.col("_block") * block_rows) & (r["_rn"] >= lookback)
                    & ((r["_rn"] - lookback) % stride == 0))

    def window(end):
        start = (end["_rn"] - first - lookback + 2).cast("int")
        x = F.transform(F.slice("_rows", start, F.lit(lookback)), lambda r: r["_x"])
        return F.struct(end["date"].alias("date"), x.alias("x"), *[end[c].alias(c) for c in labels])

    return (packed.select("symbol", F.explode(F.transform(ends, window)).alias("_w"))
            .select("symbol", "_w.date", "_w.x", *[F.col("_w")[c].alias(c) for c in labels]))


def standardize_target(df: DataFrame, train: DataFrame, target: str, out: str) -> DataFrame:
    """(y - mean) / population std of the train rows; parameters ride along as columns
    so that predictions can be mapped back."""
    stats = train.agg(F.avg(target).alias("y_mean"), F.stddev_pop(target).alias("y_std"))
    return with_row(df, stats).withColumn(
        out, (F.col(target) - F.col("y_mean")) / F.col("y_std"))


def unstandardize(col: str):
    return F.col(col) * F.col("y_std") + F.col("y_mean")
