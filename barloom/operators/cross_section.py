"""Statistics shared by the rows of one date or one (date, industry)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import rolling, ratio_change, safe_div
from barloom.operators.order_stats import quantiles

# Date-level tables hold one row per calendar day, so one ordered window over
# them is bounded by the calendar and not by the panel.
def by_day():
    return Window.partitionBy(F.lit(1)).orderBy("date")



def attach(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Left join of group statistics.

    A table keyed by date alone has one row per calendar day, a few MB for a century,
    and is broadcast: the panel is not shuffled. Anything else carries no hint:
    adaptive execution broadcasts it when its measured size allows, and splits skewed
    partitions of the rows when it does not."""
    keys = list(keys)
    return df.join(F.broadcast(stats) if keys == ["date"] else stats, keys, "left")


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame (an ungrouped aggregate) to every row."""
    return df.crossJoin(F.broadcast(row))


def index_on_calendar(dates: DataFrame, index: DataFrame) -> DataFrame:
    """Index series on every date the panel trades, carried forward over gaps."""
    cols = [c for c in index.columns if c != "date"]
    back = by_day().rowsBetween(Window.unboundedPreceding, 0)
    return (dates.select("date").distinct().join(index, "date", "left")
            .select("date", *[F.last(c, ignorenulls=True).over(back).alias(c) for c in cols]))


def index_regime(index: DataFrame, close: str = "nifty_close") -> DataFrame:
    prev = F.lag(close).over(by_day())
    d = index.groupBy("date").agg(F.first(close).alias(close)).select(
        "date", F.col(close).alias("_c"),
        F.ln(safe_div(close, prev)).alias("nifty_return"))
    return d.select(
        "date", "nifty_return",
        rolling(F.stddev_samp, "nifty_return", 20, by_day()).alias("nifty_volatility_20"),
        ratio_change("_c", rolling(F.avg, "_c", 50, by_day())).alias("nifty_trend"))


def volatility_regime(vix: DataFrame, close: str = "close") -> DataFrame:
    """Runs on the series' own calendar; the join to the panel does not fill gaps."""
    mean, std = (rolling(f, close, 60, by_day()) for f in (F.avg, F.stddev_samp))
    return vix.select(
        "date", safe_div(F.col(close) - mean, std).alias("vix_zscore_60"),
        ratio_change(close, F.lag(close, 5).over(by_day())).alias("vix_change_5d"))


def index_days(panel: DataFrame) -> DataFrame:
    return panel.groupBy("date").agg(F.max("nifty_close").alias("nifty_close"))


def add_market_regime(panel: DataFrame, vix: DataFrame, index: DataFrame = None) -> DataFrame:
    """`index` is the index by day, where the panel doesn't hold the days its windows look back."""
    index = index_days(panel) if index is None else index
    by_date = attach(index_regime(index), volatility_regime(vix), ["date"])
    out = attach(panel, by_date, ["date"])
    return out.withColumn("relative_strength", F.col("log_return") - F.col("nifty_return"))


def add_sector_return(panel: DataFrame) -> DataFrame:
    """Leave-one-out mean return of the peers of a row; 0 for a lone member.

    The divisor counts peers whose return is missing. Group totals come from a
    map-side combined group-by, so a crowded date never gathers in one task.
    """
    keys = ["date", "industry"]
    totals = panel.where(F.col("industry").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.sum("log_return"), F.lit(0.0)).alias("_s"))
    loo = F.try_divide(F.col("_s") - F.col("log_return"), F.col("_n") - 1)
    return (attach(panel, totals, keys)
            .withColumn("sector_return", F.when(F.col("_n") > 1, loo).otherwise(F.lit(0.0)))
            .drop("_n", "_s"))


def medians(long: DataFrame, keys, value: str, out: str, bounded: bool = False) -> DataFrame:
    return quantiles(long, keys, value, {out: 0.5}, bounded)
