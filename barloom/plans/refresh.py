"""The feature panel kept up to date by appends instead of rebuilds.

    start(out, ...)    builds the panel once
    extend(out, ...)   adds the bars of later dates
    panel(out)         the panel as a rebuild from all bars would give it

A folder holds the panel before the gate by month (`months`), and what an append needs of the
past, one version per last date: the last rows of each symbol with its exponential means
(`tails`), and the last days of the index (`days`). An append works out

* the features of the new rows, from the tails: windows look back `WINDOW_ROWS` rows, the
  exponential means go on from the kept ones, the index windows from the kept days;
* the labels of the last max(HORIZONS) rows of the symbols that trade again, from the same tails;
* medians, ranks and sector returns of the dates whose labels have changed. They lie in the
  months from the first such row on; earlier months are neither read nor written.

The work thus follows the rows appended and one horizon of history, whatever the panel's
length. Only a symbol that trades again after a long pause reaches back further, to its last
rows. Months are replaced as a whole, then the new versions of tails and days are written; an
append that dies between is repeated from the old ones.

Defined results: no new rows change nothing. Rows on or before the last stored date change
values everywhere after them and are refused (ValueError): build anew. The same holds for
changed statements, master data or index values of the past, which can't be seen here. Bars are
keyed (symbol, date), as `cleaning.clean_panel` gives them; further columns are ignored.
"""

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import cleaning, cross_section as xs, fundamentals as fund, labels
from barloom.operators import technicals as tech
from barloom.plans import build
from barloom.schema import FEATURE_COLS, FUNDAMENTAL_COLS, HORIZONS, LABEL_COLS, OHLCV
from barloom.session import by_symbol, folder_exists, job_tables, materialize, remove_folder

KEY = ["symbol", "date"]
BARS = [*KEY, *OHLCV, "industry", "corp_action_break"]
ROWS = [*KEY, "industry", "adj_close", "close", "corp_action_break", *FEATURE_COLS, *LABEL_COLS]
#: Labels that look ahead along the symbol; the others compare them within a date.
OWN_LABELS = [f"{stem}_{h}d" for stem in ("fwd_return", "positive_return", "future_volatility") for h in HORIZONS]
TAIL_ROWS = max(max(HORIZONS), tech.WINDOW_ROWS) + 1
#: Days of the index kept: its longest window is 50, and a return needs the day before.
TAIL_DAYS = 60


def _month(date="date"):
    return F.year(date) * 100 + F.month(date)


def _write_months(rows: DataFrame, out: str, mode: str) -> None:
    (rows.select(*ROWS, _month().alias("month")).repartitionByRange("month", "symbol")
     .sortWithinPartitions("month", *KEY)
     .write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("month")
     .parquet(f"{out}/months"))


def _version(date) -> int:
    return date.year * 10000 + date.month * 100 + date.day


def _write_state(out: str, tails: DataFrame, days: DataFrame, through) -> None:
    """Days come last: a version counts once it has them."""
    tails.write.mode("overwrite").parquet(f"{out}/tails/through={_version(through)}")
    days.coalesce(1).write.mode("overwrite").parquet(f"{out}/days/through={_version(through)}")


def covered(spark: SparkSession, out: str):
    """`through`, or None where no panel has been started."""
    return through(spark, out) if folder_exists(spark, f"{out}/days") else None


def through(spark: SparkSession, out: str):
    """The last date that the panel in `out` covers."""
    n = spark.read.parquet(f"{out}/days").agg(F.max("through")).first()[0]
    return datetime.date(n // 10000, n // 100 % 100, n % 100)


def _tails(levels: DataFrame, carries: DataFrame) -> DataFrame:
    """The last rows of each symbol, back to the row of its means at least."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    rows = levels.select(*BARS).withColumn("_back", back).join(carries, "symbol")
    near = (F.col("_back") <= TAIL_ROWS) | (F.col("date") >= F.col("_carry.date"))
    return rows.where(near).select(*BARS, "_carry")


def _last_days(index: DataFrame) -> DataFrame:
    return index.select("date", "nifty_close").orderBy(F.desc("date")).limit(TAIL_DAYS)


def start(out: str, clean: DataFrame, vix: DataFrame, known: DataFrame) -> None:
    """Builds the panel of all bars in the folder `out`; what lay there is replaced."""
    spark = clean.sparkSession
    last = clean.agg(F.max("date")).first()[0]
    if last is None:
        raise ValueError("no bars to start from")
    with job_tables(spark):
        for part in ("days", "tails"):
            remove_folder(spark, f"{out}/{part}")
        _write_months(build.feature_panel(clean, vix, known), out, "static")
        levels = by_symbol(tech.ema_levels(by_symbol(clean.select(*BARS))), dealt=True)
        _write_state(out, _tails(levels, tech.last_levels(levels)), _last_days(xs.index_days(clean)), last)


def extend(out: str, clean: DataFrame, vix: DataFrame, known: DataFrame) -> None:
    """Adds bars later than all that `out` covers. `vix` and `known` are whole, as in a build."""
    spark = clean.sparkSession
    old = through(spark, out)
    with job_tables(spark):
        fresh = materialize(clean.select(*BARS, "nifty_close"))
        first, last = fresh.agg(F.min("date"), F.max("date")).first()
        if last is None:
            return
        if first <= old:
            raise ValueError(f"bars of {first} in a panel that covers {old}: build it anew")
        tails = spark.read.parquet(f"{out}/tails/through={_version(old)}")
        days = _days(spark.read.parquet(f"{out}/days/through={_version(old)}"), fresh)
        levels = _levels(tails, fresh)
        own = _own_rows(levels)
        again = own.where("_old").select(*KEY, *[F.col(c).alias(f"_{c}") for c in OWN_LABELS])
        since = _first_changed(levels) or first
        kept = _relabelled(_stored(spark, out, since, old), again)
        whole = by_symbol(kept.unionByName(_new_rows(own, vix, known, days)))
        _write_months(_compared(whole), out, "dynamic")
        new = _tails(levels, tech.last_levels(levels))
        others = tails.join(new.select("symbol").distinct(), "symbol", "left_anti")
        _write_state(out, others.unionByName(new), _last_days(days), last)
    _forget(spark, out, _version(old))


def _days(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index on the kept and the new days, carried forward over gaps."""
    both = kept.select("date", "nifty_close").unionByName(xs.index_days(fresh))
    return materialize(xs.index_on_calendar(both, both))


def _levels(tails: DataFrame, fresh: DataFrame) -> DataFrame:
    """Tails and new rows of the symbols that have new rows, with their window features and
    means. One exchange deals them by symbol; all later windows run where they lie."""
    named = tails.join(fresh.select("symbol").distinct(), "symbol", "left_semi")
    rows = named.withColumn("_old", F.lit(True)).unionByName(
        fresh.select(*BARS, F.lit(False).alias("_old")), allowMissingColumns=True)
    carry = F.first("_carry", ignorenulls=True).over(Window.partitionBy("symbol"))
    laid = by_symbol(by_symbol(rows).withColumn("_carry", carry), dealt=True)
    return by_symbol(tech.ema_levels(tech.add_window_features(laid), carry="_carry"), dealt=True)


def _own_rows(levels: DataFrame) -> DataFrame:
    """Features and labels that need no other symbol; `_return` is the return before the mask."""
    rows = tech.ema_ratios(levels, [c for c in levels.columns if c in BARS or c == "_old"
                                    or c in FEATURE_COLS])
    return labels.mask_breaks(labels.add_forward_labels(rows.withColumn("_return", F.col("log_return"))))


def _first_changed(levels: DataFrame):
    """The earliest date whose labels the new rows change."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    ends = levels.where("_old").select("symbol", "date").withColumn("_back", back)
    return ends.where(F.col("_back") <= max(HORIZONS)).agg(F.min("date")).first()[0]


def _stored(spark, out: str, since, until) -> DataFrame:
    """The rows of the months from `since` on; months are written again as a whole."""
    return (spark.read.parquet(f"{out}/months")
            .where((F.col("month") >= since.year * 100 + since.month) & (F.col("date") <= F.lit(until)))
            .select(*ROWS))


def _relabelled(stored: DataFrame, again: DataFrame) -> DataFrame:
    joined = stored.join(again.withColumn("_again", F.lit(True)), KEY, "left")
    return joined.withColumns({c: F.when(F.col("_again"), F.col(f"_{c}")).otherwise(F.col(c))
                               for c in OWN_LABELS}).select(*ROWS)


def _new_rows(own: DataFrame, vix: DataFrame, known: DataFrame, days: DataFrame) -> DataFrame:
    """The new rows with all features; labels against others are still missing."""
    rows = own.where(~F.col("_old")).withColumnsRenamed({"log_return": "_masked", "_return": "log_return"})
    rows = xs.add_sector_return(xs.add_market_regime(rows, vix, days))
    rows = materialize(rows.drop("log_return").withColumnRenamed("_masked", "log_return"))
    facts = fund.add_fundamentals(rows.select(*KEY, "adj_close"), known)
    rows = rows.join(facts.select(*KEY, *FUNDAMENTAL_COLS), KEY)
    missing = [c for c in LABEL_COLS if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("double") for c in missing}).select(*ROWS)


def _compared(whole: DataFrame) -> DataFrame:
    """Labels against the date and the sector, on dates that are complete."""
    rest = [c for c in LABEL_COLS if c not in OWN_LABELS]
    narrow = whole.select(*KEY, "industry", "volatility_20", *[f"fwd_return_{h}d" for h in HORIZONS])
    ranked = by_symbol(labels.add_advanced_labels(labels.add_relative_labels(narrow)).select(*KEY, *rest))
    return whole.drop(*rest).join(ranked, KEY)


def _forget(spark, out: str, old: int) -> None:
    """Versions before the previous one go."""
    for row in spark.read.parquet(f"{out}/days").select("through").distinct().collect():
        if row["through"] < old:
            for part in ("days", "tails"):
                remove_folder(spark, f"{out}/{part}/through={row['through']}")


def panel(spark: SparkSession, out: str) -> DataFrame:
    """The gated panel, as `build.build` gives it."""
    return cleaning.gate(spark.read.parquet(f"{out}/months").drop("month"))
