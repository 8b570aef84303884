"""Cleaning and shaping of bar tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import timeline
from barloom.operators.cross_section import attach, index_on_calendar
from barloom.schema import FEATURE_COLS, OHLCV, REQUIRED_LABELS


def unique_bars(bars: DataFrame, prefer: str = None) -> DataFrame:
    """One row per (symbol, date), the one with the smallest `prefer` value.

    A group-by with a map-side combine: a symbol or day that fills a third of the
    input shrinks to its distinct keys before any shuffle.
    """
    rest = [c for c in bars.columns if c not in ("symbol", "date")]
    row = F.struct(*rest)
    pick = F.min_by(row, F.col(prefer) if prefer else row)
    return (bars.groupBy("symbol", "date").agg(pick.alias("_row"))
            .select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c)
                      for c in bars.columns if c != prefer]))


def drop_holidays(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("volume") > 0)


def flag_breaks(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """corp_action_break is true on the listed (symbol, date) pairs."""
    marks = actions.select("symbol", "date").distinct().withColumn("_hit", F.lit(True))
    return (attach(bars, marks, ["symbol", "date"])
            .withColumn("corp_action_break", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def clean_panel(bars: DataFrame, master: DataFrame, index: DataFrame,
                actions: DataFrame) -> DataFrame:
    """Traded bars of listed symbols with break flags, master data and the index.

    `index` carries its prefixed columns; it is filled forward on the panel's dates.
    """
    traded = drop_holidays(bars).join(master.select("symbol"), "symbol", "left_semi")
    flagged = flag_breaks(traded, actions)
    named = attach(flagged, master, ["symbol"])
    return attach(named, index_on_calendar(named.select("date"), index), ["date"])


def fill_forward(bars: DataFrame, cols=OHLCV, required=("date", "symbol", "close")) -> DataFrame:
    back = timeline().rowsBetween(Window.unboundedPreceding, 0)
    return (bars.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in cols})
            .dropna(subset=list(required)))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) for the columns that have any."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls"))
                      for c in df.columns])
    return (counts.select(F.explode(pairs).alias("_p")).select("_p.column", "_p.nulls")
            .where("nulls > 0"))


def gate(panel: DataFrame, required=None) -> DataFrame:
    """Rows with every feature and required label; best-effort labels are exempt."""
    return panel.dropna(subset=list(required or FEATURE_COLS + REQUIRED_LABELS))


def gate_report(panel: DataFrame, required=None, extras=()) -> DataFrame:
    """Rows before and after the gate and non-NULL counts of best-effort labels after it."""
    required = list(required or FEATURE_COLS + REQUIRED_LABELS)
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return panel.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(ok).alias("rows_after"),
        *[F.count_if(ok & F.col(c).isNotNull()).alias(f"n_{c}") for c in extras])


def row_asof(panel: DataFrame, symbol: str, date) -> DataFrame:
    """The last row of a symbol on or before a date (no row when there is none)."""
    return (panel.where((F.col("symbol") == symbol.upper())
                        & (F.col("date") <= F.lit(date).cast("date")))
            .orderBy(F.desc("date")).limit(1))


def search_symbols(companies: DataFrame, text: str = "", industry: str = None,
                   sort: str = "symbol", price: str = "last_close") -> DataFrame:
    """Case-insensitive substring filter, industry filter, and the two list orders."""
    out = companies.where(F.lower("symbol").contains(text.strip().lower()))
    if industry:
        out = out.where(F.col("industry") == industry)
    if sort == "price":
        return out.orderBy(F.desc(price), "symbol")
    return out.orderBy("symbol")


def industries(companies: DataFrame) -> DataFrame:
    return companies.select("industry").distinct().orderBy("industry")
