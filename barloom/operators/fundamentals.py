"""Annual statements: assembly, filing dates, growth, and the point-in-time join."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import (
    canon_symbol, fiscal_label, fiscal_year_end, parse_number, ratio_change, safe_div)
from barloom.operators.asof import asof_join
from barloom.operators.technicals import PRICE
from barloom.schema import (
    FILING_WINDOW_DAYS, REPORTING_LAG_DAYS, RESULT_KEYWORDS, STATEMENT_LABELS)

# A symbol files once a year, so its rows are few whatever the panel's size.
def by_year():
    return Window.partitionBy("symbol").orderBy("fiscal_year_end")



def assemble_statements(cells: DataFrame, labels: dict = None) -> DataFrame:
    """Long statement cells (symbol, label, year, value text) -> one row per
    (symbol, fiscal label); a year present in any section gives a row."""
    labels = STATEMENT_LABELS if labels is None else labels
    name = F.regexp_replace(F.col("label"), r"\++$", "")
    wide = (cells.where(F.col("year") != "TTM")
            .groupBy("symbol", F.col("year").alias("fiscal_label"))
            .agg(*[F.min_by(parse_number("value"), F.when(
                (name == shown) & parse_number("value").isNotNull(), F.struct("label", "value")))
                   .alias(col) for shown, col in labels.items()]))
    return wide


def add_statement_ratios(df: DataFrame) -> DataFrame:
    """ROE in percent (2 dp) and debt to equity (3 dp); missing equity parts are 0."""
    equity = F.coalesce("equity_capital", F.lit(0.0)) + F.coalesce("reserves", F.lit(0.0))
    return df.withColumns({
        "roe_pct": F.round(safe_div("net_profit", equity) * 100, 2),
        "debt_to_equity": F.round(safe_div("borrowings", equity), 3)})


def match_filings(years: DataFrame, announcements: DataFrame, keywords=RESULT_KEYWORDS,
                  window_days: int = FILING_WINDOW_DAYS,
                  lag_days: int = REPORTING_LAG_DAYS) -> DataFrame:
    """Earliest results announcement within `window_days` of each fiscal year end.

    Announcements are first reduced to one per (symbol, day) on the map side. The
    range condition becomes an equality on the month, so a busy symbol is matched
    only against the months its own windows touch.
    """
    said = F.concat_ws("\n", F.lower("desc"), F.lower("attachment"))
    told = announcements.where(reduce(lambda a, k: a | said.contains(k.lower()), keywords, F.lit(False)))
    month = F.trunc("day", "month")
    daily = (told.groupBy("symbol", F.to_date("ts").alias("day"))
             .agg(F.min("ts").alias("_ts")).withColumn("_month", month))
    # Whole days are compared: an announcement of any hour of the last day counts.
    last = F.date_add("fiscal_year_end", window_days)
    spans = years.select("symbol", "fiscal_year_end").distinct().select(
        "symbol", "fiscal_year_end",
        F.explode(F.sequence(F.trunc("fiscal_year_end", "month"), F.trunc(last, "month"),
                             F.expr("interval 1 month"))).alias("_month"))
    inside = (F.col("day") >= F.col("fiscal_year_end")) & (F.col("day") <= last)
    first = (spans.join(daily, ["symbol", "_month"]).where(inside)
             .groupBy("symbol", "fiscal_year_end").agg(F.min("_ts").alias("_ts")))
    return (years.join(first, ["symbol", "fiscal_year_end"], "left")
            .withColumns({
                "known_date": F.coalesce(F.to_date("_ts"),
                                         F.date_add("fiscal_year_end", lag_days)),
                "source": F.when(F.col("_ts").isNotNull(), "nse_actual")
                .otherwise("approximation_fallback")})
            .drop("_ts"))


def point_in_time(fundamentals: DataFrame, filings: DataFrame = None,
                  lag_days: int = REPORTING_LAG_DAYS) -> DataFrame:
    """Fiscal rows with their validity date and year-on-year growth.

    `fundamentals` has symbol, fiscal_label, net_profit, eps, roe_pct; `filings`
    symbol, fiscal_label, known_date. Labels are normalised on both sides.
    """
    f = (fundamentals.withColumns({
        "symbol": canon_symbol("symbol"),
        "fiscal_year_end": fiscal_year_end("fiscal_label"),
        "fiscal_label": fiscal_label("fiscal_label")})
        .where(F.col("fiscal_year_end").isNotNull()))
    fallback = F.date_add("fiscal_year_end", lag_days)
    if filings is None:
        f = f.withColumn("known_date", fallback)
    else:
        dates = (filings.groupBy(canon_symbol("symbol").alias("symbol"),
                                 fiscal_label("fiscal_label").alias("fiscal_label"))
                 .agg(F.min("known_date").alias("known_date")))
        f = (f.join(dates, ["symbol", "fiscal_label"], "left")
             .withColumn("known_date", F.coalesce("known_date", fallback)))
    return f.withColumns({
        "fund_net_profit_growth": _growth("net_profit"),
        "fund_eps_growth": _growth("eps"),
        "fund_roe": F.col("roe_pct") / 100})


def _growth(col: str):
    """Change on the previous year's row; missing if either value is."""
    return ratio_change(F.col(col), F.lag(col).over(by_year()))


def add_fundamentals(panel: DataFrame, known: DataFrame) -> DataFrame:
    """As-of join of `point_in_time` rows onto the panel, and the P/E ratio."""
    payload = ["eps", "fund_roe", "fund_net_profit_growth", "fund_eps_growth"]
    out = asof_join(panel, known.select("symbol", "known_date", "fiscal_year_end", *payload),
                    "date", "known_date", payload=payload,
                    tie_break=["fiscal_year_end", *payload])
    pe = F.when(F.col("eps") > 0, F.col(PRICE) / F.col("eps"))
    return out.withColumn("fund_pe_ratio", pe).drop("known_date", "eps")


def provenance(filings: DataFrame) -> DataFrame:
    return filings.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
