"""Lookup, top-k and overview queries on the stored feature panel."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.functions.scalar import signal_label, tier_label
from barloom.operators.cleaning import row_asof
from barloom.operators.cross_section import with_row
from barloom.operators.models import positive_probability
from barloom.operators.order_stats import with_rank


HISTORY_DAYS, TOP_NAMES = 1000, 48  # what the service accepts


def check_horizon(h: int) -> int:
    if h not in S.HORIZONS:
        raise ValueError(f"horizon must be one of {S.HORIZONS}")
    return h


def check_range(value: int, most: int, what: str) -> int:
    if not 1 <= int(value) <= most:
        raise ValueError(f"{what} must lie in 1 .. {most}")
    return int(value)


def latest_rows(panel: DataFrame, cols=None) -> DataFrame:
    """Each symbol's last row: one map-side combined aggregate, no sort."""
    cols = [c for c in (cols or panel.columns) if c != "symbol"]
    packed = F.struct(*dict.fromkeys(["date", *cols]))
    return (panel.groupBy("symbol").agg(F.max_by(packed, "date").alias("_l"))
            .select("symbol", *[F.col(f"_l.{c}").alias(c) for c in
                                dict.fromkeys(["date", *cols])]))


def latest_quotes(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("symbol").agg(
        F.max_by("ltp", F.struct("ts", "ltp")).alias("ltp"), F.max("ts").alias("quote_ts"))


def overlay_quotes(rows: DataFrame, quotes: DataFrame = None, as_of=None,
                   ttl_seconds: int = 5, close: str = "close",
                   expected: str = None) -> DataFrame:
    """last_close = fresh quote or stored close, with `is_live`.

    A quote is fresh when it is at most `ttl_seconds` older than `as_of` (a
    timestamp literal or column; the newest quote when not given). `expected` names
    an expected-return column from which expected_price is recomputed.
    """
    if quotes is None:
        out = rows.withColumns({"is_live": F.lit(False), "_px": F.col(close)})
    else:
        last = latest_quotes(quotes)
        if as_of is None:
            last = with_row(last, quotes.agg(F.max("ts").alias("_now")))
            now = F.col("_now")
        else:
            now = as_of if isinstance(as_of, Column) else F.lit(as_of)
        floor = now - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))
        fresh = last.where((F.col("quote_ts") >= floor) & (F.col("quote_ts") <= now))
        out = rows.join(fresh.select("symbol", "ltp"), "symbol", "left").withColumns({
            "is_live": F.col("ltp").isNotNull(), "_px": F.coalesce("ltp", F.col(close))})
        out = out.drop("ltp")
    out = out.withColumn("last_close", F.round("_px", 2))
    if expected:
        out = out.withColumn("expected_price", F.round(F.col("_px") * (1 + F.col(expected)), 2))
    return out.drop("_px")


def list_companies(panel: DataFrame, quotes: DataFrame = None, **fresh) -> DataFrame:
    rows = latest_rows(panel, ["industry", "close"])
    return overlay_quotes(rows, quotes, **fresh).select(
        "symbol", "industry", "last_close", "is_live",
        F.date_format("date", "yyyy-MM-dd").alias("as_of_date"))


def macd_signal(col="macd_hist_norm"):
    return F.when(F.col(col) > 0, "Bullish").otherwise("Bearish")


def volume_trend(col="volume_ratio"):
    return (F.when(F.col(col) > 1.1, "Above Average").when(F.col(col) < 0.9, "Below Average")
            .otherwise("Average"))


def company_detail(panel: DataFrame, symbol: str, quotes: DataFrame = None, **fresh) -> DataFrame:
    """Latest fundamentals and technicals of one symbol; no row when unknown."""
    cols = ["industry", "close", "fund_roe", "fund_pe_ratio", "fund_net_profit_growth",
            "fund_eps_growth", "rsi_14", "macd_hist_norm", "price_to_sma50",
            "price_to_ema200", "volatility_20", "volume_ratio"]
    rows = latest_rows(panel.where(F.col("symbol") == symbol.upper()), cols)

    def pct(c):
        return F.round(F.col(c) * 100, 2)

    return overlay_quotes(rows, quotes, **fresh).select(
        "symbol", "industry", "last_close", "is_live",
        F.date_format("date", "yyyy-MM-dd").alias("as_of_date"),
        pct("fund_roe").alias("roe_pct"), F.round("fund_pe_ratio", 2).alias("pe_ratio"),
        pct("fund_net_profit_growth").alias("net_profit_growth_pct"),
        pct("fund_eps_growth").alias("eps_growth_pct"),
        F.round("rsi_14", 1).alias("rsi_14"), macd_signal().alias("macd_signal"),
        pct("price_to_sma50").alias("price_vs_sma50_pct"),
        pct("price_to_ema200").alias("price_vs_ema200_pct"),
        F.round("volatility_20", 4).alias("volatility_20d"),
        volume_trend().alias("volume_trend"))


def history(panel: DataFrame, symbol: str, days: int = 180) -> DataFrame:
    """Last `days` rows (1 to 1000, else an error) in date order, with the averages
    recovered from the close and the stored price ratios."""
    days = check_range(days, HISTORY_DAYS, "days")
    last = (panel.where(F.col("symbol") == symbol.upper())
            .select("date", "close", "price_to_sma20", "price_to_sma50", "rsi_14")
            .orderBy(F.desc("date")).limit(days))

    def average(c):
        return F.round(F.try_divide(F.col("close"), 1 + F.col(c)), 2)

    return last.orderBy("date").select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("close", 2).alias("close"),
        average("price_to_sma20").alias("sma20"), average("price_to_sma50").alias("sma50"),
        F.round("rsi_14", 1).alias("rsi_14"))


def market_overview(panel: DataFrame, index: DataFrame, quotes: DataFrame = None,
                    index_symbol: str = "NIFTY50", close: str = "nifty_close",
                    **fresh) -> DataFrame:
    """Universe and latest-day counts, index level and return, trend."""
    one = panel.agg(F.count_distinct("symbol").alias("stocks_in_universe"),
                    F.max("date").alias("_last"))
    today = with_row(panel.select("date", "symbol", "nifty_return", "log_return"), one).where(
        F.col("date") == F.col("_last"))
    day = today.agg(
        F.max("date").alias("date"), F.max("stocks_in_universe").alias("stocks_in_universe"),
        F.count_distinct("symbol").alias("stocks_with_data_as_of_date"),
        F.max("nifty_return").alias("_ret"),
        F.count_if(F.col("log_return") > 0).alias("stocks_positive_today"),
        F.count_if(F.col("log_return") <= 0).alias("stocks_negative_today"))
    level = index.groupBy("date").agg(F.max(close).alias("close"))
    rows = day.join(level, "date", "left").withColumn("symbol", F.lit(index_symbol))
    out = overlay_quotes(rows, quotes, **fresh)
    return out.select(
        F.date_format("date", "yyyy-MM-dd").alias("as_of_date"),
        F.col("last_close").alias("index_close"),
        F.round(F.col("_ret") * 100, 2).alias("index_daily_return_pct"),
        F.when(F.col("_ret") > 0, "Positive").otherwise("Negative").alias("market_trend"),
        "stocks_in_universe", "stocks_with_data_as_of_date", "stocks_positive_today",
        "stocks_negative_today", "is_live")


def risk_tiers(day: DataFrame, keys=("date",), vol: str = "volatility_20") -> DataFrame:
    """Tier of a name's volatility from the share of same-day names strictly below it."""
    size = day.groupBy(*keys).agg(F.count(F.lit(1)).alias("_names"),
                                  F.count(vol).alias("_valued"))
    below = with_rank(day, keys, vol, below="_below").join(size, list(keys), "left")
    share = F.coalesce(F.col("_below"), F.lit(0.0)) * F.col("_valued") / F.col("_names")
    return below.withColumn("risk_level", tier_label(share, S.RISK_HIGH, S.RISK_LOW)).drop(
        "_below", "_names", "_valued")


def track_record(spark) -> DataFrame:
    return spark.createDataFrame(S.TRACK_RECORD, "horizon int, historical_accuracy double, "
                                                 "historical_accuracy_top_tercile double")


def _heads(rows: DataFrame, models: dict, horizon: int) -> DataFrame:
    median, tercile = models[check_horizon(horizon)]
    scored = positive_probability(median, rows, "_median")
    scored = positive_probability(tercile, scored, "_tercile")
    return scored.withColumnsRenamed({"_median": "probability",
                                      "_tercile": "probability_top_tercile"})


def _served(rows: DataFrame, horizon: int, *extra) -> DataFrame:
    record = track_record(rows.sparkSession).where(F.col("horizon") == horizon)
    sig = signal_label("probability", S.SIGNAL_POSITIVE, S.SIGNAL_NEGATIVE)
    return rows.withColumn("horizon", F.lit(horizon)).join(
        F.broadcast(record), "horizon").select(
        *extra, "symbol", "industry", "last_close", "is_live",
        F.date_format("date", "yyyy-MM-dd").alias("as_of_date"), "horizon",
        F.round("probability", 4).alias("probability_beats_median"),
        F.round("probability_top_tercile", 4).alias("probability_top_tercile"),
        sig.alias("signal"), "risk_level", "historical_accuracy",
        "historical_accuracy_top_tercile")


def prediction(panel: DataFrame, models: dict, symbol: str, horizon: int,
               quotes: DataFrame = None, **fresh) -> DataFrame:
    """Both head probabilities, signal and risk tier of a symbol's latest row.

    `panel` carries the scaled vector `features` beside the natural-unit columns.
    """
    check_horizon(horizon)
    row = row_asof(panel, symbol, "9999-12-31")
    day = panel.select("date", "symbol", "volatility_20").join(
        F.broadcast(row.select("date")), "date", "left_semi")
    tier = risk_tiers(day).where(F.col("symbol") == symbol.upper()).select("symbol", "risk_level")
    rows = overlay_quotes(_heads(row, models, horizon).join(tier, "symbol"), quotes, **fresh)
    return _served(rows, horizon)


def top_predictions(panel: DataFrame, models: dict, horizon: int, limit: int = 10,
                    quotes: DataFrame = None, **fresh) -> DataFrame:
    """Best names of the latest date by probability (1 to 48, else an error), ranked."""
    limit = check_range(limit, TOP_NAMES, "limit")
    last = panel.agg(F.max("date").alias("date"))
    day = panel.join(F.broadcast(last), "date", "left_semi")
    tiers = risk_tiers(day.select("date", "symbol", "volatility_20")).select(
        "symbol", "risk_level")
    best = _heads(day, models, horizon).orderBy(F.desc("probability"), "symbol").limit(limit)
    rows = overlay_quotes(best.join(tiers, "symbol"), quotes, **fresh)
    # At most 48 rows reach this window.
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("probability"), "symbol")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return _served(ranked, horizon, "rank").orderBy("rank")


def top_ranked(panel: DataFrame, score: str, limit: int = 10) -> DataFrame:
    """Best names of the latest date by any score column."""
    last = panel.agg(F.max("date").alias("date"))
    day = panel.join(F.broadcast(last), "date", "left_semi")
    return day.where(F.col(score).isNotNull()).orderBy(F.desc(score), "symbol").limit(limit)


def return_forecast(panel: DataFrame, model, symbol: str, date=None,
                    quotes: DataFrame = None, version: str = "30d-reg-v1", **fresh) -> DataFrame:
    """Expected 30-row return of a symbol as of a date and the implied price.

    `model` maps natural-unit feature columns to `prediction` (a fitted pipeline).
    """
    asked = F.lit(date).cast("date") if date is not None else None
    row = row_asof(panel, symbol, date if date is not None else "9999-12-31")
    scored = model.transform(row).withColumn("expected_return", F.col("prediction"))
    out = overlay_quotes(scored, quotes, expected="expected_return", **fresh)
    day = F.col("date") if asked is None else asked
    return out.select(
        "symbol", F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.date_format("date", "yyyy-MM-dd").alias("as_of_date"),
        F.col("last_close").alias("current_price"),
        F.round("expected_return", 4).alias("expected_return_30d"),
        F.round(F.col("expected_return") * 100, 2).alias("expected_return_percent"),
        "expected_price", F.lit(S.PRIMARY_HORIZON).alias("horizon_trading_days"),
        F.lit(version).alias("model_version"), "is_live")


def score_symbols(panel: DataFrame, models: dict, symbols=None, first: int = 5) -> DataFrame:
    """Long table of both probabilities at every horizon for named symbols, or for
    the first few of the universe."""
    names = panel.select("symbol").distinct().orderBy("symbol").limit(first) \
        if symbols is None else None
    rows = panel.where(F.col("symbol").isin(list(symbols))) if symbols is not None \
        else panel.join(F.broadcast(names), "symbol", "left_semi")
    latest = latest_rows(rows, ["close", "features"])
    record = F.broadcast(track_record(panel.sparkSession))
    out = None
    for h in sorted(models):
        part = _heads(latest, models, h).select(
            "symbol", F.date_format("date", "yyyy-MM-dd").alias("as_of_date"),
            F.round("close", 2).alias("current_price"), F.lit(h).alias("horizon"),
            F.round("probability", 4).alias("probability_beats_median"),
            F.round("probability_top_tercile", 4).alias("probability_top_tercile"))
        out = part if out is None else out.unionByName(part)
    return out.join(record, "horizon")


def per_symbol(df: DataFrame, func, schema) -> DataFrame:
    """Escape hatch for a user's own pandas function over one symbol's rows (bounded
    by the calendar: one row per date)."""
    return df.groupBy("symbol").applyInPandas(func, schema)
