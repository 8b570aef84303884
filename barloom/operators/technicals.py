"""Per-symbol technical features.

A feature group is a list of levels: level i may use columns of level i-1. Levels
of all requested groups are merged, so the windows of one level are evaluated in
one pass, and every window shares the one exchange and sort by (symbol, date).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import lag_by, ratio_change, rolling, safe_div, timeline
from barloom.operators.ewm import add_ewm

PRICE = "adj_close"


def log_return():
    return [{"_prev": lag_by(PRICE, 1)},
            {"log_return": F.ln(safe_div(PRICE, "_prev"))}]


def rate_of_change(widths=(5, 10, 20, 40)):
    return [{f"_lag{w}": lag_by(PRICE, w) for w in widths},
            {f"roc_{w}": ratio_change(PRICE, f"_lag{w}") for w in widths}]


def sma_ratio(widths=(10, 20, 50)):
    return [{f"_sma{w}": rolling(F.avg, PRICE, w) for w in widths},
            {f"price_to_sma{w}": ratio_change(PRICE, f"_sma{w}") for w in widths}]


def bollinger(width: int = 20, sigmas: float = 2.0):
    mid, half = F.col(f"_sma{width}"), sigmas * F.col(f"_std{width}")
    return [{f"_sma{width}": rolling(F.avg, PRICE, width),
             f"_std{width}": rolling(F.stddev_samp, PRICE, width)},
            {"_lower": mid - half, "_upper": mid + half},
            {"_over": F.col(PRICE) - F.col("_lower"),
             "_band": F.col("_upper") - F.col("_lower")},
            {"bb_pct_b": safe_div("_over", "_band"),
             "bb_width": safe_div("_band", f"_sma{width}")}]


def rsi(width: int = 14):
    """Simple-mean RSI; the first change is missing, so row width+1 is the first."""
    return [{"_prev": lag_by(PRICE, 1)},
            {"_delta": F.col(PRICE) - F.col("_prev")},
            {"_gain": F.when(F.col("_delta").isNotNull(), F.greatest("_delta", F.lit(0.0))),
             "_loss": F.when(F.col("_delta").isNotNull(), F.greatest(-F.col("_delta"), F.lit(0.0)))},
            {"_up": rolling(F.avg, "_gain", width), "_down": rolling(F.avg, "_loss", width)},
            {"_rs": safe_div("_up", "_down")},
            {f"rsi_{width}": 100 - 100 / (1 + F.col("_rs"))}]


def volatility(widths=(10, 20)):
    return [*log_return(),
            {f"volatility_{w}": rolling(F.stddev_samp, "log_return", w) for w in widths}]


def atr(width: int = 14):
    """Raw high/low against the adjusted previous close; row 1 is just high - low."""
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")),
                        F.abs(F.col("low") - F.col("_prev")))
    return [{"_prev": lag_by(PRICE, 1)}, {"_range": spread},
            {"_atr": rolling(F.avg, "_range", width)},
            {"atr_pct": safe_div("_atr", PRICE)}]


def volume_ratio(width: int = 20):
    return [{f"_vol{width}": rolling(F.avg, "volume", width)},
            {"volume_ratio": safe_div("volume", f"_vol{width}")}]


def channel_distance(widths=(20, 50)):
    frames, ratios = {}, {}
    for w in widths:
        frames[f"_high{w}"] = rolling(F.max, "high", w)
        frames[f"_low{w}"] = rolling(F.min, "low", w)
        ratios[f"dist_to_high{w}"] = ratio_change(PRICE, f"_high{w}")
        ratios[f"dist_to_low{w}"] = ratio_change(PRICE, f"_low{w}")
    return [frames, ratios]


def obv(width: int = 20):
    """On-balance volume as a z-score against its own last `width` values."""
    running = timeline().rowsBetween(Window.unboundedPreceding, 0)
    step = F.signum(F.coalesce("log_return", F.lit(0.0))) * F.col("volume")
    return [*log_return(), {"_step": step}, {"_obv": F.sum("_step").over(running)},
            {"_omean": rolling(F.avg, "_obv", width),
             "_ostd": rolling(F.stddev_samp, "_obv", width)},
            {"_ogap": F.col("_obv") - F.col("_omean")},
            {f"obv_zscore_{width}": safe_div("_ogap", "_ostd")}]


def add_features(df: DataFrame, *groups) -> DataFrame:
    """Evaluate feature groups level by level; helper columns (leading _) go."""
    keep = list(df.columns)
    for level in range(max(len(g) for g in groups)):
        new = {}
        for g in groups:
            if level < len(g):
                new.update({k: v for k, v in g[level].items() if k not in df.columns})
        keep += [c for c in new if not c.startswith("_") and c not in keep]
        df = df.withColumns(new)
    return df.select(*keep)


def ema_levels(df: DataFrame, spans=(20, 50, 200), carry: str = None) -> DataFrame:
    """The exponential means behind the EMA ratios and MACD, and `_seen`, the row's number.

    `carry` names a column that holds, on every row of a symbol whose earlier history is not in
    `df`, the struct (date, seen, means) of `last_levels`: the means go on from there, and rows
    before its date have none.
    """
    means = {**{f"_ema{s}": s for s in spans}, "_fast": 12, "_slow": 26}

    def source(name, value):
        if not carry:
            return F.col(value)
        at = F.col(f"{carry}.date")
        return (F.when(F.col("date") < at, None).when(F.col("date") == at, F.col(f"{carry}.{name}"))
                .otherwise(F.col(value)))

    keep, order = df.columns, timeline()
    if carry:
        df = df.withColumns({f"_x{n}": source(n, PRICE) for n in means})
    df = add_ewm(df, [(f"_x{n}" if carry else PRICE, s, n) for n, s in means.items()])
    df = df.withColumn("_macd", F.col("_fast") - F.col("_slow"))
    df = add_ewm(df.withColumn("_line", source("_signal", "_macd")), [("_line", 9, "_signal")])
    seen = F.row_number().over(order)
    if carry:
        later = F.count_if(F.col("date") > F.col(f"{carry}.date")).over(order)
        seen = F.coalesce(F.col(f"{carry}.seen") + later, seen)
    return df.withColumn("_seen", seen).select(*keep, *means, "_macd", "_signal", "_seen")


def last_levels(levels: DataFrame, spans=(20, 50, 200)) -> DataFrame:
    """(symbol, _carry): the means at each symbol's last row with a price (its last row, if none)."""
    names = [*[f"_ema{s}" for s in spans], "_fast", "_slow", "_signal"]
    state = F.struct("date", F.col("_seen").alias("seen"), *names)
    return levels.groupBy("symbol").agg(F.max_by(
        state, F.struct(F.col(PRICE).isNotNull(), F.col("date"))).alias("_carry"))


def add_ema_family(df: DataFrame, spans=(20, 50, 200)) -> DataFrame:
    """EMA ratios (first span-1 rows masked) and the unmasked MACD pair."""
    return ema_ratios(ema_levels(df, spans), df.columns, spans)


def ema_ratios(levels: DataFrame, keep, spans=(20, 50, 200)) -> DataFrame:
    df = levels.withColumn("_hist", F.col("_macd") - F.col("_signal"))
    new = {f"price_to_ema{s}": F.when(F.col("_seen") >= s, ratio_change(PRICE, f"_ema{s}"))
           for s in spans}
    new["macd_norm"] = safe_div("_macd", PRICE)
    new["macd_hist_norm"] = safe_div("_hist", PRICE)
    return df.withColumns(new).select(*keep, *new)


def add_window_features(bars: DataFrame) -> DataFrame:
    """The features that look back a fixed number of rows, at most `WINDOW_ROWS`."""
    return add_features(
        bars, log_return(), sma_ratio(), bollinger(), volatility(), rate_of_change(), rsi(),
        atr(), volume_ratio(), channel_distance(), obv())


#: Rows before a row that its window features depend on: 50 and the previous close.
WINDOW_ROWS = 51


def add_technicals(bars: DataFrame) -> DataFrame:
    """All per-symbol features of a bar table keyed (symbol, date)."""
    return add_ema_family(add_window_features(bars))
