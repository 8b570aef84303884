"""Declared schemas and the fixed vocabularies every stage shares."""

from pyspark.sql import types as T

# --- fixed values: horizons, thresholds and column names results depend on ---
HORIZONS = [7, 30, 60, 90]
PRIMARY_HORIZON = 30
PRIMARY_TARGET = "fwd_return_30d"
MIN_HISTORY_ROWS = 300
REPORTING_LAG_DAYS = 60
FILING_WINDOW_DAYS = 90

TECHNICAL_COLS = [
    "log_return", "price_to_sma10", "price_to_sma20", "price_to_sma50",
    "price_to_ema20", "price_to_ema50", "price_to_ema200",
    "macd_norm", "macd_hist_norm", "rsi_14", "bb_pct_b", "bb_width",
    "volatility_10", "volatility_20", "roc_5", "roc_10", "roc_20", "roc_40",
    "atr_pct", "volume_ratio", "dist_to_high20", "dist_to_low20",
    "dist_to_high50", "dist_to_low50", "obv_zscore_20",
]
REGIME_COLS = [
    "nifty_return", "nifty_volatility_20", "nifty_trend",
    "relative_strength", "sector_return", "vix_zscore_60", "vix_change_5d",
]
FUNDAMENTAL_COLS = [
    "fund_roe", "fund_net_profit_growth", "fund_eps_growth", "fund_pe_ratio",
]
FEATURE_COLS = TECHNICAL_COLS + REGIME_COLS + FUNDAMENTAL_COLS
LOG1P_COLS = ["atr_pct", "volume_ratio", "bb_width", "fund_pe_ratio"]

RESULT_KEYWORDS = [
    "financial result", "audited financial statement", "audited financial result",
]
STATEMENT_LABELS = {
    "Sales": "sales", "Net Profit": "net_profit", "EPS in Rs": "eps",
    "Equity Capital": "equity_capital", "Reserves": "reserves",
    "Borrowings": "borrowings", "ROCE %": "roce_pct",
}
# Renamed tickers (old -> new), one table for every feed.
SYMBOL_RENAMES = {"TATAMOTORS": "TMPV"}
# Known corporate actions: (symbol, type, date, breaks the price series).
CORPORATE_ACTIONS = [
    ("HDFC", "merger", "2023-07-01", False),
    ("INFRATEL", "merger", "2020-11-19", False),
    ("TATAMOTORS", "demerger", "2025-10-14", True),
    ("TMPV", "demerger", "2025-10-14", True),
    ("VEDL", "demerger", "2026-04-30", True),
]
# Published test-set hit rates per horizon: (horizon, median head, tercile head).
TRACK_RECORD = [
    (7, 0.502, 0.503), (30, 0.511, 0.508), (60, 0.507, 0.510), (90, 0.515, 0.515),
]
SIGNAL_POSITIVE, SIGNAL_NEGATIVE = 0.54, 0.46
RISK_HIGH, RISK_LOW = 0.66, 0.33
# Names of the landing inputs beside the per-symbol bar files.
LANDING = {
    "master": "stock_metadata.csv", "index": "NIFTY50_INDEX.csv",
    "volatility_index": "INDIA_VIX.csv", "fundamentals": "fundamentals_annual.csv",
    "filings": "filing_dates.csv",
}
# --- end of fixed values ---

REQUIRED_LABELS = [
    f"{stem}_{h}d"
    for stem in ("fwd_return", "rel_return", "beats_median", "positive_return",
                 "future_volatility")
    for h in HORIZONS
]
EXTRA_LABELS = [
    f"{stem}_{h}d"
    for stem in ("rel_return_sector", "beats_sector_median", "fwd_return_vol_adj",
                 "fwd_return_rank", "top_tercile")
    for h in HORIZONS
]
LABEL_COLS = REQUIRED_LABELS + EXTRA_LABELS

OHLCV = ["open", "high", "low", "close", "adj_close", "volume"]
RAW_BAR_HEADER = ["Date", "Symbol", "Adj Close", "Close", "High", "Low", "Open", "Volume"]


def _struct(*cols):
    kinds = {"s": T.StringType(), "d": T.DateType(), "f": T.DoubleType(),
             "l": T.LongType(), "t": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k], True) for n, k in cols])


BARS = _struct(("symbol", "s"), ("date", "d"), ("open", "f"), ("high", "f"),
               ("low", "f"), ("close", "f"), ("adj_close", "f"), ("volume", "l"))
RAW_BARS = _struct(("Date", "d"), ("Symbol", "s"), ("Adj Close", "f"), ("Close", "f"),
                   ("High", "f"), ("Low", "f"), ("Open", "f"), ("Volume", "l"))
RAW_INDEX = _struct(("Date", "d"), ("Adj Close", "f"), ("Close", "f"), ("High", "f"),
                    ("Low", "f"), ("Open", "f"), ("Volume", "l"))
MASTER = _struct(("Company Name", "s"), ("Industry", "s"), ("Symbol", "s"),
                 ("Series", "s"), ("ISIN Code", "s"))
FILINGS = _struct(("Symbol", "s"), ("FiscalYearEnd", "s"), ("known_date", "d"),
                  ("source", "s"))
FUNDAMENTALS = _struct(
    ("Symbol", "s"), ("FiscalYearEnd", "s"), ("sales", "f"), ("net_profit", "f"),
    ("eps", "f"), ("equity_capital", "f"), ("reserves", "f"), ("borrowings", "f"),
    ("roce_pct", "f"), ("roe_pct", "f"), ("debt_to_equity", "f"))
ANNOUNCEMENTS = _struct(("symbol", "s"), ("ts", "t"), ("desc", "s"), ("attachment", "s"))
QUOTES = _struct(("symbol", "s"), ("ts", "t"), ("ltp", "f"))
