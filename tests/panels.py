"""Small hand-made panels, and features worked out row by row."""

import datetime
import math

import numpy as np
import pandas as pd

DAY0 = datetime.date(2020, 1, 1)
SECTORS = {"AAA": "X", "BBB": "X", "CCC": "Y", "DDD": "X"}


def bars(n=260, seed=3):
    """Three long symbols, one short; flat stretches give zero gains and losses."""
    rng = np.random.default_rng(seed)
    parts = []
    for s, rows in (("AAA", n), ("BBB", n), ("CCC", n), ("DDD", 25)):
        step = rng.normal(0, 0.02, rows)
        step[40:60] = 0.0 if s == "CCC" else step[40:60]
        close = 100 * np.exp(np.cumsum(step))
        spread = rng.uniform(0, 2, rows)
        parts.append(pd.DataFrame({
            "symbol": s, "date": [DAY0 + datetime.timedelta(days=i) for i in range(rows)],
            "open": close, "high": close + spread, "low": close - spread, "close": close,
            "adj_close": close * 0.97, "volume": rng.integers(1, 1000, rows),
            "industry": SECTORS[s]}))
    return pd.concat(parts, ignore_index=True)


class Series:
    """One symbol's columns as arrays; features are defined at a row i of them."""

    def __init__(self, g):
        self.p, self.hi, self.lo = (g[c].to_numpy(float) for c in ("adj_close", "high", "low"))
        self.v = g["volume"].to_numpy(float)
        self.n = len(g)
        self.memo = {}

    def change(self, i, k=1):
        return self.p[i] / self.p[i - k] - 1 if i >= k else np.nan

    def log_return(self, i):
        return math.log(self.p[i] / self.p[i - 1]) if i else np.nan

    def window(self, value, i, w):
        """The last w values up to row i; none if there are fewer or one is missing."""
        if i + 1 < w:
            return None
        x = np.array([value(j) for j in range(i - w + 1, i + 1)])
        return None if np.isnan(x).any() else x

    def ema(self, value, span, i):
        """Recurrence from the first row on, remembered row by row."""
        done = self.memo.setdefault((value.__name__, span), [])
        while len(done) <= i:
            j = len(done)
            done.append(value(j) if not j else done[-1] + 2 / (span + 1) * (value(j) - done[-1]))
        return done[i]

    def price(self, i):
        return self.p[i]

    def macd(self, i):
        return self.ema(self.price, 12, i) - self.ema(self.price, 26, i)

    def true_range(self, i):
        reach = [self.hi[i] - self.lo[i]]
        if i:
            reach += [abs(self.hi[i] - self.p[i - 1]), abs(self.lo[i] - self.p[i - 1])]
        return max(reach)

    def obv(self, i):
        total = self.memo.setdefault("obv", [0.0])
        while len(total) <= i:
            j = len(total)
            total.append(total[-1] + math.copysign(self.v[j], self.p[j] - self.p[j - 1]) * (self.p[j] != self.p[j - 1]))
        return total[i]


def to_mean(s, i, w):
    x = s.window(s.price, i, w)
    return np.nan if x is None else s.p[i] / (x.sum() / w) - 1


def to_ema(s, i, span):
    return s.p[i] / s.ema(s.price, span, i) - 1 if i + 1 >= span else np.nan


def strength(s, i):
    """100 gains / (gains + losses) of the last 14 moves."""
    if i < 14:
        return np.nan
    moves = [s.p[j] - s.p[j - 1] for j in range(i - 13, i + 1)]
    gains, losses = sum(m for m in moves if m > 0), -sum(m for m in moves if m < 0)
    return np.nan if gains + losses == 0 else 100 * gains / (gains + losses)


def band_width(s, i):
    x = s.window(s.price, i, 20)
    return np.nan if x is None else 4 * x.std(ddof=1) / x.mean()


def band_place(s, i):
    x = s.window(s.price, i, 20)
    if x is None or x.std(ddof=1) <= 1e-9:
        return np.nan
    return ((s.p[i] - x.mean()) / x.std(ddof=1) + 2) / 4


def deviation(s, i, w):
    x = s.window(s.log_return, i, w)
    return np.nan if x is None else x.std(ddof=1)


def range_share(s, i):
    x = s.window(s.true_range, i, 14)
    return np.nan if x is None else x.mean() / s.p[i]


def volume_share(s, i):
    return s.v[i] / s.v[i - 19:i + 1].mean() if i >= 19 else np.nan


def from_extreme(s, i, w, column, pick):
    return s.p[i] / pick(column[i - w + 1:i + 1]) - 1 if i + 1 >= w else np.nan


def obv_score(s, i):
    x = s.window(s.obv, i, 20)
    return np.nan if x is None or x.std(ddof=1) == 0 else (x[-1] - x.mean()) / x.std(ddof=1)


FEATURES = {
    "log_return": Series.log_return,
    "rsi_14": strength, "bb_pct_b": band_place, "bb_width": band_width, "atr_pct": range_share,
    "volume_ratio": volume_share, "obv_zscore_20": obv_score,
    "macd_norm": lambda s, i: s.macd(i) / s.p[i],
    "macd_hist_norm": lambda s, i: (s.macd(i) - s.ema(s.macd, 9, i)) / s.p[i],
    **{f"price_to_sma{w}": lambda s, i, w=w: to_mean(s, i, w) for w in (10, 20, 50)},
    **{f"price_to_ema{w}": lambda s, i, w=w: to_ema(s, i, w) for w in (20, 50, 200)},
    **{f"roc_{w}": lambda s, i, w=w: s.change(i, w) for w in (5, 10, 20, 40)},
    **{f"volatility_{w}": lambda s, i, w=w: deviation(s, i, w) for w in (10, 20)},
    **{f"dist_to_high{w}": lambda s, i, w=w: from_extreme(s, i, w, s.hi, max) for w in (20, 50)},
    **{f"dist_to_low{w}": lambda s, i, w=w: from_extreme(s, i, w, s.lo, min) for w in (20, 50)},
}


def technicals(g):
    """The per-symbol features of one symbol, row by row from their definitions."""
    s = Series(g)
    return pd.DataFrame({"symbol": g["symbol"], "date": g["date"], **{
        name: [f(s, i) for i in range(s.n)] for name, f in FEATURES.items()}})


def per_symbol(frame, func):
    return pd.concat([func(g.reset_index(drop=True)) for _, g in frame.groupby("symbol")],
                     ignore_index=True)


def assert_same(got, want, cols, tol=1e-8):
    got = got.sort_values(["symbol", "date"]).reset_index(drop=True)
    want = want.sort_values(["symbol", "date"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in cols:
        a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all(), (c, np.where(np.isnan(a) != np.isnan(b))[0][:5])
        assert np.allclose(a, b, rtol=tol, atol=tol, equal_nan=True), c
