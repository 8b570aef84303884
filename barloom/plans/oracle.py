"""The registered queries in plain SQL over the same sample tables."""

from barloom.schema import (
    FEATURE_COLS, HORIZONS, LABEL_COLS, REQUIRED_LABELS, TECHNICAL_COLS)

CORE = [c for c in TECHNICAL_COLS if "ema" not in c and "macd" not in c]


def r(expr, dp=6):
    return f"CASE WHEN isfinite({expr}) THEN floor(({expr}) * 1e{dp} + 5e-1) / 1e{dp} END"


def rcols(cols, dp=6):
    return ", ".join(f"{r(c, dp)} AS {c}" for c in cols)


def over(lo, hi, part="symbol", order="date"):
    return f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {lo} AND {hi})"


def roll(agg, x, w, part="symbol"):
    o = over(f"{w - 1} PRECEDING", "CURRENT ROW", part)
    return f"CASE WHEN count({x}) {o} = {w} THEN {agg}({x}) {o} END"


def lag(x, n=1, part="symbol"):
    return f"lag({x}, {n}) OVER (PARTITION BY {part} ORDER BY date)"


def cents(x):
    return f"CAST(round({x} * 100) AS BIGINT)"


BARS = f"""
lines AS (
  SELECT replace(p_brand, '#', '') AS symbol, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS px, l_quantity, l_returnflag, l_linestatus,
         l_discount, l_tax, l_extendedprice,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey,
             l_extendedprice / l_quantity) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars0 AS (
  SELECT symbol, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, k) AS close,
         CAST(sum({cents('l_discount')}) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS rate,
         CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS volume
  FROM lines GROUP BY symbol, date),
bars AS (
  SELECT symbol, date, open, high, low, close, close * (1 - rate) AS adj_close, volume
  FROM bars0),
traded AS (SELECT * FROM bars WHERE volume > 0),
panel AS (
  SELECT *, 'G' || CAST(CAST(regexp_extract(symbol, '(\\d+)', 1) AS INT) % 5 AS VARCHAR)
         AS industry FROM traded)"""
INDEX = f"""
index_d AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(sum({cents('o_totalprice')}) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE)
           AS nifty_close,
         max(o_totalprice) AS nifty_high
  FROM orders GROUP BY 1),
vix_d AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         stddev_samp(o_totalprice) / avg(o_totalprice) * 100 AS close
  FROM orders GROUP BY 1)"""
ACTIONS = """
actions(symbol, date) AS (VALUES ('Brand1', DATE '1997-03-10'), ('Brand7', DATE '1999-06-15'),
  ('Brand12', DATE '1998-01-20'), ('Brand25', DATE '2000-02-02'))"""
MASTER = r"""
master AS (
  SELECT DISTINCT replace(p_brand, '#', '') AS symbol,
         'Company ' || replace(p_brand, '#', '') AS company_name,
         'G' || CAST(CAST(regexp_extract(p_brand, '(\d+)', 1) AS INT) % 5 AS VARCHAR) AS industry
  FROM part)"""


def filled_index(source):
    fill = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
days AS (SELECT DISTINCT date FROM {source}),
filled AS (
  SELECT date, last_value(nifty_close IGNORE NULLS) {fill} AS nifty_close,
         last_value(nifty_high IGNORE NULLS) {fill} AS nifty_high
  FROM days LEFT JOIN index_d USING (date))"""


def regime(source, part="1"):
    return f"""
ret_i AS (SELECT date, nifty_close, ln(nifty_close / {lag('nifty_close', 1, '1')}) AS nifty_return
          FROM {source}),
regime AS (SELECT date, nifty_return,
             {roll('stddev_samp', 'nifty_return', 20, '1')} AS nifty_volatility_20,
             nifty_close / ({roll('avg', 'nifty_close', 50, '1')}) - 1 AS nifty_trend
           FROM ret_i)"""


VIX = f"""
vix_r AS (SELECT date,
            (close - ({roll('avg', 'close', 60, '1')})) / ({roll('stddev_samp', 'close', 60, '1')})
              AS vix_zscore_60,
            close / {lag('close', 5, '1')} - 1 AS vix_change_5d FROM vix_d)"""


def feature_sql(source="panel", extra="industry, "):
    """All windowed features without the EMA family."""
    lagged = ", ".join(f"{lag('adj_close', w)} AS lag{w}" for w in (5, 10, 20, 40))
    sma = ", ".join(f"{roll('avg', 'adj_close', w)} AS sma{w}" for w in (10, 20, 50))
    ch = ", ".join(f"{roll('max', 'high', w)} AS hi{w}, {roll('min', 'low', w)} AS lo{w}"
                   for w in (20, 50))
    return f"""
f1 AS (SELECT *, {lag('adj_close')} AS prev, {lagged}, {sma}, {ch},
         {roll('stddev_samp', 'adj_close', 20)} AS std20, {roll('avg', 'volume', 20)} AS vol20
       FROM {source}),
f2 AS (SELECT *, ln(adj_close / prev) AS log_return,
         CASE WHEN prev IS NOT NULL THEN greatest(adj_close - prev, 0) END AS gain,
         CASE WHEN prev IS NOT NULL THEN greatest(prev - adj_close, 0) END AS loss,
         CASE WHEN prev IS NULL THEN high - low
              ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr
       FROM f1),
f3 AS (SELECT *, {roll('stddev_samp', 'log_return', 10)} AS volatility_10,
         {roll('stddev_samp', 'log_return', 20)} AS volatility_20,
         {roll('avg', 'gain', 14)} AS up, {roll('avg', 'loss', 14)} AS down,
         {roll('avg', 'tr', 14)} AS atr,
         sum(sign(coalesce(log_return, 0)) * volume)
           {over('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS obv
       FROM f2),
f4 AS (SELECT *, {roll('avg', 'obv', 20)} AS obv_m, {roll('stddev_samp', 'obv', 20)} AS obv_s
       FROM f3),
feat AS (
  SELECT symbol, date, {extra}close, adj_close, log_return, volatility_10, volatility_20,
    adj_close / lag5 - 1 AS roc_5, adj_close / lag10 - 1 AS roc_10,
    adj_close / lag20 - 1 AS roc_20, adj_close / lag40 - 1 AS roc_40,
    adj_close / sma10 - 1 AS price_to_sma10, adj_close / sma20 - 1 AS price_to_sma20,
    adj_close / sma50 - 1 AS price_to_sma50,
    (adj_close - (sma20 - 2 * std20)) / ((sma20 + 2 * std20) - (sma20 - 2 * std20)) AS bb_pct_b,
    ((sma20 + 2 * std20) - (sma20 - 2 * std20)) / sma20 AS bb_width,
    100 - 100 / (1 + up / down) AS rsi_14, atr / adj_close AS atr_pct,
    volume / vol20 AS volume_ratio,
    adj_close / hi20 - 1 AS dist_to_high20, adj_close / lo20 - 1 AS dist_to_low20,
    adj_close / hi50 - 1 AS dist_to_high50, adj_close / lo50 - 1 AS dist_to_low50,
    (obv - obv_m) / obv_s AS obv_zscore_20
  FROM f4)"""


def ema_sql(source="traded"):
    def step(e, span, x="b.x"):
        return f"((1 - 2e0/{span + 1}) * {e} + 2e0/{span + 1} * {x})"
    spans = (12, 26, 20, 50, 200)
    first = ", ".join(f"x AS e{s}" for s in spans)
    nxt = ", ".join(f"{step(f'e{s}', s)}" for s in spans)
    macd = f"({step('e12', 12)} - {step('e26', 26)})"
    return f"""
base AS (SELECT symbol, date, adj_close AS x,
           row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM {source}),
e AS (SELECT symbol, rn, date, x, {first}, CAST(0 AS DOUBLE) AS sig FROM base WHERE rn = 1
      UNION ALL
      SELECT b.symbol, b.rn, b.date, b.x, {nxt}, {step('sig', 9, macd)}
      FROM e JOIN base b ON b.symbol = e.symbol AND b.rn = e.rn + 1),
ema AS (SELECT symbol, date,
          CASE WHEN rn >= 20 THEN x / e20 - 1 END AS price_to_ema20,
          CASE WHEN rn >= 50 THEN x / e50 - 1 END AS price_to_ema50,
          CASE WHEN rn >= 200 THEN x / e200 - 1 END AS price_to_ema200,
          (e12 - e26) / x AS macd_norm, ((e12 - e26) - sig) / x AS macd_hist_norm FROM e)"""


def label_sql(source="lr", actions=True):
    """fwd / positive / future volatility, then the break mask (`lab`)."""
    raw, masked = [], []
    for h in HORIZONS:
        o = over("1 FOLLOWING", f"{h} FOLLOWING")
        raw += [f"lead(adj_close, {h}) OVER (PARTITION BY symbol ORDER BY date) / adj_close - 1"
                f" AS fwd_return_{h}d",
                f"CASE WHEN count(log_return) {o} = {h} THEN stddev_samp(log_return) {o} END"
                f" AS future_volatility_{h}d",
                f"coalesce(sum(CASE WHEN brk THEN 1 ELSE 0 END) {o}, 0) AS hit{h}"]
        masked += [f"CASE WHEN hit{h} = 0 THEN {c}_{h}d END AS {c}_{h}d"
                   for c in ("fwd_return", "future_volatility")]
    return f"""
lr AS (SELECT p.*, ln(adj_close / {lag('adj_close')}) AS log_return,
         (a.symbol IS NOT NULL) AS brk
       FROM panel p LEFT JOIN actions a USING (symbol, date)),
raw_lab AS (SELECT *, {', '.join(raw)} FROM {source}),
lab AS (SELECT symbol, date, industry, brk AS corp_action_break,
          CASE WHEN NOT brk THEN log_return END AS log_return, {', '.join(masked)}
        FROM raw_lab)"""


STATEMENTS = f"""
stmt0 AS (
  SELECT symbol, year(date) AS y, count(*) AS n,
    CAST(sum({cents('l_extendedprice')} * ({cents('l_discount')} - 5)) AS DOUBLE) / 10000e0
      AS net_profit,
    sum(l_quantity) AS equity_capital,
    CAST(sum({cents('l_tax')}) AS DOUBLE) / 100e0 AS borrowings
  FROM lines GROUP BY 1, 2),
stmt AS (
  SELECT symbol, make_date(y, 12, 31) AS fiscal_year_end, n, net_profit,
    net_profit / 1000 AS eps,
    equity_capital + CASE WHEN n % 3 <> 0 THEN n * 10e0 ELSE 0 END AS eq, borrowings,
    CASE WHEN n % 4 <> 0 THEN make_date(y, 12, 31) + CAST(30 + n % 60 AS INT)
         ELSE make_date(y, 12, 31) + 60 END AS known_date
  FROM stmt0 WHERE n % 5 <> 0),
known AS (
  SELECT *, round(net_profit / eq * 100, 2) AS roe_pct, round(borrowings / eq, 3) AS debt_to_equity,
    net_profit / lag(net_profit) OVER w - 1 AS fund_net_profit_growth,
    eps / lag(eps) OVER w - 1 AS fund_eps_growth,
    round(net_profit / eq * 100, 2) / 100 AS fund_roe
  FROM stmt WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_year_end))"""

MODEL = feature_sql() + f"""
, model0 AS (
  SELECT *, lead(adj_close, 30) OVER (PARTITION BY symbol ORDER BY date) / adj_close - 1
    AS fwd_return_30d FROM feat),
model AS (SELECT * FROM model0 WHERE fwd_return_30d IS NOT NULL
  AND {' AND '.join(f'{c} IS NOT NULL' for c in CORE)})"""
TAGGED = MODEL + """
, tagged AS (
  SELECT * FROM (SELECT *, CASE
      WHEN date <= DATE '1999-06-30' - 150 THEN 'train'
      WHEN date > DATE '1999-06-30' + 150 AND date <= DATE '2000-06-30' - 150 THEN 'val'
      WHEN date > DATE '2000-06-30' + 150 THEN 'test' END AS split FROM model)
  WHERE split IS NOT NULL)"""
LOGS = ("volume_ratio", "atr_pct", "bb_width")


def scaler_sql():
    parts = []
    for c in CORE:
        v = f"greatest(least({c}, hi), lo)"
        if c in LOGS:
            v = f"ln(1 + greatest({v}, 0))"
        parts.append(f"""
  SELECT '{c}' AS feature, any_value(lo) AS lo, any_value(hi) AS hi,
    {'true' if c in LOGS else 'false'} AS is_log1p, median({v}) AS center,
    quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) AS iqr
  FROM tagged, (SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi
                FROM tagged WHERE split = 'train') q WHERE split = 'train'""")
    return "\n, scaler AS (" + " UNION ALL ".join(parts) + ")"


REB = MODEL + """
, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS no
          FROM (SELECT DISTINCT date FROM model WHERE date >= DATE '1996-01-01')),
reb AS (SELECT symbol, date, roc_20 AS score, fwd_return_30d
        FROM model WHERE date IN (SELECT date FROM cal WHERE (no - 1) % 30 = 0))"""


def basket_sql(source="reb"):
    return f"""
, pos AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn,
            count(*) OVER (PARTITION BY date) AS n FROM {source}),
pick AS (SELECT *, greatest(1, CAST(floor(n * 2e-1) AS BIGINT)) AS k FROM pos),
side AS (SELECT symbol, date, 'long' AS side, score, fwd_return_30d FROM pick WHERE rn <= k
         UNION ALL
         SELECT symbol, date, 'short' AS side, score, fwd_return_30d FROM pick WHERE rn > n - k)"""


RANK_AVG = "(rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2e0)"


def arank(x, p):
    return RANK_AVG.format(p=p, x=x)


PERIODS = REB + """
, wide AS (SELECT date FROM reb GROUP BY date HAVING count(*) >= 5),
reb5 AS (SELECT * FROM reb WHERE date IN (SELECT date FROM wide))""" + basket_sql("reb5") + f"""
, steps AS (SELECT side, date, lag(date) OVER (PARTITION BY side ORDER BY date) AS prev,
              count(*) AS names FROM side GROUP BY side, date),
kept AS (SELECT s.side, s.date, count(*) AS kept FROM side s JOIN steps t USING (side, date)
         JOIN side o ON o.side = s.side AND o.symbol = s.symbol AND o.date = t.prev
         GROUP BY 1, 2),
turn AS (SELECT t.side, t.date, CASE WHEN t.prev IS NULL THEN 1
           ELSE (t.names + q.names - 2 * coalesce(kept, 0)) / (2e0 * t.names) END AS turnover
         FROM steps t LEFT JOIN steps q ON q.side = t.side AND q.date = t.prev
         LEFT JOIN kept k ON k.side = t.side AND k.date = t.date),
bench AS (SELECT date, count(*) AS breadth, avg(fwd_return_30d) AS benchmark FROM reb5 GROUP BY 1),
rk AS (SELECT date, {arank('score', 'date')} AS rs, {arank('fwd_return_30d', 'date')} AS rr
       FROM reb5),
ics AS (SELECT date, corr(rs, rr) AS ic FROM rk GROUP BY 1),
legs AS (SELECT date, avg(fwd_return_30d) FILTER (side = 'long') AS l,
           avg(fwd_return_30d) FILTER (side = 'short') AS s FROM side GROUP BY 1),
tw AS (SELECT date, max(turnover) FILTER (side = 'long') AS tl,
         max(turnover) FILTER (side = 'short') AS ts FROM turn GROUP BY 1),
periods AS (
  SELECT date, breadth, l AS long_gross, l - 25e-4 * tl AS long_net,
    (l - s) - 25e-4 * ((tl + ts) / 2) * 2 AS long_short, benchmark,
    tl AS long_turnover, ts AS short_turnover, ic
  FROM bench JOIN legs USING (date) JOIN tw USING (date) LEFT JOIN ics USING (date))"""


def log_equity(c):
    w = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (f"sum(ln(abs(1 + {c}))) {w} * CASE WHEN sum(CASE WHEN 1 + {c} < 0 THEN 1 ELSE 0 END) "
            f"{w} % 2 = 1 THEN -1 ELSE 1 END")


def flips(c):
    """-1 where an odd number of factors 1 + c is negative so far, else 1."""
    w = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN sum(CASE WHEN 1 + {c} < 0 THEN 1 ELSE 0 END) {w} % 2 = 1 THEN -1 ELSE 1 END"


def t_pvalue(t, n):
    """Two-sided p-value of t with n - 1 degrees of freedom, by Simpson's rule on the density.

    With t = sqrt(n - 1) tan(a) the density is a power of cos(a) up to a constant.
    """
    end = f"atan(abs({t}) / sqrt({n} - 1)) / 4000"
    return (f"(SELECT 1 - 2 * exp(lgamma({n} / 2e0) - lgamma(({n} - 1) / 2e0)) / sqrt(pi()) * {end} / 3 * "
            f"sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(i * {end}), {n} - 2)) "
            "FROM (SELECT unnest(range(0, 4001)) AS i))")


def performance_sql(c):
    w = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    eq = (f"exp(sum(ln(abs(1 + {c}))) {w}) * CASE WHEN sum(CASE WHEN 1 + {c} < 0 THEN 1 ELSE 0 "
          f"END) {w} % 2 = 1 THEN -1 ELSE 1 END")
    return f"""
  SELECT '{c}' AS book, count(*) AS periods,
    {r(f'ln(pow(1 + avg({c}), 252e0/30))')} AS log_ann_return,
    {r(f'stddev_samp({c}) * sqrt(252e0/30)')} AS ann_vol, {r('min(dd)')} AS max_drawdown
  FROM (SELECT {c}, eq / max(eq) {w} - 1 AS dd FROM (SELECT date, {c}, {eq} AS eq FROM periods))"""


SCORED = """
scored AS (SELECT round(l_discount * 10, 1) AS score,
             CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS label,
             l_quantity, l_tax, l_extendedprice FROM lineitem)"""
ODD = f"""
odd AS (
  SELECT symbol, date, CASE WHEN day(date) = 5 THEN NULL ELSE open END AS open,
    CASE WHEN day(date) = 3 THEN low - 1 ELSE high END AS high, low,
    CASE WHEN day(date) = 7 THEN -close ELSE close END AS close,
    CASE WHEN day(date) = 9 THEN -volume ELSE volume END AS volume FROM bars
  UNION ALL SELECT symbol, date, open, high, low, close, volume FROM bars
  WHERE day(date) = 11)"""
STRUCT_COLS = ["null_open", "null_high", "null_low", "null_close", "null_volume", "bad_ohlc",
               "non_positive_price", "negative_volume", "zero_volume"]


def structural_sql(source):
    return f"""
struct AS (
  SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT date) AS duplicate_dates,
    {', '.join(f"count(*) FILTER ({c} IS NULL) AS null_{c}"
               for c in ('open', 'high', 'low', 'close', 'volume'))},
    count(*) FILTER (high < low OR close > high OR close < low OR open > high OR open < low)
      AS bad_ohlc,
    count(*) FILTER (least(open, high, low, close) <= 0) AS non_positive_price,
    count(*) FILTER (volume < 0) AS negative_volume,
    count(*) FILTER (volume = 0) AS zero_volume
  FROM {source} GROUP BY symbol)"""


def q(*ctes, select, recursive=False):
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(ctes) + "\n" + select


def moves():
    return f"""
mv AS (SELECT symbol, date, close / {lag('close')} - 1 AS close_return,
         adj_close / {lag('adj_close')} - 1 AS adj_return FROM traded)"""


HOLED = """
holed AS (SELECT symbol, date, """ + ", ".join(
    f"CASE WHEN volume > 0 THEN {c} END AS {c}"
    for c in ("open", "high", "low", "close", "adj_close", "volume")) + " FROM bars)"
PRICES = "symbol, date, open, high, low, close, adj_close, volume"
KEY = "symbol, date"


def only(cols, source="feat", dp=6):
    return f"SELECT {KEY}, {rcols(cols, dp)} FROM {source}"


def hs(*stems):
    return [f"{s}_{h}d" for s in stems for h in HORIZONS]


def relative_sql():
    med = ", ".join(f"median(fwd_return_{h}d) AS m{h}" for h in HORIZONS)
    out = []
    for h in HORIZONS:
        f = f"fwd_return_{h}d"
        sec = f"CASE WHEN sz > 1 THEN s.m{h} ELSE d.m{h} END"
        out += [r(f"{f} - d.m{h}") + f" AS rel_return_{h}d",
                f"CASE WHEN {f} IS NOT NULL THEN CASE WHEN {f} > d.m{h} THEN 1e0 ELSE 0e0 END END"
                f" AS beats_median_{h}d",
                r(f"{f} - {sec}") + f" AS rel_return_sector_{h}d",
                f"CASE WHEN {f} IS NOT NULL THEN CASE WHEN {f} > {sec} THEN 1e0 ELSE 0e0 END END"
                f" AS beats_sector_median_{h}d"]
    return f""", dm AS (SELECT date, {med} FROM lab GROUP BY 1),
sm AS (SELECT date, industry, count(*) AS sz, {med} FROM lab GROUP BY 1, 2)
SELECT symbol, lab.date, {', '.join(out)} FROM lab JOIN dm d ON d.date = lab.date
JOIN sm s ON s.date = lab.date AND s.industry = lab.industry"""


def pct_rank(x):
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date, ({x} IS NULL) ORDER BY {x})"
            f" + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2e0)"
            f" / count({x}) OVER (PARTITION BY date) END")


def rank_sql(source="lab"):
    ranks = ", ".join(f"{pct_rank(f'fwd_return_{h}d')} AS k{h}" for h in HORIZONS)
    terc = ", ".join(f"CASE WHEN k{h} <= 1e0/3 THEN 0e0 WHEN k{h} >= 2e0/3 THEN 1e0 END"
                     f" AS top_tercile_{h}d" for h in HORIZONS)
    return f", ranks AS (SELECT *, {ranks} FROM {source}), terc AS (SELECT *, {terc} FROM ranks)"


LATEST = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC)
             AS rn_ FROM panel) WHERE rn_ = 1)"""


def ic_sql():
    un = " UNION ALL ".join(
        f"SELECT year(date) AS year, '{c}' AS feature, {c} AS x, fwd_return_30d AS y FROM model"
        for c in CORE)
    return MODEL + f"""
, long AS ({un}),
rk AS (SELECT year, feature, {arank('x', 'year, feature')} AS rx,
         {arank('y', 'year, feature')} AS ry FROM long),
ics AS (SELECT year, feature, corr(rx, ry) AS ic, count(*) AS n FROM rk GROUP BY 1, 2
        HAVING count(*) >= 200)"""


def oracles() -> dict:
    tech = {
        "returns_roc": ["log_return", "roc_5", "roc_10", "roc_20", "roc_40"],
        "sma_ratio": ["price_to_sma10", "price_to_sma20", "price_to_sma50"],
        "rsi": ["rsi_14"], "bollinger": ["bb_pct_b", "bb_width"],
        "volatility": ["log_return", "volatility_10", "volatility_20"], "atr": ["atr_pct"],
        "volume_ratio": ["volume_ratio"],
        "channel_distance": ["dist_to_high20", "dist_to_low20", "dist_to_high50",
                             "dist_to_low50"],
        "obv_z": ["log_return", "obv_zscore_20"],
    }
    out = {k: q(BARS, feature_sql(), select=only(v)) for k, v in tech.items()}
    out.update({
        "clean_bars": q(BARS, INDEX, ACTIONS, MASTER, filled_index("traded"), select=f"""
SELECT t.symbol, t.date, open, high, low, close, adj_close, volume,
  (a.symbol IS NOT NULL) AS corp_action_break, company_name, industry, nifty_close, nifty_high
FROM traded t JOIN master m ON m.symbol = t.symbol LEFT JOIN filled f ON f.date = t.date
LEFT JOIN actions a ON a.symbol = t.symbol AND a.date = t.date"""),
        "coverage": q(BARS, MASTER, select="""
SELECT symbol, rows, CASE WHEN rows = 0 THEN 'missing' WHEN rows < 1200 THEN 'short' ELSE 'ok' END
  AS status
FROM (SELECT m.symbol, count(t.symbol) AS rows FROM master m LEFT JOIN
      (SELECT * FROM traded WHERE symbol <> 'Brand3') t ON t.symbol = m.symbol GROUP BY 1)"""),
        "index_calendar_fill": q(BARS, INDEX, filled_index("bars"),
                                 select="SELECT date, nifty_close, nifty_high FROM filled"),
        "null_profile": q(BARS, HOLED, select=" UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS nulls FROM holed WHERE {c} IS NULL "
            f"HAVING count(*) > 0"
            for c in ("open", "high", "low", "close", "adj_close", "volume"))),
        "ffill_prices": q(BARS, HOLED, select=f"""
SELECT * FROM (SELECT symbol, date, {', '.join(
            f"last_value({c} IGNORE NULLS) {over('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS {c}"
            for c in ("open", "high", "low", "close", "adj_close", "volume"))} FROM holed)
WHERE close IS NOT NULL"""),
        "first_per_date": q(BARS, select=r"""
SELECT industry AS symbol, date, open, high, low, close, adj_close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY industry, date ORDER BY symbol) AS rn FROM (
    SELECT *, 'G' || CAST(CAST(regexp_extract(symbol, '(\d+)', 1) AS INT) % 5 AS VARCHAR)
      AS industry FROM bars)) WHERE rn = 1"""),
        "qc_structural": q(BARS, ODD, structural_sql("odd"), select="SELECT * FROM struct"),
        "qc_findings": q(BARS, ODD, structural_sql("odd"), select=" UNION ALL ".join(
            f"SELECT symbol, '{c}' AS \"check\", {c} AS n FROM struct WHERE {c} > 0"
            for c in ["duplicate_dates", *STRUCT_COLS])),
        "qc_gaps_jumps": q(BARS, select=f"""
SELECT symbol, count(*) FILTER (abs(ret) > 0.5) AS big_moves,
  count(*) FILTER (gap > 4) AS gaps, max(gap) FILTER (gap > 4) AS max_gap_days
FROM (SELECT symbol, close / {lag('close')} - 1 AS ret,
        datediff('day', {lag('date')}, date) AS gap FROM bars) GROUP BY symbol"""),
        "qc_unadjusted_splits": q(BARS, moves(), select=f"""
SELECT {KEY}, {rcols(['close_return', 'adj_return'])} FROM mv
WHERE abs(close_return) > 0.9 AND abs(adj_return) > 0.9
  AND sign(close_return) = sign(adj_return)"""),
        "qc_price_jumps": q(BARS, moves(), select=f"""
SELECT {KEY}, {rcols(['adj_return'])} FROM mv WHERE abs(adj_return) > 1.2"""),
        "qc_reconcile": q(BARS, STATEMENTS, select="""
SELECT symbol, 'prices' AS only_in FROM (SELECT symbol FROM bars WHERE symbol <> 'Brand3'
  EXCEPT SELECT symbol FROM stmt0 WHERE symbol <> 'Brand4')
UNION ALL
SELECT symbol, 'fundamentals' AS only_in FROM (SELECT symbol FROM stmt0 WHERE symbol <> 'Brand4'
  EXCEPT SELECT symbol FROM bars WHERE symbol <> 'Brand3')"""),
        "qc_summary": q(BARS, structural_sql("bars"), select=f"""
SELECT count(*) AS symbols, CAST(sum(rows) AS BIGINT) AS rows,
  count(*) FILTER (bad > 0) AS symbols_with_issues, min(d0) AS first_date, max(d1) AS last_date,
  CASE WHEN count(*) FILTER (bad > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT *, duplicate_dates + {' + '.join(c for c in STRUCT_COLS if c != 'zero_volume')} AS bad
      FROM struct), (SELECT min(date) AS d0, max(date) AS d1 FROM bars)"""),
        "break_report": q(BARS, INDEX, ACTIONS, filled_index("traded"), select="""
SELECT count(*) FILTER (a.symbol IS NOT NULL) AS break_rows,
  count(*) FILTER (nifty_close IS NULL) AS rows_without_index
FROM traded t LEFT JOIN filled f ON f.date = t.date
LEFT JOIN actions a ON a.symbol = t.symbol AND a.date = t.date"""),
        "ema_macd": q(BARS, ema_sql(), select=only(
            ["price_to_ema20", "price_to_ema50", "price_to_ema200", "macd_norm",
             "macd_hist_norm"], "ema"), recursive=True),
        "ewm_volume": q(BARS, """
base AS (SELECT symbol, date, CAST(volume AS DOUBLE) AS x,
           row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM traded),
e AS (SELECT symbol, rn, date, x AS volume, x AS a, x AS b FROM base WHERE rn = 1 UNION ALL
      SELECT s.symbol, s.rn, s.date, s.x, (1 - 2e0/10) * a + 2e0/10 * s.x,
        (1 - 2e0/201) * b + 2e0/201 * s.x
      FROM e JOIN base s ON s.symbol = e.symbol AND s.rn = e.rn + 1)""", select="""
SELECT symbol, date, volume, """ + r("a") + " AS vol_ema9, " + r("b") + " AS vol_ema200 FROM e",
                        recursive=True),
        "technical_panel": q(BARS, feature_sql("traded", ""), ema_sql(), select=f"""
SELECT f.symbol, f.date, {rcols(TECHNICAL_COLS)} FROM feat f
JOIN ema USING (symbol, date)""", recursive=True),
        "index_regime": q(INDEX, regime("index_d"), select=f"""
SELECT date, {rcols(['nifty_return', 'nifty_volatility_20', 'nifty_trend'])} FROM regime"""),
        "vix_regime": q(INDEX, VIX, select=f"""
SELECT date, {rcols(['vix_zscore_60', 'vix_change_5d'])} FROM vix_r"""),
        "sector_loo": q(BARS, f"""
lr0 AS (SELECT *, ln(adj_close / {lag('adj_close')}) AS log_return FROM panel),
loo AS (SELECT *, count(*) OVER g AS n, sum(log_return) OVER g AS s FROM lr0
        WINDOW g AS (PARTITION BY date, industry))""", select=f"""
SELECT symbol, date, industry, {r('log_return')} AS log_return,
  {r('CASE WHEN n > 1 THEN (coalesce(s, 0) - log_return) / (n - 1) ELSE 0 END')} AS sector_return
FROM loo"""),
        "market_regime": q(BARS, INDEX, filled_index("traded"), regime("filled"), VIX, f"""
lr0 AS (SELECT *, ln(adj_close / {lag('adj_close')}) AS log_return FROM panel)""", select=f"""
SELECT symbol, l.date, {rcols(['nifty_return', 'nifty_volatility_20', 'nifty_trend',
                               'vix_zscore_60', 'vix_change_5d'])},
  {r('log_return - nifty_return')} AS relative_strength
FROM lr0 l LEFT JOIN regime i ON i.date = l.date LEFT JOIN vix_r v ON v.date = l.date"""),
        "forward_returns": q(BARS, ACTIONS, label_sql(), select=f"""
SELECT {KEY}, {rcols(hs('fwd_return'))}, {', '.join(
            f"CASE WHEN fwd_return_{h}d > 0 THEN 1e0 WHEN fwd_return_{h}d IS NOT NULL THEN 0e0 "
            f"END AS positive_return_{h}d" for h in HORIZONS)} FROM raw_lab"""),
        "future_vol": q(BARS, ACTIONS, label_sql(),
                        select=only(hs("future_volatility"), "raw_lab")),
        "break_mask": q(BARS, ACTIONS, label_sql(), select=f"""
SELECT {KEY}, corp_action_break, {r('log_return')} AS log_return,
  {rcols(hs('fwd_return', 'future_volatility'))} FROM lab"""),
        "relative_labels": q(BARS, ACTIONS, label_sql(), select="").rstrip() + relative_sql(),
        "rank_tercile": q(BARS, ACTIONS, label_sql(), select="").rstrip() + rank_sql() + f"""
SELECT {KEY}, {', '.join(r(f"k{h}") + f" AS fwd_return_rank_{h}d" for h in HORIZONS)},
  {', '.join(hs('top_tercile'))} FROM terc""",
        "vol_adjusted": q(BARS, ACTIONS, label_sql(), f"""
v20 AS (SELECT *, {roll('stddev_samp', 'log_return', 20)} AS vol FROM raw_lab)""", select=f"""
SELECT {KEY}, {', '.join(
            r(f"fwd_return_{h}d / nullif(vol * sqrt({h}), 0)") + f" AS fwd_return_vol_adj_{h}d"
            for h in HORIZONS)} FROM v20"""),
        "gate_report": q(BARS, ACTIONS, label_sql(), f"""
v20 AS (SELECT *, {roll('stddev_samp', 'log_return', 20)} AS vol FROM raw_lab)""",
                         select="").rstrip() + rank_sql("v20") + f"""
SELECT count(*) AS rows_before, count(*) FILTER (ok) AS rows_after, {', '.join(
            f"count(*) FILTER (ok AND top_tercile_{h}d IS NOT NULL) AS n_top_tercile_{h}d"
            for h in HORIZONS)}
FROM (SELECT *, (log_return IS NOT NULL AND vol IS NOT NULL AND fwd_return_30d IS NOT NULL
      AND future_volatility_30d IS NOT NULL) AS ok FROM terc)""",
        "fundamental_growth": q(BARS, STATEMENTS, select=f"""
SELECT symbol, fiscal_year_end, known_date, {rcols(
            ['eps', 'roe_pct', 'debt_to_equity', 'fund_roe', 'fund_net_profit_growth',
             'fund_eps_growth'])} FROM known"""),
        "asof_pe": q(BARS, STATEMENTS, select=f"""
SELECT t.symbol, t.date, {rcols(['fund_roe', 'fund_net_profit_growth', 'fund_eps_growth'])},
  {r('CASE WHEN eps > 0 THEN adj_close / eps END')} AS fund_pe_ratio
FROM traded t ASOF LEFT JOIN known k ON k.symbol = t.symbol AND t.date >= k.known_date"""),
        "asof_events": f"""
WITH clicks AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT v.event_id, v.user_id AS "user", {r('c.value')} AS value,
  CAST(floor(epoch(v.ts)) - floor(epoch(c.ts)) AS BIGINT) AS seconds_since
FROM (SELECT * FROM events WHERE event_type = 'view') v
ASOF LEFT JOIN clicks c ON c.user_id = v.user_id AND v.ts >= c.ts""",
        "filing_match": FILINGS + """
SELECT symbol, fiscal_year_end, known_date, source FROM matched""",
        "filing_provenance": FILINGS + """
SELECT source, count(*) AS n FROM matched GROUP BY source""",
        "statement_pivot": q(BARS, """
cells AS (SELECT symbol, 'Dec ' || CAST(year(date) AS VARCHAR) AS fiscal_label,
            l_returnflag || l_linestatus AS label, sum(l_quantity) AS v
          FROM lines GROUP BY 1, 2, 3)""", select="""
SELECT symbol, fiscal_label, """ + ", ".join(
            f"max(v) FILTER (label = '{c.upper()}') AS {c}"
            for c in ("af", "no", "rf", "nf", "ao", "ro")) + """
FROM cells GROUP BY 1, 2"""),
        "purged_split": q(BARS, TAGGED, select="SELECT symbol, date, split FROM tagged"),
        "split_inventory": q(BARS, TAGGED, select="""
SELECT split, count(*) AS rows, count(DISTINCT symbol) AS symbols, min(date) AS first_date,
  max(date) AS last_date FROM tagged GROUP BY split"""),
        "split_integrity": q(BARS, TAGGED, select="""
SELECT *, (null_targets = 0 AND train_rows > 0 AND val_rows > 0 AND test_rows > 0
  AND duplicate_keys = 0 AND shared_keys = 0 AND train_val_gap >= 150 AND val_test_gap >= 150)
  AS passed
FROM (SELECT count(*) FILTER (fwd_return_30d IS NULL) AS null_targets,
  count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows,
  count(*) FILTER (split = 'test') AS test_rows,
  datediff('day', max(date) FILTER (split = 'train'), min(date) FILTER (split = 'val'))
    AS train_val_gap,
  datediff('day', max(date) FILTER (split = 'val'), min(date) FILTER (split = 'test'))
    AS val_test_gap FROM tagged),
(SELECT count(*) FILTER (n > 1) AS duplicate_keys, count(*) FILTER (s > 1) AS shared_keys
 FROM (SELECT count(*) AS n, count(DISTINCT split) AS s FROM tagged GROUP BY symbol, date))"""),
        "target_audit": q(BARS, MODEL, select="""
SELECT count(*) AS rows, count(*) FILTER (again IS NULL) AS missing,
  floor((max(abs(fwd_return_30d - again))) * 1e6 + 5e-1) / 1e6 AS max_abs_diff
FROM model JOIN (SELECT symbol, date, lead(adj_close, 30) OVER
  (PARTITION BY symbol ORDER BY date) / adj_close - 1 AS again FROM traded) USING (symbol, date)"""),
        "scaler_params": q(BARS, TAGGED, select="").rstrip() + scaler_sql() + f"""
SELECT feature, {rcols(['lo', 'hi', 'center', 'iqr'])}, is_log1p FROM scaler""",
        "scaled_features": q(BARS, TAGGED, select="").rstrip() + scaler_sql() + """
SELECT symbol, date, split, """ + ", ".join(_scaled(c) for c in CORE) + "\nFROM tagged " + " ".join(
            f"CROSS JOIN (SELECT * FROM scaler WHERE feature = '{c}') p_{c}" for c in CORE),
        "sequences": q(BARS, MODEL, select=f"""
SELECT symbol, date, 60 AS steps, {r('CAST(CAST(roc_20 AS FLOAT) AS DOUBLE)', 3)} AS last_roc_20,
  {r('s5', 3)} AS sum_roc_5, {r('CAST(CAST(fwd_return_30d AS FLOAT) AS DOUBLE)', 3)}
    AS fwd_return_30d
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn,
  sum(CAST(CAST(roc_5 AS FLOAT) AS DOUBLE)) {over('59 PRECEDING', 'CURRENT ROW')} AS s5 FROM model)
WHERE rn >= 60 AND (rn - 60) % 5 = 0"""),
        "time_folds": q(BARS, """
idx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS days
        FROM (SELECT DISTINCT date FROM traded)),
f AS (SELECT *, days // 6 AS len, days - (6 - fold) * (days // 6) AS start
      FROM idx, (SELECT unnest([1, 2, 3, 4, 5]) AS fold))""", select="""
SELECT date, fold, CASE WHEN pos >= start THEN 'validate' ELSE 'fit' END AS role FROM f
WHERE (pos >= start AND pos < start + len) OR pos < start - 30"""),
        "target_standardized": q(BARS, TAGGED, select="""
SELECT symbol, date, split, """ + r("(fwd_return_30d - m) / s") + """ AS z FROM tagged,
  (SELECT avg(fwd_return_30d) AS m, stddev_pop(fwd_return_30d) AS s FROM tagged
   WHERE split = 'train')"""),
        "regression_metrics": q(SCORED, f"""
d AS (SELECT l_tax AS y, score / 10 AS p FROM scored),
k AS (SELECT *, {arank('y', '1')} AS ry, {arank('p', '1')} AS rp FROM d)""", select="""
SELECT count(*) AS n, floor((avg(abs(p - y))) * 1e8 + 5e-1) / 1e8 AS mae, floor((sqrt(avg((p - y) * (p - y)))) * 1e8 + 5e-1) / 1e8
    AS rmse, floor((1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*))) * 1e8 + 5e-1) / 1e8 AS r2,
  floor((corr(y, p)) * 1e8 + 5e-1) / 1e8 AS pearson,
  floor((avg(CASE WHEN (y > 3e-2) = (p > 3e-2) THEN 1e0 ELSE 0e0 END)) * 1e8 + 5e-1) / 1e8 AS dir_acc,
  floor((avg(CASE WHEN sign(y) = sign(p) THEN 1e0 ELSE 0e0 END)) * 1e8 + 5e-1) / 1e8 AS sign_acc,
  floor((avg(p)) * 1e8 + 5e-1) / 1e8 AS pred_mean, floor((stddev_pop(p)) * 1e8 + 5e-1) / 1e8 AS pred_std,
  floor((avg(y)) * 1e8 + 5e-1) / 1e8 AS actual_mean, floor((stddev_pop(y)) * 1e8 + 5e-1) / 1e8 AS actual_std,
  floor((median(abs(p - y))) * 1e8 + 5e-1) / 1e8 AS median_ae, floor((corr(ry, rp)) * 1e8 + 5e-1) / 1e8 AS spearman FROM k"""),
        "auc_ap_brier": q(SCORED, f"""
k AS (SELECT *, {arank('score', '1')} AS rs FROM scored),
t AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY 1),
c AS (SELECT pos, sum(n) OVER w AS taken, sum(pos) OVER w AS hits FROM t
      WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
                          select="""
SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
  floor(((sum(rs * label) - sum(label) * (sum(label) + 1) / 2)
        / (sum(label) * (count(*) - sum(label)))) * 1e8 + 5e-1) / 1e8 AS roc_auc,
  floor(((SELECT sum(pos * hits / taken) FROM c) / sum(label)) * 1e8 + 5e-1) / 1e8 AS avg_precision,
  floor((avg((score - label) * (score - label))) * 1e8 + 5e-1) / 1e8 AS brier FROM k"""),
        "calibration": q(SCORED, """
d AS (SELECT l_extendedprice / 200000 AS score, label FROM scored),
e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM d),
b AS (SELECT score, label, CAST(len(list_filter(e, lambda x: x < score)) AS INT) AS bin
      FROM d, e)""", select="""
SELECT bin, count(*) AS n, floor((avg(score)) * 1e6 + 5e-1) / 1e6 AS mean_score, floor((avg(label)) * 1e6 + 5e-1) / 1e6 AS hit_rate,
  floor((abs(avg(score) - avg(label))) * 1e6 + 5e-1) / 1e6 AS gap FROM b GROUP BY bin"""),
        "confusion": q(SCORED, """
c AS (SELECT count(*) FILTER (label = 1 AND score > 0.5) AS tp,
        count(*) FILTER (label = 0 AND score > 0.5) AS fp,
        count(*) FILTER (label = 1 AND score <= 0.5) AS fn,
        count(*) FILTER (label = 0 AND score <= 0.5) AS tn FROM scored)""", select="""
SELECT *, floor((tp / (tp + fp)) * 1e6 + 5e-1) / 1e6 AS precision, floor((tp / (tp + fn)) * 1e6 + 5e-1) / 1e6 AS recall,
  floor((2 * tp / (2 * tp + fp + fn)) * 1e6 + 5e-1) / 1e6 AS f1 FROM c"""),
        "accuracy_by_level": q(SCORED, select="""
SELECT floor((score) * 1e6 + 5e-1) / 1e6 AS score, count(*) AS n,
  floor((avg(CASE WHEN label = CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END THEN 1e0 ELSE 0e0 END)) * 1e6 + 5e-1) / 1e6
    AS accuracy, floor((greatest(avg(label), 1 - avg(label))) * 1e6 + 5e-1) / 1e6 AS base_rate
FROM scored GROUP BY score"""),
        "binomial_test": q(SCORED, """
c AS (SELECT count(*) AS n, count(*) FILTER (label = CASE WHEN score > 0.5 THEN 1 ELSE 0 END)
        AS correct FROM scored)""", select="""
SELECT correct, n, 5e-1 AS naive, floor(((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1)
    - lgamma(n - i + 1) + n * ln(5e-1))) FROM (SELECT unnest(range(correct, n + 1)) AS i))) * 1e6 + 5e-1) / 1e6
  AS p_value FROM c"""),
        "yearly_ic": q(BARS, ic_sql(), select="""
SELECT year, feature, floor((ic) * 1e6 + 5e-1) / 1e6 AS ic, n FROM ics"""),
        "ic_stability": q(BARS, ic_sql(), """
s AS (SELECT feature, ic, sign(ic) AS s, lag(sign(ic)) OVER (PARTITION BY feature ORDER BY year)
        AS p FROM ics)""", select="""
SELECT feature, floor((avg(ic)) * 1e6 + 5e-1) / 1e6 AS mean_ic, floor((stddev_samp(ic)) * 1e6 + 5e-1) / 1e6 AS std_ic,
  floor((min(ic)) * 1e6 + 5e-1) / 1e6 AS min_ic, floor((max(ic)) * 1e6 + 5e-1) / 1e6 AS max_ic,
  count(*) FILTER (s <> p) + 1 AS sign_flips, count(*) FILTER (s <> p) AS true_flips,
  floor((abs(avg(ic)) / stddev_samp(ic)) * 1e6 + 5e-1) / 1e6 AS stability_score FROM s GROUP BY feature"""),
        "rebalance_calendar": q(BARS, REB, select="""
SELECT date, (no - 1) // 30 AS period FROM cal WHERE (no - 1) % 30 = 0"""),
        "baskets": q(BARS, REB + basket_sql(),
                     select=f"SELECT symbol, date, side, {r('score')} AS score FROM side"),
        "tied_baskets": q(BARS, REB + """
, coarse AS (SELECT symbol, date, round(score, 0) AS score, fwd_return_30d FROM reb)"""
                          + basket_sql("coarse"),
                          select="SELECT symbol, date, side, score FROM side"),
        "turnover_cost": q(BARS, PERIODS, select=f"""
SELECT date, breadth, {rcols(['long_gross', 'long_net', 'long_short', 'benchmark',
                              'long_turnover', 'short_turnover', 'ic'])} FROM periods"""),
        "equity_curve": q(BARS, PERIODS, select=f"""
SELECT date, {rcols(['long_net', 'long_short', 'benchmark', 'ic'])},
  {r(log_equity('long_net'))} AS long_equity, {r(log_equity('long_short'))} AS ls_equity,
  {r(log_equity('benchmark'))} AS bench_equity FROM periods"""),
        "backtest_stats": q(BARS, PERIODS, select="""
SELECT count(*) AS periods, floor((avg(breadth)) * 1e6 + 5e-1) / 1e6 AS avg_breadth,
  floor((avg(x) * 252 / 30) * 1e6 + 5e-1) / 1e6 AS excess_ann,
  floor((avg(x) / stddev_samp(x) * sqrt(252e0 / 30)) * 1e6 + 5e-1) / 1e6 AS information_ratio,
  floor((avg(x) / stddev_samp(x) * sqrt(count(x))) * 1e6 + 5e-1) / 1e6 AS excess_t,
  floor((avg(ic)) * 1e6 + 5e-1) / 1e6 AS mean_ic, floor((stddev_samp(ic)) * 1e6 + 5e-1) / 1e6 AS ic_std,
  floor((avg(ic) / stddev_samp(ic) * sqrt(count(ic))) * 1e6 + 5e-1) / 1e6 AS ic_ir,
  floor((avg(ic) * sqrt(avg(breadth))) * 1e6 + 5e-1) / 1e6 AS implied_ir,
  floor((avg(CASE WHEN long_net > benchmark THEN 1e0 ELSE 0e0 END)) * 1e6 + 5e-1) / 1e6 AS hit_rate,
  floor((SELECT """ + t_pvalue("t", "n") + """ FROM (SELECT avg(x) / stddev_samp(x) * sqrt(count(x)) AS t, count(x) AS n
    FROM (SELECT long_net - benchmark AS x FROM periods))) * 1e6 + 5e-1) / 1e6 AS excess_p
FROM (SELECT *, long_net - benchmark AS x FROM periods)"""),
        "curve_summary": q(BARS, PERIODS, f"""
eq AS (SELECT date, {log_equity('long_net')} AS le, {log_equity('long_short')} AS se,
         {log_equity('benchmark')} AS be, long_net > benchmark AS beats,
         {flips('long_net')} AS lf, {flips('long_short')} AS sf, {flips('benchmark')} AS bf FROM periods),
last AS (SELECT lf * exp(lf * le) - 1 AS l, sf * exp(sf * se) - 1 AS s, bf * exp(bf * be) - 1 AS b
         FROM eq WHERE date = (SELECT max(date) FROM eq))""", select=f"""
SELECT (SELECT count(*) FROM eq) AS periods, {r('sign(l) * ln(1 + abs(l))')} AS long_total,
  {r('sign(s) * ln(1 + abs(s))')} AS ls_total, {r('sign(b) * ln(1 + abs(b))')} AS bench_total,
  (SELECT {r('avg(CASE WHEN beats THEN 1e0 ELSE 0e0 END)')} FROM eq) AS beat_share FROM last"""),
        "performance_table": q(BARS, PERIODS, select=" UNION ALL ".join(
            performance_sql(c) for c in ("long_net", "long_gross", "long_short", "benchmark"))),
        "topk_backtest": q(BARS, REB, """
pos AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn,
          count(*) OVER (PARTITION BY date) AS breadth FROM reb),
g AS (SELECT date, max(breadth) AS breadth, avg(fwd_return_30d) AS benchmark,
        avg(fwd_return_30d) FILTER (rn <= 5) AS gross FROM pos GROUP BY date)""", select=f"""
SELECT date, breadth, {rcols(['benchmark', 'gross'])}, {r('gross - 25e-4')} AS net,
  {r('gross - 25e-4 - benchmark')} AS excess FROM g WHERE breadth >= 5"""),
        "topk_summary": q(BARS, REB, """
pos AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn,
          count(*) OVER (PARTITION BY date) AS breadth FROM reb),
g AS (SELECT date, avg(fwd_return_30d) AS benchmark,
        avg(fwd_return_30d) FILTER (rn <= 5) AS gross,
        avg(fwd_return_30d) FILTER (rn <= 5) - 25e-4 AS net FROM pos
      GROUP BY date HAVING max(breadth) >= 5)""", select=f"""
SELECT periods, log_gross, log_net, log_benchmark, mean_excess, {r('t')} AS t,
  {r(t_pvalue('t', 'periods'))} AS p_value
FROM (SELECT count(*) AS periods, {r('sum(ln(1 + gross))')} AS log_gross,
  {r('sum(ln(1 + net))')} AS log_net, {r('sum(ln(1 + benchmark))')} AS log_benchmark,
  {r('avg(net - benchmark)')} AS mean_excess,
  avg(net - benchmark) * sqrt(count(*)) / stddev_samp(net - benchmark) AS t FROM g)"""),
        "feature_bound": q(BARS, TAGGED, select="").rstrip() + scaler_sql() + """
, z AS (SELECT """ + ", ".join(_scaled(c) for c in CORE) + "\nFROM tagged " + " ".join(
            f"CROSS JOIN (SELECT * FROM scaler WHERE feature = '{c}') p_{c}" for c in CORE) + """)
SELECT max(greatest(""" + ", ".join(f"abs({c})" for c in CORE) + """)) AS max_abs,
  max(greatest(""" + ", ".join(f"abs({c})" for c in CORE) + """)) <= 5 AS within_bound FROM z""",
        "rebased_prices": q(BARS, select=f"""
SELECT symbol, date, {r('p')} AS off_peak FROM (SELECT symbol, date, adj_close / max(adj_close)
  {over('UNBOUNDED PRECEDING', 'CURRENT ROW')} - 1 AS p FROM traded)"""),
        "list_companies": q(BARS, LATEST, select="""
SELECT symbol, industry, round(close, 2) AS last_close, false AS is_live,
  strftime(date, '%Y-%m-%d') AS as_of_date FROM latest"""),
        "company_detail": q(BARS, STATEMENTS, feature_sql(), ema_sql(), select="""
SELECT upper(f.symbol) AS symbol, industry, round(close, 2) AS last_close, false AS is_live,
  strftime(f.date, '%Y-%m-%d') AS as_of_date, round(fund_roe * 100, 2) AS roe_pct,
  round(CASE WHEN eps > 0 THEN adj_close / eps END, 2) AS pe_ratio,
  round(fund_net_profit_growth * 100, 2) AS net_profit_growth_pct,
  round(fund_eps_growth * 100, 2) AS eps_growth_pct, round(rsi_14, 1) AS rsi_14,
  CASE WHEN macd_hist_norm > 0 THEN 'Bullish' ELSE 'Bearish' END AS macd_signal,
  round(price_to_sma50 * 100, 2) AS price_vs_sma50_pct,
  round(price_to_ema200 * 100, 2) AS price_vs_ema200_pct,
  round(volatility_20, 4) AS volatility_20d,
  CASE WHEN volume_ratio > 1.1 THEN 'Above Average' WHEN volume_ratio < 0.9 THEN 'Below Average'
       ELSE 'Average' END AS volume_trend
FROM feat f JOIN ema e ON e.symbol = f.symbol AND e.date = f.date
ASOF LEFT JOIN known k ON k.symbol = f.symbol AND f.date >= k.known_date
WHERE f.symbol = 'Brand7' ORDER BY f.date DESC LIMIT 1""", recursive=True),
        "history": q(BARS, feature_sql(), select="""
SELECT strftime(date, '%Y-%m-%d') AS date, round(close, 2) AS close,
  round(close / (1 + price_to_sma20), 2) AS sma20, round(close / (1 + price_to_sma50), 2) AS sma50,
  round(rsi_14, 1) AS rsi_14
FROM (SELECT * FROM feat WHERE symbol = 'Brand7' ORDER BY date DESC LIMIT 180)"""),
        "market_overview": q(BARS, INDEX, filled_index("traded"), regime("filled"), f"""
lr0 AS (SELECT *, ln(adj_close / {lag('adj_close')}) AS log_return FROM panel),
lastd AS (SELECT max(date) AS d FROM panel)""", select="""
SELECT strftime(max(l.date), '%Y-%m-%d') AS as_of_date,
  round((SELECT nifty_close FROM index_d, lastd WHERE date = d), 2) AS index_close,
  round(max(nifty_return) * 100, 2) AS index_daily_return_pct,
  CASE WHEN max(nifty_return) > 0 THEN 'Positive' ELSE 'Negative' END AS market_trend,
  (SELECT count(DISTINCT symbol) FROM panel) AS stocks_in_universe,
  count(DISTINCT symbol) AS stocks_with_data_as_of_date,
  count(*) FILTER (log_return > 0) AS stocks_positive_today,
  count(*) FILTER (log_return <= 0) AS stocks_negative_today, false AS is_live
FROM lr0 l JOIN lastd ON l.date = d LEFT JOIN regime i ON i.date = l.date"""),
        "top_ranked": q(BARS, feature_sql(), select=f"""
SELECT symbol, date, industry, {rcols(['close', 'roc_20'])} FROM feat
WHERE date = (SELECT max(date) FROM feat) AND roc_20 IS NOT NULL
ORDER BY feat.roc_20 DESC, symbol LIMIT 5"""),
        "risk_tier": q(BARS, feature_sql(), f"""
s AS (SELECT symbol, date, volatility_20,
        CASE WHEN volatility_20 IS NULL THEN 0 ELSE
          (rank() OVER (PARTITION BY date, (volatility_20 IS NULL) ORDER BY volatility_20) - 1)
        END / CAST(count(*) OVER (PARTITION BY date) AS DOUBLE) AS share FROM feat)""", select="""
SELECT symbol, date, CASE WHEN share >= 66e-2 THEN 'High' WHEN share <= 33e-2 THEN 'Low'
  ELSE 'Medium' END AS risk_level FROM s"""),
        "trend_labels": q(BARS, feature_sql(), select="""
SELECT symbol, date, CASE WHEN volume_ratio > 11e-1 THEN 'Above Average'
  WHEN volume_ratio < 9e-1 THEN 'Below Average' ELSE 'Average' END AS volume_trend FROM feat"""),
        "signal_labels": q(SCORED, select="""
SELECT CASE WHEN score >= 54e-2 THEN 'Positive' WHEN score <= 46e-2 THEN 'Negative'
  ELSE 'Neutral' END AS signal, count(*) AS n FROM scored GROUP BY 1"""),
        "live_overlay": """
WITH last AS (SELECT CAST(user_id AS VARCHAR) AS symbol, arg_max(value, row(ts, value)) AS ltp,
                max(ts) AS ts FROM events GROUP BY 1),
fresh AS (SELECT * FROM last WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR)
SELECT CAST(c_custkey AS VARCHAR) AS symbol, round(coalesce(ltp, c_acctbal), 2) AS last_close,
  ltp IS NOT NULL AS is_live
FROM customer LEFT JOIN fresh ON symbol = CAST(c_custkey AS VARCHAR)""",
        "point_lookup": q(BARS, select=f"""
SELECT upper(symbol) AS symbol, date, {rcols(['open', 'high', 'low', 'close', 'adj_close'])}, volume
FROM traded WHERE symbol = 'Brand7' AND date <= DATE '1998-07-04' ORDER BY date DESC LIMIT 1"""),
        "search_companies": q(BARS, LATEST, select="""
SELECT symbol, industry, round(close, 2) AS last_close, false AS is_live,
  strftime(date, '%Y-%m-%d') AS as_of_date FROM latest WHERE lower(symbol) LIKE '%brand1%'"""),
        "industry_list": q(MASTER, select="SELECT DISTINCT industry FROM master"),
    })
    out["stored_history"] = out["history"]
    out.update(model_oracles())
    return out


def panel_sql():
    """The whole build, gated."""
    fixed = [c for c in TECHNICAL_COLS if c != "log_return"]
    from_feat = [c for c in fixed if "ema" not in c and "macd" not in c]
    from_ema = [c for c in fixed if c not in from_feat]
    med = ", ".join(f"median(fwd_return_{h}d) AS m{h}" for h in HORIZONS)
    cols = ["l.log_return"] + [f"f.{c}" for c in from_feat] + [f"e.{c}" for c in from_ema]
    cols += ["i.nifty_return", "i.nifty_volatility_20", "i.nifty_trend", "v.vix_zscore_60",
             "v.vix_change_5d", "k.fund_roe", "k.fund_net_profit_growth", "k.fund_eps_growth"]
    outs = [f"{c} AS {c.split('.')[1]}" for c in cols]
    outs += ["f.log_return - i.nifty_return AS relative_strength",
             "o.sector_return AS sector_return",
             "CASE WHEN k.eps > 0 THEN f.adj_close / k.eps END AS fund_pe_ratio"]
    for h in HORIZONS:
        x = f"l.fwd_return_{h}d"
        sec = f"CASE WHEN sz > 1 THEN s.m{h} ELSE d.m{h} END"
        outs += [f"{x} AS fwd_return_{h}d", f"{x} - d.m{h} AS rel_return_{h}d",
                 f"CASE WHEN {x} > d.m{h} THEN 1e0 WHEN {x} IS NOT NULL THEN 0e0 END"
                 f" AS beats_median_{h}d",
                 f"CASE WHEN {x} > 0 THEN 1e0 WHEN {x} IS NOT NULL THEN 0e0 END"
                 f" AS positive_return_{h}d",
                 f"l.future_volatility_{h}d AS future_volatility_{h}d",
                 f"{x} - {sec} AS rel_return_sector_{h}d",
                 f"CASE WHEN {x} > {sec} THEN 1e0 WHEN {x} IS NOT NULL THEN 0e0 END"
                 f" AS beats_sector_median_{h}d",
                 f"{x} / nullif(f.volatility_20 * sqrt({h}), 0) AS fwd_return_vol_adj_{h}d",
                 f"l.k{h} AS fwd_return_rank_{h}d", f"l.top_tercile_{h}d AS top_tercile_{h}d"]
    need = " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLS + REQUIRED_LABELS)
    return q(BARS, INDEX, ACTIONS, STATEMENTS, feature_sql(), ema_sql(), filled_index("traded"),
             regime("filled"), VIX, label_sql(), """
lr2 AS (SELECT *, count(*) OVER g AS n, sum(log_return) OVER g AS s FROM lr
        WINDOW g AS (PARTITION BY date, industry)),
loo AS (SELECT symbol, date, CASE WHEN n > 1 THEN (coalesce(s, 0) - log_return) / (n - 1)
          ELSE 0 END AS sector_return FROM lr2)""", select="", recursive=True).rstrip() + rank_sql() + f"""
, dm AS (SELECT date, {med} FROM lab GROUP BY 1),
sm AS (SELECT date, industry, count(*) AS sz, {med} FROM lab GROUP BY 1, 2),
full_p AS (
  SELECT f.symbol, f.date, f.industry, {', '.join(outs)}
  FROM feat f JOIN ema e ON e.symbol = f.symbol AND e.date = f.date
  JOIN terc l ON l.symbol = f.symbol AND l.date = f.date
  JOIN loo o ON o.symbol = f.symbol AND o.date = f.date
  JOIN dm d ON d.date = f.date JOIN sm s ON s.date = f.date AND s.industry = f.industry
  LEFT JOIN regime i ON i.date = f.date LEFT JOIN vix_r v ON v.date = f.date
  ASOF LEFT JOIN known k ON k.symbol = f.symbol AND f.date >= k.known_date)
SELECT symbol, date, industry, {rcols(FEATURE_COLS + LABEL_COLS)} FROM full_p
WHERE {need}"""


def model_oracles() -> dict:
    test = """(SELECT * FROM tagged WHERE split = 'test')"""
    mean = "(SELECT avg(fwd_return_30d) AS p FROM tagged WHERE split = 'train')"
    beats = """
, bm AS (SELECT split, CASE WHEN fwd_return_30d > m THEN 1e0 ELSE 0e0 END AS y
         FROM tagged JOIN (SELECT date AS d, median(fwd_return_30d) AS m FROM model GROUP BY 1)
           ON d = date)"""
    lo, hi = "greatest(p_roc_20.lo, p_roc_20.center - 5 * p_roc_20.iqr)", \
        "least(p_roc_20.hi, p_roc_20.center + 5 * p_roc_20.iqr)"
    return {
        "feature_panel": panel_sql(),
        "panel_refresh": panel_sql(),
        "mean_eval": q(BARS, TAGGED, select=f"""
SELECT count(*) AS n, {r('avg(abs(p - y))')} AS mae, {r('sqrt(avg((p - y) * (p - y)))')} AS rmse,
  {r('1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*))')} AS r2, 0e0 AS pearson,
  {r('avg(CASE WHEN (y > 0) = (p > 0) THEN 1e0 ELSE 0e0 END)')} AS dir_acc,
  {r('median(abs(p - y))')} AS median_ae, {r('stddev_pop(y)')} AS actual_std
FROM (SELECT fwd_return_30d AS y, p FROM {test}, {mean})"""),
        "majority_eval": q(BARS, TAGGED, select="").rstrip() + beats + f"""
SELECT count(*) AS n, {r('avg(CASE WHEN y = c THEN 1e0 ELSE 0e0 END)')} AS accuracy,
  {r('greatest(avg(y), 1 - avg(y))')} AS base_rate
FROM bm, (SELECT CASE WHEN avg(y) > 5e-1 THEN 1e0 ELSE 0e0 END AS c FROM bm
          WHERE split = 'train') WHERE split = 'test'""",
        "momentum_eval": q(BARS, TAGGED, select="").rstrip() + scaler_sql() + f"""
, m AS (SELECT fwd_return_30d AS y, greatest(least(roc_20, {hi}), {lo}) AS p FROM {test},
        (SELECT * FROM scaler WHERE feature = 'roc_20') p_roc_20),
k AS (SELECT *, {arank('y', '1')} AS ry, {arank('round(p, 12)', '1')} AS rp FROM m)
SELECT count(*) AS n, {r('avg(abs(p - y))')} AS mae, {r('sqrt(avg((p - y) * (p - y)))')} AS rmse,
  {r('corr(y, p)')} AS pearson, {r('corr(ry, rp)')} AS spearman,
  {r('avg(CASE WHEN (y > 0) = (p > 0) THEN 1e0 ELSE 0e0 END)')} AS dir_acc FROM k""",
        "ensemble_mean": q(BARS, MODEL, select=f"""
SELECT symbol, date, {r('(roc_5 + roc_20 + log_return) / 3')} AS pred, 3 AS members FROM feat
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CORE)}"""),
        "quote_stream": """
WITH last AS (SELECT CAST(user_id AS VARCHAR) AS symbol, arg_max(value, row(ts, value)) AS ltp,
                max(ts) AS ts FROM events GROUP BY 1)
SELECT symbol, round(ltp, 2) AS last_close, true AS is_live FROM last
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR
  AND symbol IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""",
    }


def _scaled(c):
    v = f"greatest(least({c}, p_{c}.hi), p_{c}.lo)"
    if c in LOGS:
        v = f"ln(1 + greatest({v}, 0))"
    z = f"({v} - p_{c}.center) / CASE WHEN p_{c}.iqr = 0 THEN 1 ELSE p_{c}.iqr END"
    return r(f"greatest(least({z}, 5), -5)") + f" AS {c}"


FILINGS = """
WITH years AS (SELECT symbol, make_date(y, 12, 31) AS fiscal_year_end
  FROM (SELECT DISTINCT c_mktsegment AS symbol FROM customer),
       (SELECT unnest([1995, 1996, 1997, 1998, 1999, 2000]) AS y)),
told AS (SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders
  JOIN customer ON o_custkey = c_custkey WHERE lower(o_orderpriority) LIKE '%1-urgent%'),
hit AS (SELECT y.symbol, fiscal_year_end, min(day) AS first FROM years y
  LEFT JOIN told t ON t.symbol = y.symbol AND day BETWEEN fiscal_year_end AND fiscal_year_end + 7
  GROUP BY 1, 2),
matched AS (SELECT symbol, fiscal_year_end, coalesce(first, fiscal_year_end + 60) AS known_date,
  CASE WHEN first IS NULL THEN 'approximation_fallback' ELSE 'nse_actual' END AS source FROM hit)"""
