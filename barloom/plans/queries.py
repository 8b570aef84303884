"""The registered queries: each operator on panel-shaped sample tables.

Every query reads whole tables. Computed columns are rounded so that results can
be compared with another engine by value.
"""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import (
    audit, backtest, cleaning, cross_section as xs, fundamentals as fund, labels, metrics,
    scaling, serving, splits, technicals as tech)
from barloom.operators.asof import asof_join
from barloom.operators.ewm import add_ewm
from barloom.schema import TECHNICAL_COLS
from barloom.session import checkpoint_dir, materialize
from barloom.sources import sample_tables as st, writers

KEY = ["symbol", "date"]
# Sample dates run 1995-2001, so the published 2022/2024 boundaries move there.
SPLIT = {"train_end": "1999-06-30", "val_end": "2000-06-30", "purge_days": 150}
#: Every per-symbol feature but the EMA family, whose 200-row warm-up would empty the small samples.
CORE = [c for c in TECHNICAL_COLS if "ema" not in c and "macd" not in c]


def rounded(df: DataFrame, dp: int = 6) -> DataFrame:
    """Round floating columns (half up, plain double arithmetic); infinities become NULL."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(F.abs(c) < F.lit(float("inf")), c.cast("double"))
            c = F.floor(c * 10.0 ** dp + 0.5) / 10.0 ** dp
        out.append(c.alias(name))
    return df.select(*out)


def _features(make):
    def run(spark, sf):
        groups = make()
        d = tech.add_features(st.traded(spark, sf), *groups)
        return rounded(d.drop("open", "high", "low", "close", "adj_close", "volume"))
    return run


# ---- ingest ----
def clean_bars(spark, sf):
    d = cleaning.clean_panel(st.bars(spark, sf), st.master(spark, sf),
                             st.index_series(spark, sf), st.actions(spark))
    return d


def coverage(spark, sf):
    some = st.traded(spark, sf).where("symbol <> 'Brand3'")
    return audit.coverage(st.master(spark, sf), some, 1200)


def index_calendar_fill(spark, sf):
    return (xs.index_on_calendar(st.bars(spark, sf), st.index_series(spark, sf)))


def _holed(spark, sf):
    """Bars whose zero-volume rows lost their prices."""
    sold = F.col("volume") > 0
    return st.bars(spark, sf).select(*KEY, *[
        F.when(sold, F.col(c)).alias(c) for c in
        ("open", "high", "low", "close", "adj_close", "volume")])


def null_profile(spark, sf):
    return cleaning.null_profile(_holed(spark, sf))


def ffill_prices(spark, sf):
    return (cleaning.fill_forward(_holed(spark, sf)))


def first_per_date(spark, sf):
    return (cleaning.unique_bars(
        st.bars(spark, sf).withColumn("_k", F.col("symbol"))
        .withColumn("symbol", st.industry_of(F.col("symbol"))), prefer="_k"))


# ---- audit ----
def qc_structural(spark, sf):
    return audit.structural(_odd_bars(spark, sf))


def _odd_bars(spark, sf):
    """Bars with faults: repeated days, swapped highs, missing and negative values."""
    b = st.bars(spark, sf)
    d = F.dayofmonth("date")
    odd = b.withColumns({
        "high": F.when(d == 3, F.col("low") - 1).otherwise(F.col("high")),
        "open": F.when(d == 5, F.lit(None)).otherwise(F.col("open")),
        "close": F.when(d == 7, -F.col("close")).otherwise(F.col("close")),
        "volume": F.when(d == 9, -F.col("volume")).otherwise(F.col("volume"))})
    return odd.unionByName(b.where(F.dayofmonth("date") == 11))


def qc_findings(spark, sf):
    return audit.findings(audit.structural(_odd_bars(spark, sf)))


def qc_gaps_jumps(spark, sf):
    return audit.jumps_and_gaps(st.bars(spark, sf), jump=0.5, gap_days=4)


def qc_unadjusted_splits(spark, sf):
    return rounded(audit.unadjusted_splits(st.bars(spark, sf), jump=0.9))


def qc_price_jumps(spark, sf):
    return rounded(audit.price_jumps(st.bars(spark, sf), jump=1.2))


def qc_reconcile(spark, sf):
    a = st.bars(spark, sf).where("symbol <> 'Brand3'")
    b = st.statement_years(spark, sf).where("symbol <> 'Brand4'")
    return audit.reconcile(a, b, ("prices", "fundamentals"))


def qc_summary(spark, sf):
    return audit.universe_summary(st.bars(spark, sf))


def break_report(spark, sf):
    d = cleaning.clean_panel(st.bars(spark, sf), st.master(spark, sf),
                             st.index_series(spark, sf), st.actions(spark))
    return audit.break_rows(d)


# ---- technicals ----
def ema_macd(spark, sf):
    b = st.traded(spark, sf).select(*KEY, "adj_close")
    return rounded(tech.add_ema_family(b).drop("adj_close"))


def ewm_volume(spark, sf):
    b = st.traded(spark, sf).select(*KEY, F.col("volume").cast("double").alias("volume"))
    return rounded(add_ewm(b, [("volume", 9, "vol_ema9"), ("volume", 200, "vol_ema200")]))


def technical_panel(spark, sf):
    d = tech.add_technicals(st.traded(spark, sf))
    return rounded(d.select(*KEY, *tech_columns()))


def tech_columns():
    from barloom.schema import TECHNICAL_COLS
    return TECHNICAL_COLS


# ---- regime ----
def index_regime(spark, sf):
    return rounded(xs.index_regime(st.index_series(spark, sf)))


def vix_regime(spark, sf):
    return rounded(xs.volatility_regime(st.vix_series(spark, sf)))


def _returns(spark, sf):
    return tech.add_features(st.panel(spark, sf), tech.log_return())


def sector_loo(spark, sf):
    d = xs.add_sector_return(_returns(spark, sf))
    return rounded(d.select(*KEY, "industry", "log_return", "sector_return"))


def market_regime(spark, sf):
    d = _returns(spark, sf)
    d = xs.attach(d, xs.index_on_calendar(d, st.index_series(spark, sf)), ["date"])
    d = xs.add_market_regime(d, st.vix_series(spark, sf))
    return rounded(d.select(*KEY, "nifty_return", "nifty_volatility_20", "nifty_trend",
                            "vix_zscore_60", "vix_change_5d", "relative_strength"))


# ---- labels ----
def _labelled(spark, sf):
    return labels.add_forward_labels(_returns(spark, sf))


def forward_returns(spark, sf):
    cols = [f"{s}_{h}d" for s in ("fwd_return", "positive_return") for h in labels.HORIZONS]
    return rounded(_labelled(spark, sf).select(*KEY, *cols))


def future_vol(spark, sf):
    return rounded(_labelled(spark, sf).select(
        *KEY, *[f"future_volatility_{h}d" for h in labels.HORIZONS]))


def _masked(spark, sf):
    # The cross-section reads its rows several times: written once, read back.
    return materialize(labels.mask_breaks(
        cleaning.flag_breaks(_labelled(spark, sf), st.actions(spark))))


def break_mask(spark, sf):
    cols = [f"{s}_{h}d" for s in ("fwd_return", "future_volatility") for h in labels.HORIZONS]
    return rounded(_masked(spark, sf).select(*KEY, "corp_action_break", "log_return", *cols))


def relative_labels(spark, sf):
    stems = ("rel_return", "beats_median", "rel_return_sector", "beats_sector_median")
    d = labels.add_relative_labels(_masked(spark, sf))
    return rounded(d.select(*KEY, *[f"{s}_{h}d" for s in stems for h in labels.HORIZONS]))


def rank_tercile(spark, sf):
    d = labels.add_rank_labels(_masked(spark, sf))
    stems = ("fwd_return_rank", "top_tercile")
    return rounded(d.select(*KEY, *[f"{s}_{h}d" for s in stems for h in labels.HORIZONS]))


def vol_adjusted(spark, sf):
    d = labels.add_forward_labels(tech.add_features(st.panel(spark, sf), tech.volatility()))
    d = labels.add_vol_adjusted(d)
    return rounded(d.select(*KEY, *[f"fwd_return_vol_adj_{h}d" for h in labels.HORIZONS]))


def gate_report(spark, sf):
    d = tech.add_features(st.panel(spark, sf), tech.log_return(), tech.volatility())
    d = labels.add_rank_labels(labels.add_forward_labels(d))
    need = ["log_return", "volatility_20", "fwd_return_30d", "future_volatility_30d"]
    return cleaning.gate_report(d, need, [f"top_tercile_{h}d" for h in labels.HORIZONS])


# ---- point in time ----
def _statements(spark, sf):
    return fund.add_statement_ratios(st.statement_years(spark, sf))


def fundamental_growth(spark, sf):
    d = fund.point_in_time(_statements(spark, sf), st.filings(spark, sf))
    return rounded(d.select("symbol", "fiscal_year_end", "known_date", "eps", "roe_pct",
                            "debt_to_equity", "fund_roe", "fund_net_profit_growth",
                            "fund_eps_growth"))


def asof_pe(spark, sf):
    known = fund.point_in_time(_statements(spark, sf), st.filings(spark, sf))
    d = fund.add_fundamentals(st.traded(spark, sf).select(*KEY, "adj_close"), known)
    return rounded(d.drop("adj_close"))


def asof_events(spark, sf):
    """Every view with its user's newest click at or before it; days of a user are dealt apart."""
    events = st.table(spark, sf, "events").withColumns(
        {"user": F.col("user_id"), "ts": F.col("ts").cast("timestamp")})
    views = events.where("event_type = 'view'").select("event_id", "user", "ts")
    clicks = events.where("event_type = 'click'").select("user", F.col("ts").alias("click_ts"), "value")
    return rounded(asof_join(views, clicks, "ts", "click_ts", by="user", bucket="day")
                   .withColumn("seconds_since", F.unix_seconds("ts") - F.unix_seconds("click_ts"))
                   .drop("ts", "click_ts"))


def filing_match(spark, sf):
    years = (st.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("symbol"))
             .distinct().withColumn("y", F.explode(F.sequence(F.lit(1995), F.lit(2000))))
             .select("symbol", F.make_date("y", F.lit(12), F.lit(31)).alias("fiscal_year_end")))
    return fund.match_filings(years, st.announcements(spark, sf), ["1-urgent"], 7, 60)


def filing_provenance(spark, sf):
    return fund.provenance(filing_match(spark, sf))


def statement_pivot(spark, sf):
    names = {"AF": "af", "NO": "no", "RF": "rf", "NF": "nf", "AO": "ao", "RO": "ro"}
    return rounded(fund.assemble_statements(st.statement_cells(spark, sf), names))


# ---- preparation ----
def _features_panel(spark, sf):
    d = tech.add_features(st.panel(spark, sf), tech.log_return(), tech.rate_of_change(), tech.sma_ratio(),
                          tech.rsi(), tech.bollinger(), tech.volatility(), tech.atr(), tech.volume_ratio(),
                          tech.channel_distance(), tech.obv())
    return d.select(*KEY, "industry", "close", "adj_close", *CORE)


def _modelling(spark, sf):
    d = _features_panel(spark, sf)
    ahead = labels.ratio_change(F.lead("adj_close", 30).over(labels.timeline()), "adj_close")
    return d.withColumn("fwd_return_30d", ahead).dropna(subset=[*CORE, "fwd_return_30d"])


def purged_split(spark, sf):
    d = splits.purged_split(_modelling(spark, sf), **SPLIT)
    return d.select(*KEY, "split")


def split_inventory(spark, sf):
    return audit.split_inventory(splits.purged_split(_modelling(spark, sf), **SPLIT))


def split_integrity(spark, sf):
    d = splits.purged_split(_modelling(spark, sf), **SPLIT)
    return audit.split_integrity(d, SPLIT["purge_days"], "fwd_return_30d")


def target_audit(spark, sf):
    return rounded(audit.target_audit(_modelling(spark, sf), st.traded(spark, sf)))


def scaler_params(spark, sf):
    train = splits.purged_split(_modelling(spark, sf), **SPLIT).where("split = 'train'")
    return rounded(scaling.fit_parameters(train, CORE))


def scaled_features(spark, sf):
    d = splits.purged_split(_modelling(spark, sf), **SPLIT)
    model = scaling.PanelScaler(inputCols=CORE).fit(d.where("split = 'train'"))
    return rounded(model.transform(d).select(*KEY, "split", *CORE))


def sequences(spark, sf):
    """Windows of 60 rows, every fifth; summarised per window."""
    d = _modelling(spark, sf)
    s = splits.sequences(d, ["roc_5", "roc_20"], ["fwd_return_30d"], 60, 5)
    part = F.transform("x", lambda r: r[0].cast("double"))
    total = F.aggregate(part, F.lit(0.0), lambda a, v: a + v)
    return rounded(s.select(*KEY, F.size("x").alias("steps"),
                            F.element_at("x", -1)[1].alias("last_roc_20"),
                            total.alias("sum_roc_5"), "fwd_return_30d"), 3)


def time_folds(spark, sf):
    return splits.time_folds(st.traded(spark, sf), 5, 30)


def target_standardized(spark, sf):
    d = splits.purged_split(_modelling(spark, sf), **SPLIT)
    z = splits.standardize_target(d, d.where("split = 'train'"), "fwd_return_30d", "z")
    return rounded(z.select(*KEY, "split", "z"))


def feature_bound(spark, sf):
    d = splits.purged_split(_modelling(spark, sf), **SPLIT)
    model = scaling.PanelScaler(inputCols=CORE).fit(d.where("split = 'train'"))
    return rounded(audit.feature_bound(model.transform(d), CORE))


def rebased_prices(spark, sf):
    """A user's own pandas function per symbol: price over its running maximum."""
    def rebase(g):
        g = g.sort_values("date")
        return g.assign(off_peak=g.adj_close / g.adj_close.cummax() - 1)[
            ["symbol", "date", "off_peak"]]

    d = st.traded(spark, sf).select(*KEY, "adj_close")
    return rounded(serving.per_symbol(d, rebase, "symbol string, date date, off_peak double"))


# ---- evaluation ----
def regression_metrics(spark, sf):
    d = st.scored(spark, sf).select("l_tax", (F.col("score") / 10).alias("pred"),
                                    F.col("l_tax").alias("y"))
    return rounded(metrics.regression_summary(d, "y", "pred", boundary=0.03), 8)


def auc_ap_brier(spark, sf):
    return rounded(metrics.ranking_scores(st.scored(spark, sf), "label", "score"), 8)


def calibration(spark, sf):
    """Deciles of a nearly continuous score."""
    d = st.scored(spark, sf).withColumn("score", F.col("l_extendedprice") / 200000)
    return rounded(metrics.calibration(d, "label", "score"))


def confusion(spark, sf):
    d = st.scored(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("double"))
    return rounded(metrics.confusion(d, "label", "pred"))


def accuracy_by_level(spark, sf):
    d = st.scored(spark, sf).withColumn("pred", (F.col("l_quantity") > 25).cast("double"))
    return rounded(metrics.accuracy(d, "label", "pred", ["score"]))


def binomial_test(spark, sf):
    d = st.scored(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("double"))
    return rounded(metrics.binomial_test(d, "label", "pred", 0.5))


def yearly_ic(spark, sf):
    return rounded(metrics.yearly_ic(_modelling(spark, sf), "fwd_return_30d", CORE))


def ic_stability(spark, sf):
    ics = metrics.yearly_ic(_modelling(spark, sf), "fwd_return_30d", CORE)
    return rounded(metrics.ic_stability(ics))


# ---- backtest ----
def _rebalanced(spark, sf):
    """roc_20 as the score, on every 30th date; held 30 rows."""
    d = materialize(_modelling(spark, sf).select(*KEY, "roc_20", "fwd_return_30d"))
    dates = splits.rebalance_dates(d, "1996-01-01", 30).select("date")
    return (d.join(F.broadcast(dates), "date", "left_semi")
            .select(*KEY, F.col("roc_20").alias("score"), "fwd_return_30d"))


def rebalance_calendar(spark, sf):
    return splits.rebalance_dates(_modelling(spark, sf), "1996-01-01", 30)


def baskets(spark, sf):
    return rounded(backtest.basket_sides(_rebalanced(spark, sf)).select(*KEY, "side", "score"))


def tied_baskets(spark, sf):
    """Baskets of a coarse score, so the boundary runs through tie groups."""
    d = _rebalanced(spark, sf).withColumn("score", F.round(F.col("score"), 0))
    return backtest.basket_sides(d).select(*KEY, "side", "score")


def _periods(spark, sf):
    return backtest.period_returns(_rebalanced(spark, sf), "fwd_return_30d", min_names=5)


def turnover_cost(spark, sf):
    return rounded(_periods(spark, sf))


def equity_curve(spark, sf):
    curve = backtest.equity_curve(_periods(spark, sf))
    # The equities multiply up over the sample, so they are compared in logs.
    eq = ("long_equity", "ls_equity", "bench_equity")
    return rounded(curve.select("date", "long_net", "long_short", "benchmark", "ic", *[
        (F.signum(c) * F.ln(F.abs(F.col(c)))).alias(c) for c in eq]))


def backtest_stats(spark, sf):
    """Excess, information ratio, the t-test of the excess with its p-value, and IC statistics."""
    return rounded(backtest.excess_summary(_periods(spark, sf), 252 / 30))


def curve_summary(spark, sf):
    """Total returns of the equity curve and the share of periods above the benchmark."""
    d = backtest.curve_summary(materialize(backtest.equity_curve(_periods(spark, sf))))
    # The books multiply up over the sample: sign and logarithm of a total x, ln(1 + |x|).
    totals = [(F.signum(c) * F.log1p(F.abs(F.col(c)))).alias(c) for c in ("long_total", "ls_total", "bench_total")]
    return rounded(d.select("periods", *totals, "beat_share"))


def performance_table(spark, sf):
    d = backtest.performance_table(_periods(spark, sf), 252 / 30)
    return rounded(d.select("book", "periods", F.log1p("ann_return").alias("log_ann_return"),
                            "ann_vol", "max_drawdown"))


def topk_backtest(spark, sf):
    d = backtest.top_k_returns(_rebalanced(spark, sf), "fwd_return_30d")
    return rounded(d)


def topk_summary(spark, sf):
    """Compounded books in logs, mean excess, its t statistic and p-value."""
    d = backtest.top_k_summary(materialize(
        backtest.top_k_returns(_rebalanced(spark, sf), "fwd_return_30d")))
    return rounded(d.select("periods", *[F.log1p(f"cum_{c}").alias(f"log_{c}")
                                         for c in ("gross", "net", "benchmark")],
                            "mean_excess", "t", "p_value"))


# ---- serving ----
def list_companies(spark, sf):
    return serving.list_companies(st.panel(spark, sf))


def company_detail(spark, sf):
    d = tech.add_technicals(st.panel(spark, sf))
    known = fund.point_in_time(_statements(spark, sf), st.filings(spark, sf))
    upper = fund.add_fundamentals(d, known).withColumn("symbol", F.upper("symbol"))
    return serving.company_detail(upper, "brand7")


def history(spark, sf):
    d = tech.add_features(st.panel(spark, sf), tech.sma_ratio((20, 50)), tech.rsi())
    return serving.history(d.withColumn("symbol", F.upper("symbol")), "brand7", 180)


def stored_history(spark, sf):
    """The same from a stored panel laid out by symbol: one bucket's file is opened."""
    d = tech.add_features(st.panel(spark, sf), tech.sma_ratio((20, 50)), tech.rsi())
    path = f"{checkpoint_dir(spark)}/panels/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    writers.write_by_symbol(d.withColumn("symbol", F.upper("symbol")), path)
    return serving.history(writers.read_by_symbol(spark, path), "brand7", 180)


def market_overview(spark, sf):
    d = _returns(spark, sf)
    d = xs.attach(d, xs.index_on_calendar(d, st.index_series(spark, sf)), ["date"])
    d = xs.attach(d, xs.index_regime(d.groupBy("date").agg(
        F.max("nifty_close").alias("nifty_close"))).select("date", "nifty_return"), ["date"])
    return serving.market_overview(d, st.index_series(spark, sf))


def top_ranked(spark, sf):
    d = tech.add_features(st.panel(spark, sf), tech.rate_of_change((20,)))
    return rounded(serving.top_ranked(d.select(*KEY, "industry", "close", "roc_20"),
                                      "roc_20", 5))


def risk_tier(spark, sf):
    d = tech.add_features(st.panel(spark, sf), tech.volatility())
    day = materialize(d.select(*KEY, "volatility_20"))
    return serving.risk_tiers(day).select(*KEY, "risk_level")


def trend_labels(spark, sf):
    d = tech.add_features(st.traded(spark, sf), tech.volume_ratio())
    return d.select(*KEY, serving.volume_trend().alias("volume_trend"))


def signal_labels(spark, sf):
    sig = serving.signal_label("score", 0.54, 0.46)
    return (st.scored(spark, sf).withColumn("signal", sig).groupBy("signal")
            .agg(F.count(F.lit(1)).alias("n")))


def live_overlay(spark, sf):
    """Quotes of the last six hours over the stored balances."""
    return serving.overlay_quotes(st.quoted_accounts(spark, sf), st.quotes(spark, sf),
                                  ttl_seconds=6 * 3600).select("symbol", "last_close", "is_live")


def point_lookup(spark, sf):
    d = st.traded(spark, sf).withColumn("symbol", F.upper("symbol"))
    return rounded(cleaning.row_asof(d, "brand7", "1998-07-04"))


def search_companies(spark, sf):
    rows = serving.list_companies(st.panel(spark, sf))
    return cleaning.search_symbols(rows, " BRAND1 ", sort="price")


def industry_list(spark, sf):
    return cleaning.industries(st.master(spark, sf))


QUERIES = {
    f.__name__: f for f in (
        clean_bars, coverage, index_calendar_fill, null_profile, ffill_prices, first_per_date,
        qc_structural, qc_findings, qc_gaps_jumps, qc_unadjusted_splits, qc_price_jumps,
        qc_reconcile, qc_summary, break_report, ema_macd, ewm_volume, technical_panel,
        index_regime, vix_regime, sector_loo, market_regime, forward_returns, future_vol,
        break_mask, relative_labels, rank_tercile, vol_adjusted, gate_report,
        fundamental_growth, asof_pe, asof_events, filing_match, filing_provenance, statement_pivot,
        purged_split, split_inventory, split_integrity, target_audit, scaler_params,
        scaled_features, sequences, time_folds, target_standardized, regression_metrics,
        auc_ap_brier, calibration, confusion, accuracy_by_level, binomial_test, yearly_ic,
        ic_stability, rebalance_calendar, baskets, tied_baskets, turnover_cost, equity_curve,
        backtest_stats, curve_summary, performance_table, topk_backtest, topk_summary, feature_bound, rebased_prices,
        list_companies, company_detail,
        history, stored_history, market_overview, top_ranked, risk_tier, trend_labels, signal_labels,
        live_overlay, point_lookup, search_companies, industry_list)}
QUERIES.update({
    "returns_roc": _features(lambda: (tech.log_return(), tech.rate_of_change())),
    "sma_ratio": _features(lambda: (tech.sma_ratio(),)),
    "rsi": _features(lambda: (tech.rsi(),)),
    "bollinger": _features(lambda: (tech.bollinger(),)),
    "volatility": _features(lambda: (tech.volatility(),)),
    "atr": _features(lambda: (tech.atr(),)),
    "volume_ratio": _features(lambda: (tech.volume_ratio(),)),
    "channel_distance": _features(lambda: (tech.channel_distance(),)),
    "obv_z": _features(lambda: (tech.obv(),)),
})
