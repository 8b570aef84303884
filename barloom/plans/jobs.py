"""Batch jobs over folders: ingest, audit, feature build, models, evaluation, scoring.

    spark-submit -m barloom.plans.jobs features --raw RAW --out OUT
"""

import argparse
import datetime

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barloom import schema as S
from barloom.operators import (
    audit, backtest, cleaning, fundamentals as fund, metrics, models, scaling, serving, splits)
from barloom.operators.cross_section import with_row
from barloom.plans import build, refresh
from barloom.session import apply_settings, job_tables, materialize
from barloom.sources import readers, writers


def _input(raw: str, kind: str) -> str:
    return f"{raw}/{S.LANDING[kind]}"


def ingest(spark, raw: str, out: str) -> None:
    """Per-symbol CSV files, master and index -> clean panel by year."""
    landed = readers.read_signed_bars(spark, raw, renames=S.SYMBOL_RENAMES)
    bars = cleaning.unique_bars(landed.drop("file"), prefer="row_no")
    clean = cleaning.clean_panel(
        bars, readers.read_master(spark, _input(raw, "master")),
        readers.read_index(spark, _input(raw, "index")),
        readers.corporate_actions(spark, breaks_only=True))
    writers.write_panel(clean, f"{out}/clean")


def audit_raw(spark, raw: str, out: str) -> None:
    """Findings of every file check, plus coverage and cross-source differences."""
    heads = readers.headers(spark, raw)
    landed = materialize(readers.read_signed_bars(spark, raw, heads))
    helpers = [name.removesuffix(".csv") for name in S.LANDING.values()]
    bars = heads.where(~F.regexp_extract("file", readers.FILE_STEM, 1).isin(helpers))
    daily = materialize(cleaning.unique_bars(landed.drop("file"), prefer="row_no"))
    found = audit.findings(audit.structural(landed)).unionByName(
        audit.findings(audit.jumps_and_gaps(daily).fillna(0, ["max_gap_days"]))).unionByName(
        audit.unordered_files(landed).select(
            "symbol", F.lit("descending_dates").alias("check"), F.col("descents").alias("n"))).unionByName(
        audit.landing_findings(bars, landed, [c for c in S.RAW_BAR_HEADER if c != "Symbol"]))
    master = readers.read_master(spark, _input(raw, "master"))
    listed = audit.reconcile(master, landed, ("master", "files"))
    found = found.unionByName(listed.select(
        "symbol", F.concat(F.lit("only_in_"), "only_in").alias("check"), F.lit(1).cast("long").alias("n")))
    writers.write_report(found, f"{out}/qc_report")
    writers.write_result(audit.price_column_count(bars), f"{out}/price_columns")
    writers.write_result(readers.corporate_actions(spark), f"{out}/corporate_actions")
    writers.write_result(audit.coverage(master, landed), f"{out}/coverage")
    writers.write_result(audit.unadjusted_splits(daily), f"{out}/unadjusted_splits")
    writers.write_result(audit.price_jumps(daily), f"{out}/price_jumps")
    writers.write_result(audit.universe_summary(landed), f"{out}/universe")


def features(spark, raw: str, out: str) -> None:
    """Clean panel + volatility index + statements -> feature panel, by date and by symbol."""
    known = fund.point_in_time(
        readers.read_fundamentals(spark, _input(raw, "fundamentals"), S.SYMBOL_RENAMES),
        readers.read_filings(spark, _input(raw, "filings"), S.SYMBOL_RENAMES))
    clean = readers.read_panel(spark, f"{out}/clean").drop("year")
    vix = readers.read_volatility_index(spark, _input(raw, "volatility_index"))
    full = materialize(build.feature_panel(clean, vix, known))
    writers.write_result(cleaning.gate_report(full, extras=[
        f"top_tercile_{h}d" for h in S.HORIZONS]), f"{out}/gate_report")
    writers.write_features(cleaning.gate(full), f"{out}/features")
    writers.write_by_symbol(writers.narrowed(cleaning.gate(full)), f"{out}/by_symbol")


def refresh_panel(spark, raw: str, out: str) -> None:
    """The panel in `out`/refreshed: built once, then extended by the clean bars of later dates."""
    known = fund.point_in_time(
        readers.read_fundamentals(spark, _input(raw, "fundamentals"), S.SYMBOL_RENAMES),
        readers.read_filings(spark, _input(raw, "filings"), S.SYMBOL_RENAMES))
    clean = readers.read_panel(spark, f"{out}/clean")
    vix = readers.read_volatility_index(spark, _input(raw, "volatility_index"))
    have = refresh.covered(spark, f"{out}/refreshed")
    if have is None:
        refresh.start(f"{out}/refreshed", clean, vix, known)
    else:
        later = clean.where((F.col("year") >= have.year) & (F.col("date") > F.lit(have)))
        refresh.extend(f"{out}/refreshed", later, vix, known)


def prepare(spark, out: str, purge_days: int = splits.PURGE_ALL_HORIZONS,
            train_end=splits.TRAIN_END, val_end=splits.VAL_END) -> None:
    """Purged splits, scaler state and scaled split tables."""
    tagged = splits.purged_split(readers.read_panel(spark, f"{out}/features"),
                                 train_end, val_end, purge_days)
    train = tagged.where("split = 'train'")
    params = materialize(scaling.fit_parameters(train, S.FEATURE_COLS))
    writers.write_scaler(params, f"{out}/scaler")
    found = scaling.parameter_dict(params)
    scaled = tagged.withColumns({c: scaling.scale_expr(c, p) for c, p in found.items()})
    writers.write_splits(scaled, f"{out}/splits")


def regression(spark, out: str, zoo=None, train_end=splits.TRAIN_END, val_end=splits.VAL_END,
               purge_days: int = splits.PURGE_PRIMARY, feature_cols=S.FEATURE_COLS,
               version: str = "30d-reg-v1"):
    """Select, fit, evaluate and save the 30-row return model; returns the metrics."""
    target = S.PRIMARY_TARGET
    zoo = zoo or (lambda: models.regressors(spark))
    rows = readers.read_panel(spark, f"{out}/features",
                              ["date", "symbol", *feature_cols, target]).dropna()
    tagged = splits.purged_split(rows, train_end, val_end, purge_days)
    _integrity(spark, out, rows, tagged, purge_days, target)
    raw_train = tagged.where("split = 'train'")
    scaler = scaling.PanelScaler(inputCols=list(feature_cols)).fit(raw_train)
    assembler = VectorAssembler(inputCols=list(feature_cols), outputCol="features")
    data = materialize(models.labelled(assembler.transform(scaler.transform(tagged)), target)
                       .select("date", "symbol", "split", "features", "label"))
    train, val, test = (data.where(F.col("split") == s) for s in ("train", "val", "test"))
    choice = materialize(models.select_model(models.cross_validate(zoo, train)))
    best = choice.where("selected").first()["model"]
    fitted = models.fit_all(zoo(), train)
    table = models.evaluate_regressors(fitted, val, "validation").unionByName(
        models.evaluate_regressors(fitted, test, "test"))
    table = materialize(table)
    writers.write_result(choice, f"{out}/model_selection")
    writers.write_result(table, f"{out}/regression_metrics")
    span = rows.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"),
                    F.max("date").alias("b"), F.count_distinct("symbol").alias("s")).first()
    scores = {r["model"]: r.asDict() for r in table.where("split = 'test'").collect()}
    meta = {
        "version": version, "task": "regression", "best_model": best,
        "created_utc": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"),
        "target": {"name": target, "horizon_trading_days": S.PRIMARY_HORIZON,
                   "price_column": "adj_close"},
        "feature_cols": list(feature_cols),
        "training": {"train_end": train_end, "val_end": val_end, "purge_days": purge_days,
                     "dataset_rows": span["n"], "date_range": [str(span["a"]), str(span["b"])],
                     "n_symbols": span["s"], "best_model_fit_on": "train split only"},
        "test_metrics": scores[best], "baseline_test_metrics": scores["historical_mean"],
        "beats_baseline_on_test_RMSE": bool(scores[best]["beats_baseline"])}
    writers.save_model(PipelineModel([scaler, assembler, fitted[best]]), meta, f"{out}/model")
    return table


def _integrity(spark, out: str, rows, tagged, purge_days: int, target: str) -> None:
    """Nothing is fitted on splits that overlap or on targets that the bars don't bear out."""
    checks = audit.split_integrity(tagged, purge_days, target).first().asDict()
    clean = readers.read_panel(spark, f"{out}/clean", ["symbol", "date", "adj_close"])
    again = audit.target_audit(rows, clean, S.PRIMARY_HORIZON).first().asDict()
    # Stored targets are single precision.
    if not checks["passed"] or again["missing"] or (again["max_abs_diff"] or 0) >= 1e-5:
        raise ValueError(f"integrity checks failed: {checks}, {again}")


def _scaled_panel(spark, out: str, columns, feature_cols=S.FEATURE_COLS):
    """The stored feature panel with the stored scaler's feature vector."""
    panel = readers.read_panel(spark, f"{out}/features", ["date", "symbol", *feature_cols, *columns])
    found = scaling.parameter_dict(writers.read_scaler(spark, f"{out}/scaler"))
    return models.with_vector(panel.withColumns(
        {c: scaling.scale_expr(c, found[c]) for c in feature_cols}), feature_cols)


def matrix(spark, out: str, zoo_reg=None, zoo_clf=None) -> None:
    """Every target set, horizon and model on the stored splits."""
    train, test = (models.with_vector(writers.read_split(spark, f"{out}/splits", s)) for s in ("train", "test"))
    params = scaling.parameter_dict(writers.read_scaler(spark, f"{out}/scaler"))
    table = models.comparison_matrix(
        train, test, zoo_reg or (lambda: models.regressors(spark, models.FOREST, models.BOOST)),
        zoo_clf or (lambda: models.classifiers(spark)), params)
    writers.write_result(table, f"{out}/model_matrix")


def stacking(spark, out: str, bases=None, targets=("beats_median", "top_tercile"),
             horizons=S.HORIZONS, n_splits: int = models.STACK_FOLDS) -> None:
    """Base, blended and stacked accuracy for both targets at every horizon."""
    train, test = (models.with_vector(writers.read_split(spark, f"{out}/splits", s)) for s in ("train", "test"))
    bases = bases or (lambda: models.base_classifiers(spark))
    names = [f"p_{k}" for k in bases()]
    rows = None
    for t in targets:
        for h in horizons:
            scored, _ = models.stack(train, test, f"{t}_{h}d", h, bases, n_splits)
            report = models.stacking_report(materialize(scored), [*names, "p_blend", "p_stacked"])
            report = metrics.best_of(report, [n.replace("p_", "acc_", 1) for n in names], "acc_stacked").select(
                F.lit(t).alias("target"), F.lit(h).alias("horizon"), "*")
            rows = report if rows is None else rows.unionByName(report)
    writers.write_result(rows, f"{out}/stacking")


def evaluate(spark, out: str, horizon: int = S.PRIMARY_HORIZON, train_end=splits.TRAIN_END,
             val_end=splits.VAL_END, purge_days: int = splits.PURGE_ALL_HORIZONS, years=range(2017, 2027),
             start: str = "2021-01-01", step: int = backtest.REBALANCE_STEP,
             min_train: int = models.MIN_TRAIN_REBALANCE, min_names: int = backtest.TOP_K) -> None:
    """Three parts: a fixed split whose train rows aren't purged, yearly walk-forward folds,
    and a top-K book against the date median."""
    target, ret, rel = f"beats_median_{horizon}d", f"fwd_return_{horizon}d", f"rel_return_{horizon}d"
    data = materialize(_scaled_panel(spark, out, [target, ret, rel]).select(
        "date", "symbol", "features", target, ret, rel))
    tagged = splits.purged_split(data, train_end, val_end, purge_days, train_purge_days=0)
    train, test = (models.labelled(tagged.where(F.col("split") == s), target) for s in ("train", "test"))
    scored = models.positive_probability(models.Logit().fit(train), test, "p")
    scored = materialize(scored.withColumn("pred", (F.col("p") > 0.5).cast("double")))
    naive = models.MajorityClassifier().fit(train).value
    rate = scored.agg(F.avg((F.col("label") == naive).cast("double"))).first()[0]
    one = metrics.accuracy(scored, "label", "pred")
    for part in (metrics.confusion(scored, "label", "pred"), metrics.ranking_scores(scored, "label", "p").drop("n"),
                 metrics.binomial_test(scored, "label", "pred", rate).select("naive", "p_value")):
        one = with_row(one, part)
    writers.write_result(one, f"{out}/eval_fixed_split")
    writers.write_result(metrics.calibration(scored, "label", "p"), f"{out}/eval_calibration")
    folds = materialize(models.walk_forward_years(data, target, years, purge_days))
    writers.write_result(folds, f"{out}/eval_years")
    writers.write_result(metrics.fold_edge(folds), f"{out}/eval_years_edge")
    picks = models.walk_forward_scores(data, splits.rebalance_dates(data, start, step), target, ret,
                                       purge_days, min_names, min_train)
    picks = picks.join(data.select("date", "symbol", rel), ["date", "symbol"])
    book = materialize(backtest.top_k_returns(materialize(picks), ret, rel))
    writers.write_result(book, f"{out}/eval_top_k")
    writers.write_result(backtest.top_k_summary(book), f"{out}/eval_top_k_summary")
    writers.write_result(metrics.t_test(book, "excess"), f"{out}/eval_top_k_t_test")


def score(spark, out: str, symbols=None) -> None:
    """Both probabilities at every horizon for named symbols, or the first five."""
    labels = [f"{s}_{h}d" for h in S.HORIZONS for s in ("beats_median", "top_tercile")]
    panel = materialize(_scaled_panel(spark, out, ["close", *labels]))
    heads = models.fit_heads(panel)
    writers.write_result(serving.score_symbols(panel, heads, symbols), f"{out}/scores")


def portfolio_both(spark, out: str, **settings) -> None:
    """The backtest with the logistic and with the boosted classifier, side by side."""
    kinds = {"logit": models.Logit, "gradient_boosting": lambda: models.base_classifiers(spark)["gradient_boosting"]}
    for name, estimator in settings.pop("kinds", kinds).items():
        portfolio(spark, out, estimator=estimator, name=f"_{name}", **settings)


def portfolio(spark, out: str, horizon: int = 60, start: str = "2021-01-01",
              step: int = backtest.REBALANCE_STEP, estimator=models.Logit,
              purge_days: int = splits.PURGE_ALL_HORIZONS,
              min_train: int = models.MIN_TRAIN_REBALANCE, min_names: int = backtest.MIN_NAMES,
              feature_cols=S.FEATURE_COLS, name: str = ""):
    """Walk-forward long/short backtest on the stored panel and scaler."""
    target, ret = f"beats_median_{horizon}d", f"fwd_return_{horizon}d"
    scaled = _scaled_panel(spark, out, [target, ret], feature_cols)
    scores = models.walk_forward_scores(
        scaled, splits.rebalance_dates(scaled, start, step), target, ret, purge_days,
        min_names, min_train, estimator)
    periods = materialize(backtest.period_returns(materialize(scores), ret,
                                                  min_names=min_names))
    ppy = 252 / step
    writers.write_result(backtest.equity_curve(periods), f"{out}/portfolio_curve{name}")
    writers.write_result(backtest.performance_table(periods, ppy), f"{out}/portfolio_books{name}")
    summary = backtest.excess_summary(periods, ppy)
    writers.write_result(summary, f"{out}/portfolio_results{name}")
    return summary


def ic_report(spark, out: str, target: str = S.PRIMARY_TARGET) -> None:
    panel = readers.read_panel(spark, f"{out}/features", ["date", *S.FEATURE_COLS, target])
    ics = materialize(metrics.yearly_ic(panel, target, years=range(2017, 2027)))
    writers.write_result(ics, f"{out}/yearly_ic")
    writers.write_result(metrics.ic_stability(ics), f"{out}/ic_stability")


def main(argv=None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("job", choices=["ingest", "audit", "features", "refresh", "prepare", "regression", "portfolio", "ic",
                                   "matrix", "stacking", "evaluate", "score"])
    p.add_argument("--raw")
    p.add_argument("--out", required=True)
    p.add_argument("--symbols", nargs="*")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"barloom-{a.job}").getOrCreate()
    apply_settings(spark)
    jobs = {"ingest": lambda: ingest(spark, a.raw, a.out),
            "audit": lambda: audit_raw(spark, a.raw, a.out),
            "features": lambda: features(spark, a.raw, a.out),
            "refresh": lambda: refresh_panel(spark, a.raw, a.out),
            "prepare": lambda: prepare(spark, a.out),
            "regression": lambda: regression(spark, a.out),
            "portfolio": lambda: portfolio_both(spark, a.out), "ic": lambda: ic_report(spark, a.out),
            "matrix": lambda: matrix(spark, a.out), "stacking": lambda: stacking(spark, a.out),
            "evaluate": lambda: evaluate(spark, a.out), "score": lambda: score(spark, a.out, a.symbols)}
    with job_tables(spark):
        jobs[a.job]()


if __name__ == "__main__":
    main()
