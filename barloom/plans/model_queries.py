"""Registered queries that fit models or run the whole build on the sample tables.

Folds, horizons, target sets and calendars are the published ones. Tree ensembles alone are
smaller here: one boosting fit of the published size takes longer than all other queries
together on the sandbox. The zoo's defaults and the jobs hold the published settings.
"""

import datetime
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from barloom.operators import (
    backtest, cleaning, fundamentals as fund, labels, metrics, models, scaling, serving,
    splits)
from barloom.plans import build, refresh
from barloom.plans.queries import CORE, KEY, SPLIT, _features_panel, _statements, rounded
from barloom.schema import FEATURE_COLS, HORIZONS, LABEL_COLS
from barloom.session import checkpoint_dir, materialize
from barloom.sources import sample_tables as st
from barloom.streaming import live_quotes

FOREST = {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 50, "seed": 42}
#: The last date that `panel_refresh` builds at once.
REFRESHED_FROM = datetime.date(2001, 5, 31)
BOOST = {"maxIter": 5, "stepSize": 0.05, "maxDepth": 4, "seed": 42}


def feature_panel(spark, sf):
    """All 36 features and 40 labels, gated."""
    known = fund.point_in_time(_statements(spark, sf), st.filings(spark, sf))
    d = build.build(st.bars(spark, sf), st.master(spark, sf), st.index_series(spark, sf),
                    st.vix_series(spark, sf), st.actions(spark), known)
    return rounded(d.select(*KEY, "industry", *FEATURE_COLS, *LABEL_COLS))


def panel_refresh(spark, sf):
    """The same panel, built from the bars up to a date and extended by the later ones."""
    known = fund.point_in_time(_statements(spark, sf), st.filings(spark, sf))
    vix = materialize(st.vix_series(spark, sf))
    clean = materialize(cleaning.clean_panel(
        st.bars(spark, sf), st.master(spark, sf), st.index_series(spark, sf), st.actions(spark)))
    known, until = materialize(known), F.col("date") <= F.lit(REFRESHED_FROM)
    out = f"{checkpoint_dir(spark)}/panels/{uuid.uuid4().hex}"
    refresh.start(out, clean.where(until), vix, known)
    refresh.extend(out, clean.where(~until), vix, known)
    return rounded(refresh.panel(spark, out).select(*KEY, "industry", *FEATURE_COLS, *LABEL_COLS))


def _tagged(spark, sf):
    """Scaled, tagged modelling rows with the labels of all horizons."""
    hs = HORIZONS
    d = _features_panel(spark, sf)
    d = labels.add_forward_labels(d, hs)
    d = materialize(d.dropna(subset=[*CORE, "fwd_return_30d"]))
    d = labels.add_advanced_labels(labels.add_relative_labels(d, hs), hs)
    tagged = splits.purged_split(d, **SPLIT)
    scaler = scaling.PanelScaler(inputCols=CORE).fit(
        splits.purged_split(_train_view(d), **SPLIT).where("split = 'train'"))
    named = tagged.withColumns({f"raw_{c}": F.col(c) for c in ("roc_20", "volatility_20")})
    data = materialize(models.with_vector(scaler.transform(named), CORE))
    return data, scaler


def _train_view(d):
    return d.select("date", *CORE)


def _zoo(spark):
    return lambda: models.regressors(spark, FOREST, BOOST)


def _clf(spark):
    return lambda: models.classifiers(spark, FOREST, BOOST)


def _parts(data, target="fwd_return_30d"):
    d = models.labelled(data, target)
    return d.where("split = 'train'"), d.where("split = 'test'")


def _one_regressor(name):
    def run(spark, sf):
        data, _ = _tagged(spark, sf)
        train, test = _parts(data)
        zoo = {k: v for k, v in _zoo(spark)().items() if k in ("historical_mean", name)}
        return models.evaluate_regressors(
            models.fit_all(zoo, train.select("features", "label")), test, "test")
    return run


def mean_eval(spark, sf):
    data, _ = _tagged(spark, sf)
    train, test = _parts(data)
    pred = models.predicted(models.MeanRegressor().fit(train), test)
    return rounded(metrics.regression_summary(pred, "label", "pred", rank=False).select(
        "n", "mae", "rmse", "r2", "pearson", "dir_acc", "median_ae", "actual_std"))


def majority_eval(spark, sf):
    data, _ = _tagged(spark, sf)
    train, test = _parts(data, "beats_median_30d")
    m = models.MajorityClassifier().fit(train)
    return rounded(metrics.accuracy(models.predicted(m, test), "label", "pred"))


def momentum_eval(spark, sf):
    """The 20-row trailing return, mapped back from scaled units, as the forecast."""
    data, scaler = _tagged(spark, sf)
    _, test = _parts(data)
    pred = models.momentum_forecast(test, scaler.parameters(), 30)
    return rounded(metrics.regression_summary(pred, "label", "pred").select(
        "n", "mae", "rmse", "pearson", "spearman", "dir_acc"))


def logit_eval(spark, sf):
    data, _ = _tagged(spark, sf)
    train, test = _parts(data, "beats_median_30d")
    zoo = {k: v for k, v in _clf(spark)().items() if k in ("majority", "logit")}
    return models.evaluate_classifiers(models.fit_all(zoo, train.select("features", "label")),
                                       test)


def model_matrix(spark, sf):
    """Every model of the zoo on every target set and horizon."""
    data, scaler = _tagged(spark, sf)
    train, test = (data.where(F.col("split") == s) for s in ("train", "test"))
    return models.comparison_matrix(train, test, _zoo(spark), _clf(spark), scaler.parameters())


def result_pivot(spark, sf):
    acc = model_matrix(spark, sf).where("task = 'classification'")
    return metrics.result_pivot(acc, ["majority", "logit", "random_forest", "gradient_boosting"])


def stacking(spark, sf):
    data, _ = _tagged(spark, sf)
    train, test = (data.where(F.col("split") == s) for s in ("train", "test"))

    def bases():
        return models.base_classifiers(spark, FOREST, BOOST)

    scored, _ = models.stack(train, test, "beats_median_30d", 30, bases)
    cols = ["p_logit", "p_random_forest", "p_gradient_boosting", "p_blend", "p_stacked"]
    out = models.stacking_report(scored, cols)
    return metrics.best_of(out, ["acc_logit", "acc_random_forest", "acc_gradient_boosting"],
                           "acc_stacked")


def walk_forward(spark, sf):
    data, _ = _tagged(spark, sf)
    first, last = data.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    return models.walk_forward_years(data, "beats_median_30d", range(first, last + 1), 150)


def walk_forward_edge(spark, sf):
    return metrics.fold_edge(walk_forward(spark, sf))


def model_selection(spark, sf):
    data, _ = _tagged(spark, sf)
    train, _ = _parts(data)
    return models.select_model(models.cross_validate(_zoo(spark), train, gap_days=30))


def walk_forward_backtest(spark, sf):
    data, _ = _tagged(spark, sf)
    dates = splits.rebalance_dates(data)
    scores = materialize(models.walk_forward_scores(
        data, dates, "beats_median_30d", "fwd_return_30d", 150, 5))
    return backtest.excess_summary(
        backtest.period_returns(scores, "fwd_return_30d", min_names=5))


def _served(spark, sf):
    data, _ = _tagged(spark, sf)
    panel = data.withColumns({"symbol": F.upper("symbol"),
                              "volatility_20": F.col("raw_volatility_20")})
    return panel, models.fit_heads(data)


def top_predictions(spark, sf):
    return serving.top_predictions(*_served(spark, sf), 30, 10)


def prediction(spark, sf):
    panel, heads = _served(spark, sf)
    return serving.prediction(panel, heads, "brand7", 7)


def score_symbols(spark, sf):
    return serving.score_symbols(*_served(spark, sf))


def return_forecast(spark, sf):
    data, scaler = _tagged(spark, sf)
    train, _ = _parts(data)
    model = PipelineModel([scaler, VectorAssembler(inputCols=CORE, outputCol="features"),
                           models.Ridge().fit(train)])
    panel = _features_panel(spark, sf).dropna(subset=CORE).withColumn(
        "symbol", F.upper("symbol"))
    return serving.return_forecast(panel, model, "brand7", "2000-01-15")


def ensemble_mean(spark, sf):
    """Mean of three trailing-return forecasts per row."""
    d = _features_panel(spark, sf).dropna(subset=CORE)
    items = F.array(*[F.struct(F.lit(c).alias("member"), F.col(c).alias("pred"))
                      for c in ("roc_5", "roc_20", "log_return")])
    long = d.select(*KEY, F.explode(items).alias("_i")).select(*KEY, "_i.member", "_i.pred")
    return rounded(models.ensemble_mean(long, KEY))


def quote_stream(spark, sf):
    """The live overlay run as a stream over the quote events."""
    shape = st.table(spark, sf, "events").schema
    raw = spark.readStream.schema(shape).format("parquet").load(f"{sf}/events*.parquet")
    stream = raw.select(F.col("user_id").cast("string").alias("symbol"), "ts",
                        F.col("value").alias("ltp"))
    base = f"{checkpoint_dir(spark)}/streams/{spark.sparkContext.applicationId}-{id(stream)}"
    live_quotes.newest_quotes(stream, f"{base}/out", f"{base}/state", 6 * 3600).awaitTermination()
    return live_quotes.read_live(spark, f"{base}/out", st.quoted_accounts(spark, sf), 6 * 3600).select(
        "symbol", "last_close", "is_live")


MODEL_QUERIES = {f.__name__: f for f in (
    feature_panel, panel_refresh, mean_eval, majority_eval, momentum_eval, logit_eval, model_matrix,
    result_pivot, stacking, walk_forward, walk_forward_edge, model_selection,
    walk_forward_backtest, top_predictions, prediction, score_symbols, return_forecast,
    ensemble_mean, quote_stream)}
MODEL_QUERIES.update({
    "ridge_eval": _one_regressor("ridge"), "forest_eval": _one_regressor("random_forest"),
    "boosting_eval": _one_regressor("gradient_boosting")})
