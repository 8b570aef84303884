"""Model parity with closed forms, folds without leakage, selection, artifacts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from barloom.operators import metrics, models, scaling, serving, splits
from barloom.sources import writers


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 3))
    y = x @ [0.5, -1.0, 0.2] + rng.normal(size=600)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["y"], pdf["up"] = y, (y > 0).astype(float)
    pdf["date"] = [pd.Timestamp("2015-01-01").date() + pd.Timedelta(days=5 * (i // 4))
                   for i in range(600)]
    pdf["symbol"] = [f"S{i % 4}" for i in range(600)]
    return pdf


@pytest.fixture(scope="module")
def vec(spark, data):
    return models.with_vector(spark.createDataFrame(data), ["a", "b", "c"]).persist()


def test_ridge_closed_form(vec, data):
    m = models.Ridge(10.0).fit(models.labelled(vec, "y"))
    x = data[["a", "b", "c"]].to_numpy()
    xc, yc = x - x.mean(0), data.y - data.y.mean()
    w = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-10)
    assert m.intercept == pytest.approx(data.y.mean() - x.mean(0) @ w, abs=1e-10)


def test_logistic_penalty(vec, data):
    m = models.Logit(0.1).fit(models.labelled(vec, "up"))
    x = np.column_stack([data[["a", "b", "c"]].to_numpy(), np.ones(600)])
    w, pen = np.zeros(4), np.diag([1, 1, 1, 0]) / 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        h = x.T @ (x * (p * (1 - p))[:, None]) + pen
        w -= np.linalg.solve(h, x.T @ (p - data.up) + pen @ w)
    assert np.allclose(m.coefficients.toArray(), w[:3], atol=1e-5)
    assert m.intercept == pytest.approx(w[3], abs=1e-5)


def test_folds_never_fit_on_or_near_validation(spark, vec):
    f = splits.time_folds(vec, 4, 10).toPandas()
    order = {d: i for i, d in enumerate(sorted(f.date.unique()))}
    for _, g in f.groupby("fold"):
        fit, val = (g[g.role == r].date.map(order) for r in ("fit", "validate"))
        assert fit.max() + 10 < val.min() and len(val) == 30


def test_stacking_scores_every_test_row(spark, vec):
    cut = F.lit("2016-06-01").cast("date")
    train, test = vec.where(F.col("date") < cut), vec.where(F.col("date") >= cut)

    def bases():
        return {"logit": models.Logit(), "strong": models.Logit(10.0)}

    scored, meta = models.stack(train, test, "up", 3, bases, n_splits=3)
    r = models.stacking_report(scored, ["p_logit", "p_blend", "p_stacked"]).first()
    assert r["n_test"] == test.count() and r["acc_stacked"] > 0.7
    assert meta.coefficients.size == 2


def test_selection_prefers_the_steady_near_tie(spark):
    rows = [("sharp", 1, 0.8, 1.0), ("sharp", 2, 1.2, 1.0), ("steady", 1, 1.05, 1.0),
            ("steady", 2, 1.05, 1.0), ("bad", 1, 3.0, 1.0), ("bad", 2, 3.0, 1.0)]
    d = spark.createDataFrame(rows, "model string, fold int, rmse double, base_rmse double")
    got = {r["model"]: r["selected"] for r in models.select_model(d).collect()}
    assert got == {"sharp": False, "steady": True, "bad": False}


def test_regression_table_beats_flag(vec):
    train = models.labelled(vec, "y")
    zoo = {"historical_mean": models.MeanRegressor(), "ridge": models.Ridge()}
    out = models.evaluate_regressors({k: e.fit(train) for k, e in zoo.items()}, train, "train")
    rows = {r["model"]: r for r in out.collect()}
    assert rows["ridge"]["beats_baseline"] and not rows["historical_mean"]["beats_baseline"]
    assert rows["historical_mean"]["pearson"] == 0.0
    assert rows["historical_mean"]["spearman"] == 0.0
    assert rows["ridge"]["rmse_vs_baseline_pct"] < -20


def test_walk_forward_scores_are_out_of_sample(spark, vec):
    dates = splits.rebalance_dates(vec, "2016-06-01", 30)
    out = models.walk_forward_scores(vec, dates, "up", "y", 20, min_names=2, min_train=50)
    assert out.count() == 4 * dates.count()
    none = models.walk_forward_scores(vec, dates, "up", "y", 20, min_names=2, min_train=10 ** 6)
    assert none.count() == 0


def test_artifact_round_trip(spark, data, tmp_path):
    d = spark.createDataFrame(data).withColumn("close", F.lit(100.0))
    scaler = scaling.PanelScaler(inputCols=["a", "b", "c"], log1pCols=["c"]).fit(d)
    asm = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    m = models.Ridge().fit(models.labelled(asm.transform(scaler.transform(d)), "y"))
    writers.save_model(PipelineModel([scaler, asm, m]), {"version": "v1"}, str(tmp_path))
    loaded, meta = writers.load_model(spark, str(tmp_path))
    assert meta == {"version": "v1"}
    got = serving.return_forecast(d, loaded, "s1", "2016-01-01").first()
    want = PipelineModel([scaler, asm, m]).transform(
        d.where("symbol = 'S1' and date <= '2016-01-01'").orderBy(F.desc("date")).limit(1)).first()
    assert got["expected_return_30d"] == pytest.approx(want["prediction"], abs=1e-4)
    assert serving.return_forecast(d, loaded, "nope").count() == 0


def test_binomial_and_t_frames(spark):
    d = spark.createDataFrame([(1.0, 1.0)] * 60 + [(1.0, 0.0)] * 40, "y double, p double")
    r = metrics.binomial_test(d, "y", "p", 0.5).first()
    assert (r["correct"], r["n"]) == (60, 100) and r["p_value"] == pytest.approx(0.0284439668)


def test_served_predictions(spark, vec):
    panel = vec.withColumns({"symbol": F.upper("symbol"), "industry": F.lit("X"),
                             "close": F.lit(10.0), "volatility_20": F.abs(F.col("a")),
                             **{f"{s}_7d": F.col("up") for s in ("beats_median", "top_tercile")}})
    heads = models.fit_heads(panel, [7])
    top = serving.top_predictions(panel, heads, 7, 3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3]
    probs = [r["probability_beats_median"] for r in top]
    assert probs == sorted(probs, reverse=True) and top[0]["historical_accuracy"] == 0.502
    one = serving.prediction(panel, heads, "s2", 7).first()
    assert one["symbol"] == "S2" and one["risk_level"] in ("High", "Low", "Medium")
    assert serving.score_symbols(panel, heads, ["S1"]).count() == 1
