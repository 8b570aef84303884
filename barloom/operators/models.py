"""Model zoo, stacking, walk-forward fits and model selection on Spark ML."""

import itertools
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.metrics import accuracy, regression_summary, versus_baseline
from barloom.operators.scaling import unscale_expr
from barloom.operators.splits import time_folds, yearly_window
from barloom.schema import FEATURE_COLS, HORIZONS
from barloom.session import checkpoint_dir, materialize

# --- fixed values: hyper-parameters of the compared models ---
RIDGE_ALPHA = 10.0
LOGIT_C, META_C = 0.1, 1.0
LOGIT_ITER = 2000
FOREST = {"numTrees": 200, "maxDepth": 6, "minInstancesPerNode": 50, "seed": 42}
FOREST_PRIMARY = {"numTrees": 300, "maxDepth": 8, "minInstancesPerNode": 50, "seed": 42}
BOOST = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "seed": 42}
BOOST_PRIMARY = {"maxIter": 400, "stepSize": 0.05, "maxDepth": 6, "seed": 42}
STACK_FOLDS, SELECTION_FOLDS = 5, 4
MIN_TRAIN_YEAR, MIN_TEST_YEAR = 1000, 100
MIN_TRAIN_REBALANCE = 5000
#: Model fits that run side by side; each keeps its own train rows in memory or on disk.
FITS_AT_ONCE = 8
#: Train rows a task of a fit has at least: every iteration is a job, and small ones cost their start.
ROWS_PER_TASK = 50_000
# (tag, regression target, classification target, boundary of "up")
TARGET_SETS = [
    ("raw", "fwd_return_{h}d", "beats_median_{h}d", 0.0),
    ("vol_adj", "fwd_return_vol_adj_{h}d", "top_tercile_{h}d", 0.0),
    ("rank", "fwd_return_rank_{h}d", "beats_sector_median_{h}d", 0.5),
]
# --- end of fixed values ---


def with_vector(df: DataFrame, features=FEATURE_COLS, out: str = "features") -> DataFrame:
    """Feature vector of the (scaled) columns, NULL where one is missing.

    Rows without a vector are never fitted on (`labelled`) and score NULL.
    """
    features = list(features)
    whole = reduce(lambda a, c: a & F.col(c).isNotNull(), features, F.lit(True))
    made = VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)
    return made.withColumn(out, F.when(whole, F.col(out)))


def labelled(df: DataFrame, target: str) -> DataFrame:
    """Rows to fit on or to judge by: target and feature vector are there."""
    there = F.col(target).isNotNull()
    if "features" in df.columns:
        there = there & F.col("features").isNotNull()
    return df.where(there).withColumn("label", F.col(target).cast("double"))


def _scored(model, df: DataFrame, value, out: str) -> DataFrame:
    """`df` with `out` = value(of the model's output); NULL for rows without a vector."""
    if isinstance(model, _Constant):
        return value(model.transform(df)).select(*df.columns, out)
    vector = model.getFeaturesCol() if hasattr(model, "getFeaturesCol") else "features"
    done = value(model.transform(df.where(F.col(vector).isNotNull()))).select(*df.columns, out)
    rest = df.where(F.col(vector).isNull()).withColumn(out, F.lit(None).cast("double"))
    return done.unionByName(rest)


def side_by_side(spark, calls, most: int = FITS_AT_ONCE) -> list:
    """Results of the calls (without arguments), in order; `most` of them run at a time.

    A fit is a chain of small jobs, each waiting for the last; several chains fill the cluster.
    Every call has a scheduler pool of its own, so a fair scheduler shares between them. The
    first error ends the run.
    """
    sc, pools = spark.sparkContext, itertools.count()

    def run(call):
        sc.setLocalProperty("spark.scheduler.pool", f"fit-{next(pools) % most}")
        try:
            return call()
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(most) as threads:
        return list(threads.map(inheritable_thread_target(spark)(run), list(calls)))


def fitted(estimator, train: DataFrame, n: int = None):
    """The estimator's model, fitted on tasks of `ROWS_PER_TASK` rows or more.

    `n` is the number of train rows; it is counted if not given. Partitions are only put
    together, never shuffled, so large train sets stay as they are.
    """
    n = train.count() if n is None else n
    train = train.coalesce(-(-max(n, 1) // ROWS_PER_TASK))
    return estimator.fit(train, n) if isinstance(estimator, (Ridge, Logit)) else estimator.fit(train)


class MeanRegressor:
    """Predicts the train mean."""

    def fit(self, train: DataFrame):
        return _Constant(train.agg(F.avg("label")).first()[0])


class MajorityClassifier:
    """Predicts the more frequent train class."""

    def fit(self, train: DataFrame):
        share = train.agg(F.avg("label")).first()[0]
        return _Constant(float(share > 0.5), probability=share)


class _Constant:
    def __init__(self, value: float, probability=None):
        self.value, self.prob = value, probability

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"prediction": F.lit(self.value),
                               "p": F.lit(self.value if self.prob is None else self.prob)})


class Ridge:
    """Least squares with penalty alpha * |w|^2, intercept unpenalised."""

    def __init__(self, alpha: float = RIDGE_ALPHA):
        self.alpha = alpha

    def fit(self, train: DataFrame, n: int = None):
        # The solver divides the loss by n and scales the penalty by the label's std.
        n, std = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
        return LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0,
                                regParam=self.alpha / n * std).fit(train)


class Logit:
    """L2 logistic regression; C is the inverse penalty on the summed loss."""

    def __init__(self, c: float = LOGIT_C, features: str = "features"):
        self.c, self.features = c, features

    def fit(self, train: DataFrame, n: int = None):
        n = train.count() if n is None else n
        return LogisticRegression(
            featuresCol=self.features, regParam=1.0 / (self.c * n), elasticNetParam=0.0,
            standardization=False, maxIter=LOGIT_ITER, tol=1e-7).fit(train)


def _boost(cls, spark, params):
    checkpoint_dir(spark)
    return cls(checkpointInterval=10, **params)


def regressors(spark, forest=FOREST_PRIMARY, boost=BOOST_PRIMARY) -> dict:
    return {"historical_mean": MeanRegressor(), "ridge": Ridge(),
            "random_forest": RandomForestRegressor(**forest),
            "gradient_boosting": _boost(GBTRegressor, spark, boost)}


def classifiers(spark, forest=FOREST, boost=BOOST) -> dict:
    return {"majority": MajorityClassifier(), "logit": Logit(),
            "random_forest": RandomForestClassifier(**forest),
            "gradient_boosting": _boost(GBTClassifier, spark, boost)}


def base_classifiers(spark, forest=FOREST, boost=BOOST) -> dict:
    zoo = classifiers(spark, forest, boost)
    return {k: zoo[k] for k in ("logit", "random_forest", "gradient_boosting")}


def positive_probability(model, df: DataFrame, out: str = "p") -> DataFrame:
    """Adds P(label = 1), NULL without a feature vector, and drops the model's own columns."""
    p = F.col("p") if isinstance(model, _Constant) else vector_to_array("probability")[1]
    return _scored(model, df, lambda s: s.withColumn(out, p), out)


def predicted(model, df: DataFrame, out: str = "pred") -> DataFrame:
    return _scored(model, df, lambda s: s.withColumn(out, F.col("prediction")), out)


def momentum_forecast(df: DataFrame, params: dict, horizon: int) -> DataFrame:
    """Trailing return in natural units as the forecast: the window equal to the
    horizon where one exists, 20 rows otherwise."""
    col = f"roc_{horizon}" if f"roc_{horizon}" in df.columns else "roc_20"
    return df.withColumn("pred", unscale_expr(col, params[col]))


def fit_all(zoo: dict, train: DataFrame) -> dict:
    """Every estimator of the zoo on a stored train set, side by side."""
    found = side_by_side(train.sparkSession, [lambda e=e: fitted(e, train) for e in zoo.values()])
    return dict(zip(zoo, found))


def evaluate_regressors(models: dict, df: DataFrame, split: str, boundary: float = 0.0,
                        baseline: str = "historical_mean") -> DataFrame:
    """One metrics row per model, with its RMSE against the baseline's."""
    long = reduce(DataFrame.unionByName, [
        predicted(m, df.select("features", "label")).select(
            F.lit(name).alias("model"), "label", "pred") for name, m in models.items()])
    out = regression_summary(materialize(long), "label", "pred", ["model"], boundary)
    out = out.withColumn("split", F.lit(split))
    return versus_baseline(out, baseline) if baseline in models else out


def evaluate_classifiers(models: dict, df: DataFrame) -> DataFrame:
    long = reduce(DataFrame.unionByName, [
        positive_probability(m, df.select("features", "label")).select(
            F.lit(name).alias("model"), "label",
            (F.col("p") > 0.5).cast("double").alias("pred")) for name, m in models.items()])
    return accuracy(long, "label", "pred", ["model"])


def comparison_matrix(train: DataFrame, test: DataFrame, zoo_reg, zoo_clf, params=None,
                      target_sets=TARGET_SETS, horizons=HORIZONS) -> DataFrame:
    """Long table (target_set, horizon, task, model, metrics) over target families.

    `zoo_reg` and `zoo_clf` build fresh estimator dicts. Features and targets of both sides are
    stored once; the fits of all targets and models run side by side on them.
    """
    spark = train.sparkSession
    picked = [("regression", tag, h, reg.format(h=h), up) for tag, reg, _, up in target_sets for h in horizons]
    picked += [("classification", tag, h, clf.format(h=h), None) for tag, _, clf, _ in target_sets for h in horizons]
    targets = list(dict.fromkeys(y for *_, y, _ in picked))
    naive_cols = [c for c in (params or {}) if c.startswith("roc_") and c in test.columns]
    tr = materialize(train.select("features", *targets))
    te = materialize(test.select("features", *naive_cols, *targets))
    wanted = []
    for task, tag, h, y, up in picked:
        rows = labelled(tr, y).select("features", "label")
        zoo = zoo_reg() if task == "regression" else zoo_clf()
        wanted += [((task, tag, h, y, up), name, lambda e=e, rows=rows: fitted(e, rows)) for name, e in zoo.items()]
    models = side_by_side(spark, [call for *_, call in wanted])
    by_target: dict = {}
    for (target, name, _), model in zip(wanted, models):
        by_target.setdefault(target, {})[name] = model
    keep = ["model", "mae", "spearman", "dir_acc"]

    def judged(target, zoo):
        task, tag, h, y, up = target
        rows = labelled(te, y)
        if task == "regression":
            got = evaluate_regressors(zoo, rows, "test", up).select(*keep)
            if params and tag == "raw":
                naive = momentum_forecast(rows, params, h)
                got = got.unionByName(regression_summary(naive, "label", "pred", boundary=up).select(
                    F.lit("naive_momentum").alias("model"), *keep[1:]))
            got = got.withColumn("accuracy", F.lit(None).cast("double"))
        else:
            none = [F.lit(None).cast("double").alias(k) for k in keep[1:]]
            got = evaluate_classifiers(zoo, rows).select("model", *none, "accuracy")
        return materialize(got.select(F.lit(tag).alias("target_set"), F.lit(h).alias("horizon"),
                                      F.lit(task).alias("task"), *keep, "accuracy"))

    parts = side_by_side(spark, [lambda t=t, z=z: judged(t, z) for t, z in by_target.items()])
    return reduce(DataFrame.unionByName, parts)


def fold_bounds(folds: DataFrame) -> list:
    """[(fold, first fit date, last fit date, first and last validation date)] of date folds.

    A fold's dates are unbroken stretches of the calendar, so four dates say which rows it has.
    """
    ends = folds.groupBy("fold", "role").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    found: dict = {}
    for r in ends.collect():  # two rows per fold
        found.setdefault(r["fold"], {})[r["role"]] = (r["a"], r["b"])
    return [(k, *d["fit"], *d["validate"]) for k, d in sorted(found.items()) if len(d) == 2]


def _fold_rows(data: DataFrame, bounds):
    """(fold, rows to fit on, rows to validate on) by date ranges of one stored table."""
    for k, a, b, c, d in bounds:
        yield k, data.where(F.col("date").between(a, b)), data.where(F.col("date").between(c, d))


def out_of_fold(bases, data: DataFrame, bounds) -> DataFrame:
    """Base probabilities of rows in some validation block; the rest never appear.

    `data` is a stored table and `bounds` what `fold_bounds` gives: blocks of dates with a gap
    counted in dates, so every name of a day falls on the same side. The bases of all folds are
    fitted side by side.
    """
    folds = list(_fold_rows(data, bounds))
    names = list(bases())
    models = iter(side_by_side(data.sparkSession, [
        lambda e=e, rows=rows: fitted(e, rows.select("features", "label"))
        for _, rows, _ in folds for e in bases().values()]))
    parts = []
    for _, _, rows in folds:
        scored = rows.select("date", "symbol", "features", "label")
        for name in names:
            scored = positive_probability(next(models), scored, f"p_{name}")
        parts.append(scored)
    return reduce(DataFrame.unionByName, parts)


def blend(cols):
    return sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)


def stack(train: DataFrame, test: DataFrame, target: str, horizon: int, bases,
          n_splits: int = STACK_FOLDS):
    """Test rows with the base, blended and stacked probabilities, and the meta model.

    `bases` builds the base estimators; `train`/`test` carry date, symbol, features.
    """
    keep = ["date", "symbol", "features", "label"]
    tr = materialize(labelled(train, target).select(*keep))
    te = labelled(test, target).select(*keep)
    cols = [f"p_{k}" for k in bases()]
    oof = out_of_fold(bases, tr, fold_bounds(time_folds(tr, n_splits, horizon)))
    meta_in = with_vector(oof.drop("features"), cols, "meta").where("meta is not null")
    meta = fitted(Logit(META_C, "meta"), materialize(meta_in.select("meta", "label")))
    for name, model in fit_all(bases(), tr).items():
        te = positive_probability(model, te, f"p_{name}")
    te = te.withColumn("p_blend", blend(cols))
    te = positive_probability(meta, with_vector(te, cols, "meta"), "p_stacked").drop("meta")
    return te, meta


def stacking_report(scored: DataFrame, cols) -> DataFrame:
    """n, base rate and the accuracy of each probability column."""
    y = F.col("label")
    return scored.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.greatest(F.avg("label"), 1 - F.avg("label")).alias("base_rate"),
        *[F.avg(((F.col(c) > 0.5).cast("double") == y).cast("double"))
          .alias(c.replace("p_", "acc_", 1)) for c in cols])


def fit_heads(df: DataFrame, horizons=HORIZONS, c: float = LOGIT_C) -> dict:
    """{horizon: (median head, tercile head)} on one stored vector column, side by side."""
    labels = [f"{s}_{h}d" for h in horizons for s in ("beats_median", "top_tercile")]
    data = materialize(df.select("features", *labels))

    heads = side_by_side(df.sparkSession, [
        lambda y=y: fitted(Logit(c), labelled(data, y).select("features", "label")) for y in labels])
    return {h: (heads[2 * i], heads[2 * i + 1]) for i, h in enumerate(horizons)}


def walk_forward_years(df: DataFrame, target: str, years, purge_days: int,
                       min_train: int = MIN_TRAIN_YEAR, min_test: int = MIN_TEST_YEAR,
                       estimator=Logit) -> DataFrame:
    """Yearly expanding-window folds: n_test, accuracy and the naive rate.

    `df` carries date, features and the target. Years with too few rows are left out. One pass
    counts the train rows of all years; the years are fitted and judged side by side.
    """
    data, spark = materialize(df.select("date", "features", target)), df.sparkSession
    there = F.col(target).isNotNull() & F.col("features").isNotNull()
    counts = _counted(data, [(
        F.col("date") <= F.date_sub(F.lit(f"{y}-01-01").cast("date"), purge_days), F.year("date") == y)
        for y in years], lambda train, test: [
            F.count_if(train), F.count_if(test), F.count_if(train & there),
            F.avg(F.when(train & there, F.col(target).cast("double")))])

    def judged(year, n, naive):
        train, test = (labelled(d, target) for d in yearly_window(data, year, purge_days))
        model = fitted(estimator(), train.select("features", "label"), n)
        right = (F.col("p") > 0.5).cast("double") == F.col("label")
        return positive_probability(model, test.select("features", "label")).agg(
            F.lit(year).alias("year"), F.count(F.lit(1)).alias("n_test"),
            F.avg(right.cast("double")).alias("accuracy"),
            F.avg((F.col("label") == naive).cast("double")).alias("naive")).first()

    rows = side_by_side(spark, [
        lambda y=y, n=n, share=share: judged(y, n, float(share > 0.5))
        for y, (n_train, n_test, n, share) in zip(years, counts)
        if n_train >= min_train and n_test >= min_test])
    return spark.createDataFrame(rows, "year int, n_test bigint, accuracy double, naive double")


def _counted(data: DataFrame, ranges, aggregates) -> list:
    """The aggregates of every range in one pass: a few numbers a range."""
    parts = [aggregates(*r) for r in ranges]
    if not parts:
        return []
    row = list(data.agg(*[a.alias(f"c{i}") for i, a in enumerate(itertools.chain(*parts))]).first())
    width = len(parts[0])
    return [row[i:i + width] for i in range(0, len(row), width)]


def walk_forward_scores(df: DataFrame, dates, target: str, ret: str, purge_days: int,
                        min_names: int = 30, min_train: int = MIN_TRAIN_REBALANCE,
                        estimator=Logit) -> DataFrame:
    """Out-of-sample scores of each rebalance date: date, symbol, score, return.

    `dates` is the rebalance calendar (a short list); the model is refitted on rows
    at least `purge_days` older than each date, all dates side by side.
    """
    data = materialize(df.select("date", "symbol", "features", target, ret))
    days = [r["date"] for r in dates.select("date").orderBy("date").toLocalIterator()]
    has, whole = F.col(target).isNotNull(), F.col("features").isNotNull()
    counts = _counted(data, [(F.col("date") <= F.date_sub(F.lit(d), purge_days), F.col("date") == F.lit(d))
                             for d in days], lambda train, test: [
        F.count_if(train & has), F.count_if(test & has & F.col(ret).isNotNull()), F.count_if(train & has & whole)])

    def model(day, n):
        train = labelled(data.where(F.col("date") <= F.date_sub(F.lit(day), purge_days)), target)
        return day, fitted(estimator(), train.select("features", "label"), n)

    models = side_by_side(df.sparkSession, [
        lambda d=d, n=n: model(d, n) for d, (n_train, n_test, n) in zip(days, counts)
        if n_train >= min_train and n_test >= min_names])
    if not models:
        return data.limit(0).select("date", "symbol", F.lit(0.0).alias("score"), ret)
    return reduce(DataFrame.unionByName, [
        positive_probability(m, data.where((F.col("date") == F.lit(d)) & has & F.col(ret).isNotNull()), "score")
        .select("date", "symbol", "score", ret) for d, m in models])


def cross_validate(zoo, train: DataFrame, n_splits: int = SELECTION_FOLDS,
                   gap_days: int = 0) -> DataFrame:
    """(model, fold, rmse, base_rmse) over expanding date folds.

    Train rows are stored once; folds are date ranges of them, fitted and judged side by side.
    """
    data, spark = materialize(train.select("date", "features", "label")), train.sparkSession
    bounds = fold_bounds(time_folds(data, n_splits, gap_days))
    means = _counted(data, [(F.col("date").between(a, b),) for _, a, b, *_ in bounds],
                     lambda fit: [F.avg(F.when(fit, F.col("label")))])

    def judged(name, est, fold, fit_rows, val, mean):
        err, base = F.col("pred") - F.col("label"), F.lit(mean) - F.col("label")
        return predicted(fitted(est, fit_rows.select("features", "label")), val.select("features", "label")).agg(
            F.lit(name).alias("model"), F.lit(fold).alias("fold"), F.sqrt(F.avg(err * err)).alias("rmse"),
            F.sqrt(F.avg(base * base)).alias("base_rmse")).first()

    rows = side_by_side(spark, [
        lambda a=(name, est, k, fit_rows, val, mean): judged(*a)
        for (k, fit_rows, val), (mean,) in zip(_fold_rows(data, bounds), means)
        for name, est in zoo().items() if not isinstance(est, MeanRegressor)])
    return spark.createDataFrame(rows, "model string, fold int, rmse double, base_rmse double")


def select_model(folds: DataFrame) -> DataFrame:
    """Per-model CV summary with the chosen one flagged.

    Among models within one fold deviation of the best mean RMSE, the steadiest wins.
    """
    summary = folds.groupBy("model").agg(
        F.avg("rmse").alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std"),
        ((F.avg("rmse") / F.avg("base_rmse") - 1) * 100).alias("cv_rmse_vs_baseline_pct"))
    # One row per model of the zoo.
    best = Window.partitionBy(F.lit(1)).orderBy("cv_rmse_mean", "model")
    limit = F.first("cv_rmse_mean").over(best) + F.first("cv_rmse_std").over(best)
    near = summary.withColumn("_near", F.col("cv_rmse_mean") <= limit)
    steady = Window.partitionBy("_near").orderBy("cv_rmse_std", "cv_rmse_mean", "model")
    return near.withColumn(
        "selected", F.col("_near") & (F.row_number().over(steady) == 1)).drop("_near")


def ensemble_mean(members: DataFrame, keys, col: str = "pred") -> DataFrame:
    """Mean forecast per row over a long table with a `member` column."""
    return members.groupBy(*keys).agg(F.avg(col).alias(col),
                                      F.count_distinct("member").alias("members"))
