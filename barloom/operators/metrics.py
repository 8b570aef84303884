"""Evaluation of forecasts and scores. Every metric is a DataFrame."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.pvalues import binomial_pvalue, t_test_pvalue
from barloom.operators.cross_section import with_row
from barloom.operators.order_stats import (
    prefix_sums, quantiles, rank_correlation, spearman, tie_table, with_rank)
from barloom.schema import FEATURE_COLS
from barloom.session import materialize


def mean_of(cond):
    return F.avg(cond.cast("double"))


def regression_summary(df: DataFrame, y: str, p: str, keys=(), boundary: float = 0.0,
                       rank: bool = True) -> DataFrame:
    """MAE, RMSE, R2, MedianAE, correlations, both directional accuracies, moments.

    `keys` name a model or a split, of which there are few.
    """
    keys = list(keys)
    Y, P = F.col(y), F.col(p)
    err = P - Y
    n = F.count(F.lit(1))
    sse, sst = F.sum(err * err), F.var_pop(Y) * n
    flat = F.coalesce(F.stddev_pop(P), F.lit(0.0)) == 0
    pearson = F.try_divide(F.covar_pop(Y, P), F.stddev_pop(Y) * F.stddev_pop(P))
    base = df.where(Y.isNotNull() & P.isNotNull())
    out = base.groupBy(*keys).agg(
        n.alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(sse / n).alias("rmse"),
        F.when(sst > 0, 1 - sse / sst).alias("r2"),
        F.when(flat, 0.0).otherwise(pearson).alias("pearson"),
        mean_of((Y > boundary) == (P > boundary)).alias("dir_acc"),
        mean_of(F.signum(Y) == F.signum(P)).alias("sign_acc"),
        F.avg(P).alias("pred_mean"), F.stddev_pop(P).alias("pred_std"),
        F.avg(Y).alias("actual_mean"), F.stddev_pop(Y).alias("actual_std"))
    one = F.lit(1).alias("_k")
    hub = keys or ["_k"]
    with_key = base if keys else base.select("*", one)
    out = out if keys else out.select("*", one)
    med = quantiles(with_key.withColumn("_ae", F.abs(err)), hub, "_ae", {"median_ae": 0.5},
                    bounded=True)
    out = out.join(med, hub, "left")
    if rank:
        rho = spearman(with_key, hub, p, y, "_rho").drop("n")
        out = out.join(rho, hub, "left").withColumn(
            "spearman", F.coalesce("_rho", F.lit(0.0))).drop("_rho")
    return out.drop("_k")


def versus_baseline(metrics: DataFrame, baseline: str, keys=("split",)) -> DataFrame:
    """RMSE change in percent and a flag against one model's row of the same split."""
    keys = list(keys)
    base = metrics.where(F.col("model") == baseline).select(
        *keys, F.col("rmse").alias("_b"))
    return (metrics.join(F.broadcast(base), keys, "left")
            .withColumns({"beats_baseline": F.col("rmse") < F.col("_b"),
                          "rmse_vs_baseline_pct": (F.col("rmse") / F.col("_b") - 1) * 100})
            .drop("_b"))


def accuracy(df: DataFrame, y: str, pred: str, keys=()) -> DataFrame:
    rate = F.avg(F.col(y).cast("double"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), mean_of(F.col(y) == F.col(pred)).alias("accuracy"),
        F.greatest(rate, 1 - rate).alias("base_rate"))


def confusion(df: DataFrame, y: str, pred: str, keys=()) -> DataFrame:
    """Counts, precision, recall and F1 (0 where the denominator is 0)."""
    Y, P = F.col(y) == 1, F.col(pred) == 1
    c = df.groupBy(*keys).agg(
        F.count_if(Y & P).alias("tp"), F.count_if(~Y & P).alias("fp"),
        F.count_if(Y & ~P).alias("fn"), F.count_if(~Y & ~P).alias("tn"))

    def rate(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn),
                          "f1": rate(2 * tp, 2 * tp + fp + fn)})


def ranking_scores(df: DataFrame, y: str, score: str, keys=()) -> DataFrame:
    """Exact ROC-AUC, average precision and Brier score.

    Rows are combined to distinct scores first; the running counts over the
    scores are a distributed prefix sum.
    """
    keys = list(keys)
    hub = keys or ["_k"]
    d = df if keys else df.withColumn("_k", F.lit(1))
    pos = F.col(y).cast("long")
    sq = (F.col(score) - F.col(y)) * (F.col(score) - F.col(y))
    t = prefix_sums(tie_table(d, hub, score, pos=pos, sq=sq), hub, score, ("n", "pos"))
    neg, neg_before = F.col("n") - F.col("pos"), F.col("n_before") - F.col("pos_before")
    wins = F.col("pos") * (neg_before + neg / 2.0)
    # Ranked from the highest score: everything not below this score.
    taken, hits = F.col("n_total") - F.col("n_before"), F.col("pos_total") - F.col("pos_before")
    out = t.groupBy(*hub).agg(
        F.max("n_total").alias("n"), F.max("pos_total").alias("positives"),
        F.sum(wins).alias("_w"), F.sum(F.col("pos") * hits / taken).alias("_ap"),
        F.sum("sq").alias("_sq"))
    p, n = F.col("positives"), F.col("n")
    return out.select(
        *keys, "n", "positives",
        F.try_divide(F.col("_w"), (p * (n - p)).cast("double")).alias("roc_auc"),
        F.try_divide(F.col("_ap"), p.cast("double")).alias("avg_precision"),
        (F.col("_sq") / n).alias("brier"))


def calibration(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Quantile bins of the score: mean score, hit rate and their gap.

    A score on an inner edge falls in the lower bin; empty bins do not appear.
    """
    edges = quantiles(df.withColumn("_k", F.lit(1)), ["_k"], score,
                      {f"e{i}": i / bins for i in range(1, bins)}, bounded=True)
    bin_no = sum(((F.col(score) > F.col(f"e{i}")).cast("int") for i in range(1, bins)),
                 F.lit(0))
    return (with_row(df, edges).withColumn("bin", bin_no)
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
                                F.avg(y).alias("hit_rate"))
            .withColumn("gap", F.abs(F.col("mean_score") - F.col("hit_rate"))))


def binomial_test(df: DataFrame, y: str, pred: str, naive_rate) -> DataFrame:
    """One-sided test that accuracy exceeds the naive rate (a literal or Column)."""
    rate = naive_rate if not isinstance(naive_rate, float) else F.lit(naive_rate)
    return (df.agg(F.count_if(F.col(y) == F.col(pred)).alias("correct"),
                   F.count(F.lit(1)).alias("n"), F.max(rate).alias("naive"))
            .withColumn("p_value", binomial_pvalue("correct", "n", "naive")))


def t_test(df: DataFrame, col: str, keys=()) -> DataFrame:
    """Mean against zero: n, mean, t and the two-sided p-value."""
    n, m, s = F.count(col), F.avg(col), F.stddev_samp(col)
    return (df.groupBy(*keys).agg(n.alias("n"), m.alias("mean"),
                                  F.try_divide(m, s / F.sqrt(n)).alias("t"))
            .withColumn("p_value", t_test_pvalue("t", (F.col("n") - 1).cast("double"))))


def yearly_ic(panel: DataFrame, target: str, features=FEATURE_COLS, years=None,
              min_rows: int = 200) -> DataFrame:
    """Spearman(feature, target) per (year, feature); thin years are skipped.

    The target is ranked once per year; all features are then one unpivoted job.
    A feature with missing values in a year has no IC there.
    """
    picked = panel.select(F.year("date").alias("year"),
                          F.col(target).cast("double").alias("y"),
                          *[F.col(c).cast("double").alias(c) for c in features])
    if years is not None:
        picked = picked.where(F.col("year").isin(list(years)))
    picked = materialize(picked)
    size = picked.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))
    busy = size.where(F.col("rows") >= min_rows)
    ranked = materialize(with_rank(picked.join(F.broadcast(busy), "year", "left_semi"),
                                   ["year"], "y", rank="_ry"))
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x"))
                      for c in features])
    long = (ranked.select("year", "_ry", F.explode(items).alias("_i"))
            .select("year", "_ry", "_i.feature", "_i.x"))
    ics = rank_correlation(long, ["year", "feature"], "x", "_ry", "ic")
    return (ics.join(F.broadcast(busy), "year")
            .select("year", "feature", F.when(F.col("n") == F.col("rows"), F.col("ic"))
                    .alias("ic"), "n"))


def ic_stability(ics: DataFrame) -> DataFrame:
    """Mean, spread and sign changes of each feature's yearly IC.

    `sign_flips` counts the first year as a change, `true_flips` does not. Years
    without an IC are passed over; a feature without any keeps its row.
    """
    w = Window.partitionBy("feature").orderBy("year")
    sign = F.signum("ic")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    d = ics.select("feature", "ic", sign.alias("_s"),
                   F.last(sign, ignorenulls=True).over(earlier).alias("_p"))
    flips = F.count_if(F.col("_s") != F.col("_p"))
    known = (F.count("ic") > 0).cast("int")
    return d.groupBy("feature").agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"),
        F.min("ic").alias("min_ic"), F.max("ic").alias("max_ic"),
        (flips + known).alias("sign_flips"), flips.alias("true_flips"),
        F.try_divide(F.abs(F.avg("ic")), F.stddev_samp("ic")).alias("stability_score"))


def unstable_features(stability: DataFrame, flips: int = 5) -> DataFrame:
    return stability.where(F.col("sign_flips") >= flips).select("feature", "sign_flips")


def fold_edge(folds: DataFrame) -> DataFrame:
    edge = F.col("accuracy") - F.col("naive")
    return folds.agg(F.count(F.lit(1)).alias("folds"), F.avg(edge).alias("mean_edge"),
                     F.stddev_samp(edge).alias("std_edge"))


def result_pivot(results: DataFrame, models, value: str = "accuracy") -> DataFrame:
    """(target_set, horizon) x model table of mean results."""
    return results.groupBy("target_set", "horizon").pivot("model", list(models)).agg(F.avg(value))


def best_of(results: DataFrame, singles, stacked: str) -> DataFrame:
    best = F.greatest(*singles) if len(singles) > 1 else F.col(singles[0])
    return results.withColumns({"best_single": best,
                                "stack_beats_best": F.col(stacked) > best})
