"""Winsor -> log1p -> robust scaling as a Spark ML estimator."""

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import clip
from barloom.operators.order_stats import interpolate, neighbours
from barloom.schema import FEATURE_COLS, LOG1P_COLS

# --- fixed values ---
WINSOR = (0.01, 0.99)
CLIP_SIGMA = 5.0
# --- end of fixed values ---


def fit_parameters(train: DataFrame, features, log1p=LOG1P_COLS, winsor=WINSOR) -> DataFrame:
    """(feature, lo, hi, is_log1p, center, iqr), one row per feature.

    Clip and log1p are monotone, so the order statistics of the transformed
    feature are the transformed order statistics of the raw one: a single
    selection pass over all features yields both the winsor bounds and the
    median and quartiles that depend on them.
    """
    probs = [winsor[0], 0.25, 0.5, 0.75, winsor[1]]
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                      for c in features])
    long = train.select(F.explode(items).alias("_i")).select("_i.feature", "_i.v")
    found = neighbours(long, ["feature"], "v", probs, bounded=True).withColumns({
        "lo": interpolate(0, probs[0]), "hi": interpolate(4, probs[4]),
        "is_log1p": F.col("feature").isin(list(log1p))})

    def moved(name):
        v = F.greatest(F.least(F.col(name), F.col("hi")), F.col("lo"))
        return F.when(F.col("is_log1p"), F.log1p(F.greatest(v, F.lit(0.0)))).otherwise(v)

    q = {i: interpolate(i, probs[i], moved(f"lo_{i}"), moved(f"hi_{i}")) for i in (1, 2, 3)}
    spread = q[3] - q[1]
    return found.select("feature", "lo", "hi", "is_log1p", q[2].alias("center"),
                        F.when(spread == 0, 1.0).otherwise(spread).alias("iqr"))


def scale_expr(col: str, p: dict, sigma: float = CLIP_SIGMA):
    v = clip(F.col(col).cast("double"), p["lo"], p["hi"])
    if p["is_log1p"]:
        v = F.log1p(clip(v, 0.0))
    return clip((v - F.lit(p["center"])) / F.lit(p["iqr"]), -sigma, sigma)


def unscale_expr(col, p: dict):
    """Affine inverse; exact up to the winsor and sigma clips."""
    v = (F.col(col) if isinstance(col, str) else col) * F.lit(p["iqr"]) + F.lit(p["center"])
    return F.expm1(v) if p["is_log1p"] else v


def parameter_dict(params: DataFrame) -> dict:
    """One row per feature - a list as short as the schema."""
    return {r["feature"]: r.asDict() for r in params.collect()}


class _ScalerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "features",
                      TypeConverters.toListString)
    log1pCols = Param(Params._dummy(), "log1pCols", "log-scaled features",
                      TypeConverters.toListString)
    clipSigma = Param(Params._dummy(), "clipSigma", "bound in IQR units",
                      TypeConverters.toFloat)


class PanelScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on train rows; the model replaces each feature in place."""

    @keyword_only
    def __init__(self, *, inputCols=FEATURE_COLS, log1pCols=LOG1P_COLS, clipSigma=CLIP_SIGMA):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        cols = self.getOrDefault(self.inputCols) if self.isSet(self.inputCols) else FEATURE_COLS
        logs = self.getOrDefault(self.log1pCols) if self.isSet(self.log1pCols) else LOG1P_COLS
        sigma = self.getOrDefault(self.clipSigma) if self.isSet(self.clipSigma) else CLIP_SIGMA
        found = parameter_dict(fit_parameters(dataset, cols, logs))
        state = json.dumps({"features": [found[c] for c in cols], "clip_sigma": sigma})
        return PanelScalerModel()._set(state=state)


class PanelScalerModel(Model, Params, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted parameters as JSON",
                  TypeConverters.toString)

    def parameters(self) -> dict:
        s = json.loads(self.getOrDefault(self.state))
        return {p["feature"]: p for p in s["features"]}

    def _transform(self, dataset):
        sigma = json.loads(self.getOrDefault(self.state))["clip_sigma"]
        return dataset.withColumns({c: scale_expr(c, p, sigma)
                                    for c, p in self.parameters().items()})
