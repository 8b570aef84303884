"""Distributed order statistics against pandas, with ties and crowded groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics, order_stats as os_, scaling


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    crowded = pd.DataFrame({"g": 0, "v": np.where(rng.random(3000) < 0.4, 0.0,
                                                  rng.normal(0, 1e3, 3000))})
    small = pd.DataFrame({"g": rng.integers(1, 40, 400), "v": rng.integers(-3, 3, 400) / 10})
    out = pd.concat([crowded, small], ignore_index=True)
    out["y"] = out.v * 0.1 + rng.normal(size=len(out))
    out["id"] = range(len(out))
    out.loc[::17, "v"] = np.nan
    return out


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None),
                                 "g int, v double, y double, id int").persist()


def test_ranks(df, frame):
    got = os_.with_rank(df, ["g"], "v", rank="r", pct="p").toPandas().sort_values("id")
    by = frame.groupby("g").v
    assert np.allclose(got.r.to_numpy(), by.rank().to_numpy(), equal_nan=True)
    assert np.allclose(got.p.to_numpy(), by.rank(pct=True).to_numpy(), equal_nan=True)


def test_quantiles(df, frame):
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99}
    got = os_.quantiles(df, ["g"], "v", probs).toPandas().set_index("g").sort_index()
    for c, p in probs.items():
        want = frame.groupby("g").v.quantile(p).dropna()
        assert np.allclose(got[c], want, rtol=1e-12)


def test_bounded_quantiles_filter_rows_in_place(df):
    q = os_.quantiles(df, ["g"], "v", {"m": 0.5}, bounded=True)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    free = os_.quantiles(df, ["g"], "v", {"m": 0.5}).toPandas().sort_values("g")
    assert np.allclose(q.toPandas().sort_values("g").m, free.m)


def test_spearman(df, frame):
    got = os_.spearman(df, ["g"], "v", "y").toPandas().set_index("g").ic.astype(float)
    for g, part in frame.dropna().groupby("g"):
        want = part.v.rank().corr(part.y.rank())
        assert (np.isnan(got[g]) and np.isnan(want)) or got[g] == pytest.approx(want, abs=1e-12)


def test_text_order(spark):
    names = [f"Brand{i}" for i in range(30)] + ["A", "Brand", "Zed"]
    d = spark.createDataFrame([(1, n) for n in names], "g int, s string")
    t = os_.prefix_sums(os_.tie_table(d, ["g"], "s"), ["g"], "s").toPandas()
    assert list(t.sort_values("n_before").s) == sorted(names)


def test_cells_are_ordered_and_bounded(spark):
    v = sorted([0.0, 1e-300, -1e-300, 1e-5, 0.1, 0.1000001, 5.0, 1e9, 1e200, -1e200, -3.0])
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = [r[0] for r in d.select(os_.cell_of(F.col("v"))).collect()]
    assert got == sorted(got) and max(map(abs, got)) <= os_.cells_bound()


def test_scaler_matches_two_pass_fit(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame({"roc_5": rng.normal(size=999), "atr_pct": rng.lognormal(size=999),
                      "flat": 1.0})
    d = spark.createDataFrame(x)
    got = {r["feature"]: r for r in scaling.fit_parameters(d, list(x.columns)).collect()}
    for c in x:
        lo, hi = x[c].quantile(0.01), x[c].quantile(0.99)
        t = x[c].clip(lo, hi)
        t = np.log1p(t.clip(lower=0)) if c == "atr_pct" else t
        iqr = t.quantile(0.75) - t.quantile(0.25)
        assert got[c]["lo"] == pytest.approx(lo) and got[c]["hi"] == pytest.approx(hi)
        assert got[c]["center"] == pytest.approx(t.median())
        assert got[c]["iqr"] == pytest.approx(iqr if iqr else 1.0)
    model = scaling.PanelScaler(inputCols=list(x.columns)).fit(d)
    assert model.transform(d).selectExpr("max(abs(roc_5))").first()[0] <= 5


def test_auc_and_average_precision(spark):
    rng = np.random.default_rng(9)
    s = rng.integers(0, 12, 500) / 10
    y = (rng.random(500) < 0.2 + 0.05 * s).astype(float)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y)], "s double, y double")
    got = metrics.ranking_scores(d, "y", "s").first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    ap, prev = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        rec = (pos >= t).mean()
        ap += (rec - prev) * (y[s >= t]).mean()
        prev = rec
    assert got["roc_auc"] == pytest.approx(auc) and got["avg_precision"] == pytest.approx(ap)
    assert got["brier"] == pytest.approx(np.mean((s - y) ** 2))


def test_concentrated_values_use_many_cells(spark):
    """A narrow band, a common text prefix and tiny values don't share one cell."""
    d = spark.range(20_000).select((0.49 + F.col("id") / 1e6).alias("v"), (F.col("id") * 1e-12).alias("small"),
                                   F.concat(F.lit("EXCHANGE:"), F.col("id").cast("string")).alias("name"))
    n = d.agg(F.count_distinct(os_.cell_of(F.col("v"))), F.count_distinct(os_.cell_of(F.col("small"))),
              F.count_distinct(os_.cell_of(F.col("name"), True))).first()
    assert n[0] > 2_000 and n[1] > 500 and n[2] == 20_000


def test_no_window_orders_all_cells_of_a_group(df):
    ranked = os_.with_rank(df.select("g", "v", "id"), ["g"], "v", rank="r")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    windows = [x.split("windowspecdefinition(")[1] for x in plan.splitlines() if "Window [" in x and "_cell#" in x]
    ordered = [x for x in windows if "_cell#" in x.split(" ASC")[0]]
    assert ordered and all("_range#" in x.split("_cell#")[0] or "v#" in x.split(" ASC")[0] for x in ordered)


def test_ranks_over_many_ranges(spark):
    rng = np.random.default_rng(8)
    v = np.sign(rng.normal(size=3000)) * np.exp(rng.uniform(-30, 40, 3000))
    v[:300] = rng.choice([0.0, -0.0, 1e-9, -1e-9, 1e160, -1e160, np.inf, -np.inf], 300)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 3000), "id": range(3000), "v": v})
    got = os_.with_rank(spark.createDataFrame(frame), ["g"], "v", rank="r", below="b").toPandas().set_index("id")
    by = frame.set_index("id").groupby("g").v
    pd.testing.assert_series_equal(got.r.sort_index(), by.rank(), check_names=False)
    low = by.rank(method="min") - 1
    pd.testing.assert_series_equal(got.b.sort_index(), low / by.transform("size"), check_names=False)
