"""Windowed features and labels against their definitions on small panels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import cross_section as xs, labels, technicals as tech
from barloom.operators.ewm import add_ewm
from barloom.schema import HORIZONS, TECHNICAL_COLS
from tests import panels


@pytest.fixture(scope="module")
def frame():
    return panels.bars()


@pytest.fixture(scope="module")
def built(spark, frame):
    d = tech.add_technicals(spark.createDataFrame(frame))
    return d.persist()


def test_technicals_match_their_definitions(built, frame):
    want = panels.per_symbol(frame, panels.technicals)
    cols = [c for c in TECHNICAL_COLS if c != "bb_pct_b"]
    panels.assert_same(built.toPandas(), want, cols)


def test_flat_prices_have_no_rsi_and_pure_gains_have_100(spark):
    rows = [("F", i, 5.0) for i in range(20)] + [("U", i, 1.0 + i) for i in range(20)]
    d = tech.add_features(spark.createDataFrame(rows, "symbol string, date int, adj_close double"),
                          tech.rsi())
    last = {r["symbol"]: r["rsi_14"] for r in d.where("date = 19").collect()}
    assert last == {"F": None, "U": 100.0}


def test_one_exchange_by_symbol(built, spark, frame):
    d = tech.add_technicals(spark.createDataFrame(frame))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1


def test_no_look_ahead(spark, frame, built):
    cut = frame.date.sort_values().unique()[200]
    later = frame.copy()
    late = later.date > cut
    later.loc[late, ["adj_close", "high", "low"]] *= 7.0
    later.loc[late, "volume"] *= 3
    again = tech.add_technicals(spark.createDataFrame(later)).where(F.col("date") <= F.lit(cut))
    panels.assert_same(again.toPandas(), built.where(F.col("date") <= F.lit(cut)).toPandas(),
                       TECHNICAL_COLS, 1e-12)


def test_ewm_across_blocks(spark):
    n = 2600
    x = np.random.default_rng(0).normal(size=n)
    pdf = pd.DataFrame({"symbol": "A", "date": range(n), "x": x})
    got = add_ewm(spark.createDataFrame(pdf), [("x", 9, "a"), ("x", 200, "b")]).toPandas()
    got = got.sort_values("date")
    for span, col in ((9, "a"), (200, "b")):
        want = pd.Series(x).ewm(span=span, adjust=False).mean()
        assert np.abs(got[col].to_numpy() - want.to_numpy()).max() < 1e-11


def test_labels_follow_the_break_mask(spark, frame):
    d = spark.createDataFrame(frame)
    lr = tech.add_features(d, tech.log_return(), tech.volatility())
    out = labels.add_forward_labels(lr)
    hit = frame[frame.symbol == "AAA"].date.iloc[100]
    out = out.withColumn("corp_action_break",
                         (F.col("symbol") == "AAA") & (F.col("date") == F.lit(hit)))
    masked = labels.mask_breaks(out)
    full = labels.add_advanced_labels(labels.add_relative_labels(masked)).toPandas()

    # Per symbol and row: the return over the next h rows, unless the break lies between.
    ahead, spread, own = {}, {}, {}
    for name, g in frame.groupby("symbol"):
        s = panels.Series(g)
        for i, day in enumerate(g["date"]):
            own[name, day] = panels.deviation(s, i, 20)
            for h in HORIZONS:
                if i + h < s.n and not (name == "AAA" and i < 100 <= i + h):
                    ahead[name, day, h] = s.change(i + h, h)
                    spread[name, day, h] = np.std([s.log_return(j) for j in range(i + 1, i + h + 1)], ddof=1)

    sector = dict(zip(frame["symbol"], frame["industry"]))
    got = {(r["symbol"], r["date"]): r for r in full.to_dict("records")}
    assert len(got) == len(frame)
    seen = 0
    for day in sorted(set(frame["date"])):
        for h in HORIZONS:
            today = {n: ahead[n, day, h] for n in sector if (n, day, h) in ahead}
            for name in (n for n in sector if (n, day) in got):
                row, f = got[name, day], today.get(name)
                want = dict.fromkeys(("fwd_return", "positive_return", "future_volatility", "rel_return",
                                      "beats_median", "rel_return_sector", "beats_sector_median",
                                      "fwd_return_rank", "top_tercile"))
                if f is not None:
                    seen += 1
                    middle = np.median(list(today.values()))
                    peers = [v for n, v in today.items() if sector[n] == sector[name]]
                    members = sum((n, day) in got for n in sector if sector[n] == sector[name])
                    near = np.median(peers) if members > 1 else middle
                    rank = (sum(v < f for v in today.values()) + (sum(v == f for v in today.values()) + 1) / 2) / len(today)
                    want = {"fwd_return": f, "positive_return": float(f > 0),
                            "future_volatility": spread[name, day, h], "rel_return": f - middle,
                            "beats_median": float(f > middle), "rel_return_sector": f - near,
                            "beats_sector_median": float(f > near), "fwd_return_rank": rank,
                            "top_tercile": 0.0 if rank <= 1 / 3 else 1.0 if rank >= 2 / 3 else None}
                    vol = own[name, day]
                    if not np.isnan(vol) and vol > 1e-9:
                        assert row[f"fwd_return_vol_adj_{h}d"] == pytest.approx(f / (vol * h ** 0.5), rel=1e-7)
                for k, v in want.items():
                    x = row[f"{k}_{h}d"]
                    assert (x is None or np.isnan(x)) if v is None else x == pytest.approx(v, abs=1e-9), (name, day, k, h)
    assert seen > 2000


def test_sector_return_leaves_the_row_out(spark):
    rows = [("A", 1, "X", 0.1), ("B", 1, "X", 0.3), ("C", 1, "X", None), ("D", 1, "Y", 0.9),
            ("E", 1, None, 0.5)]
    d = spark.createDataFrame(rows, "symbol string, date int, industry string, log_return double")
    got = {r["symbol"]: r["sector_return"] for r in xs.add_sector_return(d).collect()}
    assert got["A"] == pytest.approx(0.15) and got["B"] == pytest.approx(0.05)
    assert got["C"] is None and got["D"] == 0.0


def test_index_is_carried_over_missing_days(spark):
    dates = spark.createDataFrame([(1,), (2,), (3,), (3,)], "date int")
    idx = spark.createDataFrame([(1, 10.0), (3, 30.0)], "date int, nifty_close double")
    got = [(r[0], r[1]) for r in xs.index_on_calendar(dates, idx).orderBy("date").collect()]
    assert got == [(1, 10.0), (2, 10.0), (3, 30.0)]


def test_sequences_over_block_ends(spark):
    import datetime as dt

    from barloom.operators.splits import sequences
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i), -float(i)) for i in range(61)]
    rows += [("B", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i), None) for i in range(4)]
    rows += [("C", dt.date(2020, 1, 1) + dt.timedelta(days=i), None, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol string, date date, f double, y double")
    for lookback, stride, block in ((5, 3, 5), (5, 1, 8), (1, 2, 7), (4, 7, 60), (5, 2, 256)):
        got = {(r["symbol"], r["date"]): (r["x"], r["y"]) for r in sequences(
            df, ["f", "f"], ["y"], lookback, stride, block).collect()}
        want = {}
        for symbol in "ABC":
            own = [r for r in rows if r[0] == symbol]
            for end in range(lookback - 1, len(own), stride):
                x = [[r[2], r[2]] for r in own[end - lookback + 1:end + 1]]
                want[symbol, own[end][1]] = x, own[end][3]
        assert got == want
    assert sequences(df.limit(0), ["f"], ["y"]).count() == 0
