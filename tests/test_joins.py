"""As-of join, filing match, statement assembly, numeric text, overlay."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import scalar
from barloom.operators import asof, audit, cleaning, fundamentals as fund, serving

D = dt.date


def test_asof_takes_latest_and_breaks_ties(spark):
    left = spark.createDataFrame([("A", D(2020, 1, d)) for d in (1, 5, 9)] + [("B", D(2020, 1, 5))],
                                 "symbol string, date date")
    right = spark.createDataFrame(
        [("A", D(2020, 1, 5), 2018, 1.0), ("A", D(2020, 1, 5), 2019, 2.0),
         ("A", D(2020, 1, 8), 2020, None), ("C", D(2020, 1, 1), 2020, 9.0)],
        "symbol string, known_date date, fy int, eps double")
    got = {(r["symbol"], r["date"].day): (r["fy"], r["eps"]) for r in asof.asof_join(
        left, right, "date", "known_date", tie_break=["fy"]).collect()}
    assert got == {("A", 1): (None, None), ("A", 5): (2019, 2.0), ("A", 9): (2020, None),
                   ("B", 5): (None, None)}


def test_asof_against_pandas(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    days = pd.date_range("2020-01-01", periods=300)
    left = pd.DataFrame({"symbol": rng.choice(list("ABC"), 200), "date": rng.choice(days, 200)})
    left = left.drop_duplicates().sort_values("date")
    right = pd.DataFrame({"symbol": rng.choice(list("ABCD"), 30), "known_date":
                          rng.choice(days, 30, replace=False), "v": rng.normal(size=30)})
    want = pd.merge_asof(left, right.sort_values("known_date"), left_on="date",
                         right_on="known_date", by="symbol").set_index(["symbol", "date"]).v
    to = lambda x: spark.createDataFrame(x)
    got = asof.asof_join(to(left), to(right), "date", "known_date").toPandas()
    got = got.set_index(["symbol", "date"]).v.sort_index()
    pd.testing.assert_series_equal(got, want.sort_index())


def test_asof_in_buckets_equals_the_plain_join(spark):
    import numpy as np
    rng = np.random.default_rng(9)
    hot = rng.random(4000) < 0.4
    left = pd.DataFrame({"symbol": np.where(hot, "HOT", rng.choice(list("ABC"), 4000)),
                         "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 90 * 86400, 4000), "s"),
                         "id": range(4000)})
    quotes = pd.DataFrame({"symbol": rng.choice(["HOT", "A", "B", "D"], 300),
                           "at": pd.Timestamp("2020-01-03") + pd.to_timedelta(rng.integers(0, 80 * 86400, 300), "s"),
                           "v": rng.normal(size=300)})
    quotes.loc[5:9, ["symbol", "at"]] = "A", left.ts[left.symbol == "A"].iloc[0]  # ties, and a time in both
    ldf, rdf = spark.createDataFrame(left), spark.createDataFrame(quotes)
    none = spark.createDataFrame([("HOT", None, -1), (None, dt.datetime(2020, 2, 2), -2)], ldf.schema)
    more = spark.createDataFrame([(None, dt.datetime(2020, 1, 9), 7.0), ("B", dt.datetime(2020, 1, 9), None),
                                  ("B", None, 1.0)], rdf.schema)
    ldf, rdf = ldf.union(none), rdf.union(more)
    plain = {r["id"]: (r["at"], r["v"]) for r in asof.asof_join(ldf, rdf, "ts", "at").collect()}
    joined = asof.asof_join(ldf, rdf, "ts", "at", bucket="day")
    assert {r["id"]: (r["at"], r["v"]) for r in joined.collect()} == plain and len(plain) == 4002
    assert plain[-1] == (None, None) and plain[-2] == (dt.datetime(2020, 1, 9), 7.0)
    windows = [x for x in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x]
    assert {"_bucket" in x.split("], [")[1] for x in windows if "_side" in x} == {True}


def test_filing_match_window_and_fallback(spark):
    years = spark.createDataFrame([("A", D(2020, 3, 31)), ("B", D(2020, 3, 31))],
                                  "symbol string, fiscal_year_end date")
    t = dt.datetime
    said = spark.createDataFrame(
        [("A", t(2020, 3, 30), "Financial Results", None),
         ("A", t(2020, 5, 9, 8), "Outcome of Board Meeting", "AUDITED FINANCIAL RESULT attached"),
         ("A", t(2020, 6, 1), "Financial Result Updates", None),
         ("B", t(2020, 7, 1), "financial results", None), ("B", t(2020, 5, 1), "Dividend", "x")],
        "symbol string, ts timestamp, desc string, attachment string")
    got = {r["symbol"]: (r["known_date"], r["source"])
           for r in fund.match_filings(years, said).collect()}
    assert got == {"A": (D(2020, 5, 9), "nse_actual"),
                   "B": (D(2020, 5, 30), "approximation_fallback")}


def test_statement_cells(spark):
    cells = spark.createDataFrame(
        [("A", "Sales+", "Mar 2020", "1,234"), ("A", "ROCE %", "Mar 2020", "12%"),
         ("A", "Reserves", "Mar 2021", "-"), ("A", "Sales", "TTM", "9"),
         ("A", "Other", "Mar 2022", "5")], "symbol string, label string, year string, value string")
    got = {r["fiscal_label"]: (r["sales"], r["roce_pct"], r["reserves"])
           for r in fund.assemble_statements(cells).collect()}
    assert got["Mar 2020"] == (1234.0, 12.0, None) and got["Mar 2021"] == (None, None, None)
    assert "TTM" not in got


def test_statement_ratios_and_growth(spark):
    f = spark.createDataFrame(
        [("M&M", "Mar 2019", 10.0, 1.0, 50.0, None, 20.0),
         ("M&M", "Mar 2020", 15.0, 0.0, 50.0, 50.0, 20.0),
         ("M&M", "Mar 202115m", 99.0, 9.0, 1.0, 1.0, 1.0),
         ("M&M", "Mar 2022", 30.0, 2.0, 50.0, 50.0, 25.0)],
        "symbol string, fiscal_label string, net_profit double, eps double, "
        "equity_capital double, reserves double, borrowings double")
    filed = spark.createDataFrame([("M&M", "Mar 2020", D(2020, 5, 1))],
                                  "symbol string, fiscal_label string, known_date date")
    rows = fund.point_in_time(fund.add_statement_ratios(f), filed).orderBy("fiscal_year_end").collect()
    assert [r["symbol"] for r in rows] == ["MM"] * 3
    assert [r["known_date"] for r in rows] == [D(2019, 5, 30), D(2020, 5, 1), D(2022, 5, 30)]
    assert rows[0]["roe_pct"] == 20.0 and rows[2]["debt_to_equity"] == 0.25
    assert [r["fund_net_profit_growth"] for r in rows] == [None, 0.5, 1.0]
    assert rows[1]["fund_eps_growth"] == -1.0 and rows[2]["fund_eps_growth"] == float("inf")


def test_numeric_text(spark):
    vals = ["1,234.5", "12%", "", "-", " 7 ", "n/a", None]
    d = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in d.select(scalar.parse_number("v")).collect()]
    assert got == [1234.5, 12.0, None, None, 7.0, None, None]


def test_safe_division(spark):
    inf = float("inf")
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 2.0), (3.0, 2.0)],
                              "a double, b double")
    assert [r[0] for r in d.select(scalar.safe_div("a", "b")).collect()] == \
        [inf, -inf, None, None, 1.5]


def test_overlay_uses_only_fresh_quotes(spark):
    rows = spark.createDataFrame([("A", 10.0, 0.1), ("B", 20.0, 0.1), ("C", 30.0, 0.1)],
                                 "symbol string, close double, r double")
    t = dt.datetime
    quotes = spark.createDataFrame(
        [("A", t(2024, 1, 1, 0, 0, 8), 11.0), ("A", t(2024, 1, 1, 0, 0, 9), 12.0),
         ("B", t(2024, 1, 1, 0, 0, 1), 21.0)], "symbol string, ts timestamp, ltp double")
    got = {r["symbol"]: (r["last_close"], r["is_live"], r["expected_price"]) for r in
           serving.overlay_quotes(rows, quotes, ttl_seconds=5, expected="r").collect()}
    assert got == {"A": (12.0, True, 13.2), "B": (20.0, False, 22.0), "C": (30.0, False, 33.0)}


def test_risk_tiers_with_missing_volatility(spark):
    rows = [(f"S{i}", 1, float(i)) for i in range(9)] + [("N", 1, None)]
    d = spark.createDataFrame(rows, "symbol string, date int, volatility_20 double")
    got = {r["symbol"]: r["risk_level"] for r in serving.risk_tiers(d).collect()}
    want = {}
    for i in range(9):
        share = i / 10
        want[f"S{i}"] = "High" if share >= 0.66 else "Low" if share <= 0.33 else "Medium"
    assert got == {**want, "N": "Low"}


def test_audit_counts(spark):
    rows = [("A", D(2020, 1, 1), 1.0, 2.0, 0.5, 1.0, 1.0, 5), ("A", D(2020, 1, 1), 1.0, 2.0, 0.5, 1.0, 1.0, 5),
            ("A", D(2020, 1, 20), 1.0, 0.4, 0.5, 2.0, 2.0, 0),
            ("A", D(2020, 1, 21), None, 2.0, 0.5, -1.0, 1.0, -3)]
    d = spark.createDataFrame(rows, "symbol string, date date, open double, high double, "
                                    "low double, close double, adj_close double, volume bigint")
    r = audit.structural(d).first()
    assert (r["rows"], r["duplicate_dates"], r["null_open"], r["bad_ohlc"],
            r["non_positive_price"], r["negative_volume"], r["zero_volume"]) == (4, 1, 1, 2, 1, 1, 1)
    g = audit.jumps_and_gaps(d).first()
    assert (g["gaps"], g["max_gap_days"]) == (1, 19)
    one = cleaning.unique_bars(d.withColumn("k", F.lit(1)), prefer="k")
    assert one.count() == 3


def test_horizon_check():
    with pytest.raises(ValueError):
        serving.check_horizon(15)
