"""Cases that the sample tables don't hold: missing values, several batches, header orders."""

import datetime as dt
import pathlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import session
from barloom.functions.pvalues import beta_cdf, binom_upper
from barloom.operators import fundamentals as fund
from barloom.operators import audit, models, serving, splits
from barloom.operators.ewm import add_ewm
from barloom.sources import readers
from barloom.streaming import live_quotes

DAY = dt.date(2020, 1, 1)


def series(spark, **columns):
    rows = [(s, DAY + dt.timedelta(i), v) for s, values in columns.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, x double")


@pytest.mark.parametrize("span", [1, 3, 20])
def test_ewm_with_missing_values(spark, span):
    values = dict(inner=[1.0, 2.0, None, 4.0], leading=[None, None, 3.0, 5.0], repeated=[1.0, None, None, None, 9.0, 2.0],
                  none=[None, None], long=[float(i % 7) if i % 11 else None for i in range(3000)])
    got = add_ewm(series(spark, **values), [("x", span, "e")]).orderBy("symbol", "date").toPandas()
    for s, v in values.items():
        want = pd.Series(v, dtype=float).ewm(span=span, adjust=False).mean()
        mine = got[got.symbol == s].e.astype(float).reset_index(drop=True)
        assert (mine.isna() == want.isna()).all() and (mine - want).abs().max() < 1e-9 or want.isna().all()


def test_ewm_probe(spark):
    got = add_ewm(series(spark, a=[1.0, 2.0, None, 4.0]), [("x", 3, "e")]).orderBy("date")
    assert [round(r["e"], 4) for r in got.collect()] == [1, 1.5, 1.5, 3.1667]


def test_growth_after_a_missing_year(spark):
    rows = [("A", f"Mar {y}", p, 1.0, 1.0) for y, p in ((2018, 10.0), (2019, None), (2020, 30.0), (2021, 45.0))]
    known = fund.point_in_time(spark.createDataFrame(
        rows, "symbol string, fiscal_label string, net_profit double, eps double, roe_pct double"))
    got = [r["fund_net_profit_growth"] for r in known.orderBy("fiscal_year_end").collect()]
    assert got == [None, None, None, 0.5]


def at(second):
    return dt.datetime(2020, 1, 1, 12) + dt.timedelta(seconds=second)


BATCHES = [[("A", at(0), 1.0), ("B", at(10), 2.0)], [("A", at(4000), 3.0), ("C", at(3900), 7.0)],
           [("C", at(100), 6.0), ("B", at(3000), 4.0)]]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_stream_equals_the_batch_overlay(spark, tmp_path, order):
    """Quotes in and out of order over several micro-batches."""
    closes = spark.createDataFrame([(s, 9.0) for s in "ABCD"], "symbol string, close double")
    schema = "symbol string, ts timestamp, ltp double"
    for n, i in enumerate(order):
        spark.createDataFrame(BATCHES[i], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
        stream = live_quotes.read_quote_stream(spark, str(tmp_path / "in" / "*"), max_files=1)
        live_quotes.newest_quotes(stream, str(tmp_path / "out"), str(tmp_path / "state"), 3600).awaitTermination()
    got = {tuple(r) for r in live_quotes.read_live(spark, str(tmp_path / "out"), closes, 3600)
           .select("symbol", "last_close").collect()}
    batch = serving.overlay_quotes(closes, spark.createDataFrame(sum(BATCHES, []), schema), ttl_seconds=3600)
    assert got == {tuple(r) for r in batch.where("is_live").select("symbol", "last_close").collect()}
    assert got == {("A", 3.0), ("B", 4.0), ("C", 7.0)}


def test_header_orders(spark, tmp_path):
    """Columns go by name: two orders, a missing column, one more than is known."""
    head = ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"]
    day = {"Date": "2020-01-02", "Open": 1.0, "High": 3.0, "Low": 0.5, "Close": 2.0, "Adj Close": 1.9, "Volume": 7}
    for name, order in (("AA", head), ("BB", head[::-1]), ("CC", [c for c in head if c != "Open"])):
        pd.DataFrame([day])[order].to_csv(tmp_path / f"{name}.csv", index=False)
    pd.DataFrame([{**day, "More, or less": "x"}]).to_csv(tmp_path / "DD.csv", index=False)
    got = {r["symbol"]: r for r in readers.read_bars(spark, str(tmp_path)).collect()}
    assert set(got) == {"AA", "BB", "CC", "DD"}
    for s, r in got.items():
        assert (r["high"], r["low"], r["close"], r["adj_close"], r["volume"]) == (3.0, 0.5, 2.0, 1.9, 7)
        assert r["open"] == (None if s == "CC" else 1.0) and r["date"] == dt.date(2020, 1, 2)
    index = readers.read_index(spark, str(tmp_path / "AA.csv")).first()
    assert (index["nifty_open"], index["nifty_close"], index["nifty_volume"]) == (1.0, 2.0, 7)


def test_requests_out_of_range_are_refused(spark):
    panel = spark.createDataFrame([("A", DAY)], "symbol string, date date")
    for days in (0, 1001):
        with pytest.raises(ValueError):
            serving.history(panel, "A", days)
    for limit in (0, 49):
        with pytest.raises(ValueError):
            serving.top_predictions(panel, {}, 30, limit)


def test_scoring_keeps_rows_with_a_missing_feature(spark):
    d = spark.createDataFrame([(float(i), float(i % 3), float(i % 2)) for i in range(40)] + [(None, 1.0, 1.0)],
                              "a double, b double, y double")
    v = models.with_vector(d, ["a", "b"])
    logit = models.Logit().fit(models.labelled(v, "y").select("features", "label"))
    ridge = models.Ridge().fit(models.labelled(v, "y").select("features", "label"))
    for out in (models.positive_probability(logit, v, "s"), models.predicted(ridge, v, "s")):
        assert out.count() == 41
        assert out.where(F.col("s").isNull()).select("a").collect() == [(None,)]


def test_tails_of_large_counts():
    # The normal limit, with continuity correction, is near enough to show a cut series.
    n = 10**9
    k = n // 2 + 31_623  # two standard deviations
    assert abs(binom_upper(k, n, 0.5) - 0.0227501) < 1e-5
    assert abs(beta_cdf(5e8, 5e8, 0.5) - 0.5) < 1e-8


def test_landing_findings(spark, tmp_path):
    (tmp_path / "OK.csv").write_text("Date,Open,Close\n2020-01-02,1,2\n")
    (tmp_path / "BARE.csv").write_text("Date,Close\n2020-01-02,2\n")
    (tmp_path / "EMPTY.csv").write_text("Close,Open,Date\n")
    heads = readers.headers(spark, str(tmp_path))
    landed = readers.read_bars(spark, str(tmp_path))
    got = {(r["symbol"], r["check"]) for r in audit.landing_findings(heads, landed, ["Date", "Open", "Close"]).collect()}
    assert got == {("BARE", "missing_column Open"), ("EMPTY", "empty_file")}


def test_job_tables_are_removed(spark):
    tables = pathlib.Path(session.checkpoint_dir(spark).removeprefix("file:")) / "tables"
    with session.job_tables(spark):
        before = set(tables.glob("*"))
        kept = session.materialize(spark.range(5))
        assert kept.count() == 5 and len(set(tables.glob("*")) - before) == 1
    assert set(tables.glob("*")) == before


def test_unpurged_train_rows(spark):
    d = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i),) for i in range(200)], "date date")
    t = splits.purged_split(d, "2020-03-01", "2020-05-01", 10, train_purge_days=0)
    ends = {r["split"]: (r["a"], r["b"]) for r in t.groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    assert ends["train"][1] == dt.date(2020, 3, 1) and ends["val"] == (dt.date(2020, 3, 12), dt.date(2020, 4, 21))
