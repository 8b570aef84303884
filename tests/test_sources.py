"""Landing readers, sinks, the streaming overlay and the CSV-to-model jobs."""

import datetime as dt
import gzip
import os

import numpy as np
import pandas as pd
import pytest

from barloom import schema as S
from barloom.operators import audit, models, serving
from barloom.plans import jobs
from barloom.sources import readers, writers
from barloom.streaming import live_quotes


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """A landing folder of seven symbols with the helper files beside them."""
    d = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(8)
    days = pd.bdate_range("2020-01-01", periods=460)
    names = ["AAA", "BBB", "CCC", "DDD", "EEE", "MM", "SHORT"]
    for s in names:
        n = 40 if s == "SHORT" else len(days)
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        pd.DataFrame({"Date": days[:n].strftime("%Y-%m-%d"), "Symbol": s.replace("MM", "M&M"),
                      "Adj Close": c * 0.98, "Close": c, "High": c * 1.02, "Low": c * 0.98,
                      "Open": c, "Volume": np.where(np.arange(n) % 50 == 3, 0, 100 + np.arange(n) % 7)}
                     ).to_csv(d / f"{s}.csv", index=False)
    idx = 1000 * np.exp(np.cumsum(rng.normal(0, 0.01, len(days))))
    pd.DataFrame({"Date": days.strftime("%Y-%m-%d"), "Adj Close": idx, "Close": idx, "High": idx,
                  "Low": idx, "Open": idx, "Volume": 1}).to_csv(d / "NIFTY50_INDEX.csv", index=False)
    vix = 15 + rng.normal(0, 1, len(days))
    pd.DataFrame({"Date": days.strftime("%Y-%m-%d"), "Adj Close": vix, "Close": vix, "High": vix,
                  "Low": vix, "Open": vix, "Volume": 0}).to_csv(d / "INDIA_VIX.csv", index=False)
    pd.DataFrame([(f"{s} Ltd", "X" if s < "CCC" else "Y", s.replace("MM", "M&M"), "EQ", "I")
                  for s in names + ["GONE"]],
                 columns=["Company Name", "Industry", "Symbol", "Series", "ISIN Code"]
                 ).to_csv(d / "stock_metadata.csv", index=False)
    rows = [(s.replace("MM", "M&M"), f"Mar {y}", 1.0, p, p / 10, 5.0, 5.0, 1.0, 9.0, p * 10, 0.1)
            for s in names for y, p in ((2017, 1.0), (2018, 2.0), (2019, 3.0), (2020, 5.0))]
    pd.DataFrame(rows, columns=[f.name for f in S.FUNDAMENTALS]).to_csv(
        d / "fundamentals_annual.csv", index=False)
    pd.DataFrame([("M&M", "Mar 2020", "2020-05-20", "nse_actual")],
                 columns=["Symbol", "FiscalYearEnd", "known_date", "source"]
                 ).to_csv(d / "filing_dates.csv", index=False)
    return str(d)


def test_signature_filter_and_symbols(spark, raw):
    files = {os.path.basename(r["file"]) for r in readers.bar_files(spark, raw).collect()}
    assert files == {f"{s}.csv" for s in ("AAA", "BBB", "CCC", "DDD", "EEE", "MM", "SHORT")}
    bars = readers.read_signed_bars(spark, raw)
    assert {r[0] for r in bars.select("symbol").distinct().collect()} >= {"MM", "AAA"}
    assert bars.count() == 6 * 460 + 40
    assert bars.where("close is null or date is null").count() == 0
    plan = bars.select("symbol", "close")._jdf.queryExecution().executedPlan().toString()
    scans = [line.split("ReadSchema")[1] for line in plan.splitlines() if "FileScan csv" in line]
    assert scans and all("Close" in x and "Open" not in x for x in scans)


def _bytes_read(spark):
    """What this JVM has read from files so far."""
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def _header_cost(spark, folder):
    before = _bytes_read(spark)
    rows = {os.path.basename(r["file"]): list(r["columns"]) for r in readers.headers(spark, folder).collect()}
    return rows, _bytes_read(spark) - before


def test_header_pass_does_not_read_the_files(spark, tmp_path):
    head, line = "Date,Close,Volume\n", "2020-01-01,1.25,100\n"
    for name, n in (("short", 10), ("long", 2_500_000)):
        (tmp_path / name).mkdir()
        for i in range(3):
            (tmp_path / name / f"S{i}.csv").write_text(("\ufeff" if i == 1 else "") + head + line * n)
    (tmp_path / "short" / "EMPTY.csv").write_text("")
    (tmp_path / "short" / "PACK.csv.gz").write_bytes(gzip.compress(b"Date,Close\n1,2\n"))
    (tmp_path / "short" / "BLANK.csv").write_text("\n\n")
    (tmp_path / "short" / "OTHER.csv").write_text('"Symbol" , "Close"\r\nA,1\r\n')
    want = {f"S{i}.csv": ["Date", "Close", "Volume"] for i in range(3)}
    rows, small = _header_cost(spark, str(tmp_path / "short"))
    assert rows == want | {"OTHER.csv": ["Symbol", "Close"], "PACK.csv.gz": ["Date", "Close"]}
    rows, large = _header_cost(spark, str(tmp_path / "long"))
    assert rows == want
    assert os.path.getsize(tmp_path / "long" / "S0.csv") > 45_000_000 and large <= small + 3 * 65_536


def test_one_scan_where_headers_agree(spark, tmp_path):
    for s in ("A", "B c%"):
        (tmp_path / f"{s}.csv").write_text("Date,Symbol,Adj Close,Close,High,Low,Open,Volume\n2020-01-02,x,1,2,3,1,2,5\n")
    bars = readers.read_bars(spark, str(tmp_path))
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert sorted((r["symbol"], r["adj_close"]) for r in bars.collect()) == [("A", 1.0), ("B c%", 1.0)]
    assert readers.read_signed_bars(spark, str(tmp_path)).count() == 2


def test_master_index_and_header_checks(spark, raw):
    m = {r["symbol"] for r in readers.read_master(spark, f"{raw}/stock_metadata.csv").collect()}
    assert "MM" in m and "M&M" not in m
    idx = readers.read_index(spark, f"{raw}/NIFTY50_INDEX.csv")
    assert idx.columns == ["date", "nifty_open", "nifty_high", "nifty_low", "nifty_close",
                           "nifty_adj_close", "nifty_volume"]
    cov = {r["symbol"]: r["status"] for r in audit.coverage(
        readers.read_master(spark, f"{raw}/stock_metadata.csv"),
        readers.read_signed_bars(spark, raw)).collect()}
    assert cov["GONE"] == "missing" and cov["SHORT"] == "short" and cov["AAA"] == "ok"
    head = readers.headers(spark, raw)
    assert audit.price_column_count(head).first()["with_both"] == 9
    assert audit.missing_columns(["Date", "Close"], S.RAW_BAR_HEADER)[0] == "Adj Close"


def test_file_order_check(spark, tmp_path):
    pd.DataFrame({"Date": ["2020-01-02", "2020-01-01", "2020-01-03"], "Symbol": "Q",
                  "Adj Close": 1.0, "Close": 1.0, "High": 1.0, "Low": 1.0, "Open": 1.0,
                  "Volume": 1}).to_csv(tmp_path / "Q.csv", index=False)
    bad = audit.unordered_files(readers.read_bars(spark, str(tmp_path))).collect()
    assert [(r["symbol"], r["descents"]) for r in bad] == [("Q", 1)]


def test_audit_job_writes_findings(spark, raw, tmp_path):
    jobs.audit_raw(spark, raw, str(tmp_path))
    lines = {r[0] for r in spark.read.text(f"{tmp_path}/qc_report").collect()}
    assert "[AAA] zero_volume: 10" in lines and not any("descending" in x for x in lines)
    assert "[GONE] only_in_master: 1" in lines and not any("missing_column" in x for x in lines)
    assert spark.read.parquet(f"{tmp_path}/price_columns").first()["with_both"] == 7
    assert spark.read.parquet(f"{tmp_path}/corporate_actions").count() == len(S.CORPORATE_ACTIONS)
    assert spark.read.parquet(f"{tmp_path}/universe").first()["symbols"] == 7


def test_jobs_from_csv_to_model(spark, raw, tmp_path):
    out = str(tmp_path)
    jobs.ingest(spark, raw, out)
    clean = readers.read_panel(spark, f"{out}/clean")
    assert clean.where("volume = 0").count() == 0
    assert clean.where("nifty_close is null or industry is null").count() == 0
    jobs.features(spark, raw, out)
    feats = readers.read_panel(spark, f"{out}/features")
    assert set(S.FEATURE_COLS + S.LABEL_COLS) <= set(feats.columns)
    assert dict(feats.dtypes)["rsi_14"] == "float" and feats.count() > 500
    laid = writers.read_by_symbol(spark, f"{out}/by_symbol")
    assert laid.columns == feats.columns and laid.exceptAll(feats).count() == feats.exceptAll(laid).count() == 0
    gate = spark.read.parquet(f"{out}/gate_report").first()
    assert gate["rows_after"] == feats.count() < gate["rows_before"]

    def zoo():
        return {"historical_mean": models.MeanRegressor(), "ridge": models.Ridge()}

    first, last = feats.selectExpr("min(date)", "max(date)").first()
    span = (last - first).days
    table = jobs.regression(
        spark, out, zoo, str(first + dt.timedelta(days=span // 2)),
        str(first + dt.timedelta(days=3 * span // 4)), 5)
    assert {r["split"] for r in table.collect()} == {"validation", "test"}
    model, meta = writers.load_model(spark, f"{out}/model")
    assert meta["best_model"] == "ridge" and len(meta["feature_cols"]) == 36
    jobs.prepare(spark, out)
    scaled = writers.read_split(spark, f"{out}/splits", "train")
    assert audit.feature_bound(scaled, S.FEATURE_COLS).first()["within_bound"]
    start = str(first + dt.timedelta(days=span // 2))
    summary = jobs.portfolio(spark, out, 30, start, 20, purge_days=45, min_train=100,
                             min_names=3).first()
    assert summary["periods"] >= 2 and summary["avg_breadth"] >= 3
    assert spark.read.parquet(f"{out}/portfolio_curve").count() == summary["periods"]
    jobs.ic_report(spark, out)
    assert spark.read.parquet(f"{out}/ic_stability").count() == 36
    middle, late = (str(first + dt.timedelta(days=n * span // 4)) for n in (2, 3))
    jobs.prepare(spark, out, 5, middle, late)

    def classes():
        return {"majority": models.MajorityClassifier(), "logit": models.Logit()}

    jobs.matrix(spark, out, zoo, classes)
    assert spark.read.parquet(f"{out}/model_matrix").count() == 3 * 4 * 4 + 4
    jobs.stacking(spark, out, classes, horizons=(7,), n_splits=2)
    assert {r["target"] for r in spark.read.parquet(f"{out}/stacking").collect()} == {"beats_median", "top_tercile"}
    jobs.evaluate(spark, out, 7, middle, late, 5, [2021], middle, 10, 100, 3)
    fixed = spark.read.parquet(f"{out}/eval_fixed_split").first()
    assert fixed["tp"] + fixed["fp"] + fixed["fn"] + fixed["tn"] == fixed["n"] and 0 <= fixed["p_value"] <= 1
    book = spark.read.parquet(f"{out}/eval_top_k").collect()
    day = feats.where(feats["date"] == book[0]["date"]).toPandas()
    assert book[0]["benchmark"] == pytest.approx(day["fwd_return_7d"].median(), abs=1e-6)
    assert spark.read.parquet(f"{out}/eval_top_k_t_test").first()["n"] == len(book)
    jobs.score(spark, out)
    assert spark.read.parquet(f"{out}/scores").count() == 5 * 4
    writers.append_new(clean.drop("year"), f"{out}/clean")
    assert readers.read_panel(spark, f"{out}/clean").count() == clean.count()


def test_report_sink(spark, tmp_path):
    d = spark.createDataFrame([("A", "bad_ohlc", 2)], "symbol string, check string, n bigint")
    writers.write_report(d, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == "[A] bad_ohlc: 2"


def test_stream_overlay_equals_batch(spark):
    import __spark_entry__ as entry
    q, sf = entry.queries(), "/root/testdata/sf0.001"
    live = {tuple(r) for r in q["quote_stream"](spark, sf).collect()}
    batch = {tuple(r) for r in q["live_overlay"](spark, sf).where("is_live").collect()}
    assert live == batch and live


T0 = dt.datetime(2024, 3, 1, 10, 0, 0)


class QuoteFeed:
    """Quote files that come one by one, and the stream that reads them."""

    def __init__(self, spark, folder, ttl=60):
        self.spark, self.ttl, self.n = spark, ttl, 0
        self.src, self.out, self.state = (f"{folder}/{x}" for x in ("src", "out", "state"))
        os.makedirs(self.src)
        self.all = []

    def send(self, *rows):
        rows = [(s, T0 + dt.timedelta(seconds=t), x) for s, t, x in rows]
        self.all += rows
        self.spark.createDataFrame(rows, S.QUOTES).coalesce(1).write.mode("append").parquet(self.src)
        return self.run()

    def run(self):
        stream = live_quotes.read_quote_stream(self.spark, self.src)
        query = live_quotes.newest_quotes(stream, self.out, self.state, self.ttl)
        query.awaitTermination()
        return [p for p in query.recentProgress if p["numInputRows"]]

    def live(self, closes):
        got = live_quotes.read_live(self.spark, self.out, closes, self.ttl).select("symbol", "last_close", "is_live")
        quotes = self.spark.createDataFrame(self.all, S.QUOTES)
        want = serving.overlay_quotes(closes, quotes, ttl_seconds=self.ttl).where("is_live")
        rows = {tuple(r) for r in got.collect()}
        assert rows == {tuple(r) for r in want.select("symbol", "last_close", "is_live").collect()}
        return {r[0]: r[1] for r in rows}


def test_quote_state_late_and_replayed(spark, tmp_path):
    closes = spark.createDataFrame([(s, 1.0) for s in "ABCD"], "symbol string, close double")
    feed = QuoteFeed(spark, str(tmp_path))
    assert live_quotes.read_live(spark, feed.out, closes).count() == 0
    feed.send(("A", 0, 10.0), ("B", 5, 20.0), ("Z", 9, 9.0), ("A", 2, 11.0))
    assert feed.live(closes) == {"A": 11.0, "B": 20.0}
    feed.send(("A", 1, 99.0), ("C", 30, 30.0))  # A's quote is older than the one that stands
    assert feed.live(closes) == {"A": 11.0, "B": 20.0, "C": 30.0}
    feed.send(("A", 0, 10.0), ("B", 5, 20.0))  # sent again
    assert feed.live(closes) == {"A": 11.0, "B": 20.0, "C": 30.0}
    feed.send(("D", 80, 40.0))  # A and B are too old by now
    assert feed.live(closes) == {"C": 30.0, "D": 40.0}
    feed.send(("A", 4, 98.0), ("B", 81, 21.0))  # A's quote comes too late to matter
    assert feed.live(closes) == {"B": 21.0, "C": 30.0, "D": 40.0}
    assert feed.live(closes) == feed.live(closes) and not feed.run()
    with pytest.raises(ValueError):
        live_quotes.newest_quotes(spark.readStream.schema(S.QUOTES).parquet(feed.src), feed.out, feed.state, 0)


def test_restarted_batch_gives_the_same_sink(spark, tmp_path):
    """A batch that was written but not committed is run again into its own folder."""
    closes = spark.createDataFrame([("A", 1.0), ("B", 1.0)], "symbol string, close double")
    feed = QuoteFeed(spark, str(tmp_path))
    feed.send(("A", 0, 10.0))
    feed.send(("A", 3, 12.0), ("B", 4, 20.0))
    before = feed.live(closes)
    commits = f"{feed.state}/commits"
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    os.remove(f"{commits}/{last}")
    if os.path.exists(f"{commits}/.{last}.crc"):
        os.remove(f"{commits}/.{last}.crc")
    feed.run()
    assert feed.live(closes) == before == {"A": 12.0, "B": 20.0}


def test_work_per_batch_follows_its_quotes(spark, tmp_path):
    """State and output of a batch are its own symbols, however many are stored."""
    feed = QuoteFeed(spark, str(tmp_path))
    feed.send(*[(f"S{i}", i % 20, 1.0) for i in range(3000)])
    total = feed.send(("S1", 25, 2.0))[0]["stateOperators"][0]
    assert total["numRowsTotal"] == 3000 and total["numRowsUpdated"] <= 2
    folders = sorted(os.listdir(f"{feed.out}/quotes"))
    assert spark.read.parquet(f"{feed.out}/quotes/{folders[-1]}").count() <= 1
    for k in range(6):  # time goes on, a minute a batch: what no longer counts goes
        last = feed.send((f"T{k}", 120 + 60 * k, 3.0))
    assert last[-1]["stateOperators"][0]["numRowsTotal"] < 10
    assert len(os.listdir(f"{feed.out}/quotes")) <= 6
    closes = spark.createDataFrame([(f"T{k}", 1.0) for k in range(6)] + [("S1", 1.0)], "symbol string, close double")
    assert feed.live(closes) == {"T4": 3.0, "T5": 3.0}
