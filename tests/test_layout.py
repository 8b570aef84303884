"""Tables laid out by symbol: plans without exchanges, lookups that open one file."""

import os
import re

import pytest
from pyspark.sql import functions as F

from barloom.operators import labels, serving
from barloom.operators.cleaning import row_asof
from barloom.operators.technicals import add_technicals
from barloom.session import by_symbol, layout_name
from barloom.sources import writers
from tests import panels


@pytest.fixture(scope="module")
def bars(spark):
    one = spark.createDataFrame(panels.bars())
    many = one.crossJoin(spark.range(12)).withColumn("symbol", F.concat("symbol", "id")).drop("id")
    return many.withColumns({"date": F.col("date").cast("date"), "corp_action_break": F.lit(False)})


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)


def records_read(spark, df):
    """(rows, records that the scans of the job handed on)."""
    sc = spark.sparkContext
    group = f"lookup-{id(df)}"
    sc.setJobGroup(group, "lookup")
    rows = df.collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    store, n = sc._jsc.sc().statusStore(), 0
    for job in sc.statusTracker().getJobIdsForGroup(group):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            n += store.lastStageAttempt(stage).inputRecords()
    return rows, n


def test_windows_and_joins_stay_where_the_rows_lie(spark, bars):
    laid = by_symbol(bars, 8)
    full = labels.mask_breaks(labels.add_forward_labels(add_technicals(laid)))
    assert exchanges(full) == []
    again = by_symbol(full, 8)
    narrow = by_symbol(again.groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("n")), 8)
    joined = again.join(narrow, ["symbol", "date"])
    assert exchanges(joined) == []
    assert joined.count() == bars.count() == joined.where("n = 1").count()
    want = labels.mask_breaks(labels.add_forward_labels(add_technicals(bars))).select("symbol", "date", "rsi_14", "fwd_return_30d")
    assert want.exceptAll(joined.select(*want.columns)).count() == 0


def test_rows_written_where_they_lie(spark, bars, tmp_path):
    laid = by_symbol(bars, 8)
    path = str(tmp_path / "again")
    again = by_symbol(labels.add_forward_labels(add_technicals(laid)), 8, path, dealt=True)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) == len({f.split("_")[1] for f in files}) <= 8  # one file a bucket
    assert exchanges(labels.mask_breaks(again)) == [] and again.count() == bars.count()
    elsewhere = by_symbol(bars.repartition(5, "date"), 8, str(tmp_path / "b"), dealt=True)  # a wrong hint
    assert exchanges(add_technicals(elsewhere)) == [] and elsewhere.exceptAll(bars).count() == 0


def test_lookup_opens_one_file(spark, bars, tmp_path):
    path = str(tmp_path / "panel")
    writers.write_by_symbol(bars, path, 16)
    spark.sql(f"DROP TABLE {layout_name(path)}")  # as another session finds it
    stored = writers.read_by_symbol(spark, path)
    assert stored.columns == bars.columns and stored.count() == bars.count()
    for symbol in ("AAA3", "DDD11"):
        rows, n = records_read(spark, row_asof(stored, symbol, "2020-03-01"))
        assert rows == row_asof(bars, symbol, "2020-03-01").collect()
        assert 0 < n <= stored.count() / 4
    assert row_asof(stored, "nobody", "2020-03-01").count() == 0
    assert exchanges(add_technicals(stored)) == []
    panel = bars.withColumns({"price_to_sma20": F.lit(0.1), "price_to_sma50": F.lit(0.2), "rsi_14": F.lit(50.0)})
    writers.write_by_symbol(panel, path, 4)  # overwritten with another layout
    got = writers.read_by_symbol(spark, path)
    assert serving.history(got, "bbb7", 30).collect() == serving.history(panel, "BBB7", 30).collect()


def test_one_symbol_of_a_shared_file(spark, bars, tmp_path):
    """Row groups of the other symbols in the file are passed over."""
    path = str(tmp_path / "one")
    many = bars.withColumn("date", F.explode(F.sequence(F.date_add("date", 0), F.date_add("date", 59 * 300), F.expr("interval 300 days"))))
    by_symbol(many, 1, path, row_group_bytes=64 << 10)
    table = spark.table(layout_name(path))
    rows, n = records_read(spark, table.where("symbol = 'BBB5'").agg(F.count(F.lit(1)), F.max("close")))
    assert rows[0][0] == many.where("symbol = 'BBB5'").count() and n < many.count() / 4


def test_empty_panel(spark, bars):
    assert by_symbol(bars.limit(0), 3).count() == 0
