"""The panel kept up to date by appends, against the panel built from all bars."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.cleaning import gate
from barloom.plans import build, refresh
from barloom.schema import FEATURE_COLS, LABEL_COLS
from tests import panels

COLS = [*FEATURE_COLS, *LABEL_COLS]


def day(i):
    return panels.DAY0 + datetime.timedelta(days=i)


@pytest.fixture(scope="module")
def data(spark):
    """AAA and BBB trade always; CCC has no price for a while; DDD stops early; EEE pauses and
    comes back; FFF is listed late; GGG never has a price."""
    d = panels.bars(420).query("symbol != 'DDD' or date < @day(25)").copy()
    rng = np.random.default_rng(5)

    def like(symbol, industry, rows):
        e = d[d.symbol == "AAA"].iloc[rows].copy()
        e["symbol"], e["industry"] = symbol, industry
        e["adj_close"] = e["adj_close"] * np.exp(np.cumsum(rng.normal(0, 0.01, len(e))))
        return e

    gap = [*range(0, 180), *range(385, 420)]
    d = pd.concat([d, like("EEE", "Y", gap), like("FFF", None, range(388, 420)), like("GGG", "X", range(300, 420))])
    d.loc[(d.symbol == "CCC") & d.date.between(day(368), day(392)), "adj_close"] = np.nan
    d.loc[d.symbol == "GGG", "adj_close"] = np.nan
    d["corp_action_break"] = ((d.symbol == "BBB") & d.date.isin([day(350), day(395)]))
    level = 1000 * np.exp(np.cumsum(rng.normal(0, 0.01, 420)))
    d["nifty_close"] = d["date"].map({day(i): None if i < 2 else level[i] for i in range(420)})
    bars = spark.createDataFrame(d.reset_index(drop=True)).withColumn("date", F.col("date").cast("date"))
    bars = bars.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("adj_close", "nifty_close")}).cache()
    vix = spark.createDataFrame([(day(i), 15 + 5 * float(np.sin(i))) for i in range(420)], "date date, close double")
    known = spark.createDataFrame(
        [(s, day(k), day(k - 60), 3.0 + k / 100, 0.1, 0.2, k / 1000.0) for s in ("AAA", "EEE") for k in (5, 300, 401)],
        "symbol string, known_date date, fiscal_year_end date, eps double, fund_roe double,"
        "fund_net_profit_growth double, fund_eps_growth double")
    return bars, vix, known


def between(bars, a, b):
    return bars.where(F.col("date").between(F.lit(day(a)), F.lit(day(b))))


@pytest.fixture(scope="module")
def appended(spark, data, tmp_path_factory):
    bars, vix, known = data
    out = str(tmp_path_factory.mktemp("panel"))
    refresh.start(out, between(bars, 0, 379), vix, known)
    for a, b in ((380, 380), (381, 390), (391, 419)):
        refresh.extend(out, between(bars, a, b).withColumn("extra", F.lit(1)), vix, known)
    return out


def test_appends_equal_a_rebuild(spark, data, appended):
    want = build.feature_panel(*data).toPandas()
    got = spark.read.parquet(f"{appended}/months").toPandas()
    assert want[COLS].notna().sum().min() > 0  # every column is put to the test
    panels.assert_same(got, want, COLS, 1e-9)
    gated = refresh.panel(spark, appended)
    assert gated.count() == gate(build.feature_panel(*data)).count() > 0


def test_state_is_bounded_and_old_versions_go(spark, data, appended):
    assert refresh.through(spark, appended) == day(419)
    versions = {r[0] for r in spark.read.parquet(f"{appended}/tails").select("through").distinct().collect()}
    assert versions == {refresh._version(day(390)), refresh._version(day(419))}
    sizes = spark.read.parquet(f"{appended}/tails").groupBy("through", "symbol").count()
    # GGG has no price: its means are those of its last row. CCC's price is back.
    assert sizes.agg(F.max("count")).first()[0] == refresh.TAIL_ROWS
    assert spark.read.parquet(f"{appended}/days").where(f"through = {refresh._version(day(419))}").count() == refresh.TAIL_DAYS


def test_refused_empty_and_repeated_appends(spark, data, appended):
    bars, vix, known = data
    before = spark.read.parquet(f"{appended}/months").count()
    refresh.extend(appended, bars.limit(0), vix, known)
    for a in (419, 100):
        with pytest.raises(ValueError):
            refresh.extend(appended, between(bars, a, 419), vix, known)
    assert spark.read.parquet(f"{appended}/months").count() == before
    with pytest.raises(ValueError):
        refresh.start(appended + "-none", bars.limit(0), vix, known)


def test_append_leaves_early_months_alone(spark, data, tmp_path):
    """Two traders always: an append writes the months of the last 90 rows, and an interrupted
    one, whose months are there and whose state isn't, is repeated."""
    bars, vix, known = data
    two = bars.where("symbol in ('AAA', 'BBB')")
    out = str(tmp_path / "p")
    assert refresh.covered(spark, out) is None
    refresh.start(out, between(two, 0, 409), vix, known)
    assert refresh.covered(spark, out) == day(409)

    def files():
        kept = spark.read.parquet(f"{out}/months").select("month", F.col("_metadata.file_path").alias("f"))
        return {(r["month"], r["f"]) for r in kept.distinct().collect()}

    before = files()
    refresh.extend(out, between(two, 410, 410), vix, known)
    after, since = files(), refresh._month(F.lit(day(320)))
    first = spark.range(1).select(since).first()[0]
    assert {f for f in before if f[0] < first} == {f for f in after if f[0] < first}
    assert not before & {f for f in after if f[0] >= first}
    for part in ("days", "tails"):
        refresh.remove_folder(spark, f"{out}/{part}/through={refresh._version(day(410))}")
    refresh.extend(out, between(two, 410, 415), vix, known)
    want = build.feature_panel(between(two, 0, 415), vix, known).toPandas()
    panels.assert_same(spark.read.parquet(f"{out}/months").toPandas(), want, COLS, 1e-9)
