"""Portfolio operators: published curve statistics and brute-force baskets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest

# Date, net long, long-short, benchmark, IC of 22 published periods.
CURVE = [
    ("2021-01-04", 0.352042334410714, 0.217315072091429, 0.142106850000284, 0.107157840660987),
    ("2021-04-07", 0.106338897178571, -0.025873046525, 0.145436991421277, -0.0617920287683548),
    ("2021-07-13", 0.252803594933333, 0.112182383366667, 0.141115683165563, 0.0689055420006971),
    ("2021-10-08", 0.0514130906266667, 0.07910120106, 0.0166887923234868, 0.222554828832893),
    ("2022-01-05", 0.10681711707, 0.0400353681566667, 0.0261979102773947, -0.0609319363855685),
    ("2022-04-04", -0.140575086566667, -0.00744925945000005, -0.110842955000654, -0.0835075657057081),
    ("2022-06-30", 0.22853821553125, 0.175550649875, 0.153003177962733, 0.357723717506326),
    ("2022-09-27", 0.004123573271875, -0.081289784278125, 0.0513241090541481, -0.169626891686107),
    ("2022-12-23", -0.05588682555625, -0.073759557628125, -0.0137554592759259, -0.0748968684418138),
    ("2023-03-22", 0.19287884553125, 0.0565328640625, 0.177258479457407, 0.0765424571772931),
    ("2023-06-21", 0.214943977415625, 0.084687969409375, 0.153487284204878, 0.234437446438045),
    ("2023-09-15", 0.22800648230625, 0.0612610650875, 0.158857404893902, 0.0444819283664114),
    ("2023-12-15", 0.154233906903125, 0.116436984103125, 0.0880247580006098, 0.155942486362956),
    ("2024-03-18", 0.2879323645, 0.198449235584848, 0.214821439792727, 0.309515667993482),
    ("2024-06-19", 0.0797050933, -0.0279950756090909, 0.0897165875767857, -0.226479416484023),
    ("2024-09-13", -0.0324594465272727, 0.0616321339575758, -0.0159669103392857, 0.14534245119229),
    ("2024-12-11", -0.1357395279, 0.0107146662212122, -0.138737507197041, 0.0522723882452389),
    ("2025-03-10", 0.215692967575758, 0.0101033433515151, 0.195724546363314, 0.0263960021878574),
    ("2025-06-10", -0.0367022267314286, -0.0150503897171429, -0.0125156376108571, -0.0703985669502911),
    ("2025-09-04", 0.13374873748, 0.144673157151429, 0.0581595698664972, 0.342930350928827),
    ("2025-12-02", 0.0579974045628572, 0.135333739734286, -0.00851804975977654, 0.301935429874668),
    ("2026-03-02", -0.0238660453228571, -0.0836037660371429, 0.025946628347191, -0.143341677935248),
]


@pytest.fixture(scope="module")
def curve(spark):
    d = spark.createDataFrame(
        CURVE, "date string, long_net double, long_short double, benchmark double, ic double")
    return (d.withColumn("date", F.col("date").cast("date"))
            .withColumns({"breadth": F.lit(162.5909090909091), "long_gross": F.col("long_net")}))


def test_published_statistics(curve):
    # The statistics published for this curve.
    books = {r["book"]: r for r in backtest.performance_table(
        curve, books=("long_net", "long_short", "benchmark")).collect()}
    assert books["long_net"]["sharpe"] == pytest.approx(1.7846755072781386, abs=1e-9)
    assert books["long_net"]["ann_return"] == pytest.approx(0.5031809828575302, abs=1e-9)
    assert books["long_net"]["max_drawdown"] == pytest.approx(-0.16379294447976533, abs=1e-9)
    assert books["long_short"]["sharpe"] == pytest.approx(1.3605962174186021, abs=1e-9)
    assert books["benchmark"]["sharpe"] == pytest.approx(1.6505053065257291, abs=1e-9)
    s = backtest.excess_summary(curve).first()
    assert s["information_ratio"] == pytest.approx(1.0234767708599934, abs=1e-9)
    assert s["excess_ann"] == pytest.approx(0.13448662508937262, abs=1e-9)
    assert s["excess_p"] == pytest.approx(0.029089698387404918, abs=1e-9)
    assert s["mean_ic"] == pytest.approx(0.07068925388231168, abs=1e-9)
    assert s["ic_ir"] == pytest.approx(1.9208198434821706, abs=1e-9)
    end = backtest.equity_curve(curve).orderBy(F.desc("date")).first()
    assert end["long_equity"] == pytest.approx(7.149455227647805, rel=1e-9)


def _brute(rows, quantile=0.2):
    want = set()
    for d in {r[1] for r in rows}:
        day = sorted((r for r in rows if r[1] == d), key=lambda r: (-r[2], r[0]))
        k = max(1, int(len(day) * quantile))
        want |= {(r[0], d, "long") for r in day[:k]} | {(r[0], d, "short") for r in day[-k:]}
    return want


def test_baskets_with_ties_and_a_crowded_date(spark):
    rng = random.Random(1)
    rows = [(f"S{i:03d}", 1, float(rng.randint(0, 4))) for i in range(400)]
    rows += [(f"S{i:03d}", d, rng.random()) for d in (2, 3) for i in range(11)]
    rows += [("S000", 4, 1.0), ("S000", 5, 2.0), ("S001", 5, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, date int, score double")
    got = {(r["symbol"], r["date"], r["side"]) for r in backtest.basket_sides(df).collect()}
    assert got == _brute(rows)


def test_turnover(spark):
    rows = [(s, d, "long") for d, names in ((1, "abcd"), (2, "abxy"), (3, "abxy"))
            for s in names]
    df = spark.createDataFrame(rows, "symbol string, date int, side string")
    got = {r["date"]: r["turnover"] for r in backtest.turnover(df).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.0}


def test_compounding_survives_total_loss(spark):
    df = spark.createDataFrame([(1, 0.5), (2, -1.0), (3, 0.2)], "date int, r double")
    got = [r["e"] for r in df.withColumn("e", backtest.compounded("r")).orderBy("date").collect()]
    assert got[0] == pytest.approx(1.5) and got[1:] == [0.0, 0.0]
    df = spark.createDataFrame([(1, -3.0), (2, 0.5), (3, -2.0)], "date int, r double")
    got = [r["e"] for r in df.withColumn("e", backtest.compounded("r")).orderBy("date").collect()]
    assert got == pytest.approx([-2.0, -3.0, 3.0])
    assert not any(math.isnan(x) for x in got)


def test_curve_summary_of_the_published_periods(curve):
    got = backtest.curve_summary(backtest.equity_curve(curve)).first()
    books = {"long_total": 1, "ls_total": 2, "bench_total": 3}
    for name, i in books.items():
        assert got[name] == pytest.approx(math.prod(1 + row[i] for row in CURVE) - 1, rel=1e-12)
    assert got["periods"] == len(CURVE)
    assert got["beat_share"] == pytest.approx(sum(row[1] > row[3] for row in CURVE) / len(CURVE))
    none = backtest.curve_summary(backtest.equity_curve(curve.limit(0))).first()
    assert none["periods"] == 0 and none["long_total"] is None and none["beat_share"] is None
