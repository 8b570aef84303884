"""Forward-looking labels: h days ahead means h rows ahead of the same symbol."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import greater, ratio_change, timeline
from barloom.operators.cross_section import attach, medians
from barloom.operators.order_stats import with_rank
from barloom.operators.technicals import PRICE
from barloom.schema import HORIZONS


def _ahead(h: int):
    return timeline().rowsBetween(1, h)


def add_forward_labels(panel: DataFrame, horizons=HORIZONS) -> DataFrame:
    new = {}
    for h in horizons:
        ret = ratio_change(F.lead(PRICE, h).over(timeline()), PRICE)
        new[f"fwd_return_{h}d"] = ret
        new[f"future_volatility_{h}d"] = F.when(
            F.count("log_return").over(_ahead(h)) == h,
            F.stddev_samp("log_return").over(_ahead(h)))
    out = panel.withColumns(new)
    return out.withColumns({f"positive_return_{h}d": greater(f"fwd_return_{h}d", 0.0)
                            for h in horizons})


def mask_breaks(panel: DataFrame, horizons=HORIZONS) -> DataFrame:
    """NULL return on a break row; NULL labels on rows whose horizon spans one."""
    hit = F.col("corp_action_break").cast("int")
    new = {}
    for h in horizons:
        clean = F.coalesce(F.sum(hit).over(_ahead(h)), F.lit(0)) == 0
        for stem in ("fwd_return", "positive_return", "future_volatility"):
            new[f"{stem}_{h}d"] = F.when(clean, F.col(f"{stem}_{h}d"))
    new["log_return"] = F.when(~F.col("corp_action_break"), F.col("log_return"))
    return panel.withColumns(new)


def melt_horizons(panel: DataFrame, stem: str, keep, horizons=HORIZONS,
                  value: str = "v") -> DataFrame:
    """One row per (row, horizon) of a label family."""
    items = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"{stem}_{h}d").alias(value))
                      for h in horizons])
    return (panel.select(*keep, F.explode(items).alias("_i"))
            .select(*keep, "_i.h", f"_i.{value}"))


def _spread(stats: DataFrame, keys, cols, horizons) -> DataFrame:
    """(keys, h, c) -> one row per keys with columns c_7d, c_30d, ..."""
    return stats.groupBy(*keys).agg(*[
        F.max(F.when(F.col("h") == h, F.col(c))).alias(f"{c}_{h}d")
        for c in cols for h in horizons])


def add_relative_labels(panel: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Return against the date median, and against the sector median of the date
    (date median where the sector has one member)."""
    long = melt_horizons(panel, "fwd_return", ["date", "industry"], horizons)
    by_date = _spread(medians(long, ["date", "h"], "v", "_med", bounded=True), ["date"],
                      ["_med"], horizons)
    peers = long.where(F.col("industry").isNotNull())
    by_sector = _spread(medians(peers, ["date", "industry", "h"], "v", "_smed"),
                        ["date", "industry"], ["_smed"], horizons)
    size = (panel.where(F.col("industry").isNotNull())
            .groupBy("date", "industry").agg(F.count(F.lit(1)).alias("_size")))
    out = attach(panel, by_date, ["date"])
    out = attach(out, attach(size, by_sector, ["date", "industry"]), ["date", "industry"])
    new = {}
    for h in horizons:
        ret, med = F.col(f"fwd_return_{h}d"), F.col(f"_med_{h}d")
        sector = F.when(F.col("_size") > 1, F.col(f"_smed_{h}d")).otherwise(med)
        new[f"rel_return_{h}d"] = ret - med
        new[f"beats_median_{h}d"] = greater(ret, med)
        new[f"rel_return_sector_{h}d"] = ret - sector
        new[f"beats_sector_median_{h}d"] = greater(ret, sector)
    drop = ["_size"] + [f"{p}_{h}d" for p in ("_med", "_smed") for h in horizons]
    return out.withColumns(new).drop(*drop)


def add_rank_labels(panel: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Percent rank within the date (ties averaged) and the outer-tercile label."""
    long = melt_horizons(panel, "fwd_return", ["symbol", "date"], horizons)
    ranked = with_rank(long, ["date", "h"], "v", pct="fwd_return_rank")
    wide = _spread(ranked, ["symbol", "date"], ["fwd_return_rank"], horizons)
    return attach(panel, wide, ["symbol", "date"]).withColumns(
        {f"top_tercile_{h}d": tercile(F.col(f"fwd_return_rank_{h}d")) for h in horizons})


def tercile(rank):
    return F.when(rank <= 1 / 3, F.lit(0.0)).when(rank >= 2 / 3, F.lit(1.0))


def add_vol_adjusted(panel: DataFrame, horizons=HORIZONS) -> DataFrame:
    new = {f"fwd_return_vol_adj_{h}d": F.try_divide(
        F.col(f"fwd_return_{h}d"), F.col("volatility_20") * math.sqrt(h))
        for h in horizons}
    return panel.withColumns(new)


def add_advanced_labels(panel: DataFrame, horizons=HORIZONS) -> DataFrame:
    return add_rank_labels(add_vol_adjusted(panel, horizons), horizons)
