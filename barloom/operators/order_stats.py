"""Exact order statistics over groups of any size.

A date's cross-section, a year of a feature or a whole score column can hold a
third of all rows, so none of these sorts a group in one task. A value is mapped
to a `cell` by a fixed non-decreasing function; cells of one group are ordered
like their values. Work then splits in three: a window inside each (group, cell), a
running total over the cells of one range of cells, and one over the ranges of a group.
A range is a fixed stretch of cells, so no task orders more than 65536 of them. Equal values are combined
before the first shuffle, so a value shared by many rows is one row here.

The cell depends on the value only - no sampling, no estimates - so a retried
task or a branch planned twice always agrees with the rest of the job.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A million scores between 0.49 and 0.51 lie in some 2,600 cells; a group has one narrow row
#: per cell that it uses, whatever its rows.
CELLS_PER_E_FOLD = 65536
LINEAR_BELOW = 1e-9
_LIMIT = 1e150
#: Longer than tickers, ISINs and their common prefixes.
TEXT_CELL = 24
#: Cells of one range: a step of e has one, a group at most some 730; texts share a range by prefix.
RANGE_CELLS = 65536
TEXT_RANGE = 3


def cell_of(value: Column, text: bool = False) -> Column:
    """Non-decreasing bucket: linear near zero, logarithmic beyond (1/65536 e-fold)."""
    if text:
        return F.substring(value, 1, TEXT_CELL)
    bounded = F.greatest(F.least(value, F.lit(_LIMIT)), F.lit(-_LIMIT))
    # log1p of the magnitude is non-decreasing in floating point too (asinh is not,
    # below zero); the sign mirrors it.
    size = F.floor(F.log1p(F.abs(bounded) / F.lit(LINEAR_BELOW)) * CELLS_PER_E_FOLD)
    return (F.signum(bounded) * size).cast("long")


def _range_of(cell: Column, text: bool = False) -> Column:
    """Non-decreasing in the cell."""
    return F.substring(cell, 1, TEXT_RANGE) if text else F.floor(cell / F.lit(RANGE_CELLS))


def _running(cells: DataFrame, keys, sums: dict, text: bool = False) -> DataFrame:
    """`cells` (one row per keys and `_cell`) with, for each weight w of `sums`, the sum of w
    over the group's smaller cells and over the whole group, named by `sums[w]`."""
    keys = list(keys)
    c = cells.withColumn("_range", _range_of(F.col("_cell"), text))
    earlier = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*keys, "_range").orderBy("_cell").rowsBetween(*earlier)
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*earlier)
    whole = Window.partitionBy(*keys)
    local = c.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_{w}_near") for w in sums])
    ranges = c.groupBy(*keys, "_range").agg(*[F.sum(w).alias(f"_{w}_range") for w in sums])
    ranges = ranges.select(
        *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_range").alias("_k_range"),
        *[F.coalesce(F.sum(f"_{w}_range").over(across), F.lit(0)).alias(f"_{w}_far") for w in sums],
        *[F.sum(f"_{w}_range").over(whole).alias(total) for w, (_, total) in sums.items()])
    same = F.col("_range") == F.col("_k_range")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    out = local.join(ranges, same)
    return out.select(*cells.columns, *[
        x for w, (before, total) in sums.items()
        for x in ((F.col(f"_{w}_far") + F.col(f"_{w}_near")).alias(before), F.col(total))])


def tie_table(df: DataFrame, keys, value: str, **sums) -> DataFrame:
    """One row per (keys, value): `n` rows, plus a named sum per keyword column."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("n"),
                 *[F.sum(c).alias(name) for name, c in sums.items()]))


def prefix_sums(ties: DataFrame, keys, value: str, weights=("n",)) -> DataFrame:
    """Adds `<w>_before` (sum over smaller values) and `<w>_total` per group.

    `ties` must hold distinct (keys, value) rows.
    """
    keys = list(keys)
    text = dict(ties.dtypes)[value] == "string"
    t = ties.withColumn("_cell", cell_of(F.col(value), text))
    inside = (Window.partitionBy(*keys, "_cell").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = t.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_{w}_in")
                            for w in weights])
    cells = t.groupBy(*keys, "_cell").agg(*[F.sum(w).alias(w) for w in weights])
    offsets = _running(cells, keys, {w: (f"_{w}_off", f"{w}_total") for w in weights}, text).drop(*weights)
    out = local.join(offsets, [*keys, "_cell"])
    for w in weights:
        out = out.withColumn(f"{w}_before", F.col(f"_{w}_off") + F.col(f"_{w}_in"))
    return out.drop("_cell", *[f"_{w}_in" for w in weights], *[f"_{w}_off" for w in weights])


def average_rank() -> Column:
    """1-based rank with ties averaged, from the columns of `prefix_sums`."""
    return F.col("n_before") + (F.col("n") + 1) / 2.0


def with_rank(df: DataFrame, keys, value: str, rank: str = None, pct: str = None,
              below: str = None) -> DataFrame:
    """Adds the average rank, its share of the non-NULL count (`pct`) and/or the
    share of strictly smaller values over all rows' count (`below`). Rows whose
    value is NULL get NULL."""
    keys = list(keys)
    ranks = prefix_sums(tie_table(df, keys, value), keys, value)
    cols = []
    if rank:
        cols.append(average_rank().alias(rank))
    if pct:
        cols.append((average_rank() / F.col("n_total")).alias(pct))
    if below:
        cols.append((F.col("n_before") / F.col("n_total")).alias(below))
    return df.join(ranks.select(*keys, value, *cols), [*keys, value], "left")


def neighbours(df: DataFrame, keys, value: str, probs, bounded: bool = False) -> DataFrame:
    """Per group: `n`, and the two order statistics `lo_i`, `hi_i` that enclose
    each quantile.

    A first pass counts rows per cell (combined on the map side); only rows in the
    cells that hold a wanted position go further. `bounded` states that the number of
    groups is limited by something other than the data - features, models, calendar
    days - so the list of wanted cells, at most 2 per quantile and group, is broadcast
    and the rows are filtered where they lie. Otherwise adaptive execution decides.
    """
    keys = list(keys)
    d = (df.where(F.col(value).isNotNull())
         .select(*keys, F.col(value).alias("_v"), cell_of(F.col(value)).alias("_cell")))
    cells = _running(d.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")), keys, {"_n": ("_off", "n")})

    def spot(p, up):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        return (F.ceil(pos) if up else F.floor(pos)).cast("long")

    wanted = F.lit(False)
    for p in probs:
        for up in (False, True):
            wanted = wanted | ((spot(p, up) >= F.col("_off"))
                               & (spot(p, up) < F.col("_off") + F.col("_n")))
    hit = cells.where(wanted).drop("_n")
    ties = (d.join(F.broadcast(hit) if bounded else hit, [*keys, "_cell"])
            .groupBy(*keys, "_cell", "_off", "n", "_v")
            .agg(F.count(F.lit(1)).alias("_c")))
    upto = (Window.partitionBy(*keys, "_cell").orderBy("_v")
            .rowsBetween(Window.unboundedPreceding, 0))
    placed = ties.withColumn("_end", F.col("_off") + F.sum("_c").over(upto))
    aggs = []
    for i, p in enumerate(probs):
        for name, up in (("lo", False), ("hi", True)):
            aggs.append(F.min(F.when(F.col("_end") > spot(p, up), F.col("_v")))
                        .alias(f"{name}_{i}"))
    return placed.groupBy(*keys, "n").agg(*aggs)


def interpolate(i: int, p: float, lo=None, hi=None) -> Column:
    """Linear interpolation between the order statistics of `neighbours`."""
    lo = F.col(f"lo_{i}") if lo is None else lo
    hi = F.col(f"hi_{i}") if hi is None else hi
    pos = F.lit(float(p)) * (F.col("n") - 1)
    return lo + (hi - lo) * (pos - F.floor(pos))


def quantiles(df: DataFrame, keys, value: str, probs: dict, bounded: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles, one output column per `probs` entry."""
    names, ps = list(probs), list(probs.values())
    found = neighbours(df, keys, value, ps, bounded)
    return found.select(*keys, *[interpolate(i, p).alias(nm)
                                 for i, (nm, p) in enumerate(zip(names, ps))])


def spearman(df: DataFrame, keys, x: str, y: str, out: str = "ic") -> DataFrame:
    """Average-rank correlation of x and y per group, with `n` pairs.

    y is ranked on the rows; x only as distinct values that carry the sum of
    their rows' y ranks, so the rows are never joined to the ranks of x.
    """
    keys = list(keys)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_rank(pairs.select(*keys, x, y), keys, y, rank="_ry")
    return rank_correlation(ranked, keys, x, "_ry", out)


def rank_correlation(ranked: DataFrame, keys, x: str, ry: str, out: str) -> DataFrame:
    """Correlation of the rank of x with an already computed rank column."""
    keys = list(keys)
    ties = prefix_sums(
        tie_table(ranked, keys, x, s=F.col(ry), ss=F.col(ry) * F.col(ry)), keys, x)
    mid = (F.col("n_total") + 1) / 2.0
    rx = average_rank() - mid
    parts = ties.groupBy(*keys).agg(
        F.max("n_total").alias("n"),
        F.sum(rx * (F.col("s") - F.col("n") * mid)).alias("_xy"),
        F.sum(F.col("n") * rx * rx).alias("_xx"),
        F.sum(F.col("ss") - 2 * mid * F.col("s") + F.col("n") * mid * mid).alias("_yy"))
    den = F.sqrt(F.col("_xx") * F.col("_yy"))
    return parts.select(*keys, F.when(den > 0, F.col("_xy") / den).alias(out), "n")


def cells_bound() -> int:
    """Upper bound on the cells of one group, whatever the data."""
    return 2 * math.ceil(math.log1p(_LIMIT / LINEAR_BELOW) * CELLS_PER_E_FOLD)
