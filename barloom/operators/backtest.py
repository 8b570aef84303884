"""Portfolio construction and performance on scored cross-sections."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.pvalues import t_test_pvalue
from barloom.operators.cross_section import by_day
from barloom.operators.order_stats import prefix_sums, spearman, tie_table
from barloom.session import materialize

# --- fixed values ---
QUANTILE = 0.20
ROUND_TRIP_COST = 0.0025
REBALANCE_STEP = 60
PERIODS_PER_YEAR = 252 / 60
MIN_NAMES = 30
TOP_K = 5
# --- end of fixed values ---


def basket_sides(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Rows of the long and the short basket of each date (`side` = long/short).

    Names are ordered by score, then symbol. Positions come from the distributed
    prefix sums: scores whose ties fall wholly inside a basket are taken as they
    are, and only the tie group on the boundary is ordered by symbol - again by
    prefix sums. A date of any breadth is never sorted in one task.
    """
    d = scored.where(F.col("score").isNotNull())
    t = prefix_sums(tie_table(d, ["date"], "score"), ["date"], "score")
    k = F.greatest(F.lit(1), F.floor(F.col("n_total") * quantile)).cast("long")
    above = F.col("n_total") - F.col("n_before") - F.col("n")
    t = t.select("date", "score", k.alias("_k"), "n_before", above.alias("_above"),
                 F.col("n").alias("_n"), "n_total")
    # Descending position: [_above, _above + n); the short basket is the last k.
    cut = t.where((F.col("_above") < F.col("_k"))
                  | (F.col("_above") + F.col("_n") > F.col("n_total") - F.col("_k")))
    rows = d.join(cut, ["date", "score"])
    whole = (F.when(F.col("_above") + F.col("_n") <= F.col("_k"), "long")
             .when(F.col("_above") >= F.col("n_total") - F.col("_k"), "short"))
    rows = rows.withColumn("_side", whole)
    split = rows.where(F.col("_side").isNull())
    order = prefix_sums(tie_table(split, ["date", "score"], "symbol"),
                        ["date", "score"], "symbol")
    placed = split.join(order.select("date", "score", "symbol",
                                     F.col("n_before").alias("_at")),
                        ["date", "score", "symbol"])
    pos = F.col("_above") + F.col("_at")
    placed = placed.withColumn("_both", F.array_compact(F.array(
        F.when(pos < F.col("_k"), "long"),
        F.when(pos >= F.col("n_total") - F.col("_k"), "short"))))
    placed = placed.withColumn("side", F.explode("_both"))
    cols = [*scored.columns, "side"]
    taken = rows.where(F.col("_side").isNotNull()).withColumn("side", F.col("_side"))
    # A score can lie wholly in both baskets when one date has very few names.
    both = taken.where((F.col("side") == "long")
                       & (F.col("_above") >= F.col("n_total") - F.col("_k")))
    return (taken.select(*cols).unionByName(placed.select(*cols))
            .unionByName(both.withColumn("side", F.lit("short")).select(*cols)))


def top_k_rows(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best rows per date; the window limit prunes them before the shuffle."""
    w = Window.partitionBy("date").orderBy(F.desc("score"), "symbol")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def turnover(baskets: DataFrame) -> DataFrame:
    """Share of each basket replaced since the side's previous rebalance, 1 at first.

    |A xor B| / 2|A| from counts: a name held on consecutive rebalances is kept.
    """
    dates = baskets.select("side", "date").distinct()
    by_side = Window.partitionBy("side").orderBy("date")
    steps = dates.select("side", "date", F.lag("date").over(by_side).alias("_prev"))
    size = baskets.groupBy("side", "date").agg(F.count(F.lit(1)).alias("names"))
    held = baskets.select("side", "symbol", F.col("date").alias("_prev"))
    kept = (baskets.select("side", "date", "symbol").join(steps, ["side", "date"])
            .join(held, ["side", "symbol", "_prev"], "left_semi")
            .groupBy("side", "date").agg(F.count(F.lit(1)).alias("_kept")))
    prev = size.select("side", F.col("date").alias("_prev"), F.col("names").alias("_pn"))
    out = (steps.join(size, ["side", "date"]).join(prev, ["side", "_prev"], "left")
           .join(kept, ["side", "date"], "left"))
    changed = F.col("names") + F.col("_pn") - 2 * F.coalesce("_kept", F.lit(0))
    return out.select("side", "date", "names",
                      F.when(F.col("_prev").isNull(), 1.0)
                      .otherwise(changed / (2.0 * F.col("names"))).alias("turnover"))


def period_returns(scored: DataFrame, ret: str, quantile: float = QUANTILE,
                   cost: float = ROUND_TRIP_COST, min_names: int = MIN_NAMES) -> DataFrame:
    """One row per rebalance date: gross and net long, net long-short, benchmark.

    `scored` holds rebalance dates only: date, symbol, score and the return column.
    It and the baskets are read several times, so both are written once.
    """
    d = scored.where(F.col("score").isNotNull() & F.col(ret).isNotNull())
    wide = (d.groupBy("date").agg(F.count(F.lit(1)).alias("breadth"))
            .where(F.col("breadth") >= min_names))
    d = materialize(d.join(wide.select("date"), "date", "left_semi").select(
        "date", "symbol", "score", ret))
    bench = (d.groupBy("date").agg(F.count(F.lit(1)).alias("breadth"),
                                   F.avg(ret).alias("benchmark")))
    picks = materialize(basket_sides(d, quantile))
    legs = picks.groupBy("date").pivot("side", ["long", "short"]).agg(F.avg(ret))
    turn = turnover(picks).groupBy("date").pivot("side", ["long", "short"]).agg(
        F.first("turnover"))
    ic = spearman(d, ["date"], "score", ret, "ic").select("date", "ic")
    out = (bench.join(legs, "date")
           .join(turn.select("date", F.col("long").alias("_tl"), F.col("short").alias("_ts")),
                 "date").join(ic, "date", "left"))
    both = (F.col("_tl") + F.col("_ts")) / 2
    return out.select(
        "date", "breadth", F.col("long").alias("long_gross"),
        (F.col("long") - cost * F.col("_tl")).alias("long_net"),
        (F.col("long") - F.col("short") - cost * both * 2).alias("long_short"),
        "benchmark", F.col("_tl").alias("long_turnover"),
        F.col("_ts").alias("short_turnover"), "ic")


def top_k_returns(scored: DataFrame, ret: str, rel: str = None, k: int = TOP_K,
                  cost: float = ROUND_TRIP_COST) -> DataFrame:
    """Top-K book with a full round trip per period; dates with fewer names are skipped.

    The benchmark is mean(ret - rel), the date median, or the universe mean
    when `rel` is not given.
    """
    base = F.col(ret) - F.col(rel) if rel else F.col(ret)
    bench = (scored.groupBy("date").agg(F.count(F.lit(1)).alias("breadth"),
                                        F.avg(base).alias("benchmark"))
             .where(F.col("breadth") >= k))
    book = top_k_rows(scored, k).groupBy("date").agg(F.avg(ret).alias("gross"))
    return (bench.join(book, "date")
            .withColumn("net", F.col("gross") - cost)
            .withColumn("excess", F.col("net") - F.col("benchmark")))


def compounded(col: str, over=None):
    """Running product of 1 + r, exact through losses of 100% and more.

    log|1 + r| is summed, the sign is the parity of the negative factors, and a
    total loss pins the product at zero. One row per rebalance date.
    """
    w = (over or by_day()).rowsBetween(Window.unboundedPreceding, 0)
    g = 1 + F.col(col)
    size = F.exp(F.sum(F.when(g != 0, F.ln(F.abs(g)))).over(w))
    flips = F.sum((g < 0).cast("int")).over(w)
    dead = F.max((g == 0).cast("int")).over(w) == 1
    return F.when(dead, 0.0).otherwise(F.when(flips % 2 == 1, -size).otherwise(size))


def equity_curve(periods: DataFrame) -> DataFrame:
    return periods.withColumns({
        "long_equity": compounded("long_net"), "ls_equity": compounded("long_short"),
        "bench_equity": compounded("benchmark")})


def performance(periods: DataFrame, col: str, ppy: float = PERIODS_PER_YEAR) -> DataFrame:
    """Annualised return and volatility, Sharpe, total return, maximum drawdown."""
    eq = periods.where(F.col(col).isNotNull()).select("date", col, compounded(col).alias("_eq"))
    peak = F.max("_eq").over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    d = eq.withColumn("_dd", F.try_divide(F.col("_eq"), peak) - 1)
    # Undefined when the mean period loses everything or more.
    ann = F.when(F.avg(col) > -1, F.pow(1 + F.avg(col), F.lit(ppy)) - 1)
    vol = F.stddev_samp(col) * F.sqrt(F.lit(ppy))
    return d.agg(
        F.count(F.lit(1)).alias("periods"), ann.alias("ann_return"), vol.alias("ann_vol"),
        F.when(vol > 0, ann / vol).alias("sharpe"),
        (F.max_by("_eq", "date") - 1).alias("total_return"),
        F.min("_dd").alias("max_drawdown")).withColumn("book", F.lit(col))


def performance_table(periods: DataFrame, ppy: float = PERIODS_PER_YEAR,
                      books=("long_net", "long_gross", "long_short", "benchmark")) -> DataFrame:
    parts = [performance(periods, b, ppy) for b in books]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def excess_summary(periods: DataFrame, ppy: float = PERIODS_PER_YEAR) -> DataFrame:
    """Excess over the benchmark, information ratio, t-test, IC statistics, hit rate."""
    d = periods.withColumn("_x", F.col("long_net") - F.col("benchmark"))
    n, m, s = F.count("_x"), F.avg("_x"), F.stddev_samp("_x")
    mi, si = F.avg("ic"), F.stddev_samp("ic")
    return d.agg(
        n.alias("periods"), F.avg("breadth").alias("avg_breadth"),
        (m * ppy).alias("excess_ann"),
        F.try_divide(m * F.sqrt(F.lit(ppy)), s).alias("information_ratio"),
        F.try_divide(m * F.sqrt(n), s).alias("excess_t"),
        mi.alias("mean_ic"), si.alias("ic_std"),
        F.try_divide(mi * F.sqrt(F.count("ic")), si).alias("ic_ir"),
        (mi * F.sqrt(F.avg("breadth"))).alias("implied_ir"),
        F.avg((F.col("long_net") > F.col("benchmark")).cast("double")).alias("hit_rate"),
    ).withColumn("excess_p", t_test_pvalue("excess_t", (F.col("periods") - 1).cast("double")))


def top_k_summary(periods: DataFrame) -> DataFrame:
    total = {c: (F.max_by(f"_{c}", "date") - 1).alias(f"cum_{c}")
             for c in ("gross", "net", "benchmark")}
    d = periods.withColumns({f"_{c}": compounded(c) for c in total})
    n, m, s = F.count("excess"), F.avg("excess"), F.stddev_samp("excess")
    return d.agg(n.alias("periods"), *total.values(), m.alias("mean_excess"),
                 F.try_divide(m * F.sqrt(n), s).alias("t")).withColumn(
        "p_value", t_test_pvalue("t", (F.col("periods") - 1).cast("double")))


def curve_summary(curve: DataFrame) -> DataFrame:
    """Periods, total returns of the books, and the share of periods that beat the benchmark.

    `curve` is what `equity_curve` gives: one row per rebalance date. Without rows the totals
    are NULL.
    """
    total = {"long_total": "long_equity", "ls_total": "ls_equity", "bench_total": "bench_equity"}
    return curve.agg(
        F.count(F.lit(1)).alias("periods"),
        *[(F.max_by(c, "date") - 1).alias(n) for n, c in total.items()],
        F.avg((F.col("long_net") > F.col("benchmark")).cast("double")).alias("beat_share"))
