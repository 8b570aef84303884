"""Exponentially weighted means as a blocked scan of built-in expressions."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import timeline

#: How far, in natural logarithms, weights fall inside a block; e^-500 is a normal double.
_FALL = 500.0


def _carry(name):
    """What the earlier blocks leave: their ends, each faded since."""
    def add(acc, s):
        return acc + F.when(s["b"] < F.col("_b"), s[f"e_{name}"] * F.exp(s[f"d_{name}"] - F.col(f"_d_{name}"))
                            ).otherwise(0.0)
    return F.aggregate("_ends", F.lit(0.0), add)


def add_ewm(df: DataFrame, specs, key: str = "symbol") -> DataFrame:
    """Adds e_0 = x_0, e_t = (1-a) e_{t-1} + a x_t with a = 2/(span+1).

    `specs` lists (source, span, output). A missing value repeats the last mean, and the
    next value meets weights that have faded for every row between: after g rows it is
    e = (w e' + a x) / (w + a) with w = (1-a)^g. Before the first value there is no mean.

    Every row thus multiplies the mean by some factor and adds something. The logarithms of
    the factors are summed along the symbol; a block is a stretch in which the sum of each
    row's steepest factor falls by `_FALL`, so all means share their blocks, and inside one the
    scan is a rescaled running sum. The ends of the earlier blocks (a block has some 250 * span
    rows of the shortest span) are folded into the carry of the next. Every window uses the
    symbol's own partitioning, so no exchange is added, and two sorts serve all means.
    """
    keep = df.columns
    order = timeline(key)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_rn", F.row_number().over(order))
    sources = list(dict.fromkeys(src for src, _, _ in specs))
    at = {src: f"_at_{i}" for i, src in enumerate(sources)}
    out = out.withColumns({at[s]: F.last(F.when(F.col(s).isNotNull(), F.col("_rn")), ignorenulls=True)
                           .over(before) for s in sources})
    fall, add = {}, {}
    for src, span, name in specs:
        a = 2.0 / (span + 1)
        gap = F.col("_rn") - F.col(at[src])
        w = F.exp(gap * math.log(1 - a)) if a < 1 else F.lit(0.0)
        # Without a gap w + a is 1. A first value starts afresh.
        share = F.when(gap == 1, F.lit(1.0)).otherwise(w + a)
        there, first = F.col(src).isNotNull(), F.col(at[src]).isNull()
        step = F.when(gap == 1, F.lit(-math.log(1 - a) if a < 1 else _FALL)).otherwise(
            F.least(F.log(share) - gap * (math.log(1 - a) if a < 1 else -_FALL), F.lit(_FALL)))
        fall[f"_f_{name}"] = F.when(there & ~first, step).otherwise(0.0)
        add[f"_u_{name}"] = (F.when(~there, 0.0).when(first, F.col(src))
                             .otherwise(F.col(src) * a / share))
    out = out.withColumns({**fall, **add})
    out = out.withColumn("_f", F.greatest(*fall) if len(fall) > 1 else F.col(next(iter(fall))))
    out = out.withColumns({f"_d_{n}": F.sum(f"_f_{n}").over(upto) for _, _, n in specs}
                          | {"_b": F.floor(F.sum("_f").over(upto) / _FALL).cast("int")})
    out = out.withColumn("_last", F.lead("_b").over(order) > F.col("_b"))
    inside = Window.partitionBy(key, "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_s_{n}": F.col(f"_d_{n}") - F.first(f"_d_{n}").over(inside) for _, _, n in specs})
    out = out.withColumns({f"_l_{n}": F.exp(-F.col(f"_s_{n}")) * F.sum(
        F.col(f"_u_{n}") * F.exp(F.col(f"_s_{n}"))).over(inside) for _, _, n in specs})
    end = F.struct(F.col("_b").alias("b"), *[F.col(f"_l_{n}").alias(f"e_{n}") for _, _, n in specs],
                   *[F.col(f"_d_{n}").alias(f"d_{n}") for _, _, n in specs])
    out = out.withColumn("_ends", F.collect_list(F.when(F.col("_last"), end)).over(Window.partitionBy(key)))
    final = {}
    for src, _, n in specs:
        seen = F.col(at[src]).isNotNull() | F.col(src).isNotNull()
        final[n] = F.when(seen, F.col(f"_l_{n}") + _carry(n))
    return out.withColumns(final).select(*keep, *[n for _, _, n in specs])
