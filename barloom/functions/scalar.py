"""Column helpers: division, rolling frames, symbols, numeric text, tiers."""

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INF = float("inf")


def safe_div(num, den) -> Column:
    """num/den with float semantics: x/0 is +-inf by the sign of x, 0/0 is NULL."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    at_zero = F.when(n > 0, F.lit(INF)).when(n < 0, F.lit(-INF))
    return F.when(d == 0, at_zero).otherwise(F.try_divide(n, d))


def ratio_change(num, den) -> Column:
    return safe_div(num, den) - 1


def timeline(*keys) -> Window:
    """Rows of one symbol in date order.

    A panel holds at most one row per (symbol, date) - `unique_bars` enforces it
    with a map-side combined group-by - so such a group is bounded by the length
    of the calendar (about 250 rows a year) however many rows the source has.
    """
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("date")


def trailing(width: int, over=None):
    return (over or timeline()).rowsBetween(-(width - 1), 0)


def filled(col, width: int, over=None) -> Column:
    """True when the last `width` rows all have a value. Two running counts, so the
    check costs the same for every width."""
    w, c = over or timeline(), _c(col)
    upto = F.count(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.count(c).over(w.rowsBetween(Window.unboundedPreceding, -width))
    return upto - before == width


def rolling(agg, col, width: int, over=None) -> Column:
    """agg over the last `width` rows, NULL until `width` non-NULL values exist."""
    c = _c(col)
    return F.when(filled(c, width, over), agg(c).over(trailing(width, over)))


def lag_by(col, n: int, over=None) -> Column:
    return F.lag(_c(col), n).over(over or timeline())


def clip(col, lo=None, hi=None) -> Column:
    """Bound a value; NULL stays NULL (greatest/least would skip it)."""
    c = _c(col)
    out = c
    if lo is not None:
        out = F.greatest(out, _c(lo) if isinstance(lo, (str, Column)) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, _c(hi) if isinstance(hi, (str, Column)) else F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def canon_symbol(col) -> Column:
    return F.regexp_replace(_c(col), "&", "")


def rename_symbol(col, renames: dict) -> Column:
    """Replace renamed tickers; the table is a short literal list."""
    c = _c(col)
    return reduce(lambda acc, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(acc),
                  sorted(renames.items()), c)


def parse_number(col) -> Column:
    """Numeric text with thousands commas and percent signs; blanks and '-' are NULL."""
    return F.regexp_replace(_c(col), "[,%]", "").try_cast("double")


def fiscal_label(col) -> Column:
    """Fiscal label without its trailing digits-and-m run.

    The run is greedy, so a transition year such as 'Mar 201615m' loses its year
    too, does not parse, and is dropped by the callers.
    """
    return F.trim(F.regexp_replace(_c(col), r"\d+m$", ""))


def fiscal_year_end(col) -> Column:
    """Month end of a 'Mon YYYY' label; NULL when it does not parse."""
    return F.last_day(F.try_to_timestamp(fiscal_label(col), F.lit("MMM yyyy")).cast("date"))


def greater(a, b) -> Column:
    """1.0/0.0 for a > b, NULL when a is NULL."""
    a, b = _c(a), (_c(b) if isinstance(b, (str, Column)) else F.lit(b))
    return F.when(a.isNotNull(), (a > b).cast("double"))


def signal_label(prob, hi: float, lo: float) -> Column:
    p = _c(prob)
    return (F.when(p >= hi, "Positive").when(p <= lo, "Negative")
            .when(p.isNotNull(), "Neutral"))


def tier_label(share, hi: float, lo: float) -> Column:
    s = _c(share)
    return F.when(s >= hi, "High").when(s <= lo, "Low").when(s.isNotNull(), "Medium")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
