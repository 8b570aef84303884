"""Feature build: clean bars in, gated feature panel out.

The order is part of the meaning: breaks are masked after the market and sector
features, so those still hold the break-day return, while medians, ranks and
terciles are taken after the mask.
"""

from pyspark.sql import DataFrame

from barloom.operators import cleaning, cross_section as xs, fundamentals as fund, labels
from barloom.operators.technicals import add_technicals
from barloom.session import by_symbol


def feature_panel(clean: DataFrame, vix: DataFrame, known: DataFrame) -> DataFrame:
    """All features and labels of a clean panel, before the gate.

    The tables written on the way are laid out by symbol, so only the clean bars, the prices
    that the as-of join merges with the statements, and the few label columns that come back
    from the cross-section are ever dealt by symbol: technicals, labels, break mask and the
    final joins run where the rows lie.
    """
    bars = by_symbol(clean)
    laid = by_symbol(labels.add_forward_labels(add_technicals(bars)), dealt=True)
    regime = xs.add_sector_return(xs.add_market_regime(laid, vix))
    masked = by_symbol(labels.mask_breaks(regime), dealt=True)
    # Labels are worked out on the few columns they need, then joined once.
    narrow = masked.select("symbol", "date", "industry", "volatility_20",
                           *[f"fwd_return_{h}d" for h in labels.HORIZONS])
    ranked = labels.add_advanced_labels(labels.add_relative_labels(narrow))
    new = [c for c in ranked.columns if c not in narrow.columns]
    # The point-in-time columns likewise.
    priced = fund.add_fundamentals(masked.select("symbol", "date", "adj_close"), known)
    facts = [c for c in priced.columns if c not in ("symbol", "date", "adj_close")]
    return (masked.join(by_symbol(ranked.select("symbol", "date", *new)), ["symbol", "date"])
            .join(by_symbol(priced.select("symbol", "date", *facts), dealt=True), ["symbol", "date"]))


def build(bars: DataFrame, master: DataFrame, index: DataFrame, vix: DataFrame,
          actions: DataFrame, known: DataFrame) -> DataFrame:
    clean = cleaning.clean_panel(bars, master, index, actions)
    return cleaning.gate(feature_panel(clean, vix, known))
