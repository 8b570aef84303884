"""Minimum slice: bars -> holiday filter -> short-window features -> top names."""

from pyspark.sql import DataFrame, SparkSession

from barloom.operators import serving, technicals as tech
from barloom.sources import sample_tables as st


def momentum_leaders(spark: SparkSession, sf: str, limit: int = 5) -> DataFrame:
    bars = st.traded(spark, sf, "p_type")
    d = tech.add_features(bars, tech.log_return(), tech.sma_ratio((10, 20)),
                          tech.rate_of_change((5, 20)))
    return serving.top_ranked(serving.latest_rows(d), "roc_20", limit).select(
        "symbol", "date", "close", "log_return", "price_to_sma20", "roc_5", "roc_20")
