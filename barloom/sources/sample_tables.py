"""Panel-shaped tables derived from the star-schema sample data.

Sums of money and rates run on whole cents and hundredths, so they do not depend
on the order in which rows arrive.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import safe_div

BREAKS = [("Brand1", "1997-03-10"), ("Brand7", "1999-06-15"), ("Brand12", "1998-01-20"),
          ("Brand25", "2000-02-02")]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(col):
    return F.round(F.col(col) * 100).cast("long")


def _branded(spark, sf, symbol="p_brand"):
    name = F.replace(F.col("p_brand"), F.lit("#"), F.lit("")) if symbol == "p_brand" \
        else F.col(symbol)
    part = table(spark, sf, "part").select("p_partkey", name.alias("symbol"))
    return table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def bars(spark: SparkSession, sf: str, symbol: str = "p_brand") -> DataFrame:
    """Daily bars of unit prices per brand (or another part attribute)."""
    px = safe_div("l_extendedprice", "l_quantity")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px")
    sold = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
    rate = F.sum(cents("l_discount")) / (100.0 * F.count(F.lit(1)))
    return (_branded(spark, sf, symbol).withColumn("px", px)
            .groupBy("symbol", F.col("l_shipdate").cast("date").alias("date"))
            .agg(F.min_by("px", seq).alias("open"), F.max("px").alias("high"),
                 F.min("px").alias("low"), F.max_by("px", seq).alias("close"),
                 rate.alias("_rate"), F.sum(sold).cast("long").alias("volume"))
            .select("symbol", "date", "open", "high", "low", "close",
                    (F.col("close") * (1 - F.col("_rate"))).alias("adj_close"), "volume"))


def traded(spark, sf, symbol="p_brand") -> DataFrame:
    return bars(spark, sf, symbol).where("volume > 0")


def industry_of(symbol):
    return F.concat(F.lit("G"), (F.regexp_extract(symbol, r"(\d+)", 1).cast("int") % 5)
                    .cast("string"))


def master(spark, sf) -> DataFrame:
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    return (table(spark, sf, "part").select(brand.alias("symbol")).distinct()
            .select("symbol", F.concat(F.lit("Company "), "symbol").alias("company_name"),
                    industry_of(F.col("symbol")).alias("industry")))


def panel(spark, sf) -> DataFrame:
    """Traded bars with their industry."""
    return traded(spark, sf).withColumn("industry", industry_of(F.col("symbol")))


def index_series(spark, sf) -> DataFrame:
    return (table(spark, sf, "orders")
            .groupBy(F.col("o_orderdate").cast("date").alias("date"))
            .agg((F.sum(cents("o_totalprice")) / (100.0 * F.count(F.lit(1))))
                 .alias("nifty_close"),
                 F.max("o_totalprice").alias("nifty_high")))


def vix_series(spark, sf) -> DataFrame:
    return (table(spark, sf, "orders")
            .groupBy(F.col("o_orderdate").cast("date").alias("date"))
            .agg((F.stddev_samp("o_totalprice") / F.avg("o_totalprice") * 100).alias("close")))


def actions(spark) -> DataFrame:
    return spark.createDataFrame(BREAKS, "symbol string, date string").withColumn(
        "date", F.col("date").cast("date"))


def statement_years(spark, sf) -> DataFrame:
    """Annual statement per brand; every fifth row carries a transition suffix."""
    y = F.year("l_shipdate")
    profit = F.sum(cents("l_extendedprice") * (cents("l_discount") - 5)) / 10000.0
    return (_branded(spark, sf).groupBy("symbol", y.alias("year"))
            .agg(F.count(F.lit(1)).alias("n"), profit.alias("net_profit"),
                 F.sum("l_quantity").alias("equity_capital"),
                 (F.sum(cents("l_tax")) / 100.0).alias("borrowings"))
            .select("symbol", "year", "n", "net_profit",
                    (F.col("net_profit") / 1000).alias("eps"), "equity_capital",
                    F.when(F.col("n") % 3 != 0, F.col("n") * 10.0).alias("reserves"),
                    "borrowings",
                    F.concat(F.lit("Dec "), F.col("year").cast("string"),
                             F.when(F.col("n") % 5 == 0, "15m").otherwise(""))
                    .alias("fiscal_label")))


def filings(spark, sf) -> DataFrame:
    """Known dates for the statement rows whose line count is not a multiple of 4."""
    end = F.make_date(F.col("year"), F.lit(12), F.lit(31))
    return (statement_years(spark, sf).where("n % 4 <> 0")
            .select("symbol", F.concat(F.lit("Dec "), F.col("year").cast("string"))
                    .alias("fiscal_label"),
                    F.date_add(end, (30 + F.col("n") % 60).cast("int")).alias("known_date")))


def announcements(spark, sf) -> DataFrame:
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (table(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("c_mktsegment").alias("symbol"), F.col("o_orderdate").alias("ts"),
                    F.col("o_orderpriority").alias("desc"),
                    F.col("o_orderstatus").alias("attachment")))


def quotes(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("symbol"), "ts",
        F.col("value").alias("ltp"))


def quoted_accounts(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("symbol"), F.col("c_acctbal").alias("close"))


def scored(spark, sf) -> DataFrame:
    """A tied score and a label per line item."""
    return table(spark, sf, "lineitem").select(
        (F.round(F.col("l_discount") * 10, 1)).alias("score"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        "l_quantity", "l_tax", "l_extendedprice")


def statement_cells(spark, sf) -> DataFrame:
    y = F.year("l_shipdate").cast("string")
    return (_branded(spark, sf)
            .groupBy("symbol", F.concat(F.lit("Dec "), y).alias("year"),
                     F.concat("l_returnflag", "l_linestatus").alias("label"))
            .agg(F.concat(F.sum("l_quantity").cast("long").cast("string"), F.lit("%"))
                 .alias("value")))
