"""Sinks: panels, splits, scaler state, results, models."""

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.schema import LABEL_COLS, FEATURE_COLS
from barloom.session import by_symbol, layout_name

MODEL_DIR, META_DIR, LAYOUT = "pipeline", "metadata", "_layout"


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Clean panel, one folder per year; rows of a year stay in few, sorted files."""
    (df.withColumn("year", F.year("date"))
     .repartitionByRange("year", "symbol", "date").sortWithinPartitions("symbol", "date")
     .write.mode(mode).partitionBy("year").parquet(path))


def append_new(df: DataFrame, path: str) -> None:
    """Append the (symbol, date) keys the stored panel does not hold yet."""
    have = df.sparkSession.read.parquet(path).select("symbol", "date")
    write_panel(df.join(have, ["symbol", "date"], "left_anti"), path, "append")


def feature_columns(df: DataFrame):
    keys = ["date", "symbol", "industry", "adj_close", "close"]
    have = set(df.columns)
    floats = [c for c in (*keys[3:], *FEATURE_COLS, *LABEL_COLS) if c in have]
    return [c for c in keys[:3] if c in have], floats


def narrowed(df: DataFrame) -> DataFrame:
    """The columns of the feature panel, numbers as float32."""
    keys, floats = feature_columns(df)
    return df.select(*keys, *[F.col(c).cast("float").alias(c) for c in floats])


def write_features(df: DataFrame, path: str) -> None:
    """Feature panel as float32, globally ordered by (date, symbol)."""
    (narrowed(df).repartitionByRange("date", "symbol").sortWithinPartitions("date", "symbol")
     .write.mode("overwrite").parquet(path))


def write_by_symbol(df: DataFrame, path: str, buckets: int = None) -> None:
    """A panel keyed (symbol, date) laid out for windows and lookups; see `session.by_symbol`."""
    laid = by_symbol(df, buckets, path)
    spark = df.sparkSession
    kept = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "schema": laid.schema.json()}
    spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}{LAYOUT}")


def read_by_symbol(spark: SparkSession, path: str) -> DataFrame:
    """The panel with its layout, in whichever session: the folder beside it names the buckets."""
    name = layout_name(path)
    if not spark.catalog.tableExists(name):
        kept = json.loads(spark.read.text(f"{path}{LAYOUT}").first()["value"])
        columns = StructType.fromJson(json.loads(kept["schema"])).toDDL()
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, date) "
                  f"INTO {kept['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_splits(tagged: DataFrame, path: str) -> None:
    tagged.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def write_scaler(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_report(findings: DataFrame, path: str) -> None:
    """Audit findings as text lines: [symbol] check: n."""
    line = F.concat(F.lit("["), "symbol", F.lit("] "), "check", F.lit(": "),
                    F.col("n").cast("string"))
    findings.orderBy("symbol", "check").select(line.alias("value")).write.mode(
        "overwrite").text(path)


def save_model(model: PipelineModel, meta: dict, path: str) -> None:
    """Fitted pipeline and its metadata, side by side on the same file system."""
    model.write().overwrite().save(f"{path}/{MODEL_DIR}")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(
        1).write.mode("overwrite").text(f"{path}/{META_DIR}")


def load_model(spark: SparkSession, path: str):
    meta = json.loads(spark.read.text(f"{path}/{META_DIR}").first()["value"])
    return PipelineModel.load(f"{path}/{MODEL_DIR}"), meta
