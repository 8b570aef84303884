"""Quotes as a stream: the newest quote of every symbol as keyed state, upserted by batch.

Freshness counts from the newest quote of the stream, so a quote that is `ttl_seconds` older
can't become live again. That bounds everything: state is the newest quote per symbol and
window of that length, the watermark lets go of windows (and of late quotes) beyond it, each
batch appends only the symbols whose state it changed, and folders whose newest quote is too
old are removed. No batch reads what earlier ones wrote.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.serving import overlay_quotes
from barloom.schema import QUOTES


def read_quote_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                      max_files: int = 100) -> DataFrame:
    return (spark.readStream.schema(QUOTES).option("maxFilesPerTrigger", max_files)
            .format(fmt).load(path))


def _batches(spark: SparkSession, out_path: str) -> dict:
    """{batch: folder} of what the sink holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/quotes")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return {int(n.split("=")[1]): f"{out_path}/quotes/{n}" for n in names if n.startswith("batch=")}


def _remove_expired(spark: SparkSession, out_path: str, ttl_seconds: int, newest) -> None:
    """Remove the oldest folders as long as no quote in them can be live any more."""
    for _, folder in sorted(_batches(spark, out_path).items())[:-1]:
        last = spark.read.schema(QUOTES).parquet(folder).agg(F.max("ts")).first()[0]
        if last is not None and (newest - last).total_seconds() <= ttl_seconds:
            return
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def newest_quotes(stream: DataFrame, out_path: str, checkpoint: str, ttl_seconds: int = 5,
                  once: bool = True):
    """Start the stream (symbol, ts, ltp) -> changed newest quotes, one folder per batch.

    Quotes may come late, twice and in any order: the newest per symbol wins (ties: the higher
    price). A replayed batch has the same state and overwrites its own folder, so the sink
    stays exact after a restart. Rows without a symbol or a time are left out.
    """
    if ttl_seconds < 1:
        raise ValueError("quotes are fresh for a second at least")
    spark = stream.sparkSession
    newest = (stream.where("symbol is not null and ts is not null")
              .withColumn("ts", F.col("ts").cast("timestamp"))
              .withWatermark("ts", f"{ttl_seconds} seconds")
              .groupBy(F.window("ts", f"{ttl_seconds} seconds"), "symbol")
              .agg(F.max(F.struct("ts", "ltp")).alias("q"))
              .select("symbol", "q.ts", "q.ltp"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        folder = f"{out_path}/quotes/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        last = spark.read.schema(QUOTES).parquet(folder).agg(F.max("ts")).first()[0]
        if last is not None:
            _remove_expired(spark, out_path, ttl_seconds, last)

    w = newest.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_quotes(spark: SparkSession, out_path: str) -> DataFrame:
    """(symbol, ts, ltp): the newest quote of each symbol that the sink still holds."""
    try:
        rows = spark.read.schema(QUOTES).parquet(f"{out_path}/quotes")
    except AnalysisException:  # no such folder: nothing has come yet
        rows = spark.createDataFrame([], QUOTES)
    return rows.groupBy("symbol").agg(F.max(F.struct("ts", "ltp")).alias("q")).select("symbol", "q.ts", "q.ltp")


def read_live(spark: SparkSession, out_path: str, closes: DataFrame, ttl_seconds: int = 5) -> DataFrame:
    """The rows of `closes` (symbol, close) that have a fresh quote, with `last_close`.

    Give the `ttl_seconds` of the stream, or fewer.
    """
    return overlay_quotes(closes, read_quotes(spark, out_path), ttl_seconds=ttl_seconds).where("is_live")
