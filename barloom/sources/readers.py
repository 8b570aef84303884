"""Readers of the landing files (CSV, declared schemas) and of the stored panels."""

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barloom import schema as S
from barloom.functions.scalar import canon_symbol, fiscal_label, rename_symbol

FILE_STEM = r"([^/]+)\.csv$"
NOT_BARS = [S.LANDING[k].removesuffix(".csv") for k in ("index", "volatility_index")]
SIGNATURE = ["Date", "Close", "Volume"]


def _csv(spark: SparkSession, path, schema, files: DataFrame = None) -> DataFrame:
    """CSV files by the names in their headers, whatever the order; with `file` and `row_no`.

    Files are grouped by header, of which there are few. Each group is one scan with the
    columns in that order, so columns are still pruned; a column that a header lacks is
    NULL. `files` (file, columns) restricts what is read.
    """
    heads = headers(spark, path) if files is None else files
    kinds = {f.name: f.dataType for f in schema}
    orders = sorted(r["columns"] for r in heads.select("columns").distinct().collect())
    out = None
    for order in orders:
        own = StructType([StructField(c if c in kinds else f"_other{i}", kinds.get(c, StringType()))
                          for i, c in enumerate(order)])
        part = spark.read.option("header", True).schema(own).csv(path).select(
            *[(F.col(f"`{c}`") if c in order else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()],
            F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row_no"))
        if files is not None or len(orders) > 1:
            mine = heads.where(F.col("columns") == F.array(*[F.lit(c) for c in order]))
            part = part.join(mine.select("file"), "file", "left_semi")
        out = part if out is None else out.unionByName(part)
    if out is None:  # no file has a header
        out = spark.createDataFrame([], schema).withColumns(
            {"file": F.lit(None).cast("string"), "row_no": F.lit(None).cast("long")})
    return out


def stem(file="file"):
    name = F.regexp_extract(F.col(file), FILE_STEM, 1)
    return F.url_decode(F.regexp_replace(name, r"\+", "%2B"))


def read_bars(spark: SparkSession, path, renames=None, files: DataFrame = None) -> DataFrame:
    """All per-symbol files as one panel, in one scan per kind of header.

    The symbol is the file's name: a column inside the file may spell it
    differently. `row_no` orders the lines of a file.
    """
    raw = _csv(spark, path, S.RAW_BARS, files)
    symbol = canon_symbol(stem())
    symbol = rename_symbol(symbol, renames) if renames else symbol
    return raw.select(
        symbol.alias("symbol"), F.col("Date").alias("date"), F.col("Open").alias("open"),
        F.col("High").alias("high"), F.col("Low").alias("low"), F.col("Close").alias("close"),
        F.col("Adj Close").alias("adj_close"), F.col("Volume").alias("volume"),
        "file", "row_no")


#: Files opened at once by the header pass.
HEADER_READERS = 16


def _first_line(spark: SparkSession, file: str):
    """The first line of a file on any file system that Spark reads; a few KB are fetched."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        text = jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
        return jvm.java.io.BufferedReader(text).readLine()
    finally:
        stream.close()


def headers(spark: SparkSession, path) -> DataFrame:
    """(file, columns) of every CSV file: its first line only. Blank first lines: no row.

    The folder is listed by Spark and no file is scanned: a Python task would read its file to
    the end, so first lines are fetched by a few threads beside the driver, one open call and
    one buffer a file whatever its length. A landing folder has a file per symbol, which bounds
    the list; callers that read twice hand it on.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    files = [r["file"] for r in listed.collect()]
    first = inheritable_thread_target(spark)(lambda f: (f, _first_line(spark, f)))
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        lines = [(f, line) for f, line in pool.map(first, files) if (line or "").lstrip("\ufeff").strip()]
    plain = F.regexp_replace(F.regexp_replace("value", r"[\"\r\uFEFF]", ""), r"\s*,\s*", ",")
    return spark.createDataFrame(lines, "file string, value string").select(
        "file", F.split(F.trim(plain), ",").alias("columns"))


def bar_files(spark: SparkSession, path, signature=SIGNATURE, skip=NOT_BARS, heads: DataFrame = None) -> DataFrame:
    """Files whose header carries the bar signature, without the index files.

    `heads` are the folder's `headers`, where the caller has them already.
    """
    ok = F.lit(True)
    for c in signature:
        ok = ok & F.array_contains("columns", c)
    name = F.regexp_extract("file", FILE_STEM, 1)
    heads = headers(spark, path) if heads is None else heads
    return heads.where(ok & ~name.isin(list(skip)))


def read_signed_bars(spark: SparkSession, path, heads: DataFrame = None, **kw) -> DataFrame:
    """Bars of every file in a mixed folder that has the bar signature.

    The file list is joined to the rows, so it never passes through the driver.
    """
    return read_bars(spark, path, files=bar_files(spark, path, heads=heads), **kw)


def read_master(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path, S.MASTER).select(
        canon_symbol("Symbol").alias("symbol"), F.col("Company Name").alias("company_name"),
        F.col("Industry").alias("industry"))


def read_index(spark: SparkSession, path, prefix: str = "nifty_") -> DataFrame:
    raw = _csv(spark, path, S.RAW_INDEX)
    return raw.select(F.col("Date").alias("date"), *[
        F.col(c).alias(prefix + c.lower().replace(" ", "_"))
        for c in ("Open", "High", "Low", "Close", "Adj Close", "Volume")])


def read_volatility_index(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path, S.RAW_INDEX).select(
        F.col("Date").alias("date"), F.col("Close").alias("close"))


def read_fundamentals(spark: SparkSession, path, renames=None) -> DataFrame:
    d = _csv(spark, path, S.FUNDAMENTALS)
    symbol = canon_symbol("Symbol")
    symbol = rename_symbol(symbol, renames) if renames else symbol
    return d.select(symbol.alias("symbol"), F.col("FiscalYearEnd").alias("fiscal_label"),
                    *[c for c in d.columns if c not in ("Symbol", "FiscalYearEnd", "file", "row_no")])


def read_filings(spark: SparkSession, path, renames=None) -> DataFrame:
    d = _csv(spark, path, S.FILINGS)
    symbol = canon_symbol("Symbol")
    symbol = rename_symbol(symbol, renames) if renames else symbol
    return d.select(symbol.alias("symbol"),
                    fiscal_label("FiscalYearEnd").alias("fiscal_label"),
                    "known_date", "source")


def corporate_actions(spark: SparkSession, breaks_only: bool = False) -> DataFrame:
    rows = [r[:3] for r in S.CORPORATE_ACTIONS if r[3] or not breaks_only]
    return (spark.createDataFrame(rows, "symbol string, type string, date string")
            .withColumn("date", F.col("date").cast("date")))


def read_panel(spark: SparkSession, path, columns=None) -> DataFrame:
    """Stored panel; only the asked-for columns are scanned."""
    d = spark.read.parquet(path)
    return d.select(*columns) if columns else d
