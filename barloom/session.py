"""Session settings the jobs rely on, and the durable cut of long lineages."""

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, **extra) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("barloom")
    conf = dict(SETTINGS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one on local masters only."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    made = tempfile.mkdtemp(prefix="barloom-ckpt-")
    sc.setCheckpointDir(made)
    return made


_OWNED: list[list[str]] = []


@contextlib.contextmanager
def job_tables(spark: SparkSession):
    """Owns the tables that `materialize` writes inside, and removes them at the end.

    Results must be written by then: frames that read such a table are of no use after it.
    """
    _OWNED.append([])
    try:
        yield
    finally:
        for path in _OWNED.pop():
            remove_folder(spark, path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def outer_tables():
    """Tables written inside belong to the job around the current one, if there is one."""
    own = _OWNED.pop()
    try:
        yield
    finally:
        _OWNED.append(own)


def apply_settings(spark: SparkSession) -> None:
    """The SQL settings the jobs rely on, on a session that somebody else has made."""
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and return a frame reading it.

    For inputs that several branches of a job read: they are computed once, the
    branches prune columns, and the planner knows the real size. The table lies in
    shared storage, so it survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_symbol(df: DataFrame, buckets: int = None, path: str = None, key: str = "symbol",
              order: str = "date", row_group_bytes: int = 8 << 20, dealt: bool = False) -> DataFrame:
    """Write `df` in `buckets` files by a hash of the key, sorted by (key, order), and read it.

    The planner knows the layout: windows by key and joins of two such tables need no exchange,
    and a lookup of one key opens one file, in which the row groups' statistics and a Bloom
    filter name the rows. A key's rows lie in one file, so keys must be bounded (one row per
    calendar day). `buckets` defaults to the session's shuffle partitions. Say `dealt` where
    the last step was a window or aggregate by the key: rows are then written where they lie.
    A wrong hint makes more files, not another result. Without a `path` it is a job table.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if path is None:
        path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
        if _OWNED:
            _OWNED[-1].append(path)
    name = layout_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = df if dealt else df.repartition(buckets, key)
    (rows.write.mode("overwrite").format("parquet").option("path", path)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", row_group_bytes)
     .bucketBy(buckets, key).sortBy(key, order).saveAsTable(name))
    return spark.table(name)


def layout_name(path: str) -> str:
    """The name under which a session knows the table in a folder."""
    return f"barloom_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
