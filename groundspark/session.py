"""Session helpers: reading tables and cutting lineage in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("groundspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where a scan gives fewer partitions than there are cores (one small file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts cost more than to move them."""
    return spread(table(spark, sf_dir, name))


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where the session has none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="groundspark-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    spark.sparkContext.setCheckpointDir(_OWN[0])
    return _OWN[0]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone by now
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage (a lost executor costs no recomputation before this point) and, unlike ``checkpoint()``, keeps column
    pruning and filter pushdown for every later use. Files are removed when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    atexit.register(_drop, spark, path)
    return spark.read.parquet(path)


#: Rows that one task puts in order.
BLOCK = 200_000


def in_blocks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds _block: blocks of about BLOCK rows that follow each other in the given order (0 first). No task orders more than a block,
    whatever the keys, as long as the whole order tells rows apart."""
    n = df.count()
    return stage(df.repartitionByRange(max(1, -(-n // BLOCK)), *order).withColumn("_block", F.spark_partition_id()), name)


def block_starts(sums: DataFrame, columns: list[str]) -> DataFrame:
    """_block and s_<column>: what comes before each block, from one row of sums a block."""
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    return sums.select("_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"s_{c}") for c in columns])


def numbered(df: DataFrame, order: list[Column], column: str) -> DataFrame:
    """Adds ``column``: the place of each row in the order, from 1."""
    b = in_blocks(df, order, "numbered")
    start = block_starts(b.groupBy("_block").agg(F.count(F.lit(1)).alias("n")), ["n"])
    own = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return b.withColumn("_own", own).join(start, "_block").withColumn(column, F.col("_own") + F.col("s_n")).drop("_block", "_own", "s_n")
