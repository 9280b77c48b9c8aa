"""Session helpers: table access, input spreading and lineage cuts that survive executor loss."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows when the scan has fewer tasks than the cluster has cores; a large scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where the session names none, a local one, but on one machine only.

    Raises RuntimeError on a cluster without the setting, since executors would write to disks of their own.
    """
    key = "spark.checkpoint.dir"
    own = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not own:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set(key, own)
    return own.rstrip("/")


_MADE: list[str] = []
PARTITION_BYTES = 32 << 20


def cut(df: DataFrame, name: str, shuffled: int = 0) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and no executor holds the only copy.

    shuffled: bytes that the largest shuffle of df is expected to move; the number of shuffle partitions is raised so that
    each gets about PARTITION_BYTES, and adaptive execution still joins small ones and splits skewed ones.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(made)  # at the latest when the driver ends
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), shuffled // PARTITION_BYTES)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by cut() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that cut() made in this process, once no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
