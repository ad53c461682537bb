"""Tables in the folder that driver and executors share: they cut lineage and are read many times after one write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; only a session in one process may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rankloom-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once and read back; what is left of it goes when the application ends."""
    path, spark = shared_folder(df.sparkSession), df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    _at(spark, path, "deleteOnExit")
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a kept table that no later plan reads."""
    _at(df.sparkSession, df._kept_at, "delete")


def _at(spark: SparkSession, path: str, what: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(jvm_path, True) if what == "delete" else files.deleteOnExit(jvm_path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores is dealt over the cores; a larger one is left as its files are split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, so that a run of very long texts makes no batch of their sum.

    All callers set the same two values, so it does not matter which of them comes last before a lazy plan runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
