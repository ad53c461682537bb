"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.shared import bound_batches  # noqa: F401  (the operators take it from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read through Spark (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a session in one process may do with a local one."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            set_dir = kept.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            set_dir = tempfile.mkdtemp(prefix="rankloom-")
        else:  # executors could not see the driver's own folder
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rankloom-{uuid.uuid4().hex}"
        self.n = 0
        self.live: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a frame that reads it."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.live.add(path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.live.discard(df._scratch_path)

    def drop_all_but(self, *needed: DataFrame) -> None:
        """Delete every table kept here that the lazy result does not read."""
        for path in self.live - {df._scratch_path for df in needed}:
            jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
            self.live.discard(path)

    def sweep(self) -> None:
        """Let Spark drop the shuffle files of plans that are no longer referenced."""
        self.spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder`` (null ids count as not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))
