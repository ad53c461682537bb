"""Sinks: result exports, append-only logs, persisted indexes with validity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import bucket, tokens

EXPORT = ["rank", "doc_id", "final", "d1", "d2", "d3", "d4", "penalty", "confidence", "recommendation"]


def export_csv(results: DataFrame, path: str) -> None:
    """Ten columns in order of query and rank, scores with four digits."""
    scores = [c for c in EXPORT if dict(results.dtypes)[c] == "double"]
    results.withColumns({c: bucket(F.col(c), 4) for c in scores}).select("query_id", *EXPORT).orderBy("query_id", "rank").write.mode("overwrite").option("header", True).csv(path)


#: Ranks that one JSON line of an export may hold.
JSON_BLOCK = 1_000


def export_json(results: DataFrame, path: str) -> None:
    """One nested object for each query and block of ``JSON_BLOCK`` ranks: query_id, block, rankings in order of rank."""
    entry = F.sort_array(F.collect_list(F.struct(*EXPORT)))
    block = F.floor((F.col("rank") - 1) / JSON_BLOCK).alias("block")
    results.groupBy("query_id", block).agg(entry.alias("rankings")).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines, added to what is there."""
    rows.write.mode("append").json(path)


def corpus_hash(docs: DataFrame) -> DataFrame:
    """One row: a hash of all (id, text), independent of row order and partitioning, by a partial aggregate.

    Every row's sha-256 gives two numbers of 48 bits; their exclusive or, their sum and the count are hashed again.
    """
    row = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256)
    parts = docs.select(*[F.conv(F.substring(row, at, 12), 16, 10).cast("long").alias(name) for at, name in ((1, "a"), (13, "b"))])
    return parts.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("a"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.col("b").cast("decimal(28,0)")), F.lit(0)).alias("s")).select(
        F.substring(F.sha2(F.concat_ws(":", "n", "x", "s"), 256), 1, 16).alias("corpus_hash"), "n"
    )


def build_index(docs: DataFrame, path: str, model: str, config_hash: str) -> None:
    """Postings and one meta row, keyed by the raw corpus and the configuration."""
    cut = docs.select("doc_id", tokens("text").alias("ts"))
    of = cut.select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    of.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")).write.mode("overwrite").parquet(f"{path}/postings")
    corpus_hash(docs).withColumn("model", F.lit(model)).withColumn("config_hash", F.lit(config_hash)).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def index_is_valid(spark: SparkSession, docs: DataFrame, path: str, model: str, config_hash: str) -> bool:
    """Whether the index at ``path`` was built from this corpus, model and configuration."""
    try:
        meta = spark.read.parquet(f"{path}/meta")
    except Exception as e:  # whatever keeps it from being read, it has to be rebuilt
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return False
    now = corpus_hash(docs).first()
    return meta.where((F.col("corpus_hash") == now.corpus_hash) & (F.col("model") == model) & (F.col("config_hash") == config_hash)).count() == 1


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings")


def index_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: postings, terms and documents."""
    return load_index(spark, path).agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.countDistinct("doc_id").alias("documents"))


def invalidate_index(spark: SparkSession, path: str) -> None:
    """Removes the meta row; the next check asks for a rebuild."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
