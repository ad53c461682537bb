"""Corpus pipeline: quality, near-duplicates, repeated passages, decontamination, packing.

``run`` applies STAGES to ``documents``; each stage writes Parquet to the shared
folder and the next one reads it, so a lost executor costs one stage at most.

All stages but the last return the columns of ``documents``, and further ones of
any name; ``n_chars``, where there is one, follows the text where a stage changes
it.  Rows of any null or empty text are rows like others: the classifier judges
them by their (absent) form, and what it keeps goes on.  Rows that share a doc_id
share the fate of that id.  Rows without an id are named by their text, above all
ids, so they too are compared, copies of them dropped, and leaks in them found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import decontamination, near_dup, packing, quality, repeats
from rankloom.llm.common import Scratch, bound_batches, held_out, table, unused


#: A passage that the third stage cuts: so many words in a row that occur elsewhere too, and at least so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def _named(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a column ``key``: the id, or a number above all ids that the text gives."""
    of_text = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 2)
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), of_text))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject."""
    bound_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    score = unused(docs, "_quality")
    return quality.score(docs, quality.train(docs, labels, docs.where(~held_out("doc_id", 5, 0))), score).where(F.col(score) >= quality.THRESHOLD).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one whose id names it."""
    key, named = unused(docs, "_row"), _named(docs, unused(docs, "_row"))
    judged = near_dup.near_duplicates(named.select(F.col(key).alias("doc_id"), "text"))
    left = named.join(judged.where("kept").select(F.col("doc_id").alias(key)).distinct(), key, "left_semi")
    # rows without an id that say the same are copies of each other; blank ones are like nothing
    nameless = F.col("doc_id").isNull() & (F.trim(F.coalesce(F.col("text"), F.lit(""))) != "")
    return left.where(~nameless).union(left.where(nameless).dropDuplicates([key])).select(*_columns(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their passages of ``PASSAGE_WORDS`` words or more that start elsewhere too."""
    cut = repeats.cut_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*_columns(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item leaks."""
    key = unused(docs, "_row")
    named = _named(docs, key)
    leaks = decontamination.find_leaks(named.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return named.join(leaks.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*_columns(docs))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents with their sequence and offset."""
    return packing.pack_documents(docs.select("doc_id", "text"), packing.tokenizer_file())


STAGES = [
    ("quality classifier", classify_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Classifier, sketches and packing are not SQL; tests/llm holds the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop_all_but(docs)
    return docs
