"""Selection rates, impact ratios, the four-fifths rule and audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import DEFAULT
from rankloom.functions.shared import keep
from rankloom.functions.tree_hash import tree_hash


def selection_rates(rows: DataFrame, group: str = "group", threshold: float = DEFAULT.selection_threshold) -> DataFrame:
    """group, n, selected, rate: share of rows of a group whose score reaches the threshold."""
    hit = (F.col("score") >= threshold).cast("int")
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(hit).alias("selected"), F.avg(hit).alias("rate"))


def impact_ratios(rates: DataFrame, partition: list[str] = ()) -> DataFrame:
    """Adds ratio: a group's rate over the best one; 0 where no group has any."""
    best = F.max("rate").over(Window.partitionBy(*partition))
    return rates.withColumn("ratio", F.when(best == 0, 0.0).otherwise(F.col("rate") / F.when(best == 0, 1.0).otherwise(best)))


def four_fifths(ratios: DataFrame, threshold: float = DEFAULT.four_fifths) -> DataFrame:
    """Groups below the threshold (clamped to 0.1 .. 1), CRITICAL below one half."""
    bound = min(1.0, max(0.1, threshold))
    return ratios.where(F.col("ratio") < bound).withColumn("severity", F.when(F.col("ratio") < 0.5, "CRITICAL").otherwise("WARNING"))


def bias_audit(rows: DataFrame, categories: list[str], threshold: float = DEFAULT.selection_threshold, rule: float = DEFAULT.four_fifths) -> DataFrame:
    """category, group, n, selected, rate, ratio, passed, severity for each category by itself, in one pass of grouping sets."""
    hit = (F.col("score") >= threshold).cast("int")
    sets = rows.groupingSets([[c] for c in categories], *categories).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), F.sum(hit).alias("selected"), F.avg(hit).alias("rate"),
    )
    of = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for i, c in enumerate(categories):
        mine = F.col("gid") == (2 ** len(categories) - 1 - 2 ** (len(categories) - 1 - i))
        of = F.when(mine, c).otherwise(of)
        value = F.when(mine, F.col(c).cast("string")).otherwise(value)
    by = sets.select(of.alias("category"), value.alias("group"), "n", "selected", "rate")
    judged = impact_ratios(by, ["category"])
    return judged.withColumn("passed", F.col("ratio") >= rule).withColumn("severity", F.when(F.col("ratio") < 0.5, "CRITICAL").when(F.col("ratio") < rule, "WARNING"))


#: Children of a node of the hash trees in audit records.
FAN = 16


def audit_record(results: DataFrame, docs: DataFrame, config_hash: str, as_of=None) -> DataFrame:
    """One record per query: results are query_id, doc_id, rank, score, confidence, recommendation, threat_level.

    config_hash, at, n_documents, hashes and rankings (trees over the hashes of the texts and over the ranked entries, in
    order of rank), review_required and n_flagged.  A record names its documents by these two hashes, not by a list, so it
    has one size whatever the number of documents; ``audit_entries`` gives the rows themselves.
    """
    hashed = docs.select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("hash"))
    rows = keep(audit_entries(results).join(hashed, "doc_id"))
    counts = rows.groupBy("query_id").agg(
        F.count("*").alias("n_documents"),
        F.bool_or(F.col("confidence") == "LOW").alias("review_required"),
        F.count_if(F.col("flagged")).alias("n_flagged"),
    )
    texts = tree_hash(rows, "query_id", ["rank", "doc_id"], "hash", FAN).select("query_id", F.col("hash").alias("hashes"))
    entries = tree_hash(rows, "query_id", ["rank", "doc_id"], "entry", FAN).select("query_id", F.col("hash").alias("rankings"))
    both = counts.join(texts, "query_id").join(entries, "query_id")
    return both.select("query_id", F.lit(config_hash).alias("config_hash"), F.lit(as_of).cast("timestamp").alias("at"), "n_documents", "hashes", "rankings", "review_required", "n_flagged")


def audit_entries(results: DataFrame) -> DataFrame:
    """query_id, doc_id, rank, confidence, flagged, entry: what an audit record is made of, a row for each result."""
    entry = F.to_json(F.struct("rank", "doc_id", "score", "confidence", "recommendation"))
    return results.select("query_id", "doc_id", "rank", "confidence", F.coalesce(F.col("threat_level").isin("HIGH", "CRITICAL"), F.lit(False)).alias("flagged"), entry.alias("entry"))


def verify_reproducibility(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id and the list of differences between two audit records of it."""
    both = a.alias("a").join(b.alias("b"), "query_id")
    checks = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(f"{c} differs")) for c in ("config_hash", "n_documents", "hashes", "rankings", "n_flagged")]
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return both.select("query_id", found.alias("differences"), (F.size(found) == 0).alias("reproducible"))
