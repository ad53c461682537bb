"""Graded ranking metrics, one row per query (and approach); input: query_id, rank, rel (and more keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import DEFAULT


def with_relevance(ranking: DataFrame, labels: DataFrame, default: float = 0.0) -> DataFrame:
    """Left join of grades (doc_id, grade) onto a ranking; unlabelled documents get the default."""
    return ranking.join(labels, [c for c in ("query_id", "doc_id") if c in labels.columns], "left").withColumn("rel", F.coalesce(F.col("grade").cast("double"), F.lit(default)))


def _gain(rel: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, rel / F.log2(rank + 1)).otherwise(0.0))


def ideal_order(rated: DataFrame, most: int = 10) -> DataFrame:
    """rel, ideal_rank: the best ``most`` grades of a list of rated documents."""
    return rated.select("rel").orderBy(F.desc("rel")).limit(most).withColumn("ideal_rank", F.row_number().over(Window.orderBy(F.desc("rel"))))


def ranking_metrics(ranked: DataFrame, keys: list[str], ks=(3, 5, 10), threshold: float = DEFAULT.relevance_threshold, best: DataFrame | None = None) -> DataFrame:
    """ndcg_k and p_k for each k, and mrr; the ideal order is that of the ranked list itself.

    Where every list ranks the same documents, ``best`` is their ``ideal_order``, and of a list only the first places are
    needed: max(ks), and as many as reach the first document of a grade of ``threshold``, or else mrr is 0.

    The list is summed by partial aggregates; of the ideal order only the first places are asked for, which every task
    cuts before it sends them, so no task sorts a whole list.  ``ranked`` is read twice.
    """
    gains = [_gain(F.col("rel"), F.col("ideal_rank"), k).alias(f"_top_{k}") for k in ks]
    if best is None:
        ideal = Window.partitionBy(*keys).orderBy(F.desc("rel"), F.asc("rank"))
        own = ranked.select(*keys, "rel", "rank").withColumn("ideal_rank", F.row_number().over(ideal)).where(F.col("ideal_rank") <= max(ks))
        tops = own.groupBy(*keys).agg(*gains)
    else:
        tops = best.agg(*gains)
    rank, rel = F.col("rank"), F.col("rel")
    out = []
    for k in ks:
        out += [_gain(rel, rank, k).alias(f"_dcg_{k}"), (F.sum(((rank <= k) & (rel >= threshold)).cast("int")) / k).alias(f"p_{k}")]
    sums = ranked.groupBy(*keys).agg(*out, F.coalesce(1.0 / F.min(F.when(rel >= threshold, rank)), F.lit(0.0)).alias("mrr"))
    both = sums.join(tops, keys) if best is None else sums.crossJoin(F.broadcast(tops))
    for k in ks:
        both = both.withColumn(f"ndcg_{k}", F.when(F.col(f"_top_{k}") == 0, 0.0).otherwise(F.col(f"_dcg_{k}") / F.when(F.col(f"_top_{k}") == 0, 1.0).otherwise(F.col(f"_top_{k}"))))
    return both.select(*keys, *[name for k in ks for name in (f"ndcg_{k}", f"p_{k}")], "mrr")


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """rho without tie correction over rows (predicted, expected); 1 below two rows."""
    n, d = F.count("*"), F.sum((F.col("predicted") - F.col("expected")) ** 2)
    safe = F.when(n < 2, 1).otherwise(n * (n * n - 1))
    return pairs.groupBy(*keys).agg(F.when(n < 2, 1.0).otherwise(1 - 6 * d / safe).alias("rho"))


def rank_agreement(ranking: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """rho of a ranking against gold order (grade descending, doc_id); documents without a rank get the last one, n."""
    order = Window.partitionBy(*[k for k in keys if k in gold.columns]).orderBy(F.desc("grade"), F.asc("doc_id"))
    n = F.count("*").over(Window.partitionBy(*[k for k in keys if k in gold.columns]))
    expected = gold.withColumn("expected", F.row_number().over(order)).withColumn("n", n)
    joined = expected.join(ranking, [c for c in (*keys, "doc_id") if c in gold.columns and c in ranking.columns], "left")
    return spearman(joined.withColumn("predicted", F.coalesce("rank", "n")), keys)


def label_means(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score of good (1), partial (0.5) and poor (0) rows and the gaps between neighbours; unlabelled rows count as poor in the gaps."""
    g, s = F.col("grade"), F.col("score")
    poor = g.isNull() | (g == 0)
    return scored.groupBy(*keys).agg(
        F.avg(F.when(g == 1, s)).alias("mean_good"), F.avg(F.when(g == 0.5, s)).alias("mean_partial"), F.avg(F.when(g == 0, s)).alias("mean_poor"),
        (F.min(F.when(g == 1, s)) - F.max(F.when(poor, s))).alias("gap_good_poor"), (F.min(F.when(g == 1, s)) - F.max(F.when(g == 0.5, s))).alias("gap_good_partial"),
    )


def delta_to_first(metrics: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Adds delta_ and best_ of each column against the first row and the best one; metrics has a row per approach."""
    first = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in columns:
        metrics = metrics.withColumn(f"delta_{c}", F.col(c) - F.first(c).over(first)).withColumn(f"best_{c}", F.col(c) == F.max(c).over(first))
    return metrics
