"""Reviewer feedback: calibration, reason counts, context rules, weight adjustment; and cost accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import DEFAULT, PRICES


def with_defaults(feedback: DataFrame, now) -> DataFrame:
    """Fills missing timestamps and ids of feedback rows."""
    ts = F.coalesce("timestamp", F.lit(now).cast("double"))
    made = F.concat_ws("_", F.lit("fb"), F.col("job_id"), F.col("doc_id"), F.floor(ts * 1000).cast("string"))
    return feedback.withColumn("feedback_id", F.coalesce("feedback_id", made)).withColumn("timestamp", ts)


def calibration(feedback: DataFrame, keys: list[str] = (), gap: float = 0.2) -> DataFrame:
    """n, means, rates of over- and under-scoring; feedback: ai_score, relevance."""
    d = F.col("ai_score") - F.col("relevance")
    share = lambda c: F.avg(c.cast("int"))
    return feedback.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("ai_score").alias("mean_ai"), F.avg("relevance").alias("mean_human"), F.avg(F.abs(d)).alias("mean_gap"),
        share(F.abs(d) > gap).alias("disagreement"), share(d > gap).alias("over"), share(d < -gap).alias("under"),
    )


def top_reasons(feedback: DataFrame, column: str = "reasons", k: int = 10) -> DataFrame:
    """reason, n of the k most frequent reasons; ties by name."""
    return feedback.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def context_rules(stats: DataFrame, rate: float = 0.3) -> DataFrame:
    """Adds the rules that calibration rows call for."""
    rules = F.array(
        F.when(F.col("over") > rate, F.lit("scores run high: be stricter")),
        F.when(F.col("under") > rate, F.lit("scores run low: be more generous")),
        F.when(F.col("disagreement") > rate, F.lit("many disagreements: review the weights")),
    )
    return stats.withColumn("rules", F.filter(rules, lambda r: r.isNotNull()))


def adjust_weights(weights: DataFrame, step: float = 0.10) -> DataFrame:
    """weight + adjustment (clamped to +-step) renormalised over all rows of a profile, 4 digits; weights: profile, name, weight, adjustment."""
    moved = F.greatest(F.lit(0.0), F.col("weight") + F.greatest(F.lit(-step), F.least(F.lit(step), F.coalesce("adjustment", F.lit(0.0)))))
    total = F.sum("moved").over(Window.partitionBy("profile"))
    share = F.col("moved") / F.when(total == 0, 1.0).otherwise(total)
    return weights.withColumn("moved", moved).withColumn("weight", F.floor(share * 10_000 + 0.5) / 10_000).drop("moved", "adjustment")


def prices(spark, table: dict = PRICES) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in table.items()], "model string, price_in double, price_out double")


def cost(calls: DataFrame, price_table: DataFrame) -> DataFrame:
    """Adds cost_usd by tokens and price per million; unknown models are free."""
    usd = (F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))) / 1_000_000
    return calls.join(F.broadcast(price_table), "model", "left").withColumn("cost_usd", F.round(usd, 8)).drop("price_in", "price_out")


def running_budget(calls: DataFrame, order: list[str], keys: list[str] = (), limit: float = DEFAULT.budget_usd) -> DataFrame:
    """Adds spent (running sum) and stopped (it has reached the limit)."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("spent", F.sum("cost_usd").over(so_far)).withColumn("stopped", F.col("spent") >= limit)


def cost_summary(calls: DataFrame, keys: list[str] = (), unit: str = "unit_id") -> DataFrame:
    """Calls, tokens, cost, cost per unit and per 1000 units."""
    units = F.countDistinct(unit)
    total = F.sum("cost_usd")
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), total.alias("cost_usd"),
        (total / units).alias("per_unit"), (1000 * total / units).alias("per_1000"),
    )
