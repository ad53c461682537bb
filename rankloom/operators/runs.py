"""What surrounds scored results: refused rows, missing reports, labels of two row formats, request weights, run lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import bucket

# Percentages of the four dimensions by named profile.
PROFILE_PERCENT = {
    "junior": (50, 25, 15, 10),
    "mid": (40, 35, 15, 10),
    "senior": (35, 45, 12, 8),
    "staff": (30, 50, 12, 8),
    "executive": (25, 55, 12, 8),
}
DIMENSIONS = ("d1", "d2", "d3", "d4")


def refused(rows: DataFrame, reason: Column) -> DataFrame:
    """Scored rows (final, d1..d4, confidence, recommendation, ...), of which those with a ``reason`` become the row of a refusal.

    Nothing is scored, the signal is one half, confidence LOW, recommendation NO_MATCH, mode rejected, and the reason is
    the only gap; other rows get the mode scored.
    """
    no = reason.isNotNull()
    zeros = {c: F.when(no, 0.0).otherwise(F.col(c)) for c in ("final", *DIMENSIONS) if c in rows.columns}
    said = {"confidence": "LOW", "recommendation": "NO_MATCH"}
    texts = {c: F.when(no, v).otherwise(F.col(c)) for c, v in said.items() if c in rows.columns}
    out = rows.withColumn("_why", reason).withColumns(zeros | texts)
    known = F.col("_why").isNotNull()
    return out.withColumns({"mode": F.when(known, "rejected").otherwise("scored"), "signal": F.when(known, 0.5), "gaps": F.when(known, F.array("_why")).otherwise(F.array().cast("array<string>"))}).drop("_why")


def with_reports(results: DataFrame, reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results with threat_level, total_penalty and flags of their report (key, those columns); clean where there is none."""
    side = reports.select(key, "threat_level", "total_penalty", "flags")
    joined = results.join(side, key, "left")
    return joined.withColumns({
        "threat_level": F.coalesce("threat_level", F.lit("NONE")), "total_penalty": F.greatest(F.coalesce("total_penalty", F.lit(0.0)), F.lit(0.0)), "flags": F.coalesce("flags", F.array().cast("array<string>")),
    })


def skill_label(s: Column) -> Column:
    """jd_skill, else skill, else name of a map; '' without any."""
    return F.coalesce(*[F.nullif(F.try_element_at(s, F.lit(k)), F.lit("")) for k in ("jd_skill", "skill", "name")], F.lit(""))


def skill_badge(s: Column) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(s, F.lit(k)), F.lit("")) for k in ("match_type", "level")], F.lit(""))


def constraint_label(c: Column) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(c, F.lit(k)), F.lit("")) for k in ("constraint", "req")], F.lit(""))


def constraint_status(c: Column) -> Column:
    """met, partial or not_met of a map: by its score if there is one, else by what is said to be met or partial."""
    score = F.try_element_at(c, F.lit("score")).try_cast("double")
    said = lambda k: F.coalesce(F.try_element_at(c, F.lit(k)).try_cast("boolean"), F.lit(False))
    by_score = F.when(score >= 1, "met").when(score >= 0.5, "partial").otherwise("not_met")
    return F.when(score.isNotNull(), by_score).when(said("met"), "met").when(said("partial"), "partial").otherwise("not_met")


def constraint_display(c: Column) -> Column:
    """The score in whole per cent, cut and not rounded, else the status in words."""
    score = F.try_element_at(c, F.lit("score")).try_cast("double")
    status = constraint_status(c)
    words = F.when(status == "met", "Met").when(status == "partial", "Partial").otherwise("Not met")
    return F.when(score.isNotNull(), F.concat((score * 100).cast("int").cast("string"), F.lit("%"))).otherwise(words)


def request_weights(profile: Column, *percent: Column, custom: Column | None = None) -> Column:
    """struct(profile, w1..w4, raw) of a request: weights of sum 1, or null for the automatic ones.

    A named profile gives its percentages, each replaced by a given one that is neither null nor 0; ``auto`` with
    ``custom`` set, and any other name, count given ones only.  What is no number, or sums to nothing, is automatic, but for
    a named profile, which then keeps its own.
    """
    name = F.lower(F.trim(F.coalesce(F.nullif(profile, F.lit("")), F.lit("auto"))))
    asked = F.when((name == "auto") & F.coalesce(custom, F.lit(False)), "custom").otherwise(name) if custom is not None else name
    own = F.create_map(*[x for k, v in PROFILE_PERCENT.items() for x in (F.lit(k), F.array(*[F.lit(float(p)) for p in v]))])
    preset = F.try_element_at(own, asked)
    broken = F.lit(False)
    for p in percent:
        broken = broken | (p.isNotNull() & (p != "") & p.try_cast("double").isNull())
    given = F.array(*[F.coalesce(F.nullif(p.try_cast("double"), F.lit(0.0)), F.coalesce(F.get(preset, F.lit(i)), F.lit(0.0))) for i, p in enumerate(percent)])
    raw = F.when(broken, preset).otherwise(given)
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    made = F.struct(asked.alias("profile"), *[(F.get(raw, F.lit(i)) / total).alias(f"w{i + 1}") for i in range(4)], raw.alias("raw"))
    return F.when((asked != "auto") & (total > 0), made)


def config_note(c: Column) -> Column:
    """A line about the weights of ``request_weights``; '' for the automatic ones."""
    parts = [F.concat(F.lit(f"{name} "), bucket(F.get(c.raw, F.lit(i)), 0).cast("int").cast("string"), F.lit("%")) for i, name in enumerate(("Skills", "Seniority", "Domain", "Constraints"))]
    return F.when(c.isNull(), "").otherwise(F.concat(F.initcap(c.profile), F.lit(" profile: "), F.concat_ws(", ", *parts)))


def newest_runs(runs: DataFrame, at: str, tie: str, most: int = 20) -> DataFrame:
    """The latest runs, newest first: every task keeps its own latest before they meet."""
    return runs.orderBy(F.desc(at), F.desc(tie)).limit(most)


def oldest_records(records: DataFrame, order: str, most: int) -> DataFrame:
    """The first records in the order they were logged."""
    return records.orderBy(F.asc(order)).limit(most)


def status_counts(rows: DataFrame, group: str, status: str, statuses: list[str]) -> DataFrame:
    """group, total and a count for each status, and ``clean``: whether all rows have the first one."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    out = rows.groupBy(group).agg(F.count("*").alias("total"), *counts)
    return out.withColumn("clean", F.col(statuses[0]) == F.col("total"))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def usage(calls: DataFrame, prices: dict[str, tuple[float, float]], default: str) -> DataFrame:
    """Calls (stage, model, tokens_in, tokens_out) with cost in USD; an unknown model costs what ``default`` does."""
    table = F.create_map(*[x for k, (i, o) in prices.items() for x in (F.lit(k), F.array(F.lit(i), F.lit(o)))])
    price = F.coalesce(F.try_element_at(table, F.col("model")), F.array(*[F.lit(x) for x in prices[default]]))
    return calls.withColumn("cost_usd", (F.col("tokens_in") * F.get(price, F.lit(0)) + F.col("tokens_out") * F.get(price, F.lit(1))) / 1e6)
