"""Queries of run bookkeeping, refusals, labels, request weights and quoted evidence, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.shared import shared_folder
from rankloom.functions.text import bucket
from rankloom.operators import dimensions, fairness, runs
from rankloom.plans.analytics_queries import scored
from rankloom.plans.catalog import load, query

# Planted quotations, and by hand what each is worth: leadership, architecture, scale, ownership as the tools score them.
QUOTES = [
    ("Led a team of engineers", 0.7, 0.0, 0.0, 0.0), ("managed 12 people", 0.7, 0.0, 0.0, 0.0), ("on a 3-person team", 0.9, 0.0, 0.0, 0.0), ("8 engineer group", 1.0, 0.0, 0.0, 0.0),
    ("architected the platform", 0.0, 0.9, 0.0, 0.0), ("end-to-end ownership of billing", 0.0, 0.9, 0.0, 0.9), ("served 10,000+ active users", 0.0, 0.0, 0.85, 0.0), ("2.5 million users", 0.0, 0.0, 0.85, 0.0),
    ("50,000 tps", 0.0, 0.0, 0.9, 0.0), ("saved $3m", 0.0, 0.0, 0.9, 0.0), ("owned the roadmap", 0.0, 0.0, 0.0, 0.9), ("production deployment", 0.0, 0.0, 0.0, 0.6), ("led", 0.0, 0.0, 0.0, 0.0),
]


def _picked(values, i="doc_id") -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{i} % {len(values)} + 1]"


@query("s05_tool_signals", f"SELECT doc_id, {', '.join(f'{_picked([q[k] for q in QUOTES])}::DOUBLE AS {name}' for k, name in enumerate(('leadership', 'architecture', 'scale', 'ownership'), 1))} FROM documents")
def s05(spark, sf_dir):
    """Quoted evidence as the tools of the second dimension score it."""
    quote = F.element_at(F.array(*[F.lit(q[0]) for q in QUOTES]), (F.col("doc_id") % len(QUOTES) + 1).cast("int"))
    docs = load(spark, sf_dir, "documents").select("doc_id", quote.alias("q"))
    return docs.select("doc_id", *[dimensions.tool_signal(name, F.col("q")).alias(name) for name in ("leadership", "architecture", "scale", "ownership")])


# Planted evidence of profiles, and by hand the sum of its weighted signals without years.
EVIDENCE = [
    ("led a team", "architected the core", "", "", 0.25 * 0.7 + 0.25 * 0.9), ("3 person team", "", "10,000 users", "owned the build", 0.25 * 0.5 + 0.2 * 0.8 + 0.15 * 0.6),
    ("", "", "", "", 0.0), ("mentor", "end-to-end ownership", "$5m", "", 0.25 * 0.7 + 0.25 * 0.9 + 0.2 * 0.9 + 0.15 * 0.9),
]
LEVELS = ["junior", "mid", "senior", "staff", "lead", "unknown"]


@query(
    "s03_profile_seniority",
    f"""WITH p AS (SELECT doc_id, {_picked([e[4] for e in EVIDENCE])}::DOUBLE AS base, (doc_id % 7)::INT AS req, (n_chars % 11)::INT AS years, {_picked([0, 1, 2, 3, 4, 2])} AS level FROM documents),
y AS (SELECT *, CASE WHEN req > 0 AND years > 0 THEN CASE WHEN req - years <= 0 THEN 1.0 WHEN req - years <= 1 THEN 0.8 WHEN req - years <= 2 THEN 0.5 ELSE 0.2 END WHEN req > 0 THEN 0.2 WHEN years > 0 THEN least(1.0, years / 5) ELSE 0.3 END AS signal,
  CASE WHEN years < 2 THEN 0 WHEN years < 5 THEN 1 WHEN years < 8 THEN 2 ELSE 3 END AS has FROM p),
d AS (SELECT *, floor(least(1.0, base + 0.15 * signal) * 1e4 + 0.5) / 1e4 AS d FROM y)
SELECT doc_id, floor(d * CASE WHEN level - has = 1 THEN 0.9 WHEN level - has >= 2 THEN 0.75 ELSE 1 END * 1e4 + 0.5) / 1e4 AS d2, req = 0 OR years >= req AS years_ok FROM d""",
)
def s03(spark, sf_dir):
    """The second dimension from profiles (S3)."""
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    signals = F.struct(*[at([e[k] for e in EVIDENCE]).alias(name) for k, name in enumerate(("leadership", "architecture", "scale", "ownership"))])
    asked = F.struct((F.col("doc_id") % 7).cast("int").alias("years_required"), at(LEVELS).alias("seniority"))
    has = F.struct((F.col("n_chars") % 11).cast("int").alias("total_years"), signals.alias("seniority_signals"))
    rows = load(spark, sf_dir, "documents").select("doc_id", asked.alias("asked"), has.alias("has"))
    return rows.select("doc_id", dimensions.profile_seniority(F.col("asked"), F.col("has")).alias("s")).select("doc_id", "s.d2", "s.years_ok")


@query(
    "pf3_refused",
    """SELECT doc_id, n_chars < 300 AS rejected, CASE WHEN n_chars < 300 THEN 0.0 ELSE (doc_id % 10) / 10.0 END::DOUBLE AS final, CASE WHEN n_chars < 300 THEN 0.0 ELSE 0.25 END::DOUBLE AS d1, CASE WHEN n_chars < 300 THEN 'LOW' ELSE 'HIGH' END AS confidence,
CASE WHEN n_chars < 300 THEN 'NO_MATCH' ELSE 'GOOD_MATCH' END AS recommendation, CASE WHEN n_chars < 300 THEN 0.5 END::DOUBLE AS signal, CASE WHEN n_chars < 300 THEN 'too short' ELSE '' END AS gaps FROM documents""",
)
def pf3(spark, sf_dir):
    """Rows that fail a check before scoring (PF3)."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 10 / 10).alias("final"), *[F.lit(0.25).alias(d) for d in runs.DIMENSIONS], F.lit("HIGH").alias("confidence"), F.lit("GOOD_MATCH").alias("recommendation"))
    out = runs.refused(rows, F.when(F.col("n_chars") < 300, "too short"))
    return out.select("doc_id", (F.col("mode") == "rejected").alias("rejected"), "final", "d1", "confidence", "recommendation", "signal", F.array_join("gaps", ",").alias("gaps"))


@query("j17_report_default", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'HIGH' ELSE 'NONE' END AS threat_level, CASE WHEN toxic = 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS total_penalty, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS n_flags FROM documents LEFT JOIN labels USING (doc_id)")
def j17(spark, sf_dir):
    """Reports of the flagged documents, a clean one for all others."""
    reports = load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("HIGH").alias("threat_level"), F.lit(0.9).alias("total_penalty"), F.array(F.lit("toxic")).alias("flags"))
    found = runs.with_reports(load(spark, sf_dir, "documents").select("doc_id"), reports)
    return found.select("doc_id", "threat_level", "total_penalty", F.size("flags").alias("n_flags"))


@query("tk05_newest_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def tk05(spark, sf_dir):
    """The twenty newest runs, which is the report's own bound (TK5)."""
    return runs.newest_runs(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("tk06_oldest_records", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 50")
def tk06(spark, sf_dir):
    """The first fifty records of a log (TK6)."""
    return runs.oldest_records(load(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 50)


@query("a16_status_counts", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) FILTER (WHERE o_orderstatus = 'F') = count(*) AS clean FROM orders GROUP BY 1")
def a16(spark, sf_dir):
    return runs.status_counts(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("so6_subset", "WITH a AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, list_has_all(['A', 'R'], f) AS returned FROM a")
def so6(spark, sf_dir):
    """Orders of which every line was returned (SO6)."""
    flags = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))  # at most three flags
    return flags.select("l_orderkey", runs.is_subset(F.col("f"), F.array(F.lit("A"), F.lit("R"))).alias("returned"))


@query(
    "f28_labels",
    """SELECT doc_id, ['python', 'sql', 'go', ''][doc_id % 4 + 1] AS label, ['exact', 'USED', '', ''][doc_id % 4 + 1] AS badge, ['met', 'partial', 'not_met', 'met', 'partial', 'not_met'][doc_id % 6 + 1] AS status, ['100%', '56%', '0%', 'Met', 'Partial', 'Not met'][doc_id % 6 + 1] AS shown FROM documents""",
)
def f28(spark, sf_dir):
    """Labels of skills and constraints in either of two row formats."""
    skills = [{"jd_skill": "python", "skill": "no", "match_type": "exact"}, {"skill": "sql", "level": "USED"}, {"jd_skill": "", "name": "go"}, {"other": "x"}]
    checks = [{"constraint": "a", "score": "1.0"}, {"constraint": "b", "score": "0.57"}, {"constraint": "c", "score": "0.0"}, {"req": "d", "met": "true"}, {"req": "e", "met": "false", "partial": "true"}, {"req": "f"}]
    made = lambda maps: F.element_at(F.array(*[F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in maps]), (F.col("doc_id") % len(maps) + 1).cast("int"))
    rows = load(spark, sf_dir, "documents").select("doc_id", made(skills).alias("s"), made(checks).alias("c"))
    return rows.select("doc_id", runs.skill_label(F.col("s")).alias("label"), runs.skill_badge(F.col("s")).alias("badge"), runs.constraint_status(F.col("c")).alias("status"), runs.constraint_display(F.col("c")).alias("shown"))


@query(
    "x02_request_weights",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.35 WHEN 2 THEN (10 + doc_id % 3) / (100.0 + doc_id % 3) WHEN 3 THEN 60 / 120.0 ELSE NULL END::DOUBLE AS w1,
CASE doc_id % 5 WHEN 1 THEN 'Senior profile: Skills 35%, Seniority 45%, Domain 12%, Constraints 8%' WHEN 2 THEN 'Custom profile: Skills ' || (10 + doc_id % 3) || '%, Seniority 40%, Domain 30%, Constraints 20%' WHEN 3 THEN 'Mid profile: Skills 60%, Seniority 35%, Domain 15%, Constraints 10%' ELSE '' END AS note FROM documents""",
)
def x02(spark, sf_dir):
    """Weights of requests: automatic, a profile, custom ones, a changed profile, nothing at all."""
    at = lambda *values: F.element_at(F.array(*[v if not isinstance(v, str | type(None)) else F.lit(v).cast("string") for v in values]), (F.col("doc_id") % 5 + 1).cast("int"))
    own = (10 + F.col("doc_id") % 3).cast("string")
    rows = load(spark, sf_dir, "documents").select(
        "doc_id", at(None, " Senior ", "auto", "mid", "custom").alias("p"), at(None, None, own, "60", "0").alias("a"), at(None, None, "40", None, "0").alias("b"), at(None, "x", "30", "", None).alias("c"), at(None, None, "20", None, None).alias("d"), (F.col("doc_id") % 5 == 2).alias("custom"),
    )
    found = rows.select("doc_id", runs.request_weights(F.col("p"), *[F.col(k) for k in "abcd"], custom=F.col("custom")).alias("w"))
    return found.select("doc_id", F.col("w.w1").alias("w1"), runs.config_note(F.col("w")).alias("note"))


@query("k03_usage", "SELECT event_id, CASE event_type WHEN 'click' THEN 'small' WHEN 'view' THEN 'large' ELSE 'other' END AS model, floor((user_id * CASE event_type WHEN 'click' THEN 0.15 ELSE 2.5 END + 100 * CASE event_type WHEN 'click' THEN 0.6 ELSE 10.0 END) / 1e6 * 1e9 + 0.5) / 1e9 AS cost_usd FROM events")
def k03(spark, sf_dir):
    """What logged calls cost; models without a price cost what the large one does (K3)."""
    from rankloom.config import PRICES

    model = F.when(F.col("event_type") == "click", "small").when(F.col("event_type") == "view", "large").otherwise("other")
    calls = load(spark, sf_dir, "events").select("event_id", model.alias("model"), F.col("user_id").alias("tokens_in"), F.lit(100).alias("tokens_out"))
    return runs.usage(calls, PRICES, "large").select("event_id", "model", bucket(F.col("cost_usd"), 9).alias("cost_usd"))


@query("sk05_bias_report", "WITH r AS (SELECT lang AS \"group\", count(*) AS n, sum((quality >= 0.5)::INT)::BIGINT AS selected, avg((quality >= 0.5)::INT) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT 'lang' AS category, \"group\", n, selected, floor(rate / max(rate) OVER () * 1e6 + 0.5) / 1e6 AS ratio FROM r")
def sk05(spark, sf_dir):
    """A bias report written as JSON and read back (SK5)."""
    path = shared_folder(spark)
    fairness.bias_audit(scored(spark, sf_dir), ["lang"]).write.json(path)
    back = spark.read.schema("category string, group string, n long, selected long, ratio double").json(path)
    return back.select("category", "group", "n", "selected", bucket(F.col("ratio")).alias("ratio"))
