"""Further queries of scalar families, profiles, evidence, deltas and sessions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import text
from rankloom.functions.text import bucket
from rankloom.operators import dimensions as dims
from rankloom.operators import evaluate, feedback, profiles, retrieval, store
from rankloom.plans.catalog import benchmark_queries, documents, load, query
from rankloom.plans.retrieval_queries import BM25, FUSED, SIX, TFIDF
from rankloom.plans.scoring_queries import CV, cv


@query(
    "f23_bands",
    """SELECT doc_id, CASE WHEN n_chars / 5000 >= 0.6 THEN 'CRITICAL' WHEN n_chars / 5000 >= 0.35 THEN 'HIGH' WHEN n_chars / 5000 >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS band,
CASE WHEN doc_id % 4 = 0 THEN 0 ELSE floor(100 * (doc_id % 3) / (doc_id % 4))::INT END AS progress FROM documents""",
)
def f23(spark, sf_dir):
    band = text.band(F.col("n_chars") / 5000, [(0.6, "CRITICAL"), (0.35, "HIGH"), (0.15, "MEDIUM")], "LOW")
    return load(spark, sf_dir, "documents").select("doc_id", band.alias("band"), text.progress(F.col("doc_id") % 3, F.col("doc_id") % 4).alias("progress"))


SPAN = r"(20[0-9]{2})\s*[-–—]+\s*(20[0-9]{2}|present|current|now)"


@query(
    "f24_year_span",
    f"""WITH p AS (SELECT doc_id, lower({CV}) AS t FROM documents), q AS (SELECT doc_id, regexp_extract_all(t, '{SPAN}', 1) AS s, regexp_extract_all(t, '{SPAN}', 2) AS e FROM p)
SELECT doc_id, coalesce(list_max(list_transform(e, lambda y: CASE WHEN y IN ('present', 'current', 'now') THEN 2026 ELSE y::INT END)) - list_min(list_transform(s, lambda y: y::INT)), 0)::INT AS years FROM q""",
)
def f24(spark, sf_dir):
    return cv(spark, sf_dir).select("doc_id", text.year_span(F.lower("text")).alias("years"))


@query("f17_tolerant_int", "SELECT doc_id, greatest(0, least(50, coalesce(try_cast(CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE (doc_id - 20)::VARCHAR END AS INT), 0)))::INT AS years FROM documents")
def f17(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 3 == 0, "x").otherwise((F.col("doc_id") - 20).cast("string"))
    return load(spark, sf_dir, "documents").select("doc_id", text.tolerant_int(raw).alias("years"))


@query("n02_canonical_seniority", "SELECT c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'senior' WHEN c_custkey % 3 = 1 THEN 'executive' ELSE 'mid' END AS level, count(*) AS n FROM customer GROUP BY ALL")
def n02(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 3 == 0, " Sr ").when(F.col("c_custkey") % 3 == 1, "VP").otherwise("unheard of")
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment", profiles.canonical_seniority(raw).alias("level")).agg(F.count("*").alias("n"))


@query("n05_query_profile", "SELECT doc_id, least(15, doc_id % 20)::INT AS n_skills, greatest(0, least(50, doc_id - 10))::INT AS years, least(10, doc_id % 13)::INT AS n_constraints FROM documents")
def n05(spark, sf_dir):
    i = F.col("doc_id").cast("int")
    skills = F.transform(F.slice(F.sequence(F.lit(1), F.lit(20)), F.lit(1), i % 20), lambda k: F.struct(k.cast("string").alias("name"), F.lit("core").alias("importance")))
    limits = F.transform(F.slice(F.sequence(F.lit(1), F.lit(13)), F.lit(1), i % 13), lambda k: k.cast("string"))
    made = load(spark, sf_dir, "documents").select("doc_id", F.struct(
        skills.alias("required_skills"), (i - 10).cast("string").alias("years_required"), F.lit("x").alias("domain"), F.lit("sr").alias("seniority"), limits.alias("hard_constraints"),
    ).alias("profile"))
    p = profiles.normalize_query_profile(made)
    return p.select("doc_id", F.size("profile.required_skills").alias("n_skills"), F.col("profile.years_required").alias("years"), F.size("profile.hard_constraints").alias("n_constraints"))


@query("pf6_verbatim_evidence", "SELECT doc_id, doc_id % 2 = 0 AND trim(regexp_replace(substr(text, 1, 40), '\\s+', ' ', 'g')) <> '' AS is_verbatim FROM documents")
def pf6(spark, sf_dir):
    said = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 40)).otherwise("§ never said")
    return documents(spark, sf_dir).select("doc_id", profiles.is_verbatim(said, F.col("text")).alias("is_verbatim"))


@query(
    "s07_profile_domain",
    "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.6 WHEN 3 THEN 0.2 WHEN 4 THEN 0.6 WHEN 5 THEN 0.2 ELSE 0.2 END::DOUBLE AS d3 FROM documents",
)
def s07(spark, sf_dir):
    names = ["fintech", "enterprise_saas", "ai_ml", "healthcare", "platform_devops", "ecommerce", "other"]
    owned = F.array(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 7 + 1).cast("int")))
    return load(spark, sf_dir, "documents").select("doc_id", dims.profile_domain_fit(F.lit("fintech"), owned).alias("d3"))


def _any(terms, low="lower(x)"):
    return " OR ".join(f"contains({low}, '{t}')" for t in terms)


@query(
    "s10_skill_evidence",
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({CV}, '[.\\n•]+'), lambda x: trim(x)), lambda x: length(x) >= 10) AS s FROM documents),
h AS (SELECT doc_id, list_filter(s, lambda x: {_any(["platform", "users", "kafka", "team"])}) AS h FROM p)
SELECT doc_id, CASE WHEN len(list_filter(h, lambda x: {_any(dims.BUILD)})) > 0 THEN 'BUILT_WITH' WHEN len(list_filter(h, lambda x: {_any(dims.USE)})) > 0 THEN 'USED' WHEN len(h) > 0 THEN 'LISTED' ELSE 'ABSENT' END AS level FROM h""",
)
def s10(spark, sf_dir):
    terms = F.array(*[F.lit(t) for t in ("platform", "users", "kafka", "team")])
    cut = cv(spark, sf_dir).select("doc_id", dims.evidence_sentences(F.col("text")).alias("ss"))
    return cut.select("doc_id", dims.skill_evidence(F.array(terms), F.col("ss"))[0].level.alias("level"))


@query(
    "r06_tail_decay",
    f"""WITH {BM25}, {TFIDF}, {FUSED}, g AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY floor(rrf * 1e6 + 0.5) DESC, doc_id) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM f)
SELECT query_id, doc_id, {SIX.format("greatest(0.01, least(0.49, 0.5 * (1 - (k - 1) / greatest(1, n)) * 0.95))")} AS probability FROM g""",
)
def r06(spark, sf_dir):
    """The cascade without a reranker: every document is in the tail."""
    found = retrieval.hybrid_search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), rerank=False, columns=["query_id", "doc_id", "probability"])
    return retrieval.bucketed(found.select("query_id", "doc_id", "probability"), "probability")


@query(
    "e07_delta_to_first",
    """WITH m AS (SELECT lang, floor(avg(n_chars) * 1e4 + 0.5) / 1e4 AS score FROM documents GROUP BY lang)
SELECT lang, score, floor((score - first_value(score) OVER (ORDER BY lang) + 1e6) * 1e3 + 0.5) / 1e3 AS delta, score = max(score) OVER () AS best FROM m""",
)
def e07(spark, sf_dir):
    means = load(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("score")).withColumn("score", bucket(F.col("score"), 4))
    found = evaluate.delta_to_first(means, "lang", ["score"])
    return found.select("lang", "score", bucket(F.col("delta_score") + 1e6, 3).alias("delta"), F.col("best_score").alias("best"))


@query("h03_context_rules", "SELECT event_type, (avg((least(1.0, value / 100) - (user_id % 5) / 4.0 > 0.2)::INT) > 0.3)::INT + (avg((least(1.0, value / 100) - (user_id % 5) / 4.0 < -0.2)::INT) > 0.3)::INT + (avg((abs(least(1.0, value / 100) - (user_id % 5) / 4.0) > 0.2)::INT) > 0.3)::INT AS n_rules FROM events GROUP BY 1")
def h03(spark, sf_dir):
    from rankloom.plans.analytics_queries import reviews

    found = feedback.context_rules(feedback.calibration(reviews(spark, sf_dir), ["event_type"]))
    return found.select("event_type", F.size("rules").alias("n_rules"))


@query("wn09_display_rank", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) END::INT AS display_rank FROM lineitem")
def wn09(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("doc_id"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("rank"), "l_linestatus")
    found = store.display_rank(rows, ["l_orderkey"], F.col("l_linestatus") == "F")
    return found.select("l_orderkey", F.col("doc_id").alias("l_linenumber"), "display_rank")


@query("pf4_mark_interrupted", "SELECT CASE WHEN o_orderstatus IN ('P', 'O') THEN 'failed' ELSE 'complete' END AS status, count(*) AS n FROM orders GROUP BY 1")
def pf4(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "processing").otherwise("complete")
    return store.mark_interrupted(load(spark, sf_dir, "orders").select(status.alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "st8_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY user_id, session""",
)
def st8_sessions(spark, sf_dir):
    """Sessions of half a day; the streaming form is the same aggregate with a watermark."""
    rows = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = rows.groupBy(F.session_window("ts", "12 hours"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
