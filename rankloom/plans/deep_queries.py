"""Queries of dictionaries, tree hashes, repaired JSON, the vector index, exports and audits, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.dictionary import Dictionary, profile_by_patterns
from rankloom.functions.json_repair import repair_json
from rankloom.functions.shared import shared_folder
from rankloom.functions.text import bucket, tokens
from rankloom.operators import evaluate, fairness, retrieval, vector_index
from rankloom.plans.catalog import benchmark_queries, documents, load, query
from rankloom.plans.retrieval_queries import BM25, CASCADE, FUSED, SIX, TFIDF, TOKENS
from rankloom.sources import sinks


@query(
    "j11_dictionary",
    f"""WITH forms AS (SELECT DISTINCT form FROM (SELECT unnest({TOKENS}) AS form FROM documents) WHERE length(form) = 6),
parts AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(t) - 4), lambda i: substr(t, i, 6))) AS form FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) WHERE length(t) >= 6)
SELECT doc_id, count(*) AS n_forms, min(form) AS first_form, max(form) AS last_form FROM parts JOIN forms USING (form) GROUP BY doc_id""",
)
def j11_dictionary(spark, sf_dir):
    """Which of over ten thousand surface forms each whole text contains, inside words too, by one automaton."""
    docs = documents(spark, sf_dir)
    words = docs.select(F.explode(tokens("text")).alias("form")).where(F.length("form") == 6)
    found = docs.select("doc_id", Dictionary.of(words, "form").contained(F.lower("text")).alias("forms")).where("size(forms) > 0")
    return found.select("doc_id", F.size("forms").cast("long").alias("n_forms"), F.array_min("forms").alias("first_form"), F.array_max("forms").alias("last_form"))


NAMES = "'Skills: Python, C++ and Node.js on AWS; ' || (doc_id % 23)::VARCHAR || '+ years of experience, data pipeline, CKA. ' || coalesce(n_chars, 0)::VARCHAR || ' years exp '"


@query(
    "g5_profile_patterns",
    f"""WITH t AS (SELECT doc_id, lower({NAMES}) AS t, doc_id % 23 AS y, coalesce(n_chars, 0) AS n FROM documents)
SELECT doc_id, 'aws,data pipeline,node.js,python' AS skills, 'cka' AS certifications, greatest(y, n)::INT AS years FROM t""",
)
def g5(spark, sf_dir):
    """Skills, certificates and years by patterns alone; a profile is planted by a rule of the row."""
    docs = load(spark, sf_dir, "documents")
    said = F.concat(
        F.lit("Skills: Python, C++ and Node.js on AWS; "), (F.col("doc_id") % 23).cast("string"), F.lit("+ years of experience, data pipeline, CKA. "), F.coalesce(F.col("n_chars"), F.lit(0)).cast("string"), F.lit(" years exp ")
    )
    p = docs.select("doc_id", profile_by_patterns(said).alias("p"))
    return p.select("doc_id", F.array_join("p.technical_skills", ",").alias("skills"), F.array_join("p.certifications", ",").alias("certifications"), F.col("p.experience_years").alias("years"))


@query("f20_json_repair", "SELECT event_id, try_cast(regexp_extract(left(props, length(props) - 1 - event_id % 8), '[0-9]+') AS INT) AS k FROM events")
def f20_repair(spark, sf_dir):
    """Props of which up to eight characters are cut off, mended and read."""
    events = load(spark, sf_dir, "events").select("event_id", F.expr("left(props, length(props) - 1 - CAST(event_id % 8 AS INT))").alias("cut"))
    return events.select("event_id", F.from_json(repair_json(F.col("cut")), "k int").k.alias("k"))


@query(
    "r02_vector_index",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - qv[i]::DOUBLE) ** 2))) AS d FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d)
SELECT query_id, vec_id, floor(d * 1e6 + 0.5) / 1e6 AS d, rank FROM r WHERE rank <= 10""",
)
def r02_index(spark, sf_dir):
    """Ten nearest vectors of every vector whose id 50 divides, from an inverted file in its exact way (R2)."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")  # the stated query set
    found = vector_index.search(vector_index.build(vectors), asked, 10, exact=True)
    return found.select("query_id", "vec_id", bucket(F.col("d")).alias("d"), F.col("rank").cast("long").alias("rank"))


@query(
    "tk03_rerank_head",
    f"""WITH {BM25}, {TFIDF}, {FUSED}, {CASCADE},
t AS (SELECT query_id, doc_id, rrf_rank, coverage, CASE WHEN rrf_rank <= 20 THEN row_number() OVER (PARTITION BY query_id, rrf_rank <= 20 ORDER BY floor(coverage * 1e6 + 0.5) DESC, doc_id) ELSE rrf_rank END AS head_rank FROM g)
SELECT query_id, doc_id, head_rank FROM t WHERE head_rank <= 50""",
)
def tk03(spark, sf_dir):
    """The first twenty in the order of the reranker, the others of the pool as they were (TK3)."""
    pool = retrieval.search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 50)
    return retrieval.rerank_head(pool, F.col("coverage")).select("query_id", "doc_id", F.col("head_rank").cast("long").alias("head_rank"))


@query(
    "j03_rank_agreement",
    """WITH g AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS expected, count(*) OVER (PARTITION BY source) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en'),
p AS (SELECT g.source, expected, coalesce(rank, n) AS predicted FROM g LEFT JOIN r USING (source, doc_id))
SELECT source, floor((CASE WHEN count(*) < 2 THEN 1.0 ELSE 1 - 6 * sum((predicted - expected) ** 2) / (count(*) * (count(*) ** 2 - 1)) END) * 1e6 + 0.5) / 1e6 AS rho FROM p GROUP BY source""",
)
def j03(spark, sf_dir):
    """Rank correlation with the grades, where documents without a rank take the last one."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    gold = load(spark, sf_dir, "labels").where("quality IS NOT NULL").join(docs, "doc_id").select(F.col("source").alias("query_id"), "doc_id", F.col("quality").alias("grade"))
    ranking = docs.where("lang = 'en'").select(F.col("source").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("score"))
    found = evaluate.rank_agreement(retrieval.ranked(ranking).select("query_id", "doc_id", "rank"), gold, ["query_id"])
    return found.select(F.col("query_id").alias("source"), bucket(F.col("rho")).alias("rho"))


@query(
    "e06_metrics_bundle",
    """SELECT lang, count(quality) AS n_labelled, floor(avg(CASE WHEN quality = 1 THEN n_chars END) * 1e4 + 0.5) / 1e4 AS mean_good, floor(avg(CASE WHEN quality = 0 THEN n_chars END) * 1e4 + 0.5) / 1e4 AS mean_poor,
min(CASE WHEN quality = 1 THEN n_chars END) - max(CASE WHEN quality IS NULL OR quality = 0 THEN n_chars END) AS gap_good_poor FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
)
def e06(spark, sf_dir):
    """Means by grade and the gap between the least good and the best poor row."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").alias("score"))
    joined = docs.join(load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade")), "doc_id", "left")
    found = evaluate.label_means(joined, ["lang"]).join(joined.groupBy("lang").agg(F.count("grade").alias("n_labelled")), "lang")
    return found.select("lang", "n_labelled", bucket(F.col("mean_good"), 4).alias("mean_good"), bucket(F.col("mean_poor"), 4).alias("mean_poor"), F.col("gap_good_poor").cast("long").alias("gap_good_poor"))


EXPORTED = """SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS rank, o_orderkey AS doc_id, floor(o_totalprice::DOUBLE / 1e6 * 1e4 + 0.5) / 1e4 AS final, o_orderpriority AS recommendation FROM orders"""


def exported(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice").cast("double") / 1e6).alias("final"), "o_totalprice", F.col("o_orderpriority").alias("recommendation"))
    ranked = retrieval.placed(orders, [F.desc("o_totalprice"), F.asc("doc_id")])
    return ranked.select("query_id", "rank", "doc_id", "final", *[F.lit(0.5).alias(c) for c in ("d1", "d2", "d3", "d4", "penalty")], F.lit("HIGH").alias("confidence"), "recommendation")


@query("sk03_export_csv", EXPORTED)
def sk03(spark, sf_dir):
    """Results of every query written as CSV and read back (SK3)."""
    path = shared_folder(spark)
    sinks.export_csv(exported(spark, sf_dir), path)
    back = spark.read.option("header", True).schema("query_id long, rank long, doc_id long, final double, d1 double, d2 double, d3 double, d4 double, penalty double, confidence string, recommendation string").csv(path)
    return back.select("query_id", "rank", "doc_id", "final", "recommendation")


@query("sk02_export_json", EXPORTED)
def sk02(spark, sf_dir):
    """The same as nested JSON, a line for each block of a query's ranks (SK2, F21)."""
    path = shared_folder(spark)
    sinks.export_json(exported(spark, sf_dir), path)
    entry = "array<struct<rank:long,doc_id:long,final:double,recommendation:string>>"
    back = spark.read.schema(f"query_id long, block long, rankings {entry}").json(path).select("query_id", F.explode("rankings").alias("r"))
    return back.select("query_id", "r.rank", "r.doc_id", bucket(F.col("r.final"), 4).alias("final"), "r.recommendation")


AUDITED = "SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, n_chars, coalesce(text, '') AS text FROM documents"


def _tree_sql(source: str, value: str, fan: int, levels: int = 3) -> str:
    """CTEs that hash ``value`` of (query_id, rank) by trees of ``fan`` children; up to fan ** levels rows a group."""
    out = [f"{source}_0 AS (SELECT query_id, rank - 1 AS p, {value} AS h FROM {source})"]
    for k in range(1, levels + 1):
        out.append(f"{source}_{k} AS (SELECT query_id, p // {fan} AS p, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, ',' ORDER BY p)) END AS h FROM {source}_{k - 1} GROUP BY query_id, p // {fan})")
    return ", ".join(out)


@query(
    "c07_reproducibility",
    f"""WITH a AS ({AUDITED}), b AS (SELECT * REPLACE (CASE WHEN query_id = (SELECT min(source) FROM documents) THEN text || '!' ELSE text END AS text) FROM a),
{_tree_sql("a", "substr(sha256(text), 1, 16)", fairness.FAN)}, {_tree_sql("b", "substr(sha256(text), 1, 16)", fairness.FAN)}
SELECT x.query_id, CASE WHEN x.h <> y.h THEN 'hashes differs' ELSE '' END AS differences, x.h = y.h AS reproducible FROM a_3 x JOIN b_3 y USING (query_id)""",
)
def c07(spark, sf_dir):
    """Two audit records of every source, of which one has changed texts."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    one = docs.agg(F.min("source")).first()[0]
    changed = docs.withColumn("text", F.when(F.col("source") == one, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    results = retrieval.placed(docs.withColumnRenamed("source", "query_id"), ["doc_id"]).select(
        "query_id", "doc_id", "rank", F.col("n_chars").cast("double").alias("score"), F.lit("HIGH").alias("confidence"), F.lit("YES").alias("recommendation"), F.lit("NONE").alias("threat_level")
    )
    found = fairness.verify_reproducibility(fairness.audit_record(results, docs, "c"), fairness.audit_record(results, changed, "c"))
    return found.select("query_id", F.array_join("differences", ",").alias("differences"), "reproducible")


STOPS = ["the", "of", "and", "der", "de"]
_KEPT = f"list_filter({TOKENS}, lambda t: length(t) >= 2 AND t NOT IN ({', '.join(repr(s) for s in STOPS)}))"
_RUNS = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"


@query(
    "r03_tfidf_ngrams",
    f"""WITH d AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_RUNS}) AS term FROM (SELECT doc_id, {_KEPT} AS ws FROM documents)) GROUP BY ALL),
q AS MATERIALIZED (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_RUNS}) AS term FROM (SELECT item_id, {_KEPT} AS ws FROM benchmark)) GROUP BY ALL),
f AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT term, tf FROM d UNION ALL SELECT term, tf FROM q) GROUP BY term ORDER BY cf DESC, term LIMIT 10000),
i AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1 AS idf FROM f),
w AS MATERIALIZED (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM d JOIN i USING (term)), v AS MATERIALIZED (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM q JOIN i USING (term)),
nw AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY doc_id), nv AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM v GROUP BY query_id),
p AS (SELECT query_id, doc_id, sum(w.w * v.w) AS dot FROM w JOIN v USING (term) GROUP BY ALL)
SELECT query_id, doc_id, floor(dot / (nw.n * nv.n) * 1e6 + 0.5) / 1e6 AS score FROM p JOIN nw USING (doc_id) JOIN nv USING (query_id)""",
)
def r03_ngrams(spark, sf_dir):
    """TF-IDF over terms of up to two words without stop words, the 10,000 most frequent, fitted on documents and queries."""
    found = retrieval.tfidf_hits(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), STOPS, ngrams=2, max_features=10_000, fit_queries=True)
    return retrieval.bucketed(found, "score")
