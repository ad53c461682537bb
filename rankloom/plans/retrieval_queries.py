"""Queries of text statistics and retrieval, over all documents and the whole benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.config import DEFAULT
from rankloom.functions.order import positions
from rankloom.functions.shared import keep, shared_folder
from rankloom.functions.text import bucket, content_hash, ngrams, tokens, unfolded, words
from rankloom.operators import evaluate, live_index, retrieval, store
from rankloom.plans.catalog import benchmark_queries, documents, load, query
from rankloom.streaming.ledger import ResultTable

TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
SIX = "floor({} * 1e6 + 0.5) / 1e6"


@query("f01_tokens", f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, len(list_distinct({TOKENS}))::BIGINT AS n_distinct FROM documents")
def f01(spark, sf_dir):
    t = F.col("ts")
    return documents(spark, sf_dir).select("doc_id", tokens("text").alias("ts")).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(
    "f10_ngrams",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, CASE WHEN len(ws) < 4 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))) END::BIGINT AS n_grams FROM w""",
)
def f10(spark, sf_dir):
    cut = documents(spark, sf_dir).select("doc_id", words("text").alias("ws"))  # once per row, not once per gram
    return cut.select("doc_id", F.size(F.array_distinct(ngrams(F.col("ws"), 4))).cast("long").alias("n_grams"))


@query("f18_content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, substr(sha256(coalesce(text, '')), 1, 16) AS short_hash FROM documents")
def f18(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", content_hash("text").alias("content_hash"), content_hash("text", 16).alias("short_hash"))


@query("wn06_dedup_first", "SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def wn06(spark, sf_dir):
    return store.deduplicate(documents(spark, sf_dir)).select("content_hash", "doc_id")


@query("j15_duplicate_owner", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first_id, doc_id > min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS is_duplicate FROM documents")
def j15(spark, sf_dir):
    # a text that a third of the rows share: the owner comes from a partial aggregate and a join, not one window task
    docs = documents(spark, sf_dir).select("doc_id", content_hash("text").alias("content_hash"))
    first = docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "content_hash").select("doc_id", "first_id", (F.col("doc_id") > F.col("first_id")).alias("is_duplicate"))


@query("a01_df_tf_stats", f"WITH p AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term")
def a01(spark, sf_dir):
    per_doc = documents(spark, sf_dir).select("doc_id", F.explode(tokens("text")).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


BM25 = f"""p AS MATERIALIZED (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM p GROUP BY ALL),
dl AS MATERIALIZED (SELECT doc_id, len({TOKENS}) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS MATERIALIZED (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
bmhit AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
pairs AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents),
bm AS MATERIALIZED (SELECT query_id, doc_id, coalesce(s, 0.0) AS bm25 FROM pairs LEFT JOIN bmhit USING (query_id, doc_id))"""
TFIDF = f"""t2 AS MATERIALIZED (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) WHERE length(term) >= 2 GROUP BY ALL),
idf2 AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM t2 GROUP BY term),
w2 AS MATERIALIZED (SELECT doc_id, term, tf * idf AS w FROM t2 JOIN idf2 USING (term)),
n2 AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w2 GROUP BY doc_id),
q2 AS MATERIALIZED (SELECT query_id, term, tf * idf AS qw FROM (SELECT item_id AS query_id, term, 1 + ln(count(*)) AS tf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) WHERE length(term) >= 2 GROUP BY ALL) JOIN idf2 USING (term)),
qn2 AS (SELECT query_id, sqrt(sum(qw * qw)) AS q_norm FROM q2 GROUP BY query_id),
d2 AS (SELECT query_id, doc_id, sum(w * qw) AS dot FROM w2 JOIN q2 USING (term) GROUP BY ALL),
pairs2 AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents),
ti AS MATERIALIZED (SELECT query_id, doc_id, coalesce(dot / (norm * q_norm), 0.0) AS second FROM pairs2 LEFT JOIN d2 USING (query_id, doc_id) LEFT JOIN n2 USING (doc_id) LEFT JOIN qn2 USING (query_id))"""
FUSED = """r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(bm25 * 1e6 + 0.5) DESC, doc_id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY floor(second * 1e6 + 0.5) DESC, doc_id) AS r2 FROM bm JOIN ti USING (query_id, doc_id)),
f AS MATERIALIZED (SELECT *, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS rrf FROM r)"""
CASCADE = f"""cov AS (SELECT query_id, doc_id, count(*) / n_terms AS coverage FROM (SELECT doc_id, unnest(list_distinct({TOKENS})) AS term FROM documents) JOIN q USING (term) JOIN (SELECT query_id, count(*) AS n_terms FROM q GROUP BY 1) USING (query_id) GROUP BY query_id, doc_id, n_terms),
g AS (SELECT f.*, coalesce(coverage, 0.0) AS coverage, row_number() OVER (PARTITION BY query_id ORDER BY floor(rrf * 1e6 + 0.5) DESC, doc_id) AS rrf_rank, count(*) OVER (PARTITION BY query_id) AS n_all FROM f LEFT JOIN cov USING (query_id, doc_id)),
h AS (SELECT *, greatest(1, floor(0.5 * least(50, n_all))::INT) AS n_rerank FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id, rrf_rank <= n_rerank ORDER BY floor(coverage * 1e6 + 0.5) DESC, doc_id) AS rr FROM h),
k AS (SELECT *, CASE WHEN rrf_rank <= n_rerank THEN greatest(0.01, least(0.99, (n_rerank - rr + 1) / n_rerank))
  ELSE greatest(0.01, least(1.0 / n_rerank - 0.01, 1.0 / n_rerank * (1 - (rrf_rank - n_rerank - 1) / greatest(1, n_all - n_rerank)) * 0.95)) END AS probability FROM i),
z AS MATERIALIZED (SELECT *, CASE WHEN rrf_rank <= n_rerank THEN rr ELSE rrf_rank END AS final_rank FROM k)"""


@query("r01_bm25", f"WITH {BM25} SELECT query_id, doc_id, floor(bm25 * 1e4 + 0.5) / 1e4 AS score FROM bm")
def r01(spark, sf_dir):
    return retrieval.bucketed(retrieval.bm25(documents(spark, sf_dir), benchmark_queries(spark, sf_dir)), "score", digits=4)


@query("r03_tfidf_cosine", f"WITH {TFIDF} SELECT query_id, doc_id, {SIX.format('second')} AS score FROM ti")
def r03(spark, sf_dir):
    return retrieval.bucketed(retrieval.tfidf(documents(spark, sf_dir), benchmark_queries(spark, sf_dir)), "score")


@query(
    "r02_dense_dot",
    """SELECT a.vec_id AS doc_id, b.vec_id AS query_id, floor(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) * 1e6 + 0.5) / 1e6 AS score
FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) b""",
)
def r02(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")  # the stated query set
    return retrieval.bucketed(retrieval.dense(vectors, asked), "score")


@query("r04_rrf", f"WITH {BM25}, {TFIDF}, {FUSED} SELECT query_id, doc_id, r1 AS bm25_rank, r2 AS second_rank, {SIX.format('rrf')} AS rrf FROM f")
def r04(spark, sf_dir):
    docs, asked = documents(spark, sf_dir), benchmark_queries(spark, sf_dir)
    found = retrieval.hybrid_search(docs, asked, rerank=False, columns=["query_id", "doc_id", "bm25_rank", "second_rank", "rrf"])
    return found.select("query_id", "doc_id", F.col("bm25_rank").cast("long"), F.col("second_rank").cast("long"), bucket(F.col("rrf")).alias("rrf"))


@query(
    "r05_rerank_cascade",
    f"WITH {BM25}, {TFIDF}, {FUSED}, {CASCADE} SELECT query_id, doc_id, rrf_rank, {SIX.format('probability')} AS probability, {SIX.format('ln(probability / (1 - probability))')} AS logit FROM z",
)
def r05(spark, sf_dir):
    found = retrieval.hybrid_search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), columns=["query_id", "doc_id", "rrf_rank", "probability", "logit"])
    return retrieval.bucketed(found.select("query_id", "doc_id", F.col("rrf_rank").cast("long").alias("rrf_rank"), "probability", "logit"), "probability", "logit")


@query(
    "r10_hybrid_search",
    f"WITH {BM25}, {TFIDF}, {FUSED}, {CASCADE} SELECT query_id, doc_id, {SIX.format('bm25')} AS bm25, {SIX.format('second')} AS second, {SIX.format('rrf')} AS rrf, final_rank FROM z WHERE final_rank <= 50",
)
def r10(spark, sf_dir):
    """The pool of 50 per query, which is the operator's own limit."""
    found = retrieval.search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 50)
    return retrieval.bucketed(found.select("query_id", "doc_id", "bm25", "second", "rrf", F.col("final_rank").cast("long").alias("final_rank")), "bm25", "second", "rrf")


METRICS = """, m AS (SELECT {keys}, rank, coalesce(quality, 0)::DOUBLE AS rel, row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(quality, 0)::DOUBLE DESC, rank) AS ideal FROM {source} LEFT JOIN labels USING (doc_id)),
a AS (SELECT {keys}, {parts}, coalesce(1.0 / min(CASE WHEN rel >= 0.5 THEN rank END), 0.0) AS mrr FROM m GROUP BY ALL)"""


def _metric_sql(keys: str, source: str) -> str:
    parts = ", ".join(
        f"CASE WHEN sum(CASE WHEN ideal <= {k} THEN rel / log2(ideal + 1) ELSE 0 END) = 0 THEN 0 ELSE sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= {k} THEN rel / log2(ideal + 1) ELSE 0 END) END AS ndcg_{k}, sum(CASE WHEN rank <= {k} AND rel >= 0.5 THEN 1 ELSE 0 END) / {k} AS p_{k}"
        for k in (3, 5, 10)
    )
    return METRICS.format(keys=keys, source=source, parts=parts)


NAMES = ["ndcg_3", "p_3", "ndcg_5", "p_5", "ndcg_10", "p_10", "mrr"]
SELECTED = ", ".join(f"{SIX.format(n)} AS {n}" for n in NAMES)


def _labels(spark, sf_dir):
    return load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("grade"))


@query("e01_ranking_metrics", f"WITH {BM25}, s AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY floor(bm25 * 1e6 + 0.5) DESC, doc_id) AS rank FROM bm){_metric_sql('query_id', 's')} SELECT query_id, {SELECTED} FROM a")
def e01(spark, sf_dir):
    """nDCG, precision and reciprocal rank of BM25 per query."""
    scores = retrieval.bm25(documents(spark, sf_dir), benchmark_queries(spark, sf_dir))
    # kept as they are ranked, so that the ranges of the order are drawn from a table and the pairs are scored once
    scores = keep(scores.select("query_id", "doc_id", (-F.floor(F.col("score") * 1e6 + 0.5)).alias("_b")))
    ranking = retrieval.placed(scores, ["_b", "doc_id"]).drop("_b")
    found = evaluate.ranking_metrics(evaluate.with_relevance(ranking, _labels(spark, sf_dir)), ["query_id"])
    return retrieval.bucketed(found.select("query_id", *NAMES), *NAMES)


ABLATION = f"""WITH {BM25}, {TFIDF}, {FUSED}, {CASCADE},
u AS (SELECT 1 AS level, 'tfidf' AS approach, query_id, doc_id, r2 AS rank FROM f UNION ALL SELECT 2, 'bm25', query_id, doc_id, r1 FROM f
UNION ALL SELECT 3, 'rrf', query_id, doc_id, rrf_rank FROM z UNION ALL SELECT 4, 'cascade', query_id, doc_id, final_rank FROM z){_metric_sql('level, approach, query_id', 'u')}
SELECT level, approach, {", ".join(f"{SIX.format(f'avg({n})')} AS {n}" for n in NAMES)} FROM a GROUP BY level, approach"""


@query("r12_ablation", ABLATION)
def r12(spark, sf_dir):
    """The ladder of rankers: the first places of each tell its metrics, as all of them rank every document.

    Only a query with no relevant document among the first of some ranker, while there is one, is ranked to its end.
    """
    docs, asked, labels = documents(spark, sf_dir), benchmark_queries(spark, sf_dir), _labels(spark, sf_dir)
    ladder = [(1, "tfidf", "second_rank"), (2, "bm25", "bm25_rank"), (3, "rrf", "rrf_rank"), (4, "cascade", "final_rank")]
    names = spark.createDataFrame(ladder, "level int, approach string, ranker string")
    best = keep(evaluate.ideal_order(evaluate.with_relevance(docs.select("doc_id"), labels)))
    metrics = keep(_ladder_metrics(retrieval.first_ranks(docs, asked), labels, names, best))
    if best.where(F.col("rel") >= DEFAULT.relevance_threshold).limit(1).count():
        late = metrics.where("mrr = 0").select("query_id").distinct()
        if late.limit(1).count():
            ranks = F.explode(F.array(*[F.struct(F.lit(c).alias("ranker"), F.col(c).alias("rank")) for _, _, c in ladder]))
            found = retrieval.hybrid_search(docs, asked.join(late, "query_id", "left_semi"), columns=["query_id", "doc_id", *[c for _, _, c in ladder]])
            whole = _ladder_metrics(found.select("query_id", "doc_id", ranks.alias("r")).select("query_id", "doc_id", "r.*"), labels, names, best)
            metrics = metrics.join(late, "query_id", "left_anti").unionByName(whole)
    means = metrics.groupBy("level", "approach").agg(*[F.avg(n).alias(n) for n in NAMES])
    return retrieval.bucketed(means, *NAMES)


def _ladder_metrics(ranks, labels, names, best):
    union = ranks.join(F.broadcast(names), "ranker").select("level", "approach", "query_id", "doc_id", F.col("rank").cast("long").alias("rank"))
    return evaluate.ranking_metrics(evaluate.with_relevance(union, labels), ["level", "approach", "query_id"], best=best)


@query(
    "e04_spearman",
    f"""WITH {BM25}, s AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY floor(bm25 * 1e6 + 0.5) DESC, doc_id) AS rank FROM bm),
g AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, doc_id) AS expected, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS predicted FROM s JOIN labels USING (doc_id))
SELECT query_id, floor((1 - 6 * sum((predicted - expected) ** 2) / (count(*) * (count(*) ** 2 - 1))) * 1e6 + 0.5) / 1e6 AS rho FROM g GROUP BY query_id""",
)
def e04(spark, sf_dir):
    """Agreement of BM25 with the grades over the labelled documents.

    Only those are ranked, as their order among themselves is that among all; the expected order is the same for every query.
    """
    docs = documents(spark, sf_dir)
    labelled = positions(_labels(spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_semi"), [F.desc("grade"), "doc_id"], "_p")
    expected = labelled.select("doc_id", (F.col("_p") + 1).alias("expected"))
    scores = retrieval.bm25(docs, benchmark_queries(spark, sf_dir)).join(expected, "doc_id")
    key = (-F.floor(F.col("score") * 1e6 + 0.5)).alias("_b")
    pairs = retrieval.placed(keep(scores.select("query_id", "doc_id", key, "expected")), ["_b", "doc_id"], "predicted")
    return retrieval.bucketed(evaluate.spearman(pairs, ["query_id"]), "rho")


@query(
    "j14_overlap_ratio",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents),
v AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))) AS g FROM w WHERE len(ws) >= 4),
b AS (SELECT query_id, unnest(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))) AS g FROM v WHERE len(ws) >= 4)
SELECT query_id, doc_id, floor(count(*) / n * 1e6 + 0.5) / 1e6 AS ratio FROM d JOIN b USING (g) JOIN (SELECT query_id, count(*) AS n FROM b GROUP BY 1) USING (query_id) GROUP BY query_id, doc_id, n""",
)
def j14(spark, sf_dir):
    """Share of a query's 4-grams in each document that has any, as an equi-join on grams."""
    grams = lambda df, key: df.select(key, words("text").alias("ws")).select(key, unfolded(F.array_distinct(ngrams(F.col("ws"), 4)), "g")).where("g IS NOT NULL")
    asked = grams(benchmark_queries(spark, sf_dir), "query_id")
    n = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = grams(documents(spark, sf_dir), "doc_id").join(retrieval._small(asked), "g").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"))
    return hits.join(retrieval._small(n), "query_id").select("query_id", "doc_id", bucket(F.col("c") / F.col("n")).alias("ratio"))


@query(
    "x11_match_run",
    f"""WITH d AS (SELECT min(doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY sha256(coalesce(text, ''))), {BM25.replace("FROM documents", "FROM d").replace("benchmark, documents", "benchmark, d")},
r AS (SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY floor(s * 1e6 + 0.5) DESC, doc_id) AS rank FROM bmhit)
SELECT query_id, doc_id, floor(s * 1e4 + 0.5) / 1e4 AS score, rank FROM r""",
)
def x11(spark, sf_dir):
    """Three runs over an index that is kept up: labelled documents, then all others while one language leaves, which then comes back.

    What is left equals an index built anew: every distinct text, under its smallest id (X11).
    """
    docs, asked = documents(spark, sf_dir), benchmark_queries(spark, sf_dir)
    # what tells the runs apart is joined to the texts once, and not to all of them in every run
    labelled = load(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"), F.lit(False).alias("german"))
    german = load(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", F.lit(False).alias("labelled"), F.lit(True).alias("german"))
    marks = keep(labelled.union(german).groupBy("doc_id").agg(F.bool_or("labelled").alias("labelled"), F.bool_or("german").alias("german")))
    marked = keep(docs.join(retrieval._small(marks), "doc_id", "left").select("doc_id", "text", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("labelled", "german")]))
    folder = shared_folder(spark)
    index = live_index.LiveIndex(spark, f"{folder}/index", buckets=16)
    results = ResultTable(spark, f"{folder}/results", ["query_id", "doc_id"], "run", buckets=8)
    live_index.match_run(index, results, "runs", 0, asked, marked.where("labelled"))
    index.update("upkeep", 0, marked.where("NOT labelled"), marks.where("german").select("doc_id"))
    live_index.match_run(index, results, "runs", 1, asked, marked.where("german"))
    found = results.read().where("status = 'scored'")
    return found.select("query_id", "doc_id", bucket(F.col("score"), 4).alias("score"), F.col("rank").cast("long").alias("rank"))
