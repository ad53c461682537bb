"""The whole match: sanitize, retrieve, score the dimensions, blend, rank; every query against the corpus in one plan.

Documents are sanitized once, whatever the number of queries, and kept in the
shared folder; only the overlap with the query text belongs to a pair, and comes
in by an equi-join on word n-grams.  Texts do not travel with the pairs: the
queries go to the documents where they are few, and only scores are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import DEFAULT, Config
from rankloom.functions.shared import keep
from rankloom.functions.text import band, bucket, ngrams, sigmoid, unfolded, words
from rankloom.operators import dimensions, retrieval
from rankloom.operators.sanitize import LEVELS, sanitize


def query_overlap(docs: DataFrame, queries: DataFrame, n: int = 4) -> DataFrame:
    """query_id, doc_id, overlap: share of a query's distinct word n-grams in each document that has any."""
    grams = lambda df, key: df.select(key, words("text").alias("ws")).select(key, unfolded(F.array_distinct(ngrams(F.col("ws"), n)), "g")).where("g IS NOT NULL")
    asked = keep(grams(queries, "query_id"))
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = _grams_between(docs, asked, n).join(retrieval._small(asked), "g").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"))
    return hits.join(retrieval._small(sizes), "query_id").select("query_id", "doc_id", (F.col("c") / F.col("n")).alias("overlap"))


#: So many first and last words of the queries' n-grams may be looked for before a document's n-grams are made.
MOST_ENDS = 10_000


def _grams_between(docs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """doc_id, g: distinct n-grams of the documents; of those whose first and last word no query has (if these are few) none is made."""
    at = F.split("g", " ")
    ends = [[r[0] for r in asked.select(F.get(at, F.lit(i))).distinct().limit(MOST_ENDS + 1).collect()] for i in (0, n - 1)]
    cut = docs.select("doc_id", words("text").alias("ws"))
    if max(map(len, ends)) > MOST_ENDS:
        made = ngrams(F.col("ws"), n)
    else:
        starts = F.when(F.size("ws") >= n, F.sequence(F.lit(1), F.size("ws") - (n - 1))).otherwise(F.array().cast("array<int>"))
        first, last = (words_ or [""] for words_ in ends)
        kept = F.filter(starts, lambda i: F.get("ws", i - 1).isin(first) & F.get("ws", i + (n - 2)).isin(last))
        made = F.transform(kept, lambda i: F.array_join(F.slice("ws", i, n), " "))
    return cut.select("doc_id", unfolded(F.array_distinct(made), "g")).where("g IS NOT NULL")


def match(
    docs: DataFrame, queries: DataFrame, keywords: list[str], second: DataFrame | None = None, weights: Column | None = None, pool: int | None = None, config: Config = DEFAULT
) -> DataFrame:
    """A row for each query (query_id, text) and document (doc_id, text), or for the ``pool`` best retrieved of each query.

    Gives the final score and rank, recommendation, confidence, threat level, penalty and flags, and all stage scores.
    ``weights`` is a struct w1..w4 of the four dimensions, the preset of a mid-level role unless given; ``second`` is as for
    ``hybrid_search``, and must be of clean texts.  Ties go by the place in retrieval.  A null text is an empty one.
    """
    safe = keep(sanitize(docs.select("doc_id", "text"), keywords, config=config).select("doc_id", F.col("clean_text").alias("text"), "threat"))
    clean = safe.select("doc_id", "text")
    found = keep(retrieval.hybrid_search(clean, queries, second, config=config) if pool is None else retrieval.search(clean, queries, pool, second, config=config))
    asked = dimensions.with_terms(queries.select("query_id", F.col("text").alias("query_text")))
    if pool is None:
        pairs = clean.crossJoin(retrieval._small(asked))
    else:
        pairs = found.select("query_id", "doc_id").join(clean, "doc_id").join(retrieval._small(asked), "query_id")
    scored = dimensions.deterministic_scores(pairs).select("query_id", "doc_id", "d1", "d2", "d3", "d4", "confidence")
    rows = found.join(scored, ["query_id", "doc_id"]).join(query_overlap(clean, queries), ["query_id", "doc_id"], "left").join(safe.select("doc_id", "threat"), "doc_id")

    overlap = F.coalesce("overlap", F.lit(0.0))
    shared = F.when(overlap > 0.3, F.least(overlap, F.lit(0.3))).otherwise(0.0)
    rows = rows.withColumn("overlap", overlap).withColumn("penalty", F.least(F.lit(config.max_penalty), 1 - (1 - F.col("threat.total_penalty")) * (1 - shared)))
    rows = rows.withColumn("threat_level", band(F.col("penalty"), LEVELS, "NONE"))
    repeated = F.when(F.col("overlap") > 0.3, F.array(F.lit("query text repeated"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("flags", F.when(~F.col("threat_level").isin("NONE", "LOW"), F.concat("threat.flags", repeated)).otherwise(F.array().cast("array<string>")))
    rows = dimensions.rationale(dimensions.blend(rows.withColumn("own_confidence", F.col("confidence")), weights, config.alpha))
    return retrieval.placed(rows, [F.desc("final"), F.asc("final_rank")]).select(
        "query_id", "doc_id", "rank", F.col("final").alias("final_score"), "recommendation", "confidence", "summary", "threat_level", "penalty", "flags",
        "bm25", "second", "rrf", F.col("final_rank").alias("retrieval_rank"), "logit", bucket(sigmoid(F.col("logit")), 4).alias("signal"), "d1", "d2", "d3", "d4", "dim", "overlap", "own_confidence",
    )


def rescore(matched: DataFrame, weights: Column, config: Config = DEFAULT) -> DataFrame:
    """A match under other weights: nothing is retrieved or scored again, the blend and the ranks are."""
    kept = [c for c in matched.columns if c not in {"rank", "final_score", "recommendation", "summary", "dim", "confidence"}]
    rows = matched.select(*kept, F.col("own_confidence").alias("confidence"))  # as it was before any downgrade
    again = dimensions.rationale(dimensions.blend(rows, weights, config.alpha))
    again = again.withColumn("final_score", F.col("final"))
    return retrieval.placed(again, [F.desc("final_score"), F.asc("retrieval_rank")]).select(*matched.columns)
