"""The sparse search against ranking every pair, where queries have few hits, none, negative and equal scores."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.config import Config
from rankloom.functions.order import positions
from rankloom.operators import retrieval


def corpus(spark, seed, n=150):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice("the of a bb cc dd ee ff".split()) for _ in range(rnd.randint(0, 8)))) for i in rnd.sample(range(1000), n)]
    rows += [(2000 + i, "rare word here") for i in range(3)] + [(3000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("seed", "pool", "config"), [(2, 7, Config(pool=10, rrf_k=3)), (3, 60, Config(rrf_k=30, bm25_epsilon=-0.5))])
def test_search_is_the_top_of_every_pair(spark, seed, pool, config):
    docs = corpus(spark, seed)
    asked = spark.createDataFrame([(1, "the of a bb"), (2, "rare"), (3, "nowhere"), (4, None), (5, "a"), (6, "the rare cc cc a")], "query_id int, text string")
    every = retrieval.hybrid_search(docs, asked, config=config).where(F.col("final_rank") <= pool)
    few = retrieval.search(docs, asked, pool, config=config)
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*every.columns).collect())
    got, want = shown(few), shown(every)
    assert len(got) == min(pool, 154) * 6
    assert got == want


def test_search_of_nothing(spark):
    asked = spark.createDataFrame([(1, "b")], "query_id int, text string")
    assert retrieval.search(spark.createDataFrame([], "doc_id long, text string"), asked, 5).count() == 0
    docs = spark.createDataFrame([(1, "b")], "doc_id long, text string")
    assert retrieval.search(docs, asked.where("false"), 5).count() == 0


def test_positions(spark):
    rows = [(i * 37 % 101, None if i % 9 == 0 else f"k{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = sorted((r.position, r.b is not None, r.b or "", r.a) for r in positions(df, [F.col("b").asc_nulls_first(), "a"]).collect())
    assert [g[0] for g in got] == list(range(400))
    assert [g[1:] for g in got] == sorted((b is not None, b or "", a) for a, b in rows)


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 1000)
    long_texts = spark.createDataFrame([(1, "x" * 2000)], "query_id int, text string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(retrieval._small(long_texts.select("query_id")))
    assert not hinted(retrieval._small(long_texts))
