"""What no query runs: the encoder slot, the choice of a provider, defaults of calibration, stored indexes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import feedback, retrieval, runs
from rankloom.sources import sinks


def test_encoder_slot(spark):
    asked = []

    def encoder(texts):
        asked.append(len(texts))
        assert len(texts) <= 3 and all(len(t) <= 5 for t in texts)
        return [[len(t), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i) for i in range(9)] + [(9, None)], "doc_id long, text string")
    got = {r.doc_id: r.vector for r in retrieval.encode(rows, "doc_id", encoder, most_chars=5, batch=3).collect()}
    for i, v in got.items():
        want = np.array([min(i, 5) if i < 9 else 0, 1.0])
        assert v == pytest.approx(list(want / np.linalg.norm(want)))
    assert len(got) == 10


@pytest.mark.parametrize(("key", "model", "want"), [(True, True, "service"), (True, False, "service"), (False, True, "local"), (False, False, "tfidf")])
def test_provider(key, model, want):
    assert retrieval.choose_provider(key, model) == want


def test_feedback_defaults(spark):
    rows = spark.createDataFrame([("j", "d", None, None), ("j", "e", 5.0, "own")], "job_id string, doc_id string, timestamp double, feedback_id string")
    got = {r.doc_id: (r.timestamp, r.feedback_id) for r in feedback.with_defaults(rows, 12.5).collect()}
    assert got == {"d": (12.5, "fb_j_d_12500"), "e": (5.0, "own")}


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b résumé"), (3, None)], "doc_id long, text string")
    path = str(tmp_path / "i")
    assert not sinks.index_is_valid(spark, docs, path, "m", "c")
    sinks.build_index(docs, path, "m", "c")
    assert sinks.index_is_valid(spark, docs, path, "m", "c") and not sinks.index_is_valid(spark, docs, path, "other", "c")
    assert {tuple(r) for r in sinks.load_index(spark, path).select("doc_id", "term", "tf", "dl").collect()} == {(1, "a", 2, 3), (1, "b", 1, 3), (2, "b", 1, 2), (2, "résumé", 1, 2)}
    assert tuple(sinks.index_stats(spark, path).first()) == (4, 3, 2)
    asked = spark.createDataFrame([(7, "résumé b")], "query_id long, text string")
    kept = {(r.doc_id, round(r.score, 9)) for r in retrieval.bm25_hits(docs, asked, index=sinks.load_index(spark, path)).collect()}
    assert kept == {(r.doc_id, round(r.score, 9)) for r in retrieval.bm25_hits(docs, asked).collect()} and len(kept) == 2
    sinks.invalidate_index(spark, path)
    assert not sinks.index_is_valid(spark, docs, path, "m", "c")


def test_clamp_passes_nulls(spark):
    from rankloom.functions.text import clamp

    got = [r[0] for r in spark.createDataFrame([(None,), (-1.0,), (0.25,), (7.0,)], "x double").select(clamp(F.col("x"))).collect()]
    assert got == [None, 0.0, 0.25, 1.0]


def test_usage_of_unknown_models(spark):
    calls = spark.createDataFrame([("s", "big", 1_000_000, 0), ("s", "what", 0, 1_000_000)], "stage string, model string, tokens_in long, tokens_out long")
    assert [r.cost_usd for r in runs.usage(calls, {"big": (2.0, 4.0)}, "big").collect()] == [2.0, 4.0]
