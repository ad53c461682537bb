"""The SQL functions against the column functions, archives and concatenated objects."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from rankloom import surface
from rankloom.functions import text as columns
from rankloom.operators import retrieval


@pytest.fixture(scope="module")
def registered(spark):
    surface.register(spark)
    docs = spark.createDataFrame([(1, "Red fox, red dog"), (2, "blue dog"), (3, None), (4, "blue dog")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red dog"), (8, "fox")], "query_id long, text string")
    surface.tables(spark, docs, asked)
    return docs, asked


def test_scalars(spark, registered):
    df = spark.createDataFrame([("A b-C d", 1.23456, "9"), (None, -2.5, "x"), ("é a", None, None)], "s string, x double, n string")
    df.createOrReplaceTempView("scalars")
    got = spark.sql("SELECT rl_tokens(s) t, rl_words(s) w, rl_ngrams(rl_words(s), 2) g, rl_content_hash(s) h, rl_sigmoid(x) e, rl_bucket(x, 2) b, rl_clamp(x, 0, 1) c, rl_tolerant_int(n, 0, 5) i, rl_logit(0.25D) l FROM scalars").collect()
    want = df.select(columns.tokens("s").alias("t"), columns.words("s").alias("w"), columns.content_hash("s").alias("h"), columns.sigmoid(F.col("x")).alias("e"), columns.bucket(F.col("x"), 2).alias("b"), columns.clamp(F.col("x")).alias("c"), columns.tolerant_int(F.col("n"), 0, 5).alias("i")).collect()
    assert [{k: r[k] for k in "twhebci"} for r in got] == [r.asDict() for r in want]
    assert got[0].g == ["a b-c", "b-c d"] and got[2].g == ["é a"] and got[1].g == [] and got[0].l == pytest.approx(-1.098612, abs=1e-6)


def test_table_functions(spark, registered):
    docs, asked = registered
    got = {(r.query_id, r.doc_id): r.score for r in spark.sql("SELECT * FROM rl_bm25()").collect()}
    want = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_hits(docs, asked).collect()}
    assert got == pytest.approx(want)
    assert [tuple(r) for r in spark.sql("SELECT query_id, doc_id, rank FROM rl_ranked() WHERE rank = 1 ORDER BY query_id").collect()] == [(7, 1, 1), (8, 1, 1)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM rl_duplicates()").collect()] == [(4, 2)]


def test_members(spark, registered):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/x.txt", "hello")
        z.writestr("y.txt", "")
    spark.createDataFrame([(1, held.getvalue()), (2, b"no archive"), (3, None)], "id int, c binary").createOrReplaceTempView("archives")
    got = sorted((r.id, r.name or "", bytes(r.content or b""), r.reason is None) for r in spark.sql("SELECT id, m.* FROM archives, LATERAL rl_members(c) m").collect())
    assert got == [(1, "a/x.txt", b"hello", True), (1, "y.txt", b"", True), (2, "", b"", False), (3, "", b"", False)]


def test_objects(spark, registered, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1} {"b": "é"}\n[2]{"cut', encoding="utf-8")
    (tmp_path / "two.json").write_text("".join(f'{{"k": {i}, "v": "{"é" * 40}"}}' for i in range(30_000)), encoding="utf-8")
    read = spark.read.format("rankloom_objects").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 2
    one = sorted((r.place, r.object) for r in read.where("file LIKE '%one.json'").collect())
    assert one == [(0, '{"a": 1}'), (1, '{"b": "é"}'), (2, "[2]"), (3, '{"cut')]
    parsed = read.where("file LIKE '%two.json'").select(F.from_json("object", "k long, v string").alias("o")).agg(F.sum("o.k"), F.min(F.length("o.v")), F.count("o.v")).first()
    assert tuple(parsed) == (sum(range(30_000)), 40, 30_000)
