"""Partitioned relational reads, and the vector index against comparing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import vector_index
from rankloom.sources import readers


def test_relational_scan(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"n{i % 7}", i / 2) for i in range(500)] + [(None, "keyless", 0.0)], "ID int, NAME string, X double")
    rows.coalesce(1).write.format("jdbc").option("url", url).option("dbtable", "items").option("createTableColumnTypes", "NAME VARCHAR(20)").option("driver", "org.apache.derby.jdbc.EmbeddedDriver").save()
    read = readers.read_table(spark, url, "items", "id", 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert read.rdd.getNumPartitions() == 4 and read.count() == 501
    assert sorted(len(p) > 50 for p in read.select("id").rdd.glom().collect()) == [True] * 4
    some = read.where("name = 'n3' AND x > 100").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(NAME,n3)" in plan.replace("name", "NAME") and "GreaterThan(X,100.0)" in plan.replace("(x", "(X")
    assert {r[0] for r in some.collect()} == {i for i in range(500) if i % 7 == 3 and i / 2 > 100}
    assert readers.read_table(spark, url, "items", driver="org.apache.derby.jdbc.EmbeddedDriver").rdd.getNumPartitions() == 1
    none = readers.read_table(spark, url, "(SELECT * FROM items WHERE id < 0) AS t", "id", 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert none.count() == 0


def vectors(spark, n=600, d=8):
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 4, (12, d))
    made = [(int(i), [float(v) for v in middle[i % 12] + rng.normal(0, 1, d)]) for i in range(n)]
    made += [(n + k, made[5][1]) for k in range(20)] + [(n + 50, None)]  # one vector in many rows
    return spark.createDataFrame(made, "vec_id long, vector array<double>").repartition(3)


@pytest.mark.parametrize("k", [1, 10, 700])
def test_vector_index(spark, k):
    of = vectors(spark)
    asked = of.where("vec_id % 50 = 0 AND vector IS NOT NULL").select(F.col("vec_id").alias("query_id"), "vector")
    index = vector_index.build(of, n_lists=24)
    assert index.lists.count() == 620
    truth = {(r.query_id, r.vec_id): r.d for r in vector_index.brute_force(of.where("vector IS NOT NULL"), asked, k).collect()}
    got = {(r.query_id, r.vec_id): r.d for r in vector_index.search(index, asked, k, probes=4, exact=True).collect()}
    assert got.keys() == truth.keys() and all(abs(got[p] - truth[p]) < 1e-6 for p in truth)
    if k == 10:
        few = vector_index.search(index, asked, k, probes=6)
        assert vector_index.recall(few, vector_index.brute_force(of.where("vector IS NOT NULL"), asked, k)) >= 0.9


def test_vector_index_recall_on_the_tables(spark):
    of = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    asked = of.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = vector_index.search(vector_index.build(of), asked, 10, probes=16)
    assert vector_index.recall(found, vector_index.brute_force(of, asked)) >= 0.9
