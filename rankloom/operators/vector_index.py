"""Nearest neighbours by an inverted file: centroids, a list of vectors for each, and searches that open few lists.

Centroids are fitted on a bounded sample; every vector is put into the list of its nearest
centroid.  A search opens the ``probes`` nearest lists (measure its recall with
``recall``), or, with ``exact``, every list that could still hold a neighbour: the distance
of a query to a list's centroid less the list's radius is a lower bound for all in it,
and lists are opened in two steps, the nearest ones to learn how near the k-th neighbour
is at most, then the others whose bound is not beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.blocks import packed, unpacked
from rankloom.functions.shared import keep, spread
from rankloom.operators.retrieval import _small, dot

SAMPLE, ROUNDS, SLACK = 20_000, 12, 1e-9


class VectorIndex(NamedTuple):
    """centroids as an array; lists: vec_id, vector, list, far; sizes: list, n, radius."""

    centroids: np.ndarray
    lists: DataFrame
    sizes: DataFrame


def fit_centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds over a sample; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].astype(float)
    for _ in range(rounds):
        near = _distances(sample, found).argmin(1)
        counts = np.bincount(near, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None], 0))


def _nearest(vectors: DataFrame, key: str, centroids: np.ndarray, n: int, name: str) -> DataFrame:
    """key, vector and ``name``: (list, distance) of the ``n`` nearest centroids (all unless n), nearest first."""
    kind = vectors.schema[key].dataType.simpleString()
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                d = _distances(np.stack(x["vector"].to_numpy()).astype(float), sent.value)
                order = np.argsort(d, 1, kind="stable")[:, : n or d.shape[1]]
                yield x.assign(**{name: [[{"list": int(i), "d": float(row[i])} for i in o] for row, o in zip(d, order, strict=True)]})

    return vectors.select(key, "vector").mapInPandas(run, f"{key} {kind}, vector array<double>, {name} array<struct<list:int,d:double>>")


def build(vectors: DataFrame, n_lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """An index of (vec_id, vector); every vector is in it.  About the square root of the table's rows lists, unless told."""
    vectors = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    n = vectors.count()
    drawn = vectors.orderBy(F.xxhash64("vec_id")).limit(sample).select("vector").toPandas()  # a bounded number
    if not n:
        raise ValueError("there are no vectors")
    centroids = fit_centroids(np.stack(drawn["vector"].to_numpy()), n_lists or max(1, round(n**0.5)))
    put = _nearest(vectors, "vec_id", centroids, 1, "near").select("vec_id", "vector", F.col("near")[0].list.alias("list"), F.col("near")[0].d.alias("far"))
    lists = keep(put.repartitionByRange("list", "vec_id"))
    return VectorIndex(centroids, lists, keep(lists.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius"))))


def _scored(index: VectorIndex, asked: DataFrame, opened: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, d, block, at: of the opened lists the k nearest of each query, none beyond its bound.

    ``asked``: blocks of queries; ``opened``: list, block, ats, bounds (places in the block and what each must not exceed).
    Blocks of a list meet the blocks of queries that open it, and a task cuts what it found before it is sent.
    """
    held = spread(packed(index.lists.repartition("list").sortWithinPartitions("list"), "vec_id", "vector", "list"))
    pairs = held.join(_small(opened), "list").join(_small(asked), "block").where("dim = q_dim")
    kinds = {"query_id": asked.schema["asked"].dataType.elementType.simpleString(), "vec_id": index.lists.schema["vec_id"].dataType.simpleString()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                dim, ats = of["dim"][i].as_py(), of["ats"][i].values.to_numpy(zero_copy_only=False)
                vectors, queries = unpacked(of["matrix"][i].as_py(), dim), unpacked(of["q_matrix"][i].as_py(), dim)[ats]
                ids, q_ids = of["keys"][i].values, of["asked"][i].values.take(pa.array(ats))
                bounds = of["bounds"][i].values.to_numpy(zero_copy_only=False)
                v, q, d = _nearest_of(vectors, queries, _objects(ids), _objects(q_ids), bounds, k)
                found = pa.table({"query_id": q_ids.take(pa.array(q)), "vec_id": ids.take(pa.array(v)), "d": pa.array(d), "block": pa.array(np.full(len(q), of["block"][i].as_py(), np.int64)), "at": pa.array(ats[q].astype(np.int32))})
                # the k nearest of a query, ties by id
                found = found.take(pc.sort_indices(found, [("at", "ascending"), ("d", "ascending"), ("vec_id", "ascending")]))
                at = found["at"].to_numpy()
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
                place = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
                yield from found.filter(pa.array(place < k)).to_batches()

    shape = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, d double, block long, at int"
    return _best(pairs.mapInArrow(run, shape), k)


def _objects(ids: pa.Array) -> np.ndarray:
    """Ids that can be compared; only integers without nulls stay as they are."""
    return ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) and not ids.null_count else np.array([*ids.to_pylist(), None], dtype=object)[:-1]


def _nearest_of(vectors: np.ndarray, queries: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, query, distance) of all that can be among the k nearest and are not beyond a query's bound.

    A product of matrices tells which they may be, with some slack; their distances are summed anew in the order of the dimensions.
    """
    squares = (vectors * vectors).sum(1)[:, None] + (queries * queries).sum(1)[None]
    rough = squares - 2 * (vectors @ queries.T)
    rough[np.isnan(rough)] = np.inf
    same = ids[:, None] == q_ids[None]
    if ids.dtype == object or q_ids.dtype == object:  # a vector without an id counts only for a query without one
        known = lambda x: np.array([v is not None for v in x], bool)
        same = (same | ~known(ids)[:, None]) & known(q_ids)[None]
    most = bounds * bounds
    if len(vectors) > k and np.isinf(bounds).any():
        most = np.minimum(most, np.partition(np.where(same, np.inf, rough), k - 1, axis=0)[k - 1])
    v, q = np.nonzero((rough <= most[None] + SLACK * (1 + squares)) & ~same)
    d = np.zeros(len(v))
    for x, y in zip(vectors.T, queries.T, strict=True):
        difference = x[v] - y[q]
        d += difference * difference
    d = np.sqrt(d)
    near = ~(d > bounds[q])
    return v[near], q[near], d[near]


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _places(asked: DataFrame, centroids: np.ndarray) -> DataFrame:
    """block, at and ``near``: (list, distance) of every centroid, nearest first, for each query of the blocks."""
    sent = asked.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, matrix in zip(*(batch.column(c).to_pylist() for c in ("block", "q_dim", "q_matrix")), strict=True):
                d = _distances(unpacked(matrix, dim), sent.value)
                order = np.argsort(d, 1, kind="stable")
                pairs = pa.StructArray.from_arrays([pa.array(order.ravel().astype(np.int32)), pa.array(np.take_along_axis(d, order, 1).ravel())], ["list", "d"])
                offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), block, np.int64)), pa.array(np.arange(len(d), dtype=np.int32)), pa.ListArray.from_arrays(offsets, pairs)], ["block", "at", "near"])

    return asked.select("block", "q_dim", "q_matrix").mapInArrow(run, "block long, at int, near array<struct<list:int,d:double>>")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
    """query_id, vec_id, d, rank: the ``k`` nearest vectors (Euclidean; ties by id) of each query (query_id, vector) but itself."""
    blocks = packed(queries, "query_id", "vector").where(F.col("dim") == index.centroids.shape[1])
    asked = keep(blocks.select(F.monotonically_increasing_id().alias("block"), F.col("keys").alias("asked"), F.col("dim").alias("q_dim"), F.col("matrix").alias("q_matrix")))
    near = keep(_places(asked, index.centroids))
    places = near.select("block", "at", F.posexplode("near").alias("pos", "l")).select("block", "at", "pos", "l.list", "l.d")
    places = places.join(_small(index.sizes), "list")
    # by list and block: a query's vector travels once and not with each list that it opens
    opening = lambda df, bound: df.groupBy("list", "block").agg(F.collect_list(F.struct("at", bound.alias("b"))).alias("o")).select("list", "block", F.col("o.at").alias("ats"), F.col("o.b").alias("bounds"))
    first = _scored(index, asked, opening(places.where(F.col("pos") < probes), F.lit(float("inf"))), k)
    if not exact:
        return first.drop("block", "at")
    first = keep(first)
    # the k-th neighbour so far; with fewer there is no bound yet
    worst = first.groupBy("block", "at").agg(F.max("d").alias("worst"), F.count("*").alias("got"))
    bound = F.when(F.col("got") == k, F.col("worst")).otherwise(float("inf"))
    more = places.where(F.col("pos") >= probes).join(_small(worst), ["block", "at"], "left").withColumn("bound", F.coalesce(bound, F.lit(float("inf"))))
    rest = _scored(index, asked, opening(more.where((F.col("d") - F.col("radius")) * (1 - SLACK) <= F.col("bound") + SLACK), F.col("bound")), k)
    return _best(first.drop("rank").union(rest.drop("rank")), k).drop("block", "at")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours (query_id, vec_id) that were found."""
    return truth.join(found.select("query_id", "vec_id", F.lit(1).alias("_hit")), ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0]


def brute_force(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same by comparing a stated set of queries with every vector."""
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("qv"))
    pairs = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).crossJoin(_small(asked)).where("vec_id <> query_id")
    d = F.sqrt(F.greatest(dot(F.col("vector"), F.col("vector")) - 2 * dot(F.col("vector"), F.col("qv")) + dot(F.col("qv"), F.col("qv")), F.lit(0.0)))
    return _best(pairs.select("query_id", "vec_id", d.alias("d")), k)
