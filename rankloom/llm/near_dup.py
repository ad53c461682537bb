"""Near-duplicates: fast similarity sketches, banding, exact verification, connected components.

1. Every text becomes its set of 5-word shingles; equal sets form a class, whose
   least doc_id stands for it.  Copies cost nothing beyond that.
2. A sketch of 128 coordinates (hashed bin placement in rounds) is cut into 32
   bands of 4; a pair at similarity 0.75 shares no band with probability 5e-6.
3. Buckets of up to ``SMALL`` members yield all their pairs.  A larger bucket is
   tested against one pivot member after another, linear work each, leaving out
   what is connected to the pivot already; pivots are the members that share
   most buckets, such as the original of a group of near copies.  What ``PIVOTS``
   rounds leave apart, families of texts that are mostly a little less than
   alike, is compared block by block (bounded memory); blocks confirm links
   themselves and emit no more of them than join their members.
4. Every candidate pair is confirmed on the full sets, and links are joined to
   components by label propagation over contracted links, in Spark.

A large group of copies or near copies thus never meets in one task and never
yields all its pairs.  No link between different texts is given up for the size of
a group; what sketches can miss is a pair at 0.75 that shares no band (5e-6, and
less above), and within blocks one whose estimate is five deviations low (3e-7).

Defined results: null, empty and blank texts have an empty set and link with
nothing, not even each other; rows of one doc_id count as one document; rows
with a null id link with nothing and are not kept; ties do not exist, since the
least doc_id decides; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, bound_batches, pick, table
from rankloom.llm.shingles import band_hashes, by_bytes, fast_similarity_sketch, shingle_sets

COORDINATES, BANDS = 128, 32
SMALL, PIVOTS, BLOCK = 8, 2, 512
ONE_TASK_EDGES = 200_000
BROADCAST_IDS = 1_000_000
ALIKE, OF = 75, 100


def _raw(texts) -> list[bytes]:
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


def sketched(docs: DataFrame, coordinates: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set, null if empty) and bands of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import blake2b

        for x in batches:
            raw = _raw(x["text"])
            for a, b in by_bytes(raw):
                sets = shingle_sets(raw[a:b])
                hashed = band_hashes(fast_similarity_sketch(sets, coordinates), bands)
                yield pd.DataFrame(
                    {
                        "doc_id": x["doc_id"].iloc[a:b].array,
                        "n_shingles": [len(s) for s in sets],
                        "set_key": [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        "bands": [h if len(s) else None for h, s in zip(hashed, sets, strict=True)],
                    }
                )

    return docs.mapInPandas(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its sorted shingle hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            raw = _raw(x["text"])
            for a, b in by_bytes(raw):
                yield pd.DataFrame({"doc_id": x["doc_id"].iloc[a:b].array, "shingles": [s.view(np.int64) for s in shingle_sets(raw[a:b])]})

    return docs.mapInPandas(run, "doc_id long, shingles array<long>")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) of every node of the edges (a, b): label is the least id that can be reached.

    Up to ``ONE_TASK_EDGES`` edges, a bounded amount, are joined in one task; beyond, labels spread in rounds: the least
    label around and then the label of that label, so chains halve.
    """
    edges = scratch.keep(edges.select("a", "b").distinct())
    if edges.count() <= ONE_TASK_EDGES:
        return edges.coalesce(1).mapInPandas(_joined, "id long, label long")
    both = scratch.keep(edges.union(edges.select("b", "a")).distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels.id == near.a, "left").select("id", "label", F.least("label", "near").alias("met"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("beyond"))
        new = scratch.keep(
            met.join(jump, F.col("met") == F.col("via"), "left").select("id", F.least("met", "beyond").alias("label"), (F.least("met", "beyond") < F.col("label")).alias("moved"))
        )
        moved = new.where("moved").limit(1).count()
        scratch.drop(labels)
        labels = new.select("id", "label")
        labels._scratch_path = new._scratch_path
        if not moved:
            return labels


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a bounded number of edges."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for x in batches:
        for a, b in zip(x["a"].tolist(), x["b"].tolist(), strict=True):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    ids = list(up)
    yield pd.DataFrame({"id": np.array(ids, np.int64), "label": np.array([top(i) for i in ids], np.int64)})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    one = lambda side: sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"s{side}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(one("a"), "a")
        .join(one("b"), "b")
        .where(F.greatest(F.size("sa"), F.size("sb")) * ALIKE <= F.least(F.size("sa"), F.size("sb")) * OF)
        .where(both * OF >= (F.size("sa") + F.size("sb") - both) * ALIKE)
        .select("a", "b")
    )


def _block_links(members: DataFrame, coordinates: int) -> DataFrame:
    """Confirmed links (a, b) between members of unlike label of a family; members: family, n_blocks, id, label, shingles.

    Members are dealt into blocks and every two blocks of a family meet in one group.  Sketches rule out pairs whose
    estimate is five deviations low; the rest is confirmed on the sets, except where links found before connect it.
    """
    dealt = members.withColumn("mine", F.pmod(F.xxhash64("id", "family"), F.col("n_blocks")).cast("int")).select(
        "family", "mine", "id", "label", "shingles", F.explode(F.expr("sequence(0, n_blocks - 1)")).alias("other")
    ).select("family", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "label", "shingles")
    cut = ALIKE / OF - 5 * (ALIKE / OF * (1 - ALIKE / OF) / coordinates) ** 0.5

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        ids, side = x["id"].to_numpy(), x["mine"].to_numpy()
        sets = [np.asarray(s, np.int64) for s in x["shingles"]]
        sizes = np.array([len(s) for s in sets])
        sketch = fast_similarity_sketch([s.view(np.uint64) for s in sets], coordinates).astype(np.uint16)
        group = np.unique(x["label"].to_numpy(), return_inverse=True)[1]  # joined as links are found
        a, b = [], []
        left, right = np.flatnonzero(side == x["i"].iloc[0]), np.flatnonzero(side == x["j"].iloc[0])
        for k in left:
            near = right[(group[right] != group[k]) & (np.minimum(sizes[right], sizes[k]) * OF >= np.maximum(sizes[right], sizes[k]) * ALIKE)]
            near = near[(sketch[near] == sketch[k]).mean(1) >= cut] if len(near) else near
            for m in near:
                if group[m] != group[k]:
                    both = len(np.intersect1d(sets[k], sets[m], assume_unique=True))
                    if both * OF >= (sizes[k] + sizes[m] - both) * ALIKE:
                        a.append(ids[k])
                        b.append(ids[m])
                        group[group == group[m]] = group[k]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.groupBy("family", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, coordinates: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    scratch = Scratch(spark)
    known = scratch.keep(sketched(docs, coordinates, bands))
    linked = known.where("doc_id is not null and set_key is not null")
    classes = scratch.keep(linked.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    reps = linked.join(classes, (linked.set_key == classes.set_key) & (linked.doc_id == classes.rep)).select("rep", "bands").dropDuplicates(["rep", "bands"])
    placed = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("first")).where("size > 1")
    # members of buckets that hold more than one class
    members = scratch.keep(placed.join(shared, "bucket").select("bucket", F.col("rep").alias("id"), "size", "first").distinct())
    ids = scratch.keep(members.select(F.col("id").alias("doc_id")).distinct())
    n_ids = ids.count()
    few = max(1, n_ids // 100_000)  # files of the small tables of ids
    wanted = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    sets = scratch.keep(full_sets(docs.join(wanted, "doc_id", "left_semi")))
    scratch.sweep()

    labels = ids.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("label"))

    def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels after the links, contracted to links between labels."""
        of = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"l{side}"))
        between = links.join(of("a"), "a").join(of("b"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        found = components(between, scratch).select(F.col("id").alias("label"), F.col("label").alias("new"))
        return scratch.keep(labels.join(found, "label", "left").select("id", F.coalesce("new", "label").alias("label")).coalesce(few))

    small = members.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    pair = F.transform(F.expr("sequence(0, size(ids) - 1)"), lambda i: F.transform(F.slice("ids", i + 2, SMALL), lambda y: F.struct(F.get("ids", i).alias("a"), y.alias("b"))))
    pairs = small.where("size(ids) > 1").select(F.explode(F.flatten(pair)).alias("p")).select("p.a", "p.b").distinct()
    labels = merge(labels, _verified(pairs, sets))

    large = members.where(F.col("size") > SMALL)
    degree = large.groupBy("id").agg(F.sum("size").alias("degree"))
    large = scratch.keep(large.join(degree, "id"))
    used = None
    for _ in range(PIVOTS):
        # buckets whose members differ in label, and of each the member of most company that has not been a pivot
        state = large.join(labels, "id")
        apart = state.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        fresh = state if used is None else state.join(used, "id", "left_anti")
        pivots = fresh.groupBy("bucket").agg(F.max_by(F.struct("id", "label"), F.struct("degree", -F.col("id"))).alias("pivot"))
        open_ = apart.join(pivots, "bucket").select("bucket", F.col("pivot.id").alias("pivot"), F.col("pivot.label").alias("pivot_label"))
        open_ = scratch.keep(open_.coalesce(few))
        if not open_.limit(1).count():  # all are alike, or all members of those that are not have been pivots
            break
        trial = state.join(open_, "bucket").where("label <> pivot_label").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        labels = merge(labels, _verified(trial, sets))
        new = open_.select(F.col("pivot").alias("id"))
        used = (new if used is None else used.union(new)).distinct()
    state = large.join(labels, "id")
    apart = state.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    left = scratch.keep(state.join(apart, "bucket", "left_semi").select("id", "label", "first"))
    if left.limit(1).count():
        # a family: what buckets that still differ connect; each member comes once, however many buckets it is in
        family = components(left.select(F.col("id").alias("a"), F.col("first").alias("b")), scratch).select("id", F.col("label").alias("family"))
        once = left.select("id", "label").distinct().join(family, "id")
        n = once.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
        found = _block_links(once.join(n, "family").join(sets.withColumnRenamed("doc_id", "id"), "id"), coordinates)
        labels = merge(labels, scratch.keep(found))

    scratch.sweep()
    # the least id of a component is that of one of its classes' representatives
    named = classes.join(labels, classes.rep == labels.id, "left").select("set_key", F.coalesce("label", "rep").alias("component"))
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return known.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept")
    )


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at similarity 0.75."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_near_dup": op3_near_dup}
ORACLE_SQL: dict[str, str] = {}
