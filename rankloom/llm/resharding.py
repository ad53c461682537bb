"""Minimum-cost-flow resharding: move the fewest bytes from an old layout to new row capacities.

A layout is a folder of Parquet files for each shard; a row's slot is its place in
the shard's files, one after the other.  ``read_layout`` reads one; ``reshard_layout``
solves the moves from the sizes it finds there and writes anew the folders of those
shards that gain or lose rows.  Folders that nothing changes stay where they are,
nothing is overwritten, and a shard that loses all its rows has no folder in the
new layout, so a row is never in two shards and a lost job leaves the old layout
whole.  Rows that stay in their shard are not shuffled: the task that reads their
file writes them.  The text of a moving row is shuffled once, to the task that
writes it: most rows know their shard from the group they are in, and only those of
groups that a move divides are ranked.

Law ``rows``: after the move, shards hold counts at most one apart.  Rows of an
old shard are summed into blocks (old shard, power-of-two size class).  A
minimum-cost flow ships each block's rows either back into the shard of the same
number, for nothing, or to other shards, at the block's mean row size, and of a
block that is split the smallest rows go (to a sixteenth of the class).  So what
moves are the smallest rows of the shards that have too many; the minimum is exact
up to that sixteenth.  The flow graph depends only on the shard counts and the
size classes, never on the corpus.

Ranks inside a block are built in two levels (``STEPS`` size steps times
``SUB_BLOCKS`` hashed parts per block, then a row number inside each), so no shard
is ever sorted by one task, however many rows are of one size.

Defined results: null text has size 16 and crc32 0; null ids are rows like any
other; equal rows are interchangeable; an empty table gives an empty result and
an empty layout; further columns are ignored by ``reshard`` and kept by layouts,
but for two of the names ``SHARD`` and ``SLOT``, which layouts use themselves.
"""

from __future__ import annotations

from collections import deque
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import Scratch, table, unused

STEPS, SUB_BLOCKS = 16, 16
ROW_OVERHEAD = 16
SHARD, SLOT = "layout_shard", "layout_slot"
FILES, FILE_BYTES = 8, 256 << 20  # tasks that write one shard at least, and the stored bytes that each may have to write


def min_cost_flow(n_nodes: int, edges: list[tuple[int, int, int, float]], source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) edge, by successive shortest augmenting paths."""
    to, cap, cost, at = [], [], [], [[] for _ in range(n_nodes)]
    for u, v, c, w in edges:
        at[u].append(len(to))
        to += [v, u]
        at[v].append(len(to) - 1)
        cap += [c, 0]
        cost += [w, -w]
    while True:
        best, via, queued = [float("inf")] * n_nodes, [-1] * n_nodes, [False] * n_nodes
        best[source] = 0
        todo = deque([source])
        while todo:
            u = todo.popleft()
            queued[u] = False
            for e in at[u]:
                if cap[e] and best[u] + cost[e] < best[to[e]] - 1e-9:
                    best[to[e]], via[to[e]] = best[u] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        todo.append(to[e])
        if via[sink] < 0:
            return [cap[2 * i + 1] for i in range(len(edges))]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def solve_moves(blocks: list[tuple[int, int, int, int]], new_shards: int) -> list[tuple]:
    """Plan rows (old, class, from_rank, to_rank, shard, first_slot) for (old, class, rows, bytes) blocks."""
    blocks = sorted(blocks)
    total = sum(b[2] for b in blocks)
    room = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    first, hub, sink = 1 + len(blocks), 1 + len(blocks) + new_shards, 2 + len(blocks) + new_shards
    edges, stays = [], {}
    for i, (old, _, rows, size) in enumerate(blocks):
        edges.append((0, 1 + i, rows, 0.0))
        if old < new_shards:
            stays[i] = len(edges)
            edges.append((1 + i, first + old, rows, 0.0))
        edges.append((1 + i, hub, rows, size / rows))
    into = len(edges)
    edges += [(hub, first + j, total, 0.0) for j in range(new_shards)]
    edges += [(first + j, sink, room[j], 0.0) for j in range(new_shards)]
    flow = min_cost_flow(sink + 1, edges, 0, sink)
    spare, j = [flow[into + k] for k in range(new_shards)], 0
    slots, plan = [0] * new_shards, []
    for i, (old, size_class, rows, _) in enumerate(blocks):
        done = flow[stays[i]] if i in stays else 0
        parts = [(0, done, old)] if done else []
        while done < rows:
            while not spare[j]:
                j += 1
            take = min(spare[j], rows - done)
            parts.append((done, done + take, j))
            spare[j] -= take
            done += take
        for a, b, shard in parts:
            plan.append((old, size_class, a, b, shard, slots[shard]))
            slots[shard] += b - a
    return plan


class _Names(NamedTuple):
    """Working columns that the rows do not have."""

    size_class: str
    step: str
    sub: str
    in_sub: str
    before: str
    moves: str
    whole: str
    move: str


def _groups(rows: DataFrame, old: str, size: str, new_shards: int, tie: list) -> tuple[DataFrame, DataFrame, list, _Names]:
    """``rows`` with the columns of their group, the moves of each group (a small table), and the plan."""
    spark = rows.sparkSession
    taken, names = rows, []
    for name in _Names._fields:
        names.append(unused(taken, f"_{name}"))
        taken = taken.withColumn(names[-1], F.lit(None))
    n = _Names(*names)
    as_double = F.col(size).cast("double")
    rows = (
        rows.withColumn(n.size_class, F.floor(F.log2(as_double)).cast("int"))
        # large rows first: what leaves a block are its last ranks
        .withColumn(n.step, F.floor((2 - as_double / F.pow(F.lit(2.0), F.col(n.size_class))) * STEPS).cast("int"))
        .withColumn(n.sub, F.pmod(F.xxhash64(*tie, F.lit("part")), F.lit(SUB_BLOCKS)).cast("int"))
    )
    keys = [old, n.size_class, n.step, n.sub]
    # at most old shards x size classes x STEPS x SUB_BLOCKS rows, whatever the corpus
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(size).alias("b")).collect()
    blocks, offsets = {}, []
    for r in sorted(sums, key=lambda r: tuple(r[k] for k in keys)):
        done, b = blocks.get((r[old], r[n.size_class]), (0, 0))
        offsets.append((*[r[k] for k in keys], done, done + r.n))
        blocks[r[old], r[n.size_class]] = (done + r.n, b + r.b)
    plan = solve_moves([(*k, *v) for k, v in blocks.items()], new_shards)
    by_block: dict = {}
    for o, c, a, b, to, first in plan:
        by_block.setdefault((o, c), []).append((a, b, to, first))
    sent = []
    for o, c, step, sub, begin, end in offsets:
        met = [m for m in by_block[o, c] if m[0] < end and m[1] > begin]
        sent.append((o, c, step, sub, begin, met, met[0][2] if len(met) == 1 else None))
    kinds = f"{old} int, {n.size_class} int, {n.step} int, {n.sub} int, {n.before} long, {n.moves} array<struct<a:long,b:long,shard:int,slot:long>>, {n.whole} int"
    return rows, F.broadcast(spark.createDataFrame(sent, kinds)), plan, n


def _ranked(joined: DataFrame, old: str, tie: list, n: _Names) -> tuple[DataFrame, Column, Column]:
    """Rows joined with their group's moves, and their shard and slot by rank."""
    in_group = Window.partitionBy(old, n.size_class, n.step, n.sub).orderBy(*tie)
    rank = F.col(n.before) + F.col(n.in_sub) - 1
    ranked = joined.withColumn(n.in_sub, F.row_number().over(in_group)).withColumn(n.move, F.filter(n.moves, lambda m: (m.a <= rank) & (rank < m.b))[0])
    return ranked, F.col(n.move).shard, F.col(n.move).slot + rank - F.col(n.move).a


def _size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + ROW_OVERHEAD).cast("long")


def _crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def reshard(docs: DataFrame, old_shard: Column, new_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot of every row; ``old_shard``: a column of ints >= 0."""
    text = F.col("text")
    rows = docs.select("doc_id", _size_of(text).alias("size"), _crc_of(text).alias("text_crc32"), old_shard.cast("int").alias("old_shard"))
    tie = [F.col(c) for c in ("doc_id", "size", "text_crc32")]
    rows, moves, _, n = _groups(rows, "old_shard", "size", new_shards, tie)
    placed, shard, slot = _ranked(rows.join(moves, ["old_shard", n.size_class, n.step, n.sub]), "old_shard", tie, n)
    return placed.select("doc_id", "size", "text_crc32", "old_shard", shard.alias("shard"), slot.alias("slot"))


class Layout(NamedTuple):
    """A stored layout: the folder of each shard that has rows, and the rows' schema."""

    folders: dict[int, str]
    schema: T.StructType


def _stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df``, a scan, reads, as the optimizer knows them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _write(rows: DataFrame, path: str, shard_bytes: int, in_place: DataFrame | None = None) -> Layout:
    """Store ``rows``, each shard by a task for every ``FILE_BYTES`` of ``shard_bytes``, and ``in_place``, rows that lie together by shard already, as they lie."""
    tasks = max(FILES, -(-shard_bytes // FILE_BYTES))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != SHARD]), F.lit(tasks))
    dealt = rows.repartition(F.col(SHARD), spread)
    (dealt if in_place is None else in_place.union(dealt)).write.option("compression", "zstd").partitionBy(SHARD).parquet(path)
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in at.getFileSystem(conf).listStatus(at)]
    folders = {int(n.split("=")[1]): f"{path}/{n}" for n in names if n.startswith(f"{SHARD}=")}
    return Layout(folders, rows.drop(SHARD).schema)


def store_layout(docs: DataFrame, shard: Column, path: str, n_shards: int = 1) -> Layout:
    """Write ``docs``, a table as it is stored, under ``path`` by the int column ``shard`` of about ``n_shards`` values."""
    return _write(docs.drop(SLOT).withColumn(SHARD, shard.cast("int")), path, _stored_bytes(docs) // n_shards)


def read_layout(spark: SparkSession, layout: Layout) -> DataFrame:
    """The rows of a layout with their shard in ``SHARD`` and their place in it in ``SLOT``."""
    roots: dict[str, list[str]] = {}
    for folder in layout.folders.values():
        roots.setdefault(folder.rsplit("/", 1)[0], []).append(folder)
    schema = T.StructType([*layout.schema.fields, T.StructField(SHARD, T.IntegerType())])
    if not roots:
        return spark.createDataFrame([], schema).withColumn(SLOT, F.lit(None).cast("long"))
    read = [spark.read.schema(schema).option("basePath", root).parquet(*sorted(folders)) for root, folders in sorted(roots.items())]
    file, at = unused(read[0], "_file"), unused(read[0], "_at")
    placed = reduce(DataFrame.union, [r.select(*r.columns, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)) for r in read])
    # one number per file: where it begins in its shard
    sizes = sorted((r[SHARD], r[file], r.n) for r in placed.groupBy(SHARD, file).agg(F.count("*").alias("n")).collect())
    begins, last, done = [], None, 0
    for shard, name, n in sizes:
        done = done if shard == last else 0
        begins.append((name, done))
        last, done = shard, done + n
    starts = spark.createDataFrame(begins, f"{file} string, {SLOT} long")
    return placed.join(F.broadcast(starts), file).withColumn(SLOT, F.col(SLOT) + F.col(at)).drop(file, at)


def reshard_layout(spark: SparkSession, layout: Layout, new_shards: int, path: str, keep_old: str | None = None) -> Layout:
    """The layout of ``new_shards`` shards; what changes is written under ``path``, a new folder.

    ``keep_old`` names a column to add for the old shard; then every shard is written.
    """
    stored = read_layout(spark, layout).drop(SLOT)
    old = unused(stored, "_old")
    rows = stored.withColumnRenamed(SHARD, old)
    size = unused(rows, "_size")
    tie = [F.xxhash64(*[F.col(f"`{c}`") for c in stored.columns if c != SHARD]), *[F.col(c) for c in ("doc_id", "text") if c in stored.columns]]
    rows, moves, plan, n = _groups(rows.withColumn(size, _size_of(F.col("text"))), old, size, new_shards, tie)
    affected = {s for o, _, _, _, j, _ in plan if o != j for s in (o, j)} if keep_old is None else set(layout.folders) | {p[4] for p in plan}
    if not affected:
        return layout
    columns = [F.col(f"`{c}`") for c in stored.columns if c not in (SHARD, keep_old)] + ([F.col(old).alias(keep_old)] if keep_old else [])
    joined = rows.join(moves, [old, n.size_class, n.step, n.sub])
    divided, shard, _ = _ranked(joined.where(F.col(n.whole).isNull()), old, tie, n)
    whole = lambda stays: joined.where((F.col(n.whole) == F.col(old)) == stays).select(*columns, F.col(n.whole).alias(SHARD))
    moved, met = whole(False).union(divided.select(*columns, shard.alias(SHARD))), F.col(SHARD).isin(sorted(affected))
    # rows that stay are written by the task that reads their file; the rest is shuffled
    written = _write(moved.where(met), path, _stored_bytes(stored) // new_shards, whole(True).where(met))
    return Layout({j: f for j, f in layout.folders.items() if j not in affected} | written.folders, written.schema)


def op6_resharding(spark: SparkSession, sf_dir: str, old_shards: int = 32, new_shards: int = 40) -> DataFrame:
    """All documents from a stored layout of 32 hashed shards into one of 40, law ``rows``, as the files of the new one have them."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    old = store_layout(docs, F.pmod(F.xxhash64("doc_id"), F.lit(old_shards)), f"{scratch.root}/old", old_shards)
    scratch.sweep()
    rows = read_layout(spark, reshard_layout(spark, old, new_shards, f"{scratch.root}/new", "old_shard"))
    return rows.select(
        "doc_id", _size_of(F.col("text")).alias("size"), _crc_of(F.col("text")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col(SHARD).alias("shard"), F.col(SLOT).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


QUERIES = {"op6_resharding": op6_resharding}
ORACLE_SQL: dict[str, str] = {}
