"""Prefix trie of conversations, built level by level.

Conversations are first rebuilt: a conversation takes the first turns of the one
that opens its hundred and goes on with its own (``rebuilt``).  Then, for each
depth, the live conversations are grouped by (parent node, next turn); a group is
a node and its smallest conv_id names it (``grow``).  A conversation that is alone
in its node is no longer live: what follows is a chain, which is written out at
once.  Levels with shared nodes are then rolled up from the deepest one, each
joined to the sums of the level below (``roll_up``).

Turns are compared by the SHA-256 of role and text, so texts do not travel.
Groups are counted by partial aggregates, and members find their node by a join
with one row for each group, which adaptive execution splits where a turn is
common.  The digest of the members that end in a node needs their ids in order:
ids are sorted by ranges, joined to pieces of text range by range (``PIECE`` ids
at most), and only the pieces of a node meet, in order, as a stream.

Defined results: rows without a conv_id are ignored; turns are ordered by turn
(null first), then role, then the digest of role and text; rows that are equal in
these are turns like others; a conversation that has rows but no rebuilt turn is
a member of the root that ends there; an empty table has no nodes, not even a
root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.order import positions
from rankloom.llm.common import Scratch, bound_batches, pick, table

HUNDRED, MOST_TAKEN, PIECE = 100, 6, 4096
NOTHING = hashlib.sha256().hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def taken(conv_id):
    """How many turns a conversation takes from the first of its hundred: 0 to 5, by crc32 of its id in decimal."""
    return (F.crc32(F.col(conv_id).cast("string")) % MOST_TAKEN).cast("int")


def rebuilt(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, size) of every rebuilt turn, and (conv_id, n_turns) of every conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    named = pick(rows, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.length(text).alias("size"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    # the row of the scan comes last: it parts equal turns, so that many of them need not share a range
    placed = positions(named, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("row")], "at", scratch.keep)
    turns = placed.select("conv_id", "key", "size", "at")
    own = scratch.keep(turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    opening = (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("opening")
    # of an opening conversation at most five turns are taken, by at most 199 conversations
    firsts = own.where(F.col("conv_id") % HUNDRED == 0).join(turns, "conv_id").where(F.col("at") - F.col("first") < MOST_TAKEN - 1)
    firsts = firsts.groupBy(F.col("conv_id").alias("opening")).agg(F.array_sort(F.collect_list(F.struct("at", "key", "size"))).alias("lent"))
    found = own.withColumn("opening", opening).join(firsts, "opening", "left").withColumn("h", taken("conv_id"))
    lent = F.slice(F.coalesce("lent", F.expr("CAST(array() AS array<struct<at:bigint,key:binary,size:int>>)")), F.lit(1), F.col("h"))
    convs = scratch.keep(found.select("conv_id", "first", "n", "h", lent.alias("lent")))
    head = convs.select("conv_id", F.posexplode("lent").alias("depth", "turn")).select("conv_id", (F.col("depth") + 1).alias("depth"), "turn.key", "turn.size")
    tail = turns.join(convs.select("conv_id", "first", "h", F.size("lent").alias("m")), "conv_id").where(F.col("at") - F.col("first") >= F.col("h"))
    tail = tail.select("conv_id", (F.col("m") + F.col("at") - F.col("first") - F.col("h") + 1).cast("int").alias("depth"), "key", "size")
    n_turns = F.size("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    return scratch.keep(head.union(tail).repartitionByRange("depth", "conv_id")), scratch.keep(convs.select("conv_id", n_turns.cast("int").alias("n_turns")))


def grow(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Of each level with live conversations: (parent, node, n, size, alone, n_turns), its nodes; the root comes first.

    ``n_turns`` is that of the one member where there is but one.  The members of the shared nodes that end there
    are kept in ``scratch.ends``, (node, depth, conv_id).
    """
    root = scratch.keep(convs.agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("n_turns").alias("n_turns")).where("n > 0"))
    first = root.first()
    if first is None:
        return []
    levels = [root.select(F.lit(None).cast("long").alias("parent"), "node", "n", F.lit(0).alias("size"), "n_turns")]
    live = convs.select("conv_id", "n_turns", F.lit(first.node).alias("node"))
    scratch.ends = [convs.where("n_turns = 0").select(F.lit(first.node).alias("node"), F.lit(0).alias("depth"), "conv_id")]
    deepest = first.n_turns if first.n > 1 else 0
    depth = 0
    while depth < deepest:
        depth += 1
        step = turns.where(F.col("depth") == depth).join(live.withColumnRenamed("node", "parent"), "conv_id").select("conv_id", "n_turns", "parent", "key", "size")
        step = scratch.keep(step)
        nodes = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("size").alias("size"), F.max("n_turns").alias("n_turns"))
        nodes = scratch.keep(nodes)
        levels.append(nodes.select("parent", "node", "n", "size", "n_turns"))
        shared = nodes.where("n > 1")
        deepest = shared.agg(F.max("n_turns")).first()[0] or 0
        if not deepest:
            break
        live = step.join(shared.select("parent", "key", "node"), ["parent", "key"]).select("conv_id", "n_turns", "node")
        scratch.ends.append(live.where(F.col("n_turns") == depth).select("node", F.lit(depth).alias("depth"), "conv_id"))
    return levels


def roll_up(levels: list[DataFrame], scratch: Scratch) -> list[DataFrame]:
    """Of each level, the nodes of ``grow`` with n_children, n_leaves and saved; a chain below a lone member is one leaf."""
    done: list[DataFrame] = []
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth]
        saved = (F.col("n") - 1) * F.col("size").cast("long")
        follows = (F.col("n") == 1) & (F.col("n_turns") > depth)
        if below is None:  # no shared node goes on from the last level
            out = nodes.select("*", F.when(follows, 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved"))
        else:
            sums = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
            children = F.coalesce(F.col("c"), F.when(follows, 1).otherwise(0)).cast("long")
            out = nodes.join(sums, "node", "left").select(*nodes.columns, children.alias("n_children"), F.coalesce("l", F.lit(1)).alias("n_leaves"), (saved + F.coalesce("s", F.lit(0))).alias("saved"))
        below = scratch.keep(out)
        done.append(below)
    return done[::-1]


def ordered_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, depth, ends_sha256): SHA-256 of each node's conv_ids in decimal, ascending, joined by commas."""
    order = ["depth", "node", "conv_id"]
    placed = positions(ends, order, "at", scratch.keep)
    pieces = placed.groupBy("depth", "node", F.floor(F.col("at") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("depth", "node", "piece", F.array_join("ids", ",").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for x in batches:
            rows = []
            for depth, node, text in zip(x["depth"].tolist(), x["node"].tolist(), x["text"].tolist(), strict=True):
                if (depth, node) != now:
                    if now is not None:
                        rows.append((*now, digest.hexdigest()))
                    now, digest = (depth, node), hashlib.sha256(text.encode())
                else:
                    digest.update(f",{text}".encode())
            yield pd.DataFrame(rows, columns=["depth", "node", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=["depth", "node", "ends_sha256"])

    streams = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "piece")
    return streams.select("depth", "node", "text").mapInPandas(run, "depth int, node long, ends_sha256 string")


def prefix_trie(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text)."""
    spark = rows.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark)
    turns, convs = rebuilt(rows, scratch)
    levels = roll_up(grow(turns, convs, scratch), scratch)
    if not levels:
        none = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return spark.createDataFrame([], none)
    nodes = None
    for depth, level in enumerate(levels):
        level = level.withColumn("depth", F.lit(depth))
        nodes = level if nodes is None else nodes.union(level)
    ends = scratch.ends[0]
    for some in scratch.ends[1:]:
        ends = ends.union(some)
    # the digest of one id, where a lone member ends, needs no order
    own_end = F.sha2(F.col("node").cast("string"), 256)
    lone = F.col("n") == 1
    digests = scratch.keep(ordered_digests(ends.where("depth = 0 OR node IS NOT NULL"), scratch))
    shared = nodes.where(~lone | (F.col("depth") == 0)).join(digests, ["depth", "node"], "left").withColumn("ends", F.coalesce("ends_sha256", F.lit(NOTHING))).drop("ends_sha256")
    single = nodes.where(lone & (F.col("depth") > 0)).withColumn("ends", F.when(F.col("n_turns") == F.col("depth"), own_end).otherwise(F.lit(NOTHING)))
    both = shared.unionByName(single)
    first = both.select(
        F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    below = nodes.where(lone & (F.col("n_turns") > F.col("depth"))).select("node", "n_turns", F.explode(F.sequence(F.col("depth") + 1, F.col("n_turns"))).alias("depth"))
    last, one = F.col("depth") == F.col("n_turns"), F.lit(1).cast("long")
    chains = below.select(
        F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, own_end).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    found = scratch.keep(first.union(chains))
    scratch.drop_all_but(found)
    return found


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the given conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH steps AS (SELECT list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR _ IN range(8)]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v, i FROM range(256) t(i)),
  crc AS (SELECT list(v ORDER BY i) AS v FROM steps),
  turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: xor(a >> 8, crc.v[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h, conv_id - conv_id % 100 AS opening FROM (SELECT DISTINCT conv_id FROM turns), crc),
  lent AS (SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.opening AND t.pos <= c.h),
  m AS (SELECT c.conv_id, c.h, count(l.depth) AS m FROM convs c LEFT JOIN lent l USING (conv_id) GROUP BY ALL),
  whole AS (SELECT * FROM lent UNION ALL SELECT conv_id, m + pos - h, role, text FROM turns JOIN m USING (conv_id) WHERE pos > h),
  ends AS (SELECT conv_id, coalesce(max(depth), 0) AS n_turns FROM convs LEFT JOIN whole USING (conv_id) GROUP BY 1),
  path AS (SELECT conv_id, depth, length(text) AS size, list(sha256(strlen(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM whole
    UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
  member AS (SELECT conv_id, depth, size, min(conv_id) OVER (PARTITION BY depth, prefix) AS node, count(*) OVER (PARTITION BY depth, prefix) AS n FROM path),
  nodes AS (SELECT a.depth, a.node, a.n, a.size, b.node AS parent FROM member a LEFT JOIN member b ON a.conv_id = b.conv_id AND b.depth = a.depth - 1 WHERE a.conv_id = a.node),
  children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS c FROM nodes WHERE depth > 0 GROUP BY ALL),
  sums AS (SELECT above.depth, above.node, sum((x.n - 1) * x.size) AS saved, count(*) FILTER (WHERE k.c IS NULL) AS leaves
    FROM nodes x LEFT JOIN children k ON k.depth = x.depth AND k.node = x.node JOIN member above ON above.conv_id = x.node AND above.depth <= x.depth GROUP BY ALL),
  digests AS (SELECT m.depth, m.node, sha256(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id)) AS d FROM member m JOIN ends e ON e.conv_id = m.conv_id AND e.n_turns = m.depth GROUP BY ALL)
SELECT x.node AS conv_id, CAST(x.depth AS BIGINT) AS depth, x.parent AS parent_conv_id, x.n AS n_convs, coalesce(k.c, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(d.d, sha256('')) AS ends_sha256
FROM nodes x LEFT JOIN children k ON k.depth = x.depth AND k.node = x.node JOIN sums s ON s.depth = x.depth AND s.node = x.node LEFT JOIN digests d ON d.depth = x.depth AND d.node = x.node
"""

QUERIES = {"op13_turn_trie": op13_turn_trie}
ORACLE_SQL = {"op13_turn_trie": ORACLE.strip()}
