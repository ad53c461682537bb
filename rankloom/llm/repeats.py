"""Repeated passages: bytes covered by a ``LEAST``-byte string that also starts elsewhere.

Strings that are equal share their minimiser, the ``ANCHOR``-byte window of least
hash in them, so they can be brought together without comparing anything else:

1. Equal texts are one text; where it occurs twice, all of it (if long enough)
   is repeated.
2. The starts of each text fall into runs of one minimiser; only (hash, range)
   is kept of a run.  Runs that span the same bytes within a text are repeated,
   and one of them goes on for the rest; so do all whose hash occurs twice.
3. Of those runs the bytes that their strings span are cut out and equal cuts
   are counted; a cut that occurs twice is repeated as a whole.
4. The differing cuts of a minimiser go together into a shard, whose Burrows-Wheeler
   transform yields the repeated starts (``suffix_array``).  Minimisers are dealt by
   hash into buckets and a bucket's by running size into shards, so that a shard has
   less than ``SHARD_BYTES`` besides its largest minimiser.
5. A minimiser with more than ``CUTS`` differing cuts, say where a common passage
   begins, is not put into one shard: its strings are dealt by a 128-bit hash of
   each and counted, the exact way for what does not fit.

Nothing is capped or sampled; memory is that of a batch of texts, or a shard.

``cut_repeats`` can ask for words as well: with ``words`` only covered spans that
hold so many words are cut (a span that begins or ends inside a word counts the
part as one), so a passage law in words is ``least`` bytes well below its length.

Defined results: a null text is the empty one and stays null; a text shorter than
``LEAST`` has no repeats; ids play no part, so null or repeated ids do no harm;
equal rows have equal results; an empty table gives an empty result; extra columns
of any name are kept by ``cut_repeats`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, bound_batches, pick, table, unused
from rankloom.llm.shingles import mix
from rankloom.llm.suffix_array import repeated_starts

LEAST, ANCHOR = 400, 64
CUTS, SHARD_BYTES, CHUNK = 1_024, 1 << 18, 1 << 17
BROADCAST_TEXTS = 1_000_000
_rng = np.random.default_rng(97)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) * 2 + 1 for x in _rng.integers(1 << 61, 1 << 62, 2)]
SPANS = "array<struct<a:long,b:long>>"


def _windows(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each position on, by doubling."""
    part, size, power = _BYTE[x], 1, base
    out, done = None, 0
    while True:
        if width & size:
            if out is None:
                out = part
            else:  # what is there already, then this part
                out = out[: len(x) - done - size + 1] * np.uint64(power) + part[done : len(x) - size + 1]
            done += size
        if done == width:
            return out
        part = part[:-size] * np.uint64(power) + part[size:]
        size, power = size * 2, power * power % (1 << 64)


def runs(raw: bytes, least: int = LEAST, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the minimiser, first start, end of starts) of each run of starts in a text."""
    keys, begins, ends = [], [], []
    span = least - anchor + 1
    for at in range(0, len(raw) - least + 1, CHUNK):
        x = np.frombuffer(raw, np.uint8)[at : at + CHUNK + least - 1]
        h = mix(_windows(x, anchor, _BASES[0]))
        n = len(x) - least + 1
        order = h & np.uint64(~0x3FFFF & 0xFFFFFFFFFFFFFFFF) | np.arange(len(h), dtype=np.uint64)
        short = -len(order) % span
        blocks = np.concatenate([order, np.full(short, ~np.uint64(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
        where = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0x3FFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        keys.append(h[where[first]].view(np.int64))
        begins.append(first + at)
        ends.append(np.concatenate([first[1:], [n]]) + at)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(begins), np.concatenate(ends)


def marked_spans(marks: np.ndarray) -> list[dict]:
    """[a, b) of each maximal stretch of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def merged(spans, widen: int = 0) -> list[tuple[int, int]]:
    """Union of [a, b + widen), ordered."""
    out: list[list[int]] = []
    for a, b in sorted((int(s["a"]), int(s["b"]) + widen) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_key(docs: DataFrame) -> DataFrame:
    """Adds raw (UTF-8), sha (hex) and text_key, a 128-bit name of the text."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sha = F.sha2(raw, 256)
    return docs.withColumn("raw", raw).withColumn("sha", sha).withColumn("text_key", F.unhex(F.substring("sha", 1, 32)))


def distinct_runs(raw: bytes, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """The runs of a text, of those that span equal bytes only the first, and the spans of all that do.

    Lines or words repeated over and over would else give a run for every few bytes.
    """
    keys, begins, ends = runs(raw, least)
    names, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    if len(names) == len(keys):
        return keys, begins, ends, []
    first: dict[tuple[int, bytes], int] = {}
    keep, own = np.ones(len(keys), bool), np.zeros(len(keys), bool)
    view = memoryview(raw)
    for i in np.flatnonzero(count[which] > 1):
        cut = (int(keys[i]), hashlib.blake2b(view[begins[i] : ends[i] + least - 1], digest_size=16).digest())
        if (j := first.setdefault(cut, i)) != i:
            keep[i], own[i], own[j] = False, True, True
    spans = merged([{"a": a, "b": b} for a, b in zip(begins[own], ends[own], strict=True)], least - 1)
    return keys[keep], begins[keep], ends[keep], [{"a": a, "b": b} for a, b in spans]


def _runs_of(texts: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [distinct_runs(bytes(r), least) for r in x["raw"]]
            yield pd.DataFrame(
                {"text_key": x["text_key"], "doc_id": x["doc_id"], "n_bytes": [len(r) for r in x["raw"]]}
                | {name: [f[k] for f in found] for k, name in enumerate(("keys", "begins", "ends", "own"))}
            )

    kinds = f"text_key binary, doc_id long, n_bytes long, keys array<long>, begins array<long>, ends array<long>, own {SPANS}"
    return texts.select("text_key", "doc_id", "raw").mapInPandas(run, kinds)


def _cuts_of(texts: DataFrame, least: int) -> DataFrame:
    """A row for each run of texts (text_key, raw, runs): its minimiser, place and the 128-bit name of the bytes it spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for text_key, raw, found in zip(x["text_key"], x["raw"], x["runs"], strict=True):
                raw = memoryview(bytes(raw))
                rows += [(text_key, r["key"], r["a"], r["b"] - r["a"], hashlib.blake2b(raw[r["a"] : r["b"] + least - 1], digest_size=16).digest()) for r in found]
            yield pd.DataFrame(rows, columns=["text_key", "key", "a", "n", "cut_key"])

    return texts.select("text_key", "raw", "runs").mapInPandas(run, "text_key binary, key long, a long, n long, cut_key binary")


def _cut_out(bodies: DataFrame, chosen: DataFrame, least: int) -> DataFrame:
    """bucket, shard, key, cut_key, n and the bytes of chosen cuts (text_key, a, n, key, cut_key, bucket, shard)."""
    of = chosen.groupBy("text_key").agg(F.collect_list(F.struct("bucket", "shard", "key", "cut_key", "a", "n")).alias("cuts"))  # at most a text's own runs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for raw, cuts in zip(x["raw"], x["cuts"], strict=True):
                rows = [(c["bucket"], c["shard"], c["key"], bytes(c["cut_key"]), c["n"], bytes(raw[c["a"] : c["a"] + c["n"] + least - 1])) for c in cuts]
                for at in range(0, len(rows), 2_000):
                    yield pd.DataFrame(rows[at : at + 2_000], columns=["bucket", "shard", "key", "cut_key", "n", "cut"])

    return bodies.join(of, "text_key").select("raw", "cuts").mapInPandas(run, "bucket long, shard long, key long, cut_key binary, n long, cut binary")


def _shard_marks(least: int):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        joined = np.frombuffer(b"\xff".join(bytes(c) for c in x["cut"]) + b"\xff", np.uint8)  # no byte of UTF-8
        repeated = repeated_starts(joined, least)
        sizes = np.array([len(c) + 1 for c in x["cut"]])
        at = np.cumsum(sizes) - sizes
        spans = [marked_spans(repeated[a : a + n]) for a, n in zip(at, x["n"], strict=True)]
        return pd.DataFrame({"key": x["key"], "cut_key": x["cut_key"], "spans": spans})

    return run


def _string_hashes(cuts: DataFrame, least: int) -> DataFrame:
    """key, cut_key, offset and a 128-bit hash of each string of the cuts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for key, cut_key, cut in zip(x["key"], x["cut_key"], x["cut"], strict=True):
                raw = np.frombuffer(cut, np.uint8)
                one, two = (mix(_windows(raw, least, b)).view(np.int64) for b in _BASES)
                yield pd.DataFrame({"key": key, "cut_key": [cut_key] * len(one), "at": np.arange(len(one)), "one": one, "two": two})

    return cuts.select("key", "cut_key", "cut").mapInPandas(run, "key long, cut_key binary, at long, one long, two long")


def repeated_spans(docs: DataFrame, least: int = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """text_key, n_bytes and spans ([a, b) in bytes, maximal) of the repeated bytes of each distinct text with any.

    Texts that occur twice have the one span of all their bytes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark)
    texts = _with_key(pick(docs, "doc_id", "text").withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))))
    known = scratch.keep(_runs_of(texts.where(F.octet_length("raw") >= least), least))
    counts = scratch.keep(known.groupBy("text_key", "n_bytes").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id")))
    one_each = known.join(counts.select("text_key", "doc_id"), ["text_key", "doc_id"]).dropDuplicates(["text_key"])
    every = one_each.select("text_key", "doc_id", F.explode(F.arrays_zip("keys", "begins", "ends")).alias("r"))
    every = every.select("text_key", "doc_id", F.col("r.keys").alias("key"), F.col("r.begins").alias("a"), F.col("r.ends").alias("b"))
    twice = every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    # per text, the runs whose minimiser occurs twice: at most its own length
    asked = scratch.keep(every.join(twice, "key").groupBy("text_key", "doc_id").agg(F.collect_list(F.struct("key", "a", "b")).alias("runs")))
    # what a text repeats within itself
    own = scratch.keep(one_each.where("size(own) > 0").select("text_key", F.explode("own").alias("s")))
    scratch.drop(known)
    named = asked.select("text_key", "doc_id").union(own.join(counts.select("text_key", "doc_id"), "text_key").select("text_key", "doc_id")).distinct()
    if named.count() <= BROADCAST_TEXTS:
        named = F.broadcast(named)
    bodies = texts.select("text_key", "doc_id", "raw").join(named, ["text_key", "doc_id"], "left_semi").dropDuplicates(["text_key"])
    bodies = scratch.keep(bodies.join(asked.select("text_key", "runs"), "text_key", "left"))
    scratch.sweep()

    cuts = scratch.keep(_cuts_of(bodies.where("runs is not null"), least))
    apart = cuts.groupBy("key", "cut_key").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.min(F.struct("text_key", "a")).alias("at"))
    apart = scratch.keep(apart.select("key", "cut_key", "copies", "n", "at.text_key", "at.a"))
    by_key = apart.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + (least - 1)).alias("size")).where("kinds > 1")
    total = by_key.where(F.col("kinds") <= CUTS).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # buckets of about eight shards each; a bucket's rows here are one per minimiser
    buckets = max(1, total // (8 * SHARD_BYTES))
    in_bucket = Window.partitionBy("bucket").orderBy("size", "key").rowsBetween(Window.unboundedPreceding, -1)
    by_key = by_key.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    by_key = scratch.keep(by_key.withColumn("shard", F.floor(F.coalesce(F.sum(F.when(F.col("kinds") <= CUTS, F.col("size"))).over(in_bucket), F.lit(0)) / SHARD_BYTES)))
    # bytes are cut out once for each differing cut of a minimiser that has several
    several = apart.join(by_key.select("key", "kinds", "bucket", "shard"), "key").select("text_key", "a", "n", "key", "cut_key", "kinds", "bucket", "shard")
    sharded = (
        _cut_out(bodies, several.where(F.col("kinds") <= CUTS), least)
        .groupBy("bucket", "shard")
        .applyInPandas(_shard_marks(least), f"key long, cut_key binary, spans {SPANS}")
    )
    hot = _string_hashes(_cut_out(bodies, several.where(F.col("kinds") > CUTS), least), least)
    again = hot.groupBy("one", "two").agg(F.count("*").alias("c")).where("c > 1").select("one", "two")
    dealt = hot.join(again, ["one", "two"]).groupBy("key", "cut_key").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("spans"))
    whole = apart.where("copies > 1").select("key", "cut_key", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("spans"))
    marks = whole.union(sharded.where("size(spans) > 0")).union(dealt)
    # starts of repeated strings, per text; a start covers `least` bytes
    starts = (
        cuts.select("text_key", "key", "cut_key", F.col("a").alias("at"))
        .join(marks, ["key", "cut_key"])
        .select("text_key", F.explode(F.transform("spans", lambda s: F.struct((s.a + F.col("at")).alias("a"), (s.b + F.col("at") + (least - 1)).alias("b")))).alias("s"))
        .union(own)
        .groupBy("text_key")
        .agg(F.collect_list("s").alias("covered"))
    )

    @F.pandas_udf(SPANS)
    def union(covered: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in merged(c)] for c in covered])

    single = starts.join(counts.where("copies = 1"), "text_key").select("text_key", "n_bytes", union("covered").alias("spans"))
    copied = counts.where("copies > 1").select("text_key", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b"))).alias("spans"))
    found = scratch.keep(single.union(copied))
    scratch.drop_all_but(found)
    return found


def kept_bytes(raw: bytes, spans) -> bytes:
    """The bytes outside the spans."""
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["a"]])
        at = s["b"]
    return b"".join([*out, raw[at:]])


def kept_text(raw: bytes, spans) -> str:
    """The text outside the spans, which shrink to whole characters."""
    out, at = [], 0
    for s in spans:
        a, b = s["a"], s["b"]
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def long_enough(raw: bytes, spans, words: int) -> list:
    """The spans that hold at least ``words`` words."""
    return [s for s in spans if not words or len(raw[s["a"] : s["b"]].split()) >= words]


def cut_repeats(docs: DataFrame, least: int = LEAST, words: int = 0) -> DataFrame:
    """``docs`` without the repeated bytes of its column text (in spans of at least ``words`` words); all columns stay."""
    columns, key, spans = docs.columns, unused(docs, "_key"), unused(docs, "_spans")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, s):
            if s is None:
                return None
            raw = t.encode("utf-8", "replace")
            return kept_text(raw, long_enough(raw, s, words))

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    found = repeated_spans(docs, least).select(F.col("text_key").alias(key), F.col("spans").alias(spans))
    text_key = F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), 1, 32))
    joined, has = docs.withColumn(key, text_key).join(found, key, "left"), F.col(spans).isNotNull()
    # texts without spans do not travel to Python
    kept = F.when(has, cut(F.when(has, F.col("text")), F.col(spans))).otherwise(F.col("text"))
    return joined.withColumn("text", kept).select(*[F.col(f"`{c}`") for c in columns])


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 400-byte repeats remove from every document, and the text that is left (whole characters only)."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")

    @F.pandas_udf("kept_sha256 string, text string")
    def cut(raw: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if s is None else (hashlib.sha256(kept_bytes(bytes(r), s)).hexdigest(), kept_text(bytes(r), s)) for r, s in zip(raw, spans, strict=True)]
        return pd.DataFrame(rows, columns=["kept_sha256", "text"], dtype=object)

    # the digest of the whole text, made once, names it and is that of what is kept where nothing repeats
    named = docs.withColumn("sha", F.sha2(raw, 256))
    found = repeated_spans(docs).select("text_key", "spans")
    joined, has = named.withColumn("text_key", F.unhex(F.substring("sha", 1, 32))).join(found, "text_key", "left"), F.col("spans").isNotNull()
    rows = joined.select("doc_id", "text", "spans", "sha", cut(F.when(has, raw), F.col("spans")).alias("cut"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.b - s.a)
    return rows.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(has, F.size("spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(has, F.col("cut.kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(has, F.col("cut.text")).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )


QUERIES = {"op4_repeats": op4_repeats}
ORACLE_SQL: dict[str, str] = {}
