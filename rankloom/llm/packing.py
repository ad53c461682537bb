"""Best-fit packing with length patterns fitted by non-negative least squares.

Documents become token pieces of at most ``capacity`` ids; how many pieces there
are of each length is all that the packing itself needs (at most ``capacity``
numbers, whatever the corpus).  On that histogram: (1) every pattern of up to
three lengths that fill a sequence exactly is a column of a sparse system; (2)
repeat counts come from non-negative least squares; (3) counts are rounded
within what is there; (4) the rest goes best-fit decreasing, in runs of equal
lengths.  The resulting plan maps the rank of a piece among those of its length
to a sequence and an offset; ranks are built in two levels, so that a very
common length is not sorted by one task.

Defined results: a null or empty text is one piece of one id, the end mark; an
empty table gives no pieces; equal rows are packed one by one; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, bound_batches, pick, table

CAPACITY, END_ID, SUB_BUCKETS = 1024, 2, 64
CACHED = 400_000

# ---------------------------------------------------------------- tokens

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼½¾"
#: Pre-tokens of a byte-level vocabulary, for texts of usual characters only, where these classes are all letters and numbers.
_WORD = re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]")
_SPACES = re.compile(r"\s\s")


def _plain_bytes() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: itself where printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Ids of whole texts as little-endian bytes.

    A pre-token never crosses a single space or line break, so the ids of the
    stretches between these can be remembered (a bounded number per worker).
    Texts with characters outside the Latin blocks go through the tokenizer whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        of = _plain_bytes()
        # the vocabulary numbers its tokens in the order of its merges, so an id is a merge's rank
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(of[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        # the pattern takes a pre-token whole: merging is all that is asked for.  Where a vocabulary is not numbered in
        # the order of its merges (some pieces' ids differ from the tokenizer's), every text goes through the tokenizer
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        some = [t for t in self.tokenizer.get_vocab() if t not in special and t.isascii()][::25]
        pairs = [bytes(of[c] for c in t + u) for t, u in zip(some, some[1:], strict=False)]
        shown = {b: c for c, b in of.items()}
        self.ordered = all(self.merge(p.decode()) == [t.id for t in self.tokenizer.model.tokenize("".join([shown[b] for b in p]))] for p in pairs)
        self.words: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """By the tokenizer, without shortcuts."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if (found := self.words.get(word)) is None:
            found = array("I", self.merge(word)).tobytes()
            if len(self.words) < CACHED:
                self.words[word] = found
        return found

    def _stretch(self, key: str) -> bytes:
        if (found := self.stretches.get(key)) is None:
            found = b"".join([self._word(w) for w in _WORD.findall(key if key[:1] == "\n" else f" {key}")])
            if len(self.stretches) < CACHED:
                self.stretches[key] = found
        return found

    def ids(self, text: str) -> bytes:
        if not self.ordered or _UNUSUAL.search(text):
            return self.whole(text)
        if _SPACES.search(text):
            return b"".join([self._word(w) for w in _WORD.findall(text)])
        first, *keys = text.replace("\n", " \n").split(" ")
        head, known = b"".join([self._word(w) for w in _WORD.findall(first)]), self.stretches
        try:
            return head + b"".join([known[k] for k in keys])
        except KeyError:
            return head + b"".join([known.get(k) or self._stretch(k) for k in keys])


_LOADED: dict[str, ByteTokens] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of the ids of ``text`` and the end mark; only longer documents are cut, the rest comes first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _LOADED:
            _LOADED[tokenizer_path] = ByteTokens(tokenizer_path)
        tokens, end = _LOADED[tokenizer_path], end_id.to_bytes(4, "little")
        for x in batches:
            rows = []
            for doc, text in zip(x["doc_id"].array, x["text"].array, strict=True):
                raw = (tokens.ids(text) if isinstance(text, str) and text else b"") + end
                n = len(raw) // 4
                at = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=pd.array([None if pd.isna(d) else d for d in out["doc_id"]], "Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES)


# ---------------------------------------------------------------- the plan


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three of the lengths, largest first and padded with 0, that sum to the capacity."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    a = np.arange(1, capacity // 2 + 1)
    two = a[there[a] & there[capacity - a]]
    out.append(np.stack([capacity - two, two, 0 * two], 1))
    for c in np.flatnonzero(there[: capacity // 3 + 1]):
        b = np.arange(c, (capacity - c) // 2 + 1)
        b = b[(b > 0) & there[b] & there[capacity - c - b]]
        out.append(np.stack([capacity - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def fit_counts(pattern: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x of least ||A x - h||, where A counts the lengths in each pattern (multiplicative updates)."""
    n, m = len(histogram), len(pattern)
    used = pattern > 0
    flat, owner = pattern[used], np.nonzero(used)[0]
    back = lambda v: np.bincount(owner, v[flat], m)  # noqa: E731  A' v
    ahead = lambda x: np.bincount(flat, x[owner], n)  # noqa: E731  A x
    target = back(histogram)
    x = target / np.maximum(1, back(ahead(np.ones(m))))
    for _ in range(rounds):
        x *= target / np.maximum(back(ahead(x)), 1e-9)
    return x


def pack_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, from_rank, to_rank, first_sequence, offset) that place every piece, and the number of sequences."""
    left, taken = histogram.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    plan, sequences = [], 0

    def place(kinds: list[int], count: int) -> None:
        nonlocal sequences
        offset = 0
        for k in kinds:
            plan.append((k, int(taken[k]), int(taken[k]) + count, sequences, offset))
            taken[k] += count
            left[k] -= count
            offset += k
        sequences += count

    whole = patterns(np.flatnonzero(left), capacity)
    if len(whole):
        x = fit_counts(whole, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            kinds = [int(k) for k in whole[i] if k]
            most = min(left[k] // kinds.count(k) for k in kinds)
            if (count := min(int(x[i] + 0.5), int(most))) > 0:
                place(kinds, count)
    # the residual: best-fit decreasing over runs (contents, bins) by free space
    bins: list[list[tuple[list[int], int]]] = [[] for _ in range(capacity + 1)]
    rest = left.copy()
    for k in range(capacity, 0, -1):
        n, free = int(rest[k]), k
        while n and free <= capacity:
            if not bins[free]:
                free += 1
                continue
            kinds, count = bins[free].pop()
            fit = min(n, count)
            if fit < count:
                bins[free].append((kinds, count - fit))
            bins[free - k].append(([*kinds, k], fit))
            n -= fit
            free = k  # what was just filled may have room for one more
        each = capacity // k
        if n >= each:
            bins[capacity - each * k].append(([k] * each, n // each))
        if n % each:
            bins[capacity - n % each * k].append(([k] * (n % each), 1))
    for runs in bins:
        for kinds, count in runs:
            place(kinds, count)
    return plan, sequences


# ---------------------------------------------------------------- the operator


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (kept pieces; it is read twice) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = cut.withColumn("_sub", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SUB_BUCKETS)).cast("int"))
    # at most capacity x SUB_BUCKETS rows, whatever the corpus
    counts = cut.groupBy("length", "_sub").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "_sub"])
    histogram = np.zeros(capacity + 1, np.int64)
    np.add.at(histogram, counts["length"].to_numpy(int), counts["n"].to_numpy(int))
    counts["before"] = counts.groupby("length")["n"].cumsum() - counts["n"]
    before = np.zeros((capacity + 1, SUB_BUCKETS), np.int64)
    before[counts["length"].to_numpy(int), counts["_sub"].to_numpy(int)] = counts["before"]
    plan = np.array(sorted(pack_plan(histogram, capacity)[0]), np.int64).reshape(-1, 5)
    # patterns and runs: their number depends on the capacity, not on the corpus
    sent = spark.sparkContext.broadcast((plan, before))
    in_sub = Window.partitionBy("length", "_sub").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(in_sub).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, before = sent.value
        starts = plan[:, 0] << 44 | plan[:, 1]
        for x in batches:
            length = x["length"].to_numpy(np.int64)
            rank = before[length, x["_sub"].to_numpy(int)] + x["_rank"].to_numpy(np.int64) - 1
            row = plan[np.searchsorted(starts, length << 44 | rank, side="right") - 1]
            yield x.drop(columns=["_sub", "_rank"]).assign(sequence_id=row[:, 3] + rank - row[:, 1], offset=row[:, 4])

    return ranked.mapInPandas(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) with their sequence and offset."""
    bound_batches(docs.sparkSession)
    return pack(Scratch(docs.sparkSession).keep(pieces(docs, tokenizer_path, capacity)), capacity)


def tokenizer_file() -> str:
    """The public byte-level vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack_documents(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), tokenizer_file())


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
