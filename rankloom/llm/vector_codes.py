"""Vector code compression: a product code fitted by Hamerly's form of Lloyd's rounds, in integers.

Vectors become integers, ``floor(SCALE * x)``, and are cut into ``PARTS`` equal
parts, each of which has a codebook of at most ``ENTRIES`` entries.  A round
assigns every part to its nearest entry (ties to the lower index) and moves each
entry to the floor of its parts' mean.  All distances that decide are integers.

What a round needs of the rounds before travels with the rows: the assigned
entry of each part, an upper bound on the distance to it and one lower bound on
the distance to every other entry.  An entry that moves by m loosens both bounds
by at most m (the lower one by the largest move of another entry).  Where the
upper bound is *strictly* below the lower one, or below half the distance from
the assigned entry to its nearest neighbour, no other entry is as near and the
assignment stands; only where that fails are all entries scanned.  Equality is a
failure, so a tie always reaches the scan, which gives the lower index.  Bounds
are floats widened by ``SLACK`` at every step, so rounding never hides a scan.

A codebook has at most ``ENTRIES`` entries of one vector in all, so what the
driver holds and sends does not grow with the table; sums are made per task and
then added.  Each round's rows are written once to the shared folder; nothing is
shuffled but the sums and, at the end, the errors by label.

Defined results: rows whose vector is null or has null or non-finite components
are dropped, and so are rows whose vector is not as long as that of the first
kept row; that length must be a multiple of ``PARTS``.  The first entries are the
vectors of the rows with the smallest ids; equal ids are taken in the order of
their integers, null ids come last.  With fewer rows there are fewer entries.
Repeated rows count each.  Integers of ``LARGEST`` or more could not have their
errors in a long and raise.  An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, bound_batches, pick, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LARGEST = 1 << 26
SLACK = 1e-9
BROADCAST_LABELS = 100_000
STATE = "vec_id long, label long, raw binary, code array<int>, upper array<double>, lower array<double>"


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``ints`` of the rows that are kept."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    kept = pick(rows, "vec_id", "embedding", "label").where(whole)
    return kept.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), scaled.alias("ints"))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to all entries, exact (as floats where they hold all sums, which is faster)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if most < 1 << 22 and 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


class Codebook:
    """The entries of one part, how far each came in the last move, and how near another entry is."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        moved = np.sqrt(((entries - (entries if before is None else before)) ** 2).sum(1).astype(float)) * (1 + SLACK)
        self.moved = moved
        order = np.argsort(-moved, kind="stable")
        self.farthest, self.most = int(order[0]), float(moved[order[0]])
        self.second = float(moved[order[1]]) if len(order) > 1 else 0.0
        between = distances(entries, entries).astype(float)
        np.fill_diagonal(between, np.inf)
        self.half = np.sqrt(between.min(1)) / 2 * (1 - SLACK)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry (lower index of ties), and both bounds, from all distances."""
        found = distances(x, self.entries)
        code = found.argmin(1)
        rows = np.arange(len(x))
        upper = np.sqrt(found[rows, code].astype(float)) * (1 + SLACK)
        found[rows, code] = np.iinfo(np.int64).max
        lower = np.sqrt(found.min(1).astype(float)) * (1 - SLACK)
        return code, upper, lower

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring a part's assignments and bounds up to date in place; gives how many rows were scanned."""
        upper += self.moved[code]
        upper *= 1 + SLACK
        lower -= np.where(code == self.farthest, self.second, self.most)
        lower -= np.abs(lower) * SLACK
        failed = np.flatnonzero(upper >= np.maximum(lower, self.half[code]))
        if len(failed):  # the true distance to the assigned entry may do
            upper[failed] = np.sqrt(((x[failed] - self.entries[code[failed]]) ** 2).sum(1).astype(float)) * (1 + SLACK)
            failed = failed[upper[failed] >= np.maximum(lower[failed], self.half[code[failed]])]
        if len(failed):
            code[failed], upper[failed], lower[failed] = self.scan(x[failed])
        return len(failed)


def _vectors(raw: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), size).astype(np.int64)


def _first_assignment(kept: DataFrame, books: list[Codebook], size: int) -> DataFrame:
    """State of every row after a scan of all entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            ints = np.stack(x["ints"].to_numpy()).astype(np.int64)
            if np.abs(ints).max() >= LARGEST:
                raise ValueError(f"integers of {LARGEST} or more have no errors that fit a long")
            found = [b.scan(part) for b, part in zip(books, np.split(ints, PARTS, 1), strict=True)]
            code, upper, lower = (np.stack([f[k] for f in found], 1) for k in range(3))
            yield _state(x, [r.tobytes() for r in ints.astype("<i4")], code, upper, lower)

    return kept.mapInPandas(run, STATE)


def _state(x: pd.DataFrame, raw: list[bytes], code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"vec_id": x["vec_id"].astype("Int64"), "label": x["label"].astype("Int64"), "raw": raw, "code": list(code.astype(np.int32)), "upper": list(upper), "lower": list(lower)})


def _next_assignment(state: DataFrame, books: list[Codebook], size: int) -> DataFrame:
    """State of every row after the entries moved: a scan only where the bounds fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            ints = _vectors(x["raw"], size)
            code, upper, lower = (np.ascontiguousarray(np.stack(x[c].to_numpy()).T) for c in ("code", "upper", "lower"))
            code = code.astype(np.int64)
            for k, (book, part) in enumerate(zip(books, np.split(ints, PARTS, 1), strict=True)):
                book.assign(part, code[k], upper[k], lower[k])
            yield _state(x, x["raw"].tolist(), code.T, upper.T, lower.T)

    return state.mapInPandas(run, STATE)


def _sums(state: DataFrame, sizes: list[int], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each part: how many parts each entry has, and their sums (one row for each entry used leaves a task)."""
    width = size // PARTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros((n, width + 1), np.int64) for n in sizes]
        for x in batches:
            if len(x):
                ints, code = _vectors(x["raw"], size), np.stack(x["code"].to_numpy())
                for k, part in enumerate(np.split(ints, PARTS, 1)):
                    order = np.argsort(code[:, k], kind="stable")
                    of = code[order, k]
                    at = np.flatnonzero(np.diff(of, prepend=-1))
                    total[k][of[at], 1:] += np.add.reduceat(part[order], at, 0)
                    total[k][:, 0] += np.bincount(of, minlength=sizes[k])
        for k, t in enumerate(total):
            used = np.flatnonzero(t[:, 0])
            yield pd.DataFrame({"part": k, "entry": used, "n": t[used, 0], "sums": list(t[used, 1:])})

    found = state.select("raw", "code").mapInPandas(run, "part int, entry int, n long, sums array<long>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = [(np.zeros(n, np.int64), np.zeros((n, width), np.int64)) for n in sizes]
    for r in added.collect():  # one row for each entry
        out[r.part][0][r.entry], out[r.part][1][r.entry] = r.n, r.sums
    return out


def compress(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, scratch: Scratch | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, errors) of the kept rows, and the final entries of each part."""
    spark = rows.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark)
    kept = integers(rows)
    smallest = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()  # a bounded number
    empty = "vec_id long, label long, codes array<int>, error long"
    if not smallest:
        return spark.createDataFrame([], empty), [np.zeros((0, 0), np.int64)] * PARTS
    size = len(smallest[0].ints)
    if size % PARTS or not size:
        raise ValueError(f"vectors of {size} components cannot be cut into {PARTS} equal parts")
    kept = kept.where(F.size("ints") == size)
    if any(len(r.ints) != size for r in smallest):
        smallest = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    first = np.array([r.ints for r in smallest], np.int64)
    if np.abs(first).max() >= LARGEST:
        raise ValueError(f"integers of {LARGEST} or more have no errors that fit a long")
    books = [Codebook(part) for part in np.split(first, PARTS, 1)]
    state = scratch.keep(_first_assignment(kept, books, size))
    for _ in range(rounds):
        moved = []
        for book, (n, sums) in zip(books, _sums(state, [len(b.entries) for b in books], size), strict=True):
            mean = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], book.entries)
            moved.append(Codebook(mean, book.entries))
        books = moved
        following = scratch.keep(_next_assignment(state, books, size))
        scratch.drop(state)
        state = following
    final = [b.entries for b in books]

    @F.pandas_udf("long")
    def error(raw: pd.Series, code: pd.Series) -> pd.Series:
        if not len(raw):
            return pd.Series([], dtype="int64")
        code = np.stack(code.to_numpy())
        parts = np.split(_vectors(raw, size), PARTS, 1)
        return pd.Series(sum(((part - final[k][code[:, k]]) ** 2).sum(1) for k, part in enumerate(parts)))

    return state.select("vec_id", "label", F.col("code").alias("codes"), error("raw", "code").alias("error")), final


def codebooks_text(books: list[np.ndarray]) -> str:
    """All components in decimal: by part, entry and place in the part."""
    return ",".join([str(v) for b in books for v in b.reshape(-1).tolist()])


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every embedding, the error of its label, and a digest of the codebooks."""
    scratch = Scratch(spark)
    codes, books = compress(table(spark, sf_dir, "embeddings"), scratch=scratch)
    hexed = F.concat(*[F.lpad(F.lower(F.hex(F.col("codes")[k])), 2, "0") for k in range(PARTS)])
    done = scratch.keep(codes.select("vec_id", "label", hexed.alias("code"), "error")) if codes.columns and len(books[0]) else codes.select("vec_id", "label", F.lit("").alias("code"), "error")
    of_label = done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    if len(books[0]):
        of_label = scratch.keep(of_label)
        scratch.drop_all_but(done, of_label)
        if of_label.count() <= BROADCAST_LABELS:
            of_label = F.broadcast(of_label)
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    joined = done.join(of_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds by full scans, in SQL."""
    width = 16
    cut = ", ".join(f"list_slice(ints, {k * width + 1}, {(k + 1) * width})" for k in range(PARTS))
    steps = [
        f"""kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
              list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS ints
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, label, p - 1 AS part, x FROM (SELECT vec_id, label, unnest([{cut}]) AS x, unnest(range(1, {PARTS + 1})) AS p FROM kept)),
        book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM (SELECT r, unnest([{cut}]) AS x, unnest(range(0, {PARTS})) AS part FROM kept WHERE r <= {ENTRIES}))"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.x) AS x, any_value(p.label) AS label,
              min(CAST(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {ENTRIES} + b.entry) AS best
            FROM parts p JOIN book{k} b USING (part) GROUP BY p.vec_id, p.part)"""
        )
        if k < ROUNDS:
            # the floor of a quotient: what is left of the division, made non-negative, goes first
            sums = ", ".join([f"CAST((sum(x[{i}]) - (sum(x[{i}]) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT)" for i in range(1, width + 1)])
            steps.append(
                f"""mean{k} AS (SELECT part, best % {ENTRIES} AS entry, [{sums}] AS c FROM near{k} GROUP BY ALL),
        book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))"""
            )
    text = ",\n        ".join(steps)
    return f"""WITH {text},
        coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(best % {ENTRIES} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id),
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE_SQL = {"op12_vector_codes": _oracle()}
