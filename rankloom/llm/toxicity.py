"""Toxicity by a factorization machine over hashed terms.

Score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of
a text (words and beginnings of words), each hashed to one of 2^18 buckets: the
linear weights carry single terms, the factors carry pairs such as an insult
next to a group's name.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows (those
with the smallest hash of their id), whose terms are hashed on the executors.  Two
screens, both over the sample alone, tell which buckets get weights and factors:
the ``KEPT`` most associated with the label one by one, and those of up to
``PAIRS`` pairs of words that say more together than either says alone, so that a
word that is neutral by itself takes part for its company.  Pairs are counted
among at most ``PAIR_WORDS`` words of a row (drawn anew for each row, so any two
may meet) that are neither rare in the sample nor in most of its rows.  Scoring
reads every whole text and broadcasts the model, whose size is fixed.

Defined results: a null or empty text has no terms and gets the base rate's
score; rows without label, or with a null id, are not learned from; without
labelled rows of both kinds every score is the base rate, or 0; a text of any
length is scored whole; equal texts have equal scores, and repeated rows stay;
rows that share a labelled id are each learned from with the highest of its labels;
terms of equal standing at a screen's edge go by bucket; an empty table gives an
empty result; extra columns of documents are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, held_out, pick, table

BUCKETS, SAMPLE, KEPT, FACTORS = 1 << 18, 20_000, 1_024, 8
PAIRS, PAIR_WORDS, PAIR_SEEN, COMMON, TRIED_PAIRS = 256, 64, 8, 0.6, 4_096
PREFIXES = (4, 5, 6, 7)
#: Precision of the normal prior of the factors; over n rows the mean loss bears PRIOR / n of it.
PRIOR = 2.6
THRESHOLD = 0.7
_TERM = re.compile(r"\w+")
_KNOWN: dict[str, tuple[int, ...]] = {}
REMEMBERED = 400_000


def buckets_of(word: str) -> tuple[int, ...]:
    """Buckets of a word's terms: itself and its beginnings, which inflected and compound forms share."""
    found = _KNOWN.get(word)
    if found is None:
        terms = [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
        found = tuple({zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in terms})
        if len(_KNOWN) < REMEMBERED:
            _KNOWN[word] = found
    return found


def hashed_terms(text: str | None) -> set[int]:
    """Buckets of the distinct terms of the lower-cased words."""
    return {b for word in set(_TERM.findall((text or "").lower())) for b in buckets_of(word)}


class Machine(NamedTuple):
    """Weights by bucket position: ``place`` maps a bucket to a row of w and v, row 0 being all zeros."""

    bias: float
    place: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def scores(self, texts: Iterable[str | None], known: dict[str, tuple[int, ...]]) -> np.ndarray:
        """Probabilities for texts; ``known`` remembers which rows of the weights each word has, mostly none."""
        rows = []
        for text in texts:
            found: set[int] = set()
            for word in set(_TERM.findall((text or "").lower())):
                at = known.get(word)
                if at is None:
                    at = tuple(int(i) for i in self.place[list(buckets_of(word))] if i)
                    if len(known) < REMEMBERED:
                        known[word] = at
                if at:
                    found.update(at)
            rows.append(found)
        sizes = np.array([len(r) for r in rows], int)
        at = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
        return _sigmoid(self.bias + _machine_sum(self.w, self.v, at, np.repeat(np.arange(len(rows)), sizes), len(rows))[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _machine_sum(w, v, at, owner, n):
    """Linear and pairwise part of each row, and the rows' factor sums."""
    sums = np.stack([np.bincount(owner, v[at, f], n) for f in range(v.shape[1])], 1)
    squares = np.bincount(owner, (v[at] ** 2).sum(1), n)
    return np.bincount(owner, w[at], n) + 0.5 * ((sums**2).sum(1) - squares), sums


def choose_buckets(seen: np.ndarray, hits: np.ndarray, n: int, positives: int) -> np.ndarray:
    """Buckets with the largest z statistic of label counts ``hits`` among the rows ``seen`` with each bucket."""
    rate = positives / max(n, 1)
    z = (hits - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1)
    use = np.argsort(-np.abs(z), kind="stable")[:KEPT]
    return use[(seen[use] >= 3) & (np.abs(z[use]) > 2.5)]


def _pair_keys(rows: list[np.ndarray]) -> np.ndarray:
    """One number for each two buckets of each row."""
    out = [np.zeros(0, np.int64)]
    for r in rows:
        r = np.unique(r).astype(np.int64)
        a, b = np.triu_indices(len(r), 1)
        out.append(r[a] << 32 | r[b])
    return np.concatenate(out)


def choose_pairs(rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Buckets of the word pairs whose label rate exceeds that of both words; ``rows`` are the drawn word buckets of each row."""
    positive = [r for r, y in zip(rows, labels, strict=True) if y]
    keys, in_positive = np.unique(_pair_keys(positive), return_counts=True)
    often = in_positive >= PAIR_SEEN
    tried = np.argsort(-in_positive[often], kind="stable")[:TRIED_PAIRS]
    keys, in_positive = keys[often][tried], in_positive[often][tried]
    order = np.argsort(keys)
    keys, in_positive = keys[order], in_positive[order].astype(float)
    total = in_positive.copy()
    negative = [r for r, y in zip(rows, labels, strict=True) if not y]
    for at in range(0, len(negative), 500):
        found = _pair_keys(negative[at : at + 500])
        place = np.searchsorted(keys, found)
        known = place < len(keys)
        known[known] = keys[place[known]] == found[known]
        total += np.bincount(place[known], minlength=len(keys))[: len(keys)]
    a, b = keys >> 32, keys & 0xFFFFFFFF
    alone = np.maximum((hits[a] + 0.5) / (seen[a] + 1), (hits[b] + 0.5) / (seen[b] + 1))
    z = (in_positive - total * alone) / np.sqrt(total * alone * (1 - alone) + 1)
    best = np.argsort(-z, kind="stable")[:PAIRS]
    best = best[z[best] > 3]
    return np.unique(np.concatenate([a[best], b[best]])).astype(np.int64)


def drawn_words(text: str | None, fit: np.ndarray, seed: int) -> list[int]:
    """Buckets of at most ``PAIR_WORDS`` distinct words that are fit for pairs, in an order that depends on the row."""
    found = sorted({b for word in set(_TERM.findall((text or "").lower())) if fit[b := zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS]})
    if len(found) > PAIR_WORDS:
        found.sort(key=lambda b: zlib.crc32(b"%d %d" % (b, seed)))
    return found[:PAIR_WORDS]


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, use: np.ndarray, steps: int = 400, seed: int = 7, prior: float = PRIOR) -> Machine:
    """Full-batch Adam on the logistic loss with L2; ``rows`` hold positions in ``use``, the buckets that take part.

    The data's gradient is a mean over rows, so the factors' prior weighs in by its share of one row: with few rows the
    factors stay near nought and the weights decide, with many a pair counts as much as the data say.
    """
    n = len(rows)
    decay = prior / max(n, 1)
    y = np.asarray(labels, float)
    place = np.zeros(BUCKETS, np.int32)
    rate = float(y.mean()) if n else 0.0
    base = float(np.log((rate + 1e-4) / (1 - rate + 1e-4)))
    if not n or rate in (0.0, 1.0) or not len(use):
        return Machine(base, place, np.zeros(1), np.zeros((1, FACTORS)))
    place[use] = 1 + np.arange(len(use))
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    at = 1 + np.concatenate(rows)
    rng = np.random.default_rng(seed)
    bias, w, v = np.array([base]), np.zeros(len(use) + 1), rng.normal(0, 0.05, (len(use) + 1, FACTORS))
    weight = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate)) ** 0.5
    weight *= n / weight.sum()
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (bias, w, v)]
    for step in range(1, steps + 1):
        value, sums = _machine_sum(w, v, at, owner, n)
        g = weight * (_sigmoid(bias[0] + value) - y) / n
        gw = np.bincount(at, g[owner], len(w)) + 1e-5 * w
        gv = np.stack([np.bincount(at, g[owner] * (sums[owner, f] - v[at, f]), len(w)) for f in range(FACTORS)], 1) + decay * v
        for p, grad, m in zip((bias, w, v), (np.array([g.sum()]), gw, gv), moments, strict=True):
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.01 * (grad**2 - m[1])
            p -= 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    w[0], v[0] = 0, 0
    return Machine(float(bias[0]), place, w, v)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled rows, those whose ids hash lowest; the ids are what is broadcast."""
    one = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return pick(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from labelled rows (labels: doc_id, toxic): one pass counts the buckets, one fetches those that take part."""
    rows = labelled_sample(docs, labels, "toxic", sample)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, hits = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for x in batches:
            for text, y in zip(x["text"], x["y"], strict=True):
                terms = list(hashed_terms(text))
                seen[terms] += 1
                hits[terms] += int(y)
        there = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": there, "seen": seen[there], "hits": hits[there]})

    # at most BUCKETS rows of each task, summed on the executors
    summed = rows.mapInPandas(counts, "bucket int, seen long, hits long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits"))
    found = summed.where("seen >= 3").toPandas()
    seen, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
    seen[found["bucket"]], hits[found["bucket"]] = found["seen"], found["hits"]
    n, positives = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    use = choose_buckets(seen, hits, n, positives)
    fit = (seen >= PAIR_SEEN) & (seen <= COMMON * n)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            words = [np.array(drawn_words(t, fit, int(i)), np.int32) for i, t in zip(x["doc_id"], x["text"], strict=True)]
            yield pd.DataFrame({"doc_id": x["doc_id"], "y": x["y"], "words": words})

    # at most SAMPLE x PAIR_WORDS numbers
    words = rows.mapInPandas(drawn, "doc_id long, y int, words array<int>").toPandas().sort_values("doc_id", kind="stable")
    use = np.union1d(use, choose_pairs([np.asarray(w) for w in words["words"]], words["y"].to_numpy(), seen, hits))
    place = np.full(BUCKETS, -1, np.int32)
    place[use] = np.arange(len(use))

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            terms = [place[sorted(hashed_terms(t))] if t else place[:0] for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "y": x["y"], "terms": [t[t >= 0] for t in terms]})

    fetched = rows.mapInPandas(chosen, "doc_id long, y int, terms array<int>").toPandas().sort_values("doc_id", kind="stable")
    return fit_machine([np.asarray(t, np.int64) for t in fetched["terms"]], fetched["y"].to_numpy(), use)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` (doc_id, text) with ``score`` in place of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "score": sent.value.scores(x["text"], known)})

    return docs.mapInPandas(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels outside the held-out third."""
    bound_batches(spark)
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
