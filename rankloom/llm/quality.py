"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows labelled good; the unlabelled set is drawn from all
documents that may be learned from, labelled or not, and none of their labels is
read: it stands for the corpus as it is, which is what the risk asks of it, at any
number of labels.  A small network over form statistics of the text (character
classes, repetition, line and word shapes) minimises

    pi R_P+  +  max(0, R_U-  -  pi R_P-)

where the class prior pi is estimated first: a positive-against-unlabelled
model ranks both sets, and the smallest ratio of the unlabelled to the positive
share above a cut (with a confidence margin) bounds the share of positives.

Fitting takes at most ``POSITIVES`` and ``UNLABELLED`` rows, those with the
smallest hash of their id; their statistics (a fixed number of doubles each) are
computed on the executors and fitted on the driver.  Scoring reads every whole
text.

Defined results: a null or empty text has all-zero statistics and is scored
like any other; rows with null id or label are not learned from; rows that share
an id are each drawn with it, and repeated labels count once (the higher one);
without two positives and two documents every score is 1/2; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, held_out, pick, table
from rankloom.llm.toxicity import labelled_sample

POSITIVES, UNLABELLED, HIDDEN = 8_000, 12_000, 16
THRESHOLD = 0.3

#: Class of each byte of UTF-8: lower, upper, digit, space, line break, stop, comma, !?, bar, symbols, other, beyond ASCII.
_CLASS = np.full(256, 10, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".", b",;:", b"!?", b"|", b"#$%&*@^~<>={}[]\\_+")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 11
CLASSES = 12
STATS = CLASSES + 13


def statistics(text: str | None) -> np.ndarray:
    """Form statistics of a whole text."""
    out = np.zeros(STATS)
    text = text or ""
    words = text.split()
    if not words:
        return out
    counts = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=CLASSES)
    out[:CLASSES] = counts / counts.sum()
    n, distinct = len(words), set(words)
    lines = [x for x in text.split("\n") if x]
    sizes = np.fromiter(map(len, words), int, n)
    out[CLASSES:] = (
        np.log(len(text)),
        np.log(n),
        sizes.mean(),
        sizes.std(),
        sizes.max() ** 0.5,
        len(distinct) / n,
        len(distinct) / n**0.7,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        np.log(n / len(lines)),
        np.log(1 + len(lines)),
        sum(map(operator.eq, words[:-2], words[2:])) / n,
        (sizes <= 3).mean(),
    )
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Net(NamedTuple):
    """Standardising constants, layers and the prior they were fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.a + self.b) @ self.c + self.d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))


def pu_risk(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative risk of scores on positives and unlabelled rows, and the steps for their logits.

    Losses are -log s for positive and -log(1 - s) for negative; their slopes in the logit are s - 1 and s.
    """
    positive = -prior * np.log(sp + 1e-12).mean()
    negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
    if negative >= 0:
        return positive + negative, -prior / len(sp) + np.zeros_like(sp), su / len(su)
    # step back on the part that has gone below nought
    return positive, prior * sp / len(sp), -su / len(su)


def fit_net(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = 600, seed: int = 11) -> Net:
    """Adam on the non-negative PU risk; with ``prior`` None, on plain positive-against-unlabelled loss."""
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (p, u))
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (STATS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in params]
    for step in range(1, steps + 1):
        a, b, c, d = params
        hp, hu = np.tanh(zp @ a + b), np.tanh(zu @ a + b)
        sp, su = _sigmoid(hp @ c + d[0]), _sigmoid(hu @ c + d[0])
        if prior is None:
            gp, gu = (sp - 1) / len(p), su / len(u)
        else:
            _, gp, gu = pu_risk(sp, su, prior)
        grads = [
            zp.T @ (gp[:, None] * c * (1 - hp**2)) + zu.T @ (gu[:, None] * c * (1 - hu**2)) + 1e-3 * a,
            (gp[:, None] * c * (1 - hp**2)).sum(0) + (gu[:, None] * c * (1 - hu**2)).sum(0),
            hp.T @ gp + hu.T @ gu + 1e-3 * c,
            np.array([gp.sum() + gu.sum()]),
        ]
        for x, g, m in zip(params, grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g**2 - m[1])
            x -= 0.02 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Net(mean, scale, *params, prior if prior is not None else 0.5)


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 3) -> float:
    """Share of positives among ``u``: least ratio of the shares above a cut, on rows the ranking model has not seen."""
    rng = np.random.default_rng(seed)
    sides = [rng.permutation(len(x)) % 2 == 0 for x in (p, u)]
    if min(s.sum() for s in sides) < 20 or min((~s).sum() for s in sides) < 20:
        return 0.5
    net = fit_net(p[sides[0]], u[sides[1]], None, steps=300)
    zp, zu = np.sort(net.logits(p[~sides[0]])), np.sort(net.logits(u[~sides[1]]))
    cuts = zp[: max(1, int(0.9 * len(zp)))]
    share_p = 1 - np.searchsorted(zp, cuts, side="left") / len(zp)
    share_u = 1 - np.searchsorted(zu, cuts, side="left") / len(zu)
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(zu)) + 1 / np.sqrt(len(zp)))
    best = np.argmin((share_u + margin) / share_p)
    # the lower end: too large a prior hides the negatives, too small a one only costs certainty
    return float(np.clip(share_u[best] / share_p[best] - margin, 0.05, 0.95))


STATS_TYPE = "doc_id long, y int, stats array<double>"


def _statistics_of(rows: DataFrame) -> np.ndarray:
    """Statistics of a bounded set of rows (doc_id, text, y) as a matrix, in order of id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "y": x["y"], "stats": [statistics(t) for t in x["text"]]})

    found = rows.select("doc_id", "text", "y").mapInPandas(run, STATS_TYPE).toPandas().sort_values("doc_id", kind="stable")
    return np.stack(found["stats"].to_numpy()) if len(found) else np.zeros((0, STATS))


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Net | None:
    """A net from rows labelled good (labels: doc_id, quality) and unlabelled ones of ``corpus``, all ``docs`` unless given."""
    good = _statistics_of(labelled_sample(docs, labels.where("quality = 1"), "quality", positives))
    corpus = docs if corpus is None else corpus
    drawn = corpus.select("doc_id", F.lit(1).alias("quality"))  # which rows are read, not what their label is
    unknown = _statistics_of(labelled_sample(corpus, drawn, "quality", unlabelled))
    if len(good) < 2 or len(unknown) < 2:
        return None
    return fit_net(good, unknown, estimate_prior(good, unknown))


def score(docs: DataFrame, net: Net | None, into: str = "score") -> DataFrame:
    """``docs`` with a double column ``into`` (a column of that name is replaced); its other columns stay."""
    docs = docs.drop(into)
    if net is None:
        return docs.withColumn(into, F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.scores(np.stack([statistics(t) for t in texts]))) if len(texts) else pd.Series([], dtype=float)

    return docs.withColumn(into, scores("text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labels outside the held-out fifth."""
    bound_batches(spark)
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    scored = score(docs, train(docs, labels, docs.where(~held_out("doc_id", 5, 0))))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}
