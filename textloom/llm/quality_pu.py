"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents; all other documents of a sample are unlabelled web text, whatever their label. The class
prior is estimated from how the two score apart, and a logistic model over text statistics minimises the non-negative unbiased risk
(Kiryo et al., 2017): prior * R(positive as good) + max(0, R(unlabelled as bad) - prior * R(positive as bad)).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, one_each, slices, table, texts_of

#: Sampled documents at most: trusted positives, unlabelled ones.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 8000, 16000
HELD_OUT_PARTS, HELD_OUT = 5, 0
ROUNDS, RATE, RIDGE = 600, 0.05, 1e-3
_WORD = re.compile("[^ \t-\r]+")
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~@=+_`]")
_UPPER = re.compile(r"[^\W\d_a-zà-öø-ÿ]")
MEMO = 1 << 17


class _Ids(dict):
    """Word -> a number of 64 bits."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = hash(word) & (1 << 63) - 1
        return h


_ids = _Ids()


def statistics(text: str) -> list[float]:
    """What the model reads of a text; all zero for a text without a word."""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * N_STATISTICS
    h = np.fromiter(map(_ids.__getitem__, words), np.int64, n).view(np.uint64)
    distinct = len(np.unique(h))
    g = h[:-2] * np.uint64(31) + h[1:-1] * np.uint64(1009) + h[2:] * np.uint64(1000003) if n > 2 else h[:0]
    repeated = 1 - len(np.unique(g)) / len(g) if len(g) else 0.0
    twice = float(np.mean(h[1:] == h[:-1])) if n > 1 else 0.0
    lines = [x for x in text.split("\n") if not x.isspace() and x]
    chars = max(1, len(text) - text.count(" "))
    c = Counter({x: text.count(x) for x in "!?.,|"})
    return [
        math.log(n),
        sum(map(len, words)) / n,
        distinct / n,
        math.log(distinct) / math.log(n + 1),
        repeated,
        twice,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(_UPPER.findall(text)) / chars,
        len(_SYMBOL.findall(text)) / chars,
        c["!"] / n,
        c["?"] / n,
        c["|"] / n,
        c["."] / n,
        c[","] / n,
        sum(map(text.count, "0123456789")) / chars,
        max(map(len, words)) / 20,
    ]


N_STATISTICS = 16

_STATS = pa.schema([("group", pa.int32()), ("f", pa.list_(pa.float64()))])


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        yield table(_STATS, [b.column(0), [statistics(t.decode("utf-8", "replace")) for t in b.column(1).to_pylist()]])


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised statistics, clipped, and their distance from the middle, so that a logistic model can bound a range; bias last."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.c_[z, np.abs(z), np.ones(len(z))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(gradient, n: int, rounds: int) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good documents among the unlabelled.

    A classifier tells the two samples apart. Where the scores of good documents lie, the unlabelled share above a threshold is at least
    the prior times the positive share above it; the smallest ratio over thresholds with enough positives estimates the prior.
    """
    x, y = np.r_[positive, unlabelled], np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    weight = np.where(y > 0, 0.5 / len(positive), 0.5 / len(unlabelled))
    w = _descend(lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)) + RIDGE * np.r_[w[:-1], 0], x.shape[1], 200)
    p, u = np.sort(positive @ w), np.sort(unlabelled @ w)
    at = np.quantile(p, np.linspace(0.02, 0.5, 25))
    above_p = 1 - np.searchsorted(p, at) / len(p)
    above_u = 1 - np.searchsorted(u, at) / len(u)
    return float(np.clip((above_u / above_p).min(), 0.05, 0.98))


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk of the logistic loss."""

    def gradient(w: np.ndarray) -> np.ndarray:
        p, u = positive @ w, unlabelled @ w
        good = positive.T @ (_sigmoid(p) - 1) / len(p)
        bad_p, bad_u = positive.T @ _sigmoid(p) / len(p), unlabelled.T @ _sigmoid(u) / len(u)
        bad = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        regular = RIDGE * np.r_[w[:-1], 0]
        if bad < 0:  # over-fitted: climb out of it
            return -(bad_u - prior * bad_p) + regular
        return prior * good + bad_u - prior * bad_p + regular

    return _descend(gradient, positive.shape[1], ROUNDS)


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Model from the folds that aren't held out; None without trusted positives or unlabelled text."""
    usable = fold("doc_id", HELD_OUT_PARTS) != HELD_OUT
    own = labels.where(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    trusted = own.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_POSITIVE).select("doc_id", F.lit(1).alias("group"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    # Another order than that of the positives, so that the sample doesn't follow theirs.
    others = ids.where(usable).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(SAMPLE_UNLABELLED).distinct().select("doc_id", F.lit(0).alias("group"))
    texts = texts_of(docs)
    # At most SAMPLE_POSITIVE + SAMPLE_UNLABELLED rows, sorted so that sums of floats don't depend on how rows were dealt.
    # A repeated id counts once in either group.
    sample = one_each(texts.join(F.broadcast(trusted.unionByName(others)), "doc_id"), "group")
    rows = sorted(sample.select("group", "text").mapInArrow(_stat_batches, "group int, f array<double>").collect())
    x, group = np.array([r["f"] for r in rows]).reshape(-1, N_STATISTICS), np.array([r["group"] for r in rows])
    if not (group == 1).any() or not (group == 0).any():
        return None
    mean, scale = x[group == 1].mean(0), x[group == 1].std(0) + 0.02 * np.abs(x).std(0) + 1e-3
    positive, unlabelled = expand(x[group == 1], mean, scale), expand(x[group == 0], mean, scale)
    prior = estimate_prior(positive, unlabelled)
    return {"mean": mean, "scale": scale, "w": non_negative_risk(positive, unlabelled, prior), "prior": prior}


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score_batches(model: dict | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        x = np.array([statistics(t.decode("utf-8", "replace")) for t in b.column(1).to_pylist()]).reshape(-1, N_STATISTICS)
        p = np.full(len(x), 0.5) if model is None else _sigmoid((expand(x, model["mean"], model["scale"]) * model["w"]).sum(1))
        yield table(_SCORES, [b.column(0), p])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.3).

    Null and empty texts are scored like others, on all-zero statistics. A null doc_id stays null, as does its held_out. Repeated rows
    each come back; other columns are ignored; an empty table gives no rows. Without positives every score is 0.5.
    """
    texts = texts_of(docs)
    out = texts.mapInArrow(partial(_score_batches, train(docs, labels)), "doc_id long, score double")
    return out.select("doc_id", (fold("doc_id", HELD_OUT_PARTS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
