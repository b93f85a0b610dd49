"""Quality classifier by positive-unlabelled learning.

A linear model on style features minimises the non-negative unbiased risk

    p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))

over trusted positives (documents labelled 1) and unlabelled web text; labels
of 0 are never used.  The class prior p is estimated from the same two sets:
where a positive-against-unlabelled scorer is most certain, the share of
unlabelled over that of positives falls to p.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, hash_share, held_out

#: Documented bounds of the training sample: expected rows of each kind.
POSITIVES, UNLABELLED = 12_000, 12_000
SLICE = 1 << 20

# Classes of bytes.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t\v\f", b".", b",", b"!", b"?", b"|", b"'\"()-:;", b"#$%&*+/<=>@[\\]^_`{}~"]
CLASSES = len(_GROUPS) + 3
_CLASS_OF = np.full(256, len(_GROUPS), np.uint8)
for _i, _chars in enumerate(_GROUPS):
    _CLASS_OF[list(_chars)] = _i
_CLASS_OF[0x80:0xC0] = len(_GROUPS) + 1
_CLASS_OF[0xC0:] = len(_GROUPS) + 2
WORD_FEATURES = 8
FEATURES = CLASSES * CLASSES + CLASSES + WORD_FEATURES


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes and of their pairs, and statistics of words, of the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    pairs = np.zeros(CLASSES * CLASSES)
    n_words = same = long = size = upper = bare = 0
    distinct: set[int] = set()
    last = b""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and data[end] not in b" \n\t\r\v\f":
            end += 1
        cls = _CLASS_OF[np.frombuffer(data, np.uint8, end - max(0, at - 1), max(0, at - 1))].astype(np.int32)
        pairs += np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES)
        words = data[at:end].split()
        if words:
            same += sum(map(eq, words, words[1:])) + (words[0] == last)
            last = words[-1]
            n_words += len(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            size += int(lengths.sum())
            long += int((lengths > 24).sum())
            upper += sum(w.isupper() for w in words)
            bare += sum(w.isalpha() for w in words)
            distinct.update(h & 0xFFFFF for h in map(hash_word, words))
        at = end
    n = max(1, n_words)
    total = max(1.0, pairs.sum())
    single = pairs.reshape(CLASSES, CLASSES).sum(axis=0)
    # A text of n words drawn freely repeats some; the log ratio takes the length out of the distinct share.
    spread = np.log1p(len(distinct)) / np.log1p(n)
    stats = [same / n, spread, min(size / n, 64) / 8, long / n, upper / n, bare / n, np.log1p(n) / 8, float(n_words == 0)]
    return np.concatenate([np.sqrt(pairs / total), np.sqrt(single / total), stats]).astype(np.float32)


def hash_word(word: bytes) -> int:
    """A hash that is the same in every process."""
    return zlib.crc32(word)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Adam with a falling step."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x @ w.astype(np.float32)).astype(np.float64)


def _sums(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return (by.astype(np.float32) @ x).astype(np.float64)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, tail: float = 0.5) -> float:
    """Share of positives among unlabelled rows.

    Scores come from a positive-against-unlabelled scorer.  Above a threshold
    the share of unlabelled rows is p times that of positives plus what
    negatives add; the smallest ratio over thresholds that at least ``tail``
    of the positives pass estimates p, from 0.001 to 0.999.
    """
    order = np.sort(positive)
    best = 1.0
    for t in np.quantile(order, np.linspace(0.0, 1 - tail, 60)):
        best = min(best, (unlabelled >= t).mean() / max((order >= t).mean(), 1e-9))
    return float(np.clip(best, 0.001, 0.999))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, l2: float = 0.03) -> QualityModel:
    """Non-negative PU learning of a linear model with the logistic loss."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 4.0, 1.0)
    # Sums in doubles, rows in four bytes: the driver holds the sample and one copy of it.
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(axis=0, dtype=np.float64) + unlabelled.sum(axis=0, dtype=np.float64)) / n
    scale = np.sqrt((((positive - mean.astype(np.float32)) ** 2).sum(axis=0, dtype=np.float64) + ((unlabelled - mean.astype(np.float32)) ** 2).sum(axis=0, dtype=np.float64)) / n) + 1e-3

    def ones(x):
        out = np.ones((len(x), FEATURES + 1), np.float32)
        np.clip((x - mean.astype(np.float32)) / scale.astype(np.float32), -8, 8, out=out[:, :-1])
        return out

    p, u = ones(positive), ones(unlabelled)
    shrink = np.append(np.full(FEATURES, l2), 0.0)
    if prior is None:
        # Each half of the rows is scored by what the other half taught.
        scores = []
        for k in (0, 1):
            pk, uk = p[k::2], u[k::2]
            contrast = _descend(lambda w, pk=pk, uk=uk: -_sums(pk, _sigmoid(-_products(pk, w))) / max(1, len(pk)) + _sums(uk, _sigmoid(_products(uk, w))) / max(1, len(uk)) + shrink * w, FEATURES + 1, 150)
            scores.append((_products(p[1 - k :: 2], contrast), _products(u[1 - k :: 2], contrast)))
        prior = float(np.mean([estimate_prior(*x) for x in scores if len(x[0]) and len(x[1])] or [0.9]))

    def gradient(w):
        sp, su = _sigmoid(_products(p, w)), _sigmoid(_products(u, w))
        # Logistic losses: log(1 + exp(-z)) for the positive class, log(1 + exp(z)) for the negative one.
        negative = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
        against = _sums(u, su) / len(u) - prior * _sums(p, sp) / len(p)
        if negative < 0:  # the risk of negatives can't be below zero: step back from it
            return -against + shrink * w
        return -prior * _sums(p, 1 - sp) / len(p) + against + shrink * w

    w = _descend(gradient, FEATURES + 1)
    return QualityModel(mean, scale, w[:-1], float(w[-1]), prior)


def training_rows(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features of sampled positives and of sampled web text, without held-out rows.

    A document is positive if all its non-null labels are 1.  Sampling is by a
    hash of doc_id, about as many rows as stated whatever the input's size.
    """
    bound_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1")
    n_docs, n_known = docs.count(), known.count()
    share_u = unlabelled / max(1, n_docs * 0.75)
    share_p = positives / max(1, n_known)
    chosen = known.where(hash_share(F.col("doc_id"), share_p)).select("doc_id", F.lit(True).alias("positive"))
    # About ``positives`` ids: where that holds they are broadcast, and no text is shuffled.
    chosen = F.broadcast(chosen) if chosen.count() <= 2 * positives + 1000 else chosen
    own = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.where(hash_share(F.col("doc_id"), max(share_u, share_p)))
    rows = own.join(chosen, "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"), hash_share(F.col("doc_id"), share_u).alias("web"))

    def run(batches):
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], ["positive", "web", "features"])

    table = rows.where("positive or web").mapInArrow(run, "positive boolean, web boolean, features binary").toArrow()
    chunks = [c for c in table.column("features").chunks if len(c)]
    parts = [np.frombuffer(c.buffers()[2], np.float32)[c.offset * FEATURES : (c.offset + len(c)) * FEATURES] for c in chunks]
    all_rows = np.concatenate([*parts, np.empty(0, np.float32)]).reshape(-1, FEATURES)
    pick = lambda name: all_rows[table.column(name).to_numpy(zero_copy_only=False).astype(bool)]
    order = lambda x: x[np.lexsort(x.T[:8])]  # noqa: E731  the same sums whatever order rows come in
    return order(pick("positive")), order(pick("web"))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    return train(*training_rows(docs, labels, positives, unlabelled))


def score_column(text: Column, model: QualityModel) -> Column:
    """Score of each text from 0 to 1; a null text scores as an empty one."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, FEATURES)))

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, model: QualityModel | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null texts score as empty ones, null ids count as not held out, repeated
    rows stay, other columns are ignored; without training rows every score is
    the same and above the threshold.
    """
    model = model or fit(docs, labels)
    scored = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    return docs.where(score_column(F.col("text"), fit(docs, labels)) >= threshold)
