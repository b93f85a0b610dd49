"""Language identification by averaged subword embeddings.

A text is the average of the embeddings of its hashed character n-grams (1 to 3
letters, word ends included); a linear softmax on that average gives the
language.  Both are trained by stochastic gradient descent in numpy.  A
temperature fitted on texts kept back calibrates the score.  The best of few
languages has a high score whatever the text, so texts that no learned language
fits are told by their n-grams as well: by how likely these are in the
language named.  Thresholds of both are set on texts kept back.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, bound_batches, held_out

BUCKETS, WIDTH = 1 << 13, 16
#: Documented bound of the training sample: expected documents of all languages, and of each where there are many languages.
DOCUMENTS, EACH = 4_000, 100
#: Share of the texts kept back that a threshold may reject.
REJECTED = 0.0005
SLICE = 1 << 20
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subwords(text: str | None) -> np.ndarray:
    """Counts by bucket of the hashed n-grams of the whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    text = text or ""
    for start in range(0, len(text), SLICE):
        codes = np.frombuffer(text[start : start + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters(codes)
        # Zero stands for everything between words, once.
        codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint32)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, 4):
            m = len(codes) - n + 1
            if m <= 0:
                break
            step = codes[n - 1 :]
            gram = gram[:m] * np.uint32(0x01000193) + step + np.uint32(n)
            # No n-gram spans two words: a zero may stand at its ends, not within.
            use = gram[step != 0] if n == 1 else gram if n == 2 else gram[codes[1 : 1 + m] != 0]
            counts += np.bincount(use * np.uint32(0x9E3779B1) >> np.uint32(32 - 13), minlength=BUCKETS)
    return counts


_LETTER = np.zeros(0x110000, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _LETTER[ord("a")]:
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER[codes]


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    #: Share of each language that one n-gram of a bucket adds: embeddings times softmax weights.
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    #: Log likelihood of one n-gram of a bucket in each language.
    logs: np.ndarray | None = None
    #: By language: mean of a text's log likelihood an n-gram, variance of one n-gram, variance between texts.
    usual: np.ndarray | None = None
    least_fit: float = -np.inf

    def fit(self, counts: np.ndarray, at: int) -> float:
        """How far the n-grams are less likely in a language than those of its texts are, in standard deviations, as a negative number."""
        if self.logs is None:
            return 0.0
        n, (mean, within, between) = max(1, counts.sum()), self.usual[at]
        return float((counts @ self.logs[:, at] / n - mean) / np.sqrt(within / n + between))

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = (counts @ self.table / max(1, counts.sum()) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """A learned language, its probability and whether the text is rejected; ``und`` and 0 without letters or languages."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = self.probabilities(counts := subwords(text))
        at = int(p.argmax())
        return self.langs[at], float(p[at]), bool(p[at] < self.threshold or self.fit(counts, at) < self.least_fit)


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 42) -> LanguageModel:
    """``rows`` are (buckets, counts) of texts, ``langs`` their languages; one row in five is kept back for calibration."""
    names = tuple(sorted(set(langs)))
    if not names:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    order = rng.permutation(len(rows))
    back, own = order[: len(rows) // 5], order[len(rows) // 5 :]
    # Languages weigh the same however many texts they have.
    weigh = len(own) / (len(names) * np.maximum(1, np.bincount(y[own], minlength=len(names))))
    steps, step = epochs * len(own), 0
    for _ in range(epochs):
        for i in rng.permutation(own):
            at, n = rows[i]
            share = n / n.sum()
            mean = share @ embed[at]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            r = rate * (1 - step / steps) * min(weigh[y[i]], 5.0)
            back_to = weights @ p
            weights -= r * np.outer(mean, p)
            bias -= r * 0.1 * p
            # Shares are small; embeddings move as if each n-gram had its own step.
            embed[at] -= r * len(at) ** 0.5 * share[:, None] * back_to
            step += 1
    model = LanguageModel(names, embed @ weights, bias, 1.0, 0.0)
    if not len(back):
        return model
    logits = np.array([n @ model.table[at] / n.sum() + bias for at, n in (rows[i] for i in back)])

    def loss(t):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return -(z[np.arange(len(back)), y[back]] - np.log(np.exp(z).sum(axis=1))).mean() + 1e-4 * abs(np.log(t))

    temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    z = logits / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.argmax(axis=1) == y[back]
    threshold = float(np.quantile(p.max(axis=1)[right], REJECTED)) if right.any() else 0.0
    logs, usual = likelihoods([rows[i] for i in own], y[own], len(names))
    model = LanguageModel(names, model.table, bias, temperature, threshold, logs, usual)
    fits = [model.fit(np.bincount(rows[i][0], rows[i][1], BUCKETS), y[i]) for i in back[right]]
    return replace(model, least_fit=float(np.quantile(fits, REJECTED)) if fits else -np.inf)


def likelihoods(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods of n-grams by bucket and language, and the figures that LanguageModel.usual holds, over training texts."""
    logs, usual = np.zeros((BUCKETS, k)), np.zeros((k, 3))
    for c in range(k):
        own = [r for r, x in zip(rows, y) if x == c]
        total = np.ones(BUCKETS)
        for at, n in own:
            # Long texts count no more than short ones with as many different n-grams.
            total[at] += n / n.sum() * len(at)
        logs[:, c] = np.log(total / total.sum())
        if not own:
            continue
        sums = np.array([n.sum() for _, n in own])
        means = np.array([n @ logs[at, c] / n.sum() for at, n in own])
        within = np.array([n @ (logs[at, c] - m) ** 2 / n.sum() for (at, n), m in zip(own, means)])
        mean, inside = np.median(means), within.mean()
        usual[c] = mean, inside, max(1e-4, np.median((means - mean) ** 2 - inside / sums))
    usual[:, 1] = np.maximum(usual[:, 1], 1e-4)
    return logs, usual


def training_rows(docs: DataFrame, documents: int = DOCUMENTS) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Counts of sampled texts, each whole and as a short passage of it, without held-out rows, null ids and null languages."""
    bound_batches(docs.sparkSession)
    own = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # As many documents of each language, however rare it is.
    sizes = own.groupBy("lang").count()
    k = sizes.count()
    limit = F.least(F.lit(1.0), max(documents / max(1, k), EACH) / F.col("count")) * 2**31
    sizes = sizes.select("lang", limit.cast("long").alias("limit"))
    sizes = F.broadcast(sizes) if k <= HOT else sizes
    chosen = own.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(2**31)) < F.col("limit"))

    def run(batches):
        for batch in batches:
            langs, found = [], []
            for text, lang in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                middle = len(text) // 2
                for part in (text, text[middle : middle + 60]):
                    counts = subwords(part)
                    if (at := np.flatnonzero(counts)).size:
                        found.append(np.concatenate([at, counts[at]]).astype(np.int32).tobytes())
                        langs.append(lang.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "counts"])

    table = chosen.select("text", "lang").mapInArrow(run, "lang string, counts binary").toArrow()
    pairs = sorted(zip(table.column("counts").to_pylist(), table.column("lang").to_pylist()))
    rows = [np.frombuffer(x, np.int32).reshape(2, -1) for x, _ in pairs]
    return [(x[0], x[1].astype(np.float64)) for x in rows], [lang for _, lang in pairs]


def fit(docs: DataFrame, documents: int = DOCUMENTS) -> LanguageModel:
    return train(*training_rows(docs, documents))


def predict_column(text: Column, model: LanguageModel) -> Column:
    """Struct of lang_pred, score and rejected."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict(text)


def language_scores(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``docs``.

    Texts that are null or have no letter are ``und`` with score 0; the score
    of others is the calibrated probability of the language named.  Rejected
    are ``und``, scores below the model's threshold and texts whose n-grams
    the language named makes less likely than its own texts' are.  Null ids count as not
    held out, repeated rows stay, other columns are ignored.
    """
    model = model or fit(docs)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict_column(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told with enough certainty, with all their columns."""
    model = fit(docs)
    return docs.where(~predict_column(F.col("text"), model)["rejected"])
