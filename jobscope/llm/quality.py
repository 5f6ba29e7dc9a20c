"""Quality of whole texts by positive-unlabelled learning.

Trusted positives are labelled rows; everything else, labelled or not, is unlabelled text.  An additive logistic
model over binned text statistics minimises the non-negative unbiased risk
``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``, where the class prior is the share of positives
among the labelled training rows.  With the logistic loss the output is a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import map_text, small, stored

#: The model is fitted on about this many positives and as many unlabelled texts, chosen by a hash of doc_id.
SAMPLE_ROWS = 8000
#: Rows whose crc32(doc_id as text) modulo this is 0 are held out: their labels are never learned from.
HOLD_OUT = 5
THRESHOLD = 0.3
SEGMENT = 1024
#: Quantiles between which a feature's bins lie; finer at both ends, where rare faults show.
QUANTILES = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
BINS = len(QUANTILES)
STEPS = 1200

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[_PUNCTUATION] = 1, 2, 3, 4, 5, 6
_CLASS[128:] = 7
N_FEATURES = 8 + len(_PUNCTUATION) + 15


def features(texts: list[bytes | None]) -> np.ndarray:
    """Statistics of whole texts: shares of characters and words, line shapes, and extremes over segments."""
    out = np.zeros((len(texts), N_FEATURES), dtype=np.float32)
    for row, text in zip(out, texts):
        if not text:
            continue
        data = np.frombuffer(text, dtype=np.uint8)
        n = len(data)
        counts = np.bincount(data, minlength=256)
        kind = _CLASS[data]
        row[:8] = np.bincount(_CLASS, weights=counts, minlength=8) / n
        row[8 : 8 + len(_PUNCTUATION)] = counts[_PUNCTUATION] / n
        starts = np.arange(0, n, SEGMENT)
        size = np.diff(np.append(starts, n))
        marks, upper = (np.add.reduceat(kind == k, starts, dtype=np.int32) / size for k in (6, 2))
        words, lines = text.split(), text.split(b"\n")
        number = max(1, len(words))
        twin = (data[1:] == data[:-1]) & (kind[1:] == 6)
        row[8 + len(_PUNCTUATION) :] = (
            np.log1p(n),
            marks.max(),
            upper.max(),
            marks.min(),
            np.count_nonzero(twin) / n,
            np.count_nonzero((kind[1:] == 6) & (kind[:-1] == 6)) / n,
            np.count_nonzero((kind[1:] == 6) & (kind[:-1] == 4)) / n,
            np.count_nonzero((kind[1:] == 2) & (kind[:-1] == 2)) / n,
            len(words) / n,
            len(set(words)) / number,
            sum(map(bytes.isupper, words)) / number,
            sum(map(bytes.__eq__, words, words[1:])) / number,
            len(set(lines)) / len(lines),
            np.log1p(n / len(lines)),
            np.log1p(max(map(len, words), default=0)),
        )
    return out


@dataclass
class Model:
    """Bin edges per feature and a weight per bin; the constant alone where nothing could be learned."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        found = [np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)]
        return np.stack(found, axis=1) + np.arange(len(self.edges)) * (BINS + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[self.bins(x)].sum(axis=1) + self.bias, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Minimise the non-negative risk by full-batch gradient steps with adaptive, falling rates."""
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, QUANTILES, axis=0).T.astype(np.float32)
    prior = float(np.clip(prior, 0.01, 0.99))
    model = Model(edges, np.zeros(edges.shape[0] * (BINS + 1)), float(np.log(prior / (1 - prior))))
    p, u = model.bins(positive), model.bins(unlabelled)
    first, second = np.zeros(len(model.weights) + 1), np.zeros(len(model.weights) + 1)

    def gradient(rows, slope):
        weights = np.bincount(rows.ravel(), weights=np.repeat(slope, rows.shape[1]), minlength=len(model.weights))
        return np.append(weights, slope.sum())

    for step in range(1, steps + 1):
        g_p, g_u = (np.clip(model.weights[r].sum(axis=1) + model.bias, -30, 30) for r in (p, u))
        s_p, s_u = 1 / (1 + np.exp(-g_p)), 1 / (1 + np.exp(-g_u))
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        change = gradient(u, s_u / len(u)) - gradient(p, prior * s_p / len(p))
        if negative >= 0:
            change += gradient(p, prior * (s_p - 1) / len(p))
        else:
            change = -change
        change[:-1] += 3e-5 * model.weights
        first, second = 0.9 * first + 0.1 * change, 0.99 * second + 0.01 * change**2
        rate = 0.1 * (1 - (step - 1) / steps)
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model.weights -= move[:-1]
        model.bias -= move[-1]
    return model


def held_out() -> F.Column:
    """Whether a row's label must not be learned; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HOLD_OUT == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``sample_rows`` positives and as many unlabelled documents.

    Labels without doc_id or quality are left out.  Without positive labels or texts the model is the constant 0.5.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    seen = known.agg(F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("ones")).first()
    total, ones = docs.count(), seen["ones"] or 0
    nothing = Model(np.zeros((N_FEATURES, BINS), dtype=np.float32), np.zeros(N_FEATURES * (BINS + 1)), 0.0)
    if not ones or not total:
        return nothing
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where((F.col("quality") == 1) & (place < sample_rows / ones)).select("doc_id").distinct()
    chosen = stored(chosen.withColumn("__positive", F.lit(True)), "positives")
    rows = docs.select("doc_id", "text").join(small(chosen), "doc_id", "left")
    rows = rows.withColumn("__unlabelled", F.coalesce(place < sample_rows / total, F.lit(False)))
    rows = rows.withColumn("__positive", F.coalesce("__positive", F.lit(False))).where("__positive or __unlabelled")
    field = T.StructField("x", T.ArrayType(T.FloatType()))
    found = map_text(rows, [field], lambda: lambda texts: [list(features(texts))], keep=["doc_id", "__positive", "__unlabelled"])
    got = found.toPandas().sort_values("doc_id")
    if not got["__positive"].any() or not got["__unlabelled"].any():
        return nothing
    x = np.stack(got["x"].to_numpy())
    return fit(x[got["__positive"].to_numpy()], x[got["__unlabelled"].to_numpy()], ones / seen["n"])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score of each whole text; null texts score like empty ones."""

    def start():
        return lambda texts: [model.score(features(texts))]

    return map_text(docs, [T.StructField(name, T.DoubleType())], start, keep=keep)
