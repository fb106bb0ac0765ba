"""Quality by Bradley-Terry ranking.

Pairs of a good and a bad labelled document are preferences.  A document's
strength is linear in measurements of its text; the logistic loss on the
difference of two documents' measurements fits the weights.  One labelled
document in HELD_BACK is kept from the fit; of the quantiles of the strengths of
those, the one that divides their labels best gives the cut, and a document of
that strength scores CUT.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, labelled_ids, map_arrow, texts
from .linear import fit_dense, sigmoid
from .quality_rules import measure

FOLDS = 5
#: Labelled documents that the fit uses at most (about; chosen by hash), and pairs drawn from them.
SAMPLE, PAIRS = 20_000, 100_000
CUT = 0.3
#: One labelled document in so many chooses the cut, by quantiles in steps of 1 / STEPS.
HELD_BACK, STEPS = 4, 200
_KNOTS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4)


def features(text: bytes) -> np.ndarray:
    """Measurements of a text: ratios, each also above a few knots, and the logarithm of its length."""
    (n, *_), ratios = measure(text)
    r = np.array(ratios)
    distinct = len(set(text.split())) / n if n else 0.0
    lines = text.count(b"\n") + 1
    more = np.array([distinct, min(1.0, lines / max(n, 1)), text.count(b".") / max(n, 1)])
    r = np.r_[r, more]
    hinges = np.concatenate([np.maximum(r - k, 0) for k in _KNOTS] + [np.minimum(r, 0.02) * 10])
    size = np.log1p(n)
    return np.r_[hinges, size, max(0.0, 4 - size)].astype(np.float32)


class Ranker:
    """weights over standardised features; `cut` is the strength that scores CUT: that of `quantile` of the held-back documents (None: no labels to choose by)."""

    def __init__(self, mean, scale, weights, cut, quantile=None):
        self.mean, self.scale, self.weights, self.cut, self.quantile = mean, scale, weights, cut, quantile

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.strength(x) - self.cut + np.log(CUT / (1 - CUT)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranker:
    """Fits on rows x with labels y; without both classes every strength is 0 and the score is 0.5, or CUT/2 if all are bad."""
    width = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(width)
    scale = x.std(0) if len(x) else np.ones(width)
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
    if not len(good) or not len(bad):
        base = CUT / 2 if len(bad) else 0.5
        return Ranker(mean, scale, np.zeros(width), np.log(CUT / (1 - CUT)) - np.log(base / (1 - base)))
    z = (x - mean) / scale
    held = np.arange(len(y)) % HELD_BACK == 0
    if len(np.unique(y[held] > 0)) < 2 or len(np.unique(y[~held] > 0)) < 2:  # too few labels to keep some back
        held = np.zeros(len(y), bool)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good[~held[good]], pairs), rng.choice(bad[~held[bad]], pairs)
    sign = np.where(np.arange(pairs) % 2 == 0, 1.0, -1.0)
    diff = (z[a] - z[b]) * sign[:, None]
    w = fit_dense(diff, (sign > 0).astype(float), l2=pairs * 1e-4)
    chosen = held if held.any() else ~held
    cut, quantile = best_quantile(z[chosen] @ w, y[chosen] > 0)
    return Ranker(mean, scale, w, cut, quantile)


def best_quantile(strength: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(cut, quantile): the middle of the quantiles that divide good from bad with the least error, both classes weighing alike."""
    quantiles = np.arange(STEPS + 1) / STEPS
    cuts = np.quantile(strength, quantiles)
    wrong = [(good & (strength < c)).sum() / max(good.sum(), 1) + (~good & (strength >= c)).sum() / max((~good).sum(), 1) for c in cuts]
    best = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-12)
    at = int(best[len(best) // 2])
    return float(cuts[at]), float(quantiles[at])


def _measured(docs: DataFrame, extra: list[str]) -> DataFrame:
    """(doc_id, extra, f) from (doc_id, text, extra)."""

    def fn(batch):
        f = [features(t).tobytes() for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in extra], pa.array(f, pa.binary())], ["doc_id", *extra, "f"])

    kinds = {k: v.dataType.simpleString() for k, v in zip(docs.columns, docs.schema.fields)}
    return map_arrow(docs, fn, ", ".join(f"{c} {kinds[c]}" for c in ["doc_id", *extra]) + ", f binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ranker:
    """Fits on labelled documents outside fold 0 of FOLDS by crc32 of the id, about `sample` at most, one row an id."""
    ids = F.broadcast(labelled_ids(labels.where(~in_fold(id_col, FOLDS)), ["quality"], sample, id_col))  # bounded by `sample`
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(ids, id_col).select(F.col(id_col).alias("doc_id"), "text", "quality")
    one = _measured(rows, ["quality"]).groupBy("doc_id").agg(F.min("f").alias("f"), F.first("quality").alias("quality"))  # one row an id
    got = one.toArrow().to_pydict()
    order = sorted(range(len(got["f"])), key=lambda i: zlib.crc32(str(got["doc_id"][i]).encode()))  # reruns agree; ids in no order of theirs
    width = len(features(b""))
    x = np.array([np.frombuffer(got["f"][i], np.float32) for i in order], float).reshape(len(order), width)
    return fit_pairs(x, np.array([got["quality"][i] for i in order]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; predicted is 1 from a score of CUT on.

    A null text counts as empty and is scored like any text.  A row without an
    id is not held out, and never learnt from.
    """
    ranker = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), in_fold(id_col, FOLDS).alias("held_out"))

    def fn(batch):
        x = np.array([features(t) for t in texts(batch)], float)
        s = ranker.score(x)
        cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, fn, f"doc_id {kind}, held_out boolean, score double, predicted int")
