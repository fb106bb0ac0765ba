"""Toxicity by a classifier chain.

The categories are label columns.  One linear model a category, in order: each
sees hashed words and word beginnings of the text and, besides, the
probabilities of the categories before it.  In training those probabilities
are out-of-fold predictions, so that a later model learns from values as
uncertain as it will meet.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_column, labelled_ids, map_arrow, stored, texts
from .linear import Sparse, fit_sparse, sigmoid

#: Hashed feature space.
DIMS = 1 << 22
#: Labelled documents that the fit uses at most (about; they are chosen by hash).
SAMPLE = 8_000
FOLDS = 5
#: A feature needs so many documents, and so many standard errors between the classes.
LEAST_DOCS, LEAST_Z = 4, 5.0
#: Features kept for a category at most, the strongest first.
WIDTH = 512
#: Weights below this share of the largest are left out.
FAINT = 0.03
THRESHOLD = 0.5
#: A level of a feature: so many words hold it once at least.
RATES = (200, 60)
_EDGE = b".,;:!?\"'()[]{}*&%$#|<>-_"
_CACHE = 100_000
#: Chain used by the query and the pipeline: 1 - quality first, then toxic.
CHAIN = ("low_quality", "toxic")


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its beginnings of 4, 5 and 6 bytes."""
    word = word.strip(_EDGE)
    if not word:
        return ()
    crc = zlib.crc32
    out = [crc(b"w" + word)]
    for k in (4, 5, 6):
        if len(word) >= k:
            out.append(crc(b"%d" % k + word[:k]))
    return tuple(h % DIMS for h in out)


#: What is added to a feature's hash for its levels: at all, twice or more, and one in RATES words or more.
STEPS = (0, 7_919, *(k * 104_729 for k in range(1, len(RATES) + 1)))


def levels(count: int, words: int) -> list[int]:
    """Which of STEPS a feature reaches that a text of so many words holds so many times."""
    return [0] if count < 2 else [0, 1, *(k for k, rate in enumerate(RATES, 2) if count * rate >= words)]


def features(text: bytes) -> np.ndarray:
    """Distinct hashed features of a text."""
    words = text.lower().split()
    counts: Counter[int] = Counter()
    for w, n in Counter(words).items():
        for f in word_features(w):
            counts[f] += n
    found: set[int] = set()
    for f, n in counts.items():
        found.update((f + STEPS[k]) % DIMS for k in levels(n, len(words)))
    return np.fromiter(found, np.int64, len(found))


class Chain:
    """A fitted chain: for each category the kept features, their weights, an intercept and the earlier categories' weights."""

    def __init__(self, names: tuple[str, ...], links: list[tuple[np.ndarray, np.ndarray]]):
        self.names, self.links = names, links
        # For a feature's hash: (level, category, weight) of whatever its levels may add.
        self.table: dict[int, list[tuple[int, int, float]]] = {}
        for k, (kept, w) in enumerate(links):
            for f, x in zip(kept.tolist(), w[: len(kept)].tolist()):
                for level, step in enumerate(STEPS):
                    self.table.setdefault((f - step) % DIMS, []).append((level, k, x))
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"names": self.names, "links": self.links}

    def __setstate__(self, state):
        self.__init__(state["names"], state["links"])

    def score(self, text: bytes) -> list[float]:
        """Probability of each category; of an empty text, what the intercepts give."""
        cache, table = self.cache, self.table
        words = text.lower().split()
        counts: dict[int, int] = {}
        for w, n in Counter(words).items():
            hit = cache.get(w)
            if hit is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                hit = cache[w] = tuple(f for f in word_features(w) if f in table)
            for f in hit:
                counts[f] = counts.get(f, 0) + n
        sums = [0.0] * len(self.links)
        for f in sorted(counts):
            reached = levels(counts[f], len(words))
            for level, k, x in table[f]:
                if level in reached:
                    sums[k] += x
        out: list[float] = []
        for k, (kept, w) in enumerate(self.links):
            rest = w[len(kept) :]
            out.append(float(sigmoid(sums[k] + rest[0] + sum(a * b for a, b in zip(rest[1:], out)))))
        return out


def separation(c: np.ndarray, c1: np.ndarray, n: float, n1: float) -> np.ndarray:
    """Standard errors between the shares of both classes that hold each feature, in c of n documents and c1 of the n1 positive; 0 below LEAST_DOCS."""
    n0 = n - n1
    if not n1 or not n0:
        return np.zeros(len(c))
    p = c / n
    z = np.abs(c1 / n1 - (c - c1) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return np.where(c < LEAST_DOCS, 0.0, z)


def strongest(rows: list[np.ndarray], t: np.ndarray) -> np.ndarray:
    """The features that a category keeps, ascending: what fit() selects in the executors, for rows in memory."""
    found, at = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int64), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    z = separation(np.bincount(at, minlength=len(found)), np.bincount(at, t[owner], len(found)), len(rows), t.sum())
    kept = np.flatnonzero(z >= LEAST_Z)
    return np.sort(found[kept[np.argsort(-z[kept], kind="stable")[:WIDTH]]])


def fit_chain(rows: list[np.ndarray], y: np.ndarray, names: tuple[str, ...], folds: np.ndarray, kept: list[np.ndarray] | None = None) -> Chain:
    """rows: distinct features a document, ascending; y: a column of 0/1 a category; folds: a fold number a document;
    kept: the features of each category, ascending (none: strongest()).

    Without documents, or where a category has one class, that category's
    features get no weight and its intercept carries the class seen (none: an
    even chance).
    """
    n = len(rows)
    links, earlier = [], np.zeros((n, 0))
    for k in range(len(names)):
        t = y[:, k] if n else np.zeros(0)
        n1 = t.sum()
        if n1 == 0 or n1 == n:
            sure = 0.0 if not n else 4.0 if n1 else -4.0
            links.append((np.zeros(0, np.int64), np.r_[sure, np.zeros(k)]))
            earlier = np.c_[earlier, np.full(n, sigmoid(sure))]
            continue
        own = strongest(rows, t) if kept is None else kept[k]
        x = Sparse([np.searchsorted(own, r[np.isin(r, own)]) for r in rows], len(own), np.c_[np.ones(n), earlier])
        guess = np.zeros(n)
        for f in np.unique(folds):
            guess[folds == f] = sigmoid(x.dot(fit_sparse(x, t, folds != f)))[folds == f]
        w = fit_sparse(x, t)
        strong = np.abs(w[: len(own)]) >= FAINT * np.abs(w[: len(own)]).max(initial=0)
        links.append((own[strong], np.r_[w[: len(own)][strong], w[len(own) :]]))
        earlier = np.c_[earlier, guess]
    return Chain(names, links)


def fit(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """Fits on documents with labels, about `sample` at most, one row an id; labels has a 0/1 column for each of names.

    Features are counted and selected in the executors; WIDTH features a
    category, and what the labelled documents hold of them, reach the driver.
    """
    ids = F.broadcast(labelled_ids(labels, list(names), sample, id_col))  # bounded by `sample`
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(ids, id_col).select(F.col(id_col).alias("doc_id"), "text", *names)
    kinds = ", ".join(f"{c} double" for c in names)

    def measure(batch):
        feats = [np.sort(features(t)).astype("<u4").tobytes() for t in texts(batch)]
        fold = [zlib.crc32(str(i).encode()) // 7 % FOLDS for i in batch.column("doc_id").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(feats, pa.binary()), pa.array(fold, pa.int32()), *[batch.column(c) for c in names]], ["doc_id", "f", "fold", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    held = map_arrow(rows, measure, f"doc_id {kind}, f binary, fold int, {kinds}")
    held = stored(held.groupBy("doc_id").agg(F.min("f").alias("f"), *[F.first(c).alias(c) for c in ("fold", *names)]).drop("doc_id"), "chain-features")
    sums = held.agg(F.count("*"), *[F.sum(c) for c in names]).first()
    n, positive = sums[0], [s or 0.0 for s in sums[1:]]

    def count(batches):
        for b in batches:
            rows = [np.frombuffer(f, "<u4") for f in b.column("f").to_pylist()]
            found, at = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.uint32), return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            cols = [np.bincount(at, minlength=len(found)).astype(float), *[np.bincount(at, b.column(c).to_numpy()[owner], len(found)) for c in names]]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), *map(pa.array, cols)], ["feature", "seen", *names])

    def judge(batch):
        z = [separation(batch.column("seen").to_numpy(), batch.column(c).to_numpy(), n, n1) for c, n1 in zip(names, positive)]
        strong = pa.array(np.any([x >= LEAST_Z for x in z], axis=0))
        return pa.RecordBatch.from_arrays([batch.column("feature"), *map(pa.array, z)], ["feature", *names]).filter(strong)

    counts = held.mapInArrow(count, f"feature long, seen double, {kinds}").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("seen", *names)])
    judged = stored(map_arrow(counts, judge, f"feature long, {kinds}"), "chain-judged")
    kept = [np.sort(np.array([r.feature for r in judged.where(F.col(c) >= LEAST_Z).orderBy(F.desc(c), "feature").limit(WIDTH).collect()], np.int64)) for c in names]
    wanted = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)

    def pick(batch):
        feats = [f[np.isin(f, wanted)].tobytes() for f in (np.frombuffer(f, "<u4") for f in batch.column("f").to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(feats, pa.binary()), batch.column("fold"), *[batch.column(c) for c in names]], ["f", "fold", *names])

    got = map_arrow(held, pick, f"f binary, fold int, {kinds}").toArrow()  # a row a labelled document
    feats = [np.frombuffer(f, "<u4").astype(np.int64) for f in got.column("f").to_pylist()]
    y = np.array([got.column(c).to_numpy() for c in names]).T.reshape(len(feats), len(names))
    fold = got.column("fold").to_numpy()
    order = sorted(range(len(feats)), key=lambda i: (fold[i], y[i].tolist(), len(feats[i]), feats[i].tolist()))  # reruns agree
    return fit_chain([feats[i] for i in order], y[order], names, fold[order], kept)


def scores(chain: Chain, text):
    """An array of the probabilities of chain's categories for a text column: the texts alone go to Python."""
    names = [f"p_{c}" for c in chain.names]

    def fn(column):
        p = np.array([chain.score(t or b"") for t in column.cast(pa.binary()).to_pylist()]).reshape(len(column), len(names))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(names))], names=names)

    return arrow_column(fn, T.StructType([T.StructField(c, T.DoubleType()) for c in names]))(text)


def scored(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a p_<category> double for each category and toxic boolean (the last one at least `threshold`).

    All rows and columns come through; a column of docs with one of these
    names is replaced.  A null text counts as empty.
    """
    new = [f"p_{c}" for c in chain.names]
    kept = [c for c in docs.columns if c not in (*new, "toxic")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], scores(chain, F.col(f"`{text_col}`")).alias("_scores"))
    return rows.select(*[F.col(f"`{c}`") for c in kept], "_scores.*", (F.col(f"_scores.{new[-1]}") >= threshold).alias("toxic"))


def chain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The label columns of CHAIN from `quality` and `toxic`."""
    return labels.select(F.col(id_col), (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) for every row of docs; see fit() and scored() for nulls and empties."""
    chain = fit(docs, chain_labels(labels, id_col), CHAIN, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(rows, chain).drop("text")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the toxic ones, columns as they were."""
    chain = fit(docs, chain_labels(labels, id_col), CHAIN, id_col, text_col)
    return docs.where(scores(chain, F.col(text_col))[f"p_{CHAIN[-1]}"] < THRESHOLD)
