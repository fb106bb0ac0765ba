"""Quality rules with risk-controlled cutoffs.

A document fails a rule where a ratio measured on its text exceeds a cutoff.
The labelled good documents are dealt in two by hash.  One half proposes, for
a ladder of ever stricter levels, the cutoff of each ratio.  The other half,
the holdout, tests the ladder step by step in each stratum: a level stands
while the exact (Clopper-Pearson) upper bound of the share of good documents
that its rules reject is at most ALPHA.  Steps are tested in a fixed order and
stop at the first that fails, and the error is dealt over the strata
(Bonferroni), so with probability 1 - DELTA no stratum that gets a level
rejects more than ALPHA of its good documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_column, stored

ALPHA, DELTA = 0.02, 0.05
#: Share of good documents that each level may cost on the proposing half, over all rules; the mildest first.
LADDER = (0.0, 0.0005, 0.001, 0.002, 0.005, 0.01)
#: A ratio is a rule at a level if the bad documents exceed its cutoff so many times as often as the good.
LEAST_LIFT = 5.0
#: Steps of a ratio: cutoffs lie on sqrt(ratio) * BINS.
BINS = 400
RATIOS = ("symbols", "capitals", "marks", "digits", "dup_lines", "repeats", "long_words", "short_words")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_WS = b" \t\n\r\x0b\f"
_NOT_POINTS = _WS + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_CAPITALS, _SMALL, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"!?=_~^+{}[]\\/@"


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which is found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(n)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i] = hit[j] = 1
    covered, until = 0, 0
    for i in range(n):
        if hit[i]:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """The counts of _COUNTS and the ratios of RATIOS."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _NOT_POINTS))
    size = len(text)
    count = lambda what: size - len(text.translate(None, what))
    symbols = count(_SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(_WS)]
    dup = len(lines) - len(set(lines))
    again = repeat_words(words)
    capitals, small = count(_CAPITALS), count(_SMALL)
    mean = chars / n if n else 0.0
    ratios = [
        symbols / max(chars, 1),
        capitals / max(capitals + small, 1),
        count(_MARKS) / max(chars, 1),
        count(_DIGITS) / max(chars, 1),
        dup / max(len(lines), 1),
        again / max(n, 1),
        min(mean / 40, 1.0),
        max(0.0, 1 - mean / 10),
    ]
    return [n, chars, symbols, dup, again], ratios


#: What measured() adds.
MEASURES = T.StructType([*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("base_failed", T.BooleanType())])


def _measure_column(text):
    """MEASURES of a text column: the texts alone go to Python, the rest of a row stays in the JVM."""

    def fn(column):
        got = [measure(t or b"") for t in column.cast(pa.binary()).to_pylist()]
        counts = np.array([g[0] for g in got], np.int64).reshape(len(got), len(_COUNTS))
        bins = np.floor(np.sqrt(np.array([g[1] for g in got]).reshape(len(got), len(RATIOS))) * BINS).astype(np.int32)
        n, again = counts[:, 0], counts[:, 4]
        failed = (n < 50) | (100 * again > 50 * n)
        cols = [*[pa.array(counts[:, k]) for k in range(len(_COUNTS))], pa.array(list(bins), pa.list_(pa.int32())), pa.array(failed)]
        return pa.StructArray.from_arrays(cols, names=MEASURES.names)

    return arrow_column(fn, MEASURES)(text)


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(row, stratum, counts of _COUNTS (long), bins (array of int, one a ratio), base_failed); `row` is the row of docs.

    A null text has no words.  The stratum is the language itself; a null one,
    apart from '', is a stratum like any other.  Without the language column
    all rows are one stratum.
    """
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), lang.cast("string").alias("stratum"), _measure_column(F.col(text_col)).alias("m"))
    return rows.select("row", "stratum", "m.*")


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + top / c
            c = c if abs(c) > 1e-300 else 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def upper_bound(k: int, n: int, delta: float) -> float:
    """The largest p under which k or fewer of n still have probability delta (Clopper-Pearson); 1 for n = 0."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if betainc(n - k, k + 1, 1 - p) > delta:
            low = p
        else:
            high = p
    return high


def propose(good: np.ndarray, bad: np.ndarray) -> list[list[int]]:
    """Cutoffs for each level and ratio from bin counts (a row a ratio) of good and bad documents; BINS: no rule."""
    out = []
    for share in LADDER:
        level = []
        for g, b in zip(good, bad):
            n, nb = g.sum(), b.sum()
            above, above_bad = n - np.cumsum(g), nb - np.cumsum(b)  # documents over each bin
            at = int(np.argmax(above <= share / len(RATIOS) * n)) if n else BINS
            lift = above_bad[at] / max(nb, 1) >= LEAST_LIFT * max(above[at], 1) / max(n, 1) if at < BINS else False
            level.append(at if lift else BINS)
        out.append(level)
    return out


def control(rejected: np.ndarray, n: int, strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """The last level of the ladder that stands, from the good holdouts that each level rejects; -1: none."""
    last = -1
    for level, k in enumerate(rejected):
        if upper_bound(int(k), n, delta / max(strata, 1)) > alpha:
            break
        last = level
    return last


def least_holdouts(strata: int) -> int:
    """The good holdouts without which no level stands, even if none is rejected."""
    return math.ceil(math.log(DELTA / max(strata, 1)) / math.log(1 - ALPHA) - 1e-6)


def learn(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> dict[str | None, list[int]]:
    """Cutoffs for each stratum that gets rules. rows: (id, stratum, bins) of all documents; labels: id, quality.

    Every labelled document counts, each label once a row.  Strata with too
    few labels for any level get no rules.  What reaches the driver is a count
    for each other stratum, ratio and bin.
    """
    spark = rows.sparkSession
    quality = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.max("quality").alias("good"))
    half = F.pmod(F.xxhash64(F.col(id_col), F.lit("half")), F.lit(2))
    known = stored(rows.where("not base_failed").join(quality, id_col).select("stratum", "bins", "good", half.alias("half")), "rules-labelled")
    sizes = stored(known.groupBy("stratum").agg(F.count_if(F.expr("half = 1 and good > 0")).alias("n")), "rules-strata")
    strata = sizes.count()
    enough = [r.stratum for r in sizes.where(F.col("n") >= least_holdouts(strata)).select("stratum").collect()]
    if not enough:
        return {}

    def of(strata: DataFrame) -> DataFrame:
        own = strata.withColumnRenamed("stratum", "own")
        return known.join(F.broadcast(own), F.col("stratum").eqNullSafe(F.col("own")))

    first = of(spark.createDataFrame([(s,) for s in enough], "stratum string")).where("half = 0")
    counts = first.select("stratum", "good", F.posexplode("bins").alias("ratio", "bin")).groupBy("stratum", (F.col("good") > 0).alias("good"), "ratio", "bin").count().collect()
    tables = {s: np.zeros((2, len(RATIOS), BINS + 1), np.int64) for s in enough}
    for r in counts:
        tables[r.stratum][int(r.good), r.ratio, r.bin] += r["count"]
    proposals = {s: propose(t[1], t[0]) for s, t in tables.items()}
    second = of(spark.createDataFrame(list(proposals.items()), "stratum string, cuts array<array<int>>")).where("half = 1 and good > 0")
    fails = [F.count_if(F.exists(F.zip_with("bins", F.col("cuts")[k], lambda b, c: b > c), lambda x: x)).alias(f"l{k}") for k in range(len(LADDER))]
    out = {}
    for r in second.groupBy("stratum").agg(F.count("*").alias("n"), *fails).collect():
        level = control([r[f"l{k}"] for k in range(len(LADDER))], r.n, strata)
        if level >= 0:
            out[r.stratum] = proposals[r.stratum][level]
    return out


def verdict(cutoffs: dict[str | None, list[int]]):
    """True where a row of measured() passes: not base_failed, and no rule of its stratum rejects it."""
    if not cutoffs:
        return ~F.col("base_failed")
    name = lambda s: "" if s is None else "=" + s  # noqa: E731  (a map has no null keys)
    pairs = [x for s, cut in sorted(cutoffs.items(), key=lambda c: name(c[0])) for x in (F.lit(name(s)), F.array(*map(F.lit, cut)))]
    cut = F.try_element_at(F.create_map(*pairs), F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("")))
    over = F.exists(F.zip_with("bins", cut, lambda b, c: b > c), lambda x: x)
    return ~(F.col("base_failed") | F.coalesce(over, F.lit(False)))


def rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row a document.

    Null and empty texts have no words and fail the base rule.  Repeated rows
    come back as often as they are.  Without labels no rule is learnt and the
    base rule alone decides.
    """
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")] + ([F.col(lang_col).alias("lang")] if lang_col in docs.columns else [])
    rows = measured(docs.select(*cols)).select("row.doc_id", "stratum", *_COUNTS, "bins", "base_failed")
    rows = stored(rows, "rules-measured")
    cutoffs = learn(rows, labels.withColumnRenamed(id_col, "doc_id"))
    return rows.select("doc_id", *_COUNTS, "base_failed", verdict(cutoffs).alias("kept"))


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that rules() keeps, columns as they were."""
    rows = stored(measured(docs, text_col, lang_col), "rules-measured")  # each text is measured once
    cutoffs = learn(rows.select(F.col(f"row.{id_col}").alias(id_col), "stratum", "bins", "base_failed"), labels, id_col)
    return rows.where(verdict(cutoffs)).select("row.*")
