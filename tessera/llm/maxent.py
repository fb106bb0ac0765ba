"""A hashed maximum-entropy language model with a class-factored softmax.

A token is hashed to one of CLASSES * MEMBERS slots.  Its probability is
P(class | history) P(slot | class, history) P(token | slot).  The history is
the token before (n-gram features) and the one before that (a skip feature),
hashed to buckets; the class softmax adds up weights of each bucket and of a
hash of the pair, the softmax within the class those of the previous bucket.
P(token | slot) is the token's smoothed share of its slot.

One pass over the training texts counts tokens and, for each pair of history
buckets, classes and slots.  The likelihood and its gradient are functions of
these counts alone, so gradient updates run over a table whose size the
hashes fix, dealt over the executors, and never over the texts again.

Token counts grow with the corpus.  The most frequent HOT_WORDS are sent to
the scoring tasks; all other tokens of a document meet their counts in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, in_fold, map_arrow, stored, texts, tidy

#: A text ends with this token; no word can equal it.
END = b"\n"
FOLDS = 10


class Size(NamedTuple):
    """The model's size, which the counts of history buckets and the weights sent to the tasks have too; README gives what it buys."""

    classes: int = 32
    members: int = 32
    #: Buckets of the previous token, of the one before it, and of their pairs.
    near: int = 256
    skip: int = 64
    pair: int = 4_096

    @property
    def slots(self) -> int:
        return self.classes * self.members


#: Words of the corpus for each bucket of the previous token, about, and the bounds of their number: at 1,024 a task counts in 7 MB and a round sends
#: the tasks 7 MB of weights.
WORDS_A_BUCKET, LEAST_NEAR, MOST_NEAR = 1_500, 64, 1_024


def size_for(docs: DataFrame, text_col: str = "text") -> Size:
    """The size that a corpus can fill: buckets of histories in proportion to its words (six bytes each, about), up to what a task can hold."""
    held = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    near = 1 << round(math.log2(max(1, held / 6 / WORDS_A_BUCKET)))
    near = min(MOST_NEAR, max(LEAST_NEAR, near))
    return Size(32, 32, near, 16, min(16 * near, 16_384))


SIZE = Size()
CLASSES, MEMBERS, NEAR, SKIP, PAIR = SIZE
SLOTS = SIZE.slots
ROUNDS, PRIOR = 12, 2.0
SMOOTH = 0.1
#: Words sent to the scoring tasks at most; longer ones than LONG_WORD bytes never are.
HOT_WORDS, LONG_WORD = 200_000, 64
#: Distinct words that a task holds before it passes their counts on.
FLUSH = 300_000
_CHUNK = 200_000


def tokens(text: bytes) -> list[bytes]:
    """Lower-case (A-Z) words, then END."""
    out = text.lower().split()
    out.append(END)
    return out


def _codes(docs: list[list[bytes]], size: Size) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot, near bucket, skip bucket, tokens per text) of the tokens of several texts; before a text stand two zeros."""
    crc, at = zlib.crc32, []
    lengths = np.array([len(d) for d in docs])
    for d in docs:
        at += (0, 0)
        at.extend(map(crc, d))
    h = np.array(at, np.int64)
    first = np.repeat(np.cumsum(lengths + 2) - lengths, lengths)
    place = first + np.arange(len(first)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return h[place] % size.slots, (h[place - 1] >> 10) % size.near, (h[place - 2] >> 18) % size.skip, lengths


def _pair(near, skip, size: Size):
    return (near * 40_503 + skip * 9_973) % size.pair


def _packed(counts: np.ndarray) -> bytes:
    """Counts, most of which are 0, as bytes: their places and themselves, as small as they are."""
    at = np.flatnonzero(counts)
    own = counts[at] if counts.ndim == 1 else counts.reshape(-1)[at]
    kind = np.uint8 if own.max(initial=0) < 1 << 8 else np.uint16 if own.max(initial=0) < 1 << 16 else np.int64
    head = np.array([counts.size, len(at), np.dtype(kind).itemsize], np.int64)
    return zlib.compress(head.tobytes() + np.diff(at, prepend=0).astype(np.int32).tobytes() + own.astype(kind).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = zlib.decompress(blob)
    size, n, width = np.frombuffer(raw, np.int64, 3)
    out = np.zeros(size, np.int64)
    kind = {1: np.uint8, 2: np.uint16, 8: np.int64}[int(width)]
    out[np.cumsum(np.frombuffer(raw, np.int32, n, 24))] = np.frombuffer(raw, kind, n, 24 + 4 * int(n))
    return out


def gathered(docs: DataFrame, size: Size = SIZE) -> tuple[DataFrame, DataFrame]:
    """(words: word, n), (counts: near, classes, slots) of the training texts in a column `text`.

    `classes` holds counts for each skip bucket and class, `slots` for each slot.
    """

    def fn(batches):
        words: Counter[bytes] = Counter()
        classes, slots = np.zeros((size.near, size.skip, size.classes), np.int32), np.zeros((size.near, size.slots), np.int32)
        some = False

        def out():
            n = len(words)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(list(words.keys()), pa.binary()), pa.array(list(words.values()), pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], ["near", "word", "n", "classes", "slots"])

        def count(docs):
            slot, near, skip, _ = _codes(docs, size)
            np.add.at(classes.reshape(-1), (near * size.skip + skip) * size.classes + slot // size.members, 1)
            np.add.at(slots.reshape(-1), near * size.slots + slot, 1)

        for whole in batches:
            some = some or whole.num_rows > 0
            for i in range(0, whole.num_rows, ROWS):
                held, n = [], 0
                for t in texts(whole.slice(i, ROWS)):
                    held.append(tokens(t))
                    words.update(held[-1])
                    n += len(held[-1])
                    if n >= _CHUNK:
                        count(held)
                        held, n = [], 0
                if held:
                    count(held)
                if len(words) >= FLUSH:
                    yield out()
                    words.clear()
        if some:
            yield out()
            words.clear()
            blobs = [[_packed(x[k]) for k in range(size.near)] for x in (classes, slots)]
            yield pa.RecordBatch.from_arrays([pa.array(range(size.near), pa.int32()), pa.nulls(size.near, pa.binary()), pa.nulls(size.near, pa.int64()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], ["near", "word", "n", "classes", "slots"])
        tidy()

    rows = stored(docs.select("text").mapInArrow(fn, "near int, word binary, n long, classes binary, slots binary"), "maxent-gathered")
    words = stored(rows.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "maxent-words")

    def add(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for near, c, s in zip(*(b.column(k).to_pylist() for k in ("near", "classes", "slots"))):
                c, s = _unpacked(c), _unpacked(s)
                sums[near] = [sums[near][0] + c, sums[near][1] + s] if near in sums else [c, s]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([_packed(x[0]) for x in sums.values()], pa.binary()), pa.array([_packed(x[1]) for x in sums.values()], pa.binary())], ["near", "classes", "slots"])

    # Each task over the texts gives one row a near bucket, so sums are taken in two steps: over groups of those tasks, then over groups.
    parts = rows.where("word is null").select("near", "classes", "slots").withColumn("of", F.spark_partition_id())
    groups = max(1, math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kinds = "near int, classes binary, slots binary"
    first = parts.repartition(min(size.near, 32) * groups, "near", F.col("of") % groups).select("near", "classes", "slots").mapInArrow(add, kinds)
    counts = stored(first.repartition(min(size.near, 32), "near").mapInArrow(add, kinds), "maxent-counts")
    return words, counts


def _softmax_log(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


class Weights:
    """The model's weights, as many as its size says."""

    def __init__(self, size: Size = SIZE):
        self.size = size
        self.bias = np.zeros(size.classes)
        self.near, self.skip, self.pair = np.zeros((size.near, size.classes)), np.zeros((size.skip, size.classes)), np.zeros((size.pair, size.classes))
        self.member, self.near_member = np.zeros(size.slots), np.zeros((size.near, size.slots))

    def class_log(self, near: int) -> np.ndarray:
        """log P(class | history) for each skip bucket."""
        return _softmax_log(self.bias + self.near[near] + self.skip + self.pair[_pair(near, np.arange(self.size.skip), self.size)])

    def member_log(self, near: int) -> np.ndarray:
        """log P(slot | class, history) for each slot."""
        return _softmax_log((self.member + self.near_member[near]).reshape(self.size.classes, self.size.members)).reshape(-1)


def _moments(w: Weights, near: int, classes: np.ndarray, slots: np.ndarray):
    """Expected counts under the model for one near bucket, like `classes` and `slots`."""
    shape = w.size.classes, w.size.members
    expect = np.exp(w.class_log(near)) * classes.sum(1, keepdims=True)
    inside = slots.reshape(shape).sum(1, keepdims=True)
    return expect, (np.exp(w.member_log(near)).reshape(shape) * inside).reshape(-1)


def trained(counts: DataFrame, rounds: int = ROUNDS, size: Size = SIZE) -> Weights:
    """Gradient updates on the log-likelihood: tasks add up the counts of each feature that the model expects, the driver
    takes scaled steps toward those seen.

    A round sends the driver each near bucket's own features once and the shared ones once a task: 3 MB for 4 tasks at
    256 buckets, 13 MB at the most that size_for() gives.
    """
    w = Weights(size)
    shared, own = ("bias", "skip", "pair", "member"), ("near", "near_member")
    counts, sc = counts.coalesce(4), counts.sparkSession.sparkContext

    def job(w, expected):
        """Sums of each feature over the counts seen, or over those expected under w. The weights go out in single precision, and their files go when the round ends."""
        sent = sc.broadcast({k: getattr(w, k).astype(np.float32) for k in (*shared, *own)}) if expected else None

        def fn(batches):
            sums, rows = Weights(size), []
            if expected:
                w = Weights(size)
                for k, v in sent.value.items():
                    setattr(w, k, v.astype(float))
            for b in batches:
                for near, c, s in zip(*(b.column(k).to_pylist() for k in ("near", "classes", "slots"))):
                    c, s = _unpacked(c).reshape(size.skip, size.classes), _unpacked(s)
                    if expected:
                        c, s = _moments(w, near, c, s)
                    sums.bias += c.sum(0)
                    sums.skip += c
                    np.add.at(sums.pair, _pair(near, np.arange(size.skip), size), c)
                    sums.member += s
                    rows += [("near", near, c.sum(0)), ("near_member", near, s)]
            if rows:
                rows += [(k, -1, getattr(sums, k)) for k in shared]
                name, at, value = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(at, pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in value], pa.binary())], ["field", "at", "value"])

        out = {k: np.zeros(getattr(w, k).shape) for k in (*shared, *own)}
        got = counts.mapInArrow(fn, "field string, at int, value binary").toArrow().to_pydict()
        for k, at, blob in sorted(zip(got["field"], got["at"], got["value"])):  # sorted: reruns agree
            into = out[k] if at < 0 else out[k][at]
            into += np.frombuffer(blob, np.float32).reshape(into.shape)
        if sent is not None:
            sent.destroy(blocking=True)
        return out

    seen = job(w, False)
    w.bias = np.log(seen["bias"] + 1.0)
    w.member = np.log(seen["member"] + 1.0)
    active = {"bias": 4, "near": 4, "skip": 4, "pair": 4, "member": 2, "near_member": 2}
    for _ in range(rounds):
        for k, want in job(w, True).items():
            step = (seen[k] - want) / (active[k] * (want + PRIOR))
            setattr(w, k, getattr(w, k) + np.clip(step, -1.0, 1.0))
    return w


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: Size = SIZE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a document.

    Learns from documents outside fold 0 of FOLDS by crc32 of the id; a row
    without an id is learnt from.  A null or empty text is END alone.  Scores
    are base-10 logarithms.  Repeated rows come back as often as they are, and
    count as often.  An empty table gives an empty one.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), in_fold(id_col, FOLDS).alias("held_out"))
    words, counts = gathered(own.where("not held_out"), size)
    weights = trained(counts, size=size)
    slot_of = F.pmod(F.crc32("word"), F.lit(size.slots)).cast("int")
    per_slot = words.groupBy(slot_of.alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # a row a slot at most
    total, distinct = sum(r.n for r in per_slot), sum(r.v for r in per_slot)
    below = np.full(size.slots, SMOOTH)
    for r in per_slot:
        below[r.slot] = r.n + SMOOTH * (r.v + 1)
    base_below = float(np.log10(total + SMOOTH * (distinct + 1)))

    bins = words.where(F.length("word") <= LONG_WORD).groupBy(F.floor(F.log2("n") * 4).alias("bin")).count().orderBy(F.desc("bin")).collect()
    least, room = None, HOT_WORDS
    for r in bins:
        if r["count"] > room:
            break
        least, room = r.bin, room - r["count"]
    hot = words.where(F.length("word") <= LONG_WORD).where(F.floor(F.log2("n") * 4) >= (least if least is not None else 1 << 40)).toArrow()  # HOT_WORDS rows at most
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(dict(zip(hot.column("word").to_pylist(), np.log10(hot.column("n").to_numpy() + SMOOTH).tolist())))
    class_log = np.array([weights.class_log(k) for k in range(size.near)], np.float32) / np.float32(np.log(10))
    member_log = (np.array([weights.member_log(k) for k in range(size.near)]) / np.log(10) - np.log10(below)).astype(np.float32)
    model = spark.sparkContext.broadcast((class_log, member_log))

    def fn(batch):
        get = known.value.get
        class_log, member_log = model.value
        n_tokens, n_hot, logs, fixed = [], [], [], []
        rare_words: list[bytes] = []
        rare_n: list[int] = []
        ends = [0]

        def score(held):
            slot, near, skip, lengths = _codes(held, size)
            each = class_log[near, skip, slot // size.members].astype(float) + member_log[near, slot]
            fixed.extend(np.add.reduceat(each, np.cumsum(lengths) - lengths).tolist())

        held, waiting = [], 0
        for t in texts(batch):
            toks = tokens(t)
            held.append(toks)
            waiting += len(toks)
            total, hot = 0.0, 0
            for w, n in Counter(toks).items():
                v = get(w)
                if v is None:
                    rare_words.append(w)
                    rare_n.append(n)
                else:
                    total += v * n
                    hot += n
            ends.append(len(rare_n))
            n_tokens.append(len(toks))
            n_hot.append(hot)
            logs.append(total)
            if waiting >= _CHUNK:
                score(held)
                held, waiting = [], 0
        if held:
            score(held)
        rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_n, pa.int64())], names=["word", "n"]))
        cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_hot, pa.int64()), pa.array(logs, pa.float64()), pa.array(fixed, pa.float64()), rare]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_hot", "logs", "fixed", "rare"])

    kind = own.schema["doc_id"].dataType.simpleString()
    part = map_arrow(own, fn, f"doc_id {kind}, held_out boolean, n_tokens long, n_hot long, logs double, fixed double, rare array<struct<word:binary,n:long>>")
    part = stored(part.withColumn("row", F.monotonically_increasing_id()), "maxent-partial")  # row numbers are fixed by the write
    rare = part.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    own_n = words.select(F.col("word").alias("w"), F.col("n").alias("c"))
    met = rare.join(own_n, rare.word == own_n.w, "left")
    sums = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("also"))
    sums = sums.withColumnRenamed("row", "of")
    got = part.drop("rare").join(sums, part.row == sums.of, "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return got.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * base_below).alias("base_score"),
        (F.col("fixed") + logs).alias("score"),
    )
