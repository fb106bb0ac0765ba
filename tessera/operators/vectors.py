"""Nearest neighbours: vectors dealt to cells by their nearest centre, searched in the cells nearest to a query, or in all of them for an exact answer."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import shared_dir

#: Vectors that centres are fitted on at most; every vector is indexed.
SAMPLE = 20_000
#: Vectors of a cell that one task compares with a query at most; larger cells are dealt in blocks.
BLOCK = 20_000
#: Components of a share of the queries at most: what a task holds beside one shard of vectors.
SHARE = 1 << 21


def distance_sql(a: str, b: str, metric: str) -> str:
    """The distance of two arrays as SQL text; null where their lengths differ or a component is null."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> CAST(p AS DOUBLE) * q), 0D, (n, v) -> n + v)"
    if metric == "euclidean":
        return f"sqrt(aggregate(zip_with({a}, {b}, (p, q) -> (CAST(p AS DOUBLE) - q) * (CAST(p AS DOUBLE) - q)), 0D, (n, v) -> n + v))"
    if metric == "dot":
        return f"-{dot(a, b)}"
    return f"1 - try_divide({dot(a, b)}, sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


def fitted(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centres of a bounded sample by Lloyd's rounds; the first centres are rows evenly spaced in it."""
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres, 1)[:, 0]
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, 2,048 rows at a time."""
    out = [np.zeros((0, k), int)]
    for a in range(0, len(x), 2048):
        d = (centres**2).sum(1) - 2 * (x[a : a + 2048] @ centres.T)
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k] if k > 1 else d.argmin(1)[:, None])
    return np.concatenate(out)


def _cells_of(column: str, centres: np.ndarray, k: int, unit: bool) -> Column:
    """The k nearest centres of a vector column."""

    def run(v: pa.Array) -> pa.Array:
        x = np.asarray(v.flatten(), float).reshape(len(v), -1) if len(v) else np.zeros((0, centres.shape[1]))
        return pa.array(_nearest(_unit(x) if unit else x, centres, k).tolist(), pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(F.col(column))


def _shards_of(column: str, centres: np.ndarray, k: int, unit: bool, shards: np.ndarray, blocks: np.ndarray) -> Column:
    """Of a vector's k nearest cells: the shards that hold them, each with those of its cells."""

    def run(v: pa.Array) -> pa.Array:
        x = np.asarray(v.flatten(), float).reshape(len(v), -1) if len(v) else np.zeros((0, centres.shape[1]))
        cell = _nearest(_unit(x) if unit else x, centres, k).ravel()
        row = np.repeat(np.arange(len(v)), k)
        many = blocks[cell]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)  # block of its cell
        cell, row = np.repeat(cell, many), np.repeat(row, many)
        shard = shards[cell] + nth
        order = np.lexsort((cell, shard, row))
        cell, row, shard = cell[order], row[order], shard[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])) if len(row) else np.zeros(0, int)
        cells = pa.ListArray.from_arrays(pa.array([*first, len(cell)], pa.int32()), pa.array(cell, pa.int32()))
        pairs = pa.StructArray.from_arrays([pa.array(shard[first], pa.int32()), cells], ["shard", "cells"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(len(v) + 1)), pa.int32()), pairs)

    return F.arrow_udf(run, "array<struct<shard: int, cells: array<int>>>")(F.col(column))


def _rank_of(column: str, cell: str, centres: np.ndarray, unit: bool) -> Column:
    """The place of a cell among all, nearest to a vector first, counted from 0."""

    def run(v: pa.Array, c: pa.Array) -> pa.Array:
        out = []
        for a in range(0, len(v), 1024):
            part, own = v.slice(a, 1024), np.asarray(c.slice(a, 1024))
            x = np.asarray(part.flatten(), float).reshape(len(part), -1)
            order = _nearest(_unit(x) if unit else x, centres, len(centres))
            out.append((order.reshape(len(part), -1) == own[:, None]).argmax(1))
        return pa.array(np.concatenate(out) if out else [], pa.int32())

    return F.arrow_udf(run, "int")(F.col(column), F.col(cell))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _rows(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as a matrix of doubles, whether each has that many components and none that is null); the length is the most frequent one."""
    flat = v.flatten()
    sizes = np.diff(np.asarray(v.offsets)) if len(v) else np.zeros(0, int)
    width = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    whole = sizes == width
    if flat.null_count:
        bad = np.add.accumulate(np.concatenate([[0], np.asarray(flat.is_null().cast(pa.int64()))]))
        ends = np.cumsum(sizes)
        whole &= bad[ends] == bad[ends - sizes]
    x = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")))
    out = np.full((len(v), width), np.nan)
    keep = sizes == width
    out[keep] = x[np.repeat(keep, sizes)].reshape(-1, width)
    return out, whole


def _sums(terms: np.ndarray) -> np.ndarray:
    """Sums of rows, one component after the other as distance_sql() adds them, so that equal vectors have equal distances to the last bit."""
    total = np.zeros(len(terms))
    for j in range(terms.shape[1]):
        total += terms[:, j]
    return total


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(what distance_sql() says of one vector and many, where it is null)."""
    with np.errstate(all="ignore"):
        if metric == "euclidean":
            return np.sqrt(_sums((q - x) ** 2)), np.zeros(len(x), bool)
        dot = _sums(q * x)
        if metric == "dot":
            return -dot, np.zeros(len(x), bool)
        sizes = np.sqrt(_sums(q[None] * q)) * np.sqrt(_sums(x * x))
        return 1 - dot / sizes, sizes == 0


def _bounds(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each pair that rises with its distance, by a product of matrices; how far rounding may put each query's numbers off)."""
    eps = 4 * (x.shape[1] + 8) * np.finfo(float).eps
    with np.errstate(all="ignore"):
        long_q, long_x = (q * q).sum(1), (x * x).sum(1)
        if metric == "euclidean":
            return long_q[:, None] + long_x - 2 * (q @ x.T), eps * (np.sqrt(long_q) + np.sqrt(long_x.max())) ** 2 + 1e-300
        if metric == "dot":
            return -(q @ x.T), eps * np.sqrt(long_q * long_x.max()) + 1e-300
        out = -((q / np.sqrt(long_q)[:, None]) @ (x / np.sqrt(long_x)[:, None]).T)
        out[:, long_x == 0] = np.inf  # their distance is null, behind all others
        tiny = (long_x < 1e-280) & (long_x > 0)  # their squares have few digits
        return out, np.where(tiny.any() | (long_q < 1e-280), np.inf, eps)


def _nearest_rows(q: np.ndarray, sound: bool, x: np.ndarray, at: np.ndarray, k: int, metric: str) -> list[tuple[int, float | None]]:
    """(row, distance) of the k nearest of the rows `at`, which are in the order of their keys: exact distances, NULL behind NaN behind all others, ties to the earlier row."""
    if sound:
        d, null = _distances(q, x[at], metric)
    else:
        d, null = np.zeros(len(at)), np.ones(len(at), bool)
    grade = np.where(null, 2, np.isnan(d))
    order = np.lexsort((at, np.where(grade > 0, 0.0, d), grade))[:k]
    return [(int(at[i]), None if null[i] else float(d[i])) for i in order]


def _met(metric: str, k: int):
    """Queries and rows of one shard: each query's k nearest among the rows whose cells it looks in (null: all).

    Products of matrices tell which rows may be among them, 256 queries at a
    time; those within rounding of the k-th are compared exactly.
    """

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key").combine_chunks()
        asked = asked.combine_chunks()
        kind = rows.schema.field("key").type
        found: list[tuple[int, int, float | None]] = []
        if len(asked) and len(rows):
            one = lambda t, c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
            x, _ = _rows(one(rows, "vector"))
            cells = np.asarray(one(rows, "cell"))
            column = one(asked, "q")
            q, sound = _rows(column)
            if q.shape[1] != x.shape[1]:  # most queries are of another length; those that fit are taken by themselves
                sizes = np.diff(np.asarray(column.offsets))
                fit = np.flatnonzero(sizes == x.shape[1])
                q, whole = np.full((len(asked), x.shape[1]), np.nan), np.zeros(len(asked), bool)
                if len(fit):
                    q[fit], whole[fit] = _rows(column.take(pa.array(fit)))
                sound = whole
            looked = one(asked, "cells")
            every = looked.null_count == len(looked)
            sets = None if every else [set(c) for c in looked.to_pylist()]
            turn = np.arange(len(asked)) if every else np.array(sorted(range(len(asked)), key=lambda i: sorted(sets[i])))
            for a in range(0, len(turn), 256):
                part = turn[a : a + 256]
                if every:
                    at, allowed = np.arange(len(x)), None
                else:
                    at = np.flatnonzero(np.isin(cells, list(set().union(*[sets[i] for i in part]))))
                    here, place = np.unique(cells[at], return_inverse=True)
                    allowed = np.array([[c in sets[i] for c in here.tolist()] for i in part], bool).reshape(len(part), -1)[:, place]
                if not len(at):
                    continue
                d, off = _bounds(q[part], x[at], metric)
                firm = sound[part] & np.isfinite(np.where(d == np.inf, 0, d)).all(axis=1) & np.isfinite(off)
                if metric != "cosine":
                    firm &= np.isfinite(d).all(axis=1)
                if allowed is not None:
                    d[~allowed] = np.inf
                many = min(k, len(at))
                last = np.partition(d, many - 1, axis=1)[:, many - 1]
                for j, i in enumerate(part):
                    if firm[j]:
                        near = d[j] <= last[j] + 2 * off[j]
                        if allowed is not None:
                            near &= allowed[j]
                    else:
                        near = np.ones(len(at), bool) if allowed is None else allowed[j]
                    found += [(int(i), n, v) for n, v in _nearest_rows(q[i], bool(sound[i]), x, at[near], k, metric)]
        i, n, v = zip(*found) if found else ((), (), ())
        take = lambda t, c, at: t.column(c).take(pa.array(at, pa.int64())) if len(at) else pa.array([], t.schema.field(c).type)
        return pa.table({"query": take(asked, "query", i), "neighbour": take(rows, "key", n).cast(kind) if len(n) else pa.array([], kind), "distance": pa.array(v, pa.float64())})

    return run


@dataclass(frozen=True)
class VectorIndex:
    """Rows (key, vector, cell, block), sorted by cell; centres and sizes of cells are the bounded rest."""

    key: str
    metric: str
    path: str
    centres: np.ndarray
    blocks: tuple[int, ...]  # of each cell
    shards: tuple[int, ...]  # of each cell, that of its first block

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
        """(query, neighbour, distance, place) of the k nearest vectors of each query; ties go to the smaller key. probes: cells to look in, all where it is None (exact).

        Cells are dealt to shards of some 20,000 vectors, a block of a large
        cell is one by itself, and queries to shares of at most 16 MB.  A
        query goes once to each shard that holds a cell it looks in, a row
        once to each share, and a task holds one shard and one share; a query
        keeps k candidates of each before they move on.
        """
        spark = queries.sparkSession
        rows = spark.read.parquet(self.path)
        asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("q"))
        many = min(probes or len(self.centres), len(self.centres))
        shares = max(1, -(-asked.count() // max(1, SHARE // max(1, self.centres.shape[1]))))
        last = max(s + b for s, b in zip(self.shards, self.blocks))
        asked = asked.withColumn("share", F.pmod(F.xxhash64("query"), F.lit(shares)).cast("int"))
        if many < len(self.centres):
            dealt = _shards_of("q", self.centres, many, self.metric == "cosine", np.array(self.shards), np.array(self.blocks))
            asked = asked.select("query", "q", "share", F.inline(dealt))
        else:
            asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last - 1)))).withColumn("cells", F.lit(None).cast("array<int>"))
        rows = rows.withColumn("shard", F.get(F.array(*[F.lit(n) for n in self.shards]), F.col("cell")) + F.col("block")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        kinds = [f"`query` {asked.schema['query'].dataType.simpleString()}", f"neighbour {rows.schema['key'].dataType.simpleString()}", "distance double"]
        pairs = asked.select("shard", "share", "query", "q", "cells").groupBy("shard", "share").cogroup(rows.select("shard", "share", "key", "vector", "cell").groupBy("shard", "share"))
        met = pairs.applyInArrow(_met(self.metric, k), ", ".join(kinds))
        near = W.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "neighbour")
        return met.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)

    def recalls(self, queries: DataFrame, key: str, vector: str, k: int, true: DataFrame | None = None) -> list[float]:
        """The share of true neighbours found with 1, 2, ... cells: from the rank, among a query's cells, of the cell that each true neighbour lies in. A count for each rank reaches the driver. true: what an exact search of the queries gave, where there is one."""
        spark = queries.sparkSession
        homes = spark.read.parquet(self.path).select(F.col("key").alias("neighbour"), "cell")
        true = self.search(queries, key, vector, k) if true is None else true
        asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("q"))
        placed = true.select("query", "neighbour").join(homes, "neighbour").join(asked, "query")
        counts = dict(placed.groupBy(_rank_of("q", "cell", self.centres, self.metric == "cosine").alias("rank")).count().collect())
        found = np.cumsum([counts.get(r, 0) for r in range(len(self.centres))])
        return [float(f / found[-1]) if found[-1] else 1.0 for f in found]

    def probes_for(self, queries: DataFrame, key: str, vector: str, k: int, target: float = 0.9, true: DataFrame | None = None) -> int:
        """The fewest cells whose search reaches a recall, measured on queries against brute force."""
        return 1 + next(i for i, r in enumerate(self.recalls(queries, key, vector, k, true)) if r >= target)


def build(df: DataFrame, key: str, vector: str, metric: str = "cosine", cells: int | None = None, path: str | None = None) -> VectorIndex:
    """Indexes every row with a key and a vector whose components are finite; others are in no search.

    Centres are fitted on at most 20,000 vectors (those whose key's hash falls
    lowest); by default there are as many as the square root of the number of
    rows, 4,096 at most.  Lengths that differ are an error.
    """
    spark: SparkSession = df.sparkSession
    path = path or os.path.join(shared_dir(spark), f"vectors-{uuid.uuid4().hex}")
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & whole & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    total, low, high = rows.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} components stand in one table")
    deal = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    sample = rows.where(deal < (1 << 40) * min(1.0, SAMPLE / max(total, 1))).orderBy(deal, "key").limit(SAMPLE + SAMPLE // 10).select("vector").collect()
    x = np.array([r[0] for r in sample], float) if sample else np.zeros((1, low or 1))
    unit = metric == "cosine"
    centres = fitted(_unit(x) if unit else x, cells or min(4096, max(1, round(total**0.5))))
    dealt = rows.withColumn("cell", F.get(_cells_of("vector", centres, 1, unit), F.lit(0)))
    counts = {c: n for c, n in dealt.groupBy("cell").count().collect()}  # a row a cell
    blocks = tuple(max(1, -(-counts.get(c, 0) // BLOCK)) for c in range(len(centres)))
    shards, free, held = [], 0, 0  # free: the next shard's number; held: vectors in the one that is filled
    for c, b in enumerate(blocks):
        n = counts.get(c, 0)
        if b > 1 or held + n > BLOCK or not c:
            shards.append(free)
            free, held = free + b, BLOCK if b > 1 else n
        else:
            shards.append(free - 1)
            held += n
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.get(F.array(*[F.lit(b) for b in blocks]), F.col("cell"))).cast("int"))
    dealt.repartitionByRange("cell", "block", "key").sortWithinPartitions("cell", "block", "key").write.parquet(path)
    return VectorIndex(key, metric, path, centres, blocks, tuple(shards))
