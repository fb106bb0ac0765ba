"""Vector code compression: product codes learnt on the distinct integer parts, each weighted by how often it occurs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_by_weight, stored, tidy

#: Integer components must lie below this, so that squared distances of up to 8,192 components fit a long.
LIMIT = 1 << 24
#: Rows of parts whose distances to all entries stand in memory at once.
ROWS = 4096


@dataclass(frozen=True)
class Codebooks:
    """entries[p] holds the entries of part p, one a row, as 64-bit integers. At most parts x entries rows, whatever the corpus."""

    entries: tuple[np.ndarray, ...]

    def nearest(self, pos: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, its squared distance) of each row; ties go to the lower index. Exact."""
        book = self.entries[pos]
        top = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
        code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for i in range(0, len(parts), ROWS):
            x = parts[i : i + ROWS]
            if 4 * top * top * max(book.shape[1], 1) < 1 << 53:  # products and sums are whole numbers that doubles hold exactly
                a, b = x.astype(float), book.astype(float)
                d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
            else:
                d = np.stack([((x - e) ** 2).sum(1) for e in book], 1)
            code[i : i + ROWS] = d.argmin(1)
            error[i : i + ROWS] = d.min(1)
        return code, error

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and place."""
        return hashlib.sha256(",".join(str(v) for book in self.entries for v in book.ravel().tolist()).encode()).hexdigest()


def integer_parts(vector: Column, parts: int, scale: int) -> Column:
    """The vector as `parts` arrays of floor(scale * x); null where the vector is null or holds a null or non-finite component."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    width = F.size(vector) / parts
    cut = F.array(*[F.slice(whole, (F.lit(p) * width + 1).cast("int"), width.cast("int")).cast("array<int>") for p in range(parts)])
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    uneven = F.raise_error(F.format_string(f"a vector of %s components does not make {parts} equal parts", F.size(vector)))
    large = F.raise_error(F.format_string(f"a component times {scale} exceeds {LIMIT} in a vector of %s components", F.size(vector)))
    return (
        F.when(vector.isNull() | odd, None)
        .when(F.size(vector) % parts != 0, uneven.cast("array<array<int>>"))
        .when(F.exists(whole, lambda x: F.abs(x) >= LIMIT), large.cast("array<array<int>>"))
        .otherwise(cut)
    )


def _blocks(batches, width: int):
    """(batch, position -> (row numbers, their parts as a matrix)) of each batch with columns pos and part."""
    for batch in batches:
        pos = batch.column("pos").to_numpy(zero_copy_only=False)
        flat = batch.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        parts = flat.reshape(len(pos), width)
        yield batch, {int(p): (at := np.flatnonzero(pos == p), parts[at]) for p in np.unique(pos)}


def _moved(distinct: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """One round of weighted Lloyd: every distinct part to its nearest entry, every used entry to the floored mean of its parts.

    A task sends one row for each entry it meets, so what is shuffled and
    collected is bounded by the codebooks.
    """

    def sums(batches):
        n = [np.zeros(len(b), np.int64) for b in books.entries]
        total = [np.zeros(b.shape, np.int64) for b in books.entries]
        for batch, blocks in _blocks(batches, width):
            weight = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            for p, (at, parts) in blocks.items():
                code, _ = books.nearest(p, parts)
                np.add.at(n[p], code, weight[at])
                np.add.at(total[p], code, parts * weight[at][:, None])
        rows = [(p, e) for p in range(len(n)) for e in np.flatnonzero(n[p])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in rows], pa.int32()),
                pa.array([int(e) for _, e in rows], pa.int32()),
                pa.array([int(n[p][e]) for p, e in rows], pa.int64()),
                pa.array([total[p][e].tolist() for p, e in rows], pa.list_(pa.int64())),
            ],
            names=["pos", "entry", "n", "total"],
        )
        tidy()

    partial = distinct.mapInArrow(sums, "pos int, entry int, n bigint, total array<bigint>")
    merged = partial.groupBy("pos", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    entries = [b.copy() for b in books.entries]
    for pos, entry, n, total in merged.collect():
        entries[pos][entry] = [t // n for t in total]
    return Codebooks(tuple(entries))


def _coded(distinct: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """(pos, part, n, code, error) of every distinct part."""

    def assign(batches):
        for batch, blocks in _blocks(batches, width):
            code, error = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for p, (at, parts) in blocks.items():
                code[at], error[at] = books.nearest(p, parts)
            yield pa.RecordBatch.from_arrays([*batch.select(["pos", "part", "n"]).columns, pa.array(code), pa.array(error)], names=["pos", "part", "n", "code", "error"])
        tidy()

    return distinct.select("pos", "part", "n").mapInArrow(assign, "pos int, part array<int>, n bigint, code bigint, error bigint")


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> DataFrame:
    """(id, code string, error long, label_error long, codebooks_sha256) of every vector that is whole.

    Components become floor(scale * x), vectors are cut into equal parts, and
    equal parts of a position are one row with a weight: Lloyd's rounds read
    those distinct rows alone.  Codebooks start as the parts of the rows with
    the `entries` smallest ids (rows without an id last; of rows that share an
    id, the smaller vector first).  Codes and errors of distinct parts are
    joined back to the vectors; a part that at least one row in 1,000 holds is
    joined by broadcast (at most 1,000 a position), so no key fills a task.

    A null vector, or one with a null, NaN or infinite component, gives no
    row.  Repeated rows give a row each, rows without an id or label too
    (labels that are null count as equal).  An empty vector has empty parts,
    at distance 0 of entry 0.  Vectors of other lengths than the rest, of a
    length that `parts` does not divide, or with a component of 2^24 or more
    after scaling are errors.  An empty table gives no rows.  Other columns
    are not read.
    """
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), integer_parts(F.col(vector), parts, scale).alias("parts")).where("parts IS NOT NULL")
    kept = stored(kept.withColumn("row", F.monotonically_increasing_id()), "vector-parts")
    total, least, most = kept.agg(F.count(F.lit(1)), F.min(F.size(F.col("parts")[0])), F.max(F.size(F.col("parts")[0]))).first()
    if least != most:
        raise ValueError(f"vectors of {parts * least} and of {parts * most} components stand in one table")
    width = least or 0
    first = kept.orderBy(F.col("id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
    books = Codebooks(tuple(np.array([r.parts[p] for r in first], np.int64).reshape(len(first), width) for p in range(parts)))
    each = kept.select("row", "id", "label", F.posexplode("parts").alias("pos", "part"))
    distinct = stored(each.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")), "vector-distinct")
    for _ in range(rounds if total else 0):
        books = _moved(distinct, books, width)
    coded = stored(_coded(distinct, books, width), "vector-codes")
    digits = max(2, len(f"{entries - 1:x}"))
    got = joined_by_weight(each, coded, ["pos", "part"], "n", total)
    own = got.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.first("label").alias("label"),
        F.concat(*[F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == p, F.col("code"))))), digits, "0") for p in range(parts)]).alias("code"),
        F.sum("error").alias("error"),
    )
    own = stored(own.drop("row"), "vector-errors")
    by_label = own.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return joined_by_weight(own, by_label, ["label"], "n", total).select(id_col, "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
