"""Vector codes against the same rounds over all vectors one by one."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes


def plain(rows, parts=4, entries=256, rounds=4):
    """(id, code, error, label_error, digest) of (id, vector, label) rows, without distinct parts, weights or numpy."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts if kept else 0
    cut = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in cut[p]:
                own.setdefault(nearest(p, x)[1], []).append(x)
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    found = [[nearest(p, cut[p][r]) for p in range(parts)] for r in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, y), e in zip(kept, errors):
        by_label[y] = by_label.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(kept[r][0], "".join(f"{k:02x}" for _, k in found[r]), errors[r], by_label[kept[r][2]], sha) for r in range(len(kept))]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def vectors(n, seed=3):
    x, out = seed, []
    for i in range(n):
        v = []
        for _ in range(8):
            x = (x * 1103515245 + 12345) % (1 << 31)
            v.append((x % 2000 - 1000) / 997)
        out.append((i, v, i % 3 if i % 7 else None))
    return out


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def as_floats(spark, rows):
    return [tuple(r) for r in spark.createDataFrame(rows, SCHEMA).collect()]


def test_equals_rounds_over_all_vectors(spark):
    copies = [(1000 + i, vectors(1)[0][1], 9) for i in range(150)]  # a third of the rows share every part
    odd = [(2000, None, 1), (2001, [0.1] * 7 + [None], 1), (2002, [0.1] * 7 + [float("nan")], 1), (2003, [float("inf")] + [0.0] * 7, 1), (None, [0.5] * 8, None), (5, [0.25] * 8, 2), (5, [0.25] * 8, 2), (2004, [-0.0005] * 8, 4)]
    rows = as_floats(spark, vectors(300) + copies + odd)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("code", F.lit("clash")).withColumn("row", F.lit(0)).withColumn("n", F.lit(1))
    for entries in (256, 10):
        got = vector_codes.compressed(df, entries=entries)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert rows_of(got) == sorted(plain(rows, entries=entries), key=repr)


def test_large_components_stay_exact(spark):
    rows = [(i, [(-1) ** i * (16000.0 + i / 4), i * 100.0, 0.0, 3.0], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert rows_of(vector_codes.compressed(df, parts=2, entries=7)) == sorted(plain(rows, 2, 7), key=repr)


def test_empty_table_and_empty_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compressed(empty).count() == 0
    sha = hashlib.sha256(b"").hexdigest()
    assert rows_of(vector_codes.compressed(spark.createDataFrame([(1, [], 0), (2, [], 0)], SCHEMA))) == [(1, "00000000", 0, 0, sha), (2, "00000000", 0, 0, sha)]


@pytest.mark.parametrize("rows", [[(1, [0.0] * 4, 0), (2, [0.0] * 8, 0)], [(1, [0.0] * 6, 0)], [(1, [1e30] * 8, 0)]])
def test_vectors_that_cannot_be_cut_alike_are_errors(spark, rows):
    with pytest.raises(Exception, match="components"):
        vector_codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()
