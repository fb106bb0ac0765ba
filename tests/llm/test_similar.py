import random

import numpy as np
import pytest

from tessera.llm import simhash


def brute_sets(text):
    w = (text or "").lower().split()
    return {tuple(t) for t in zip(*(w[k:] for k in range(5)))} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_kept(rows):
    """Places of the rows that stay, by comparing all pairs."""
    sets, root = [brute_sets(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g in groups.values()]


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n in (6, 30, 60, 60, 200, 200, 1_500):
        base = [rng.choice(words) for _ in range(n)]
        for k in range(8):
            t = list(base)
            for _ in range(k * n // 150):  # from the same words to far below 0.8
                t[rng.randrange(n)] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(200, None), (201, ""), (None, "one two"), (202, "One  two"), (203, "a"), (None, "no id here"), (None, "no id here")]
    return rows


def test_groups_equal_brute_force_at_a_similarity_of_four_fifths(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, at long").repartition(3)
    got = simhash.without_similar(df)
    assert got.columns == ["doc_id", "text", "at"]
    want = [(rows[i][0], " ".join(sorted(brute_sets(rows[i][1]))[0]) if brute_sets(rows[i][1]) else "") for i in brute_kept(rows)]
    kept = [(r.doc_id, " ".join(sorted(brute_sets(r.text))[0]) if brute_sets(r.text) else "") for r in got.collect()]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_an_id_on_two_texts_loses_neither(spark):
    one, two = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, " ".join(one)), (5, " ".join(one)), (5, " ".join(two)), (6, " ".join(two))]
    got = simhash.without_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_pipeline_stage_drops_an_edited_copy(spark):
    import corpus_pipeline as pipeline

    base = [f"word{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:40] + ["x"] + base[41:120] + ["y"] + base[121:])), (3, " ".join(reversed(base)))]
    got = dict(pipeline.STAGES)["SimHash near-duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 1_000, np.uint64))
    a, b = h[:900], h[100:]
    same = (simhash.minima(a) == simhash.minima(b)).mean()
    assert abs(same - simhash.similarity(a, b)) < 0.15 and simhash.similarity(a, b) == 0.8


def test_empty_table(spark):
    assert simhash.without_similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("small", [False, True])
def test_large_clusters_and_bands_lose_no_link(spark, monkeypatch, small):
    """A chain of edits whose ends are far apart: small blocks and bands deal it over many tasks."""
    if small:
        for name, value in (("BLOCK", 4), ("LEADS", 2), ("BAND_ROWS", 6)):
            monkeypatch.setattr(simhash, name, value)
    rng = random.Random(8)
    rows = []
    for n, step in ((120, 4), (120, 9), (90, 2)):
        t = [f"v{rng.randrange(300)}" for _ in range(n)]
        for _ in range(14):
            rows.append((len(rows), " ".join(t)))
            for _ in range(step):
                t[rng.randrange(n)] = f"v{rng.randrange(300)}"
    got = simhash.without_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == sorted(rows[i][0] for i in brute_kept(rows))


def test_segments_are_searched_apart():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 12, (300, 2), np.uint64)
    seg = rng.integers(0, 7, 300)
    a, b = simhash.local_links(fps, seg, 6, pairs=500)
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(300):
        for j in range(i):
            if seg[i] == seg[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= 6:
                root[find(i)] = find(j)
    groups, stars = {}, {}
    for i in range(300):
        groups.setdefault(find(i), set()).add(i)
    for x, y in zip(a.tolist(), b.tolist()):
        stars.setdefault(y, {y}).add(x)
    assert sorted(map(sorted, stars.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
