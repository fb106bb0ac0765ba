import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def brute_fp(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(x) for x in zip(w, w[1:], w[2:])] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {i: min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(ids))}


def test_gray_rank_orders_the_gray_code():
    codes = np.array([i ^ i >> 1 for i in range(64)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(64))


@pytest.mark.parametrize("n, spread", [(1, 64), (9, 64), (300, 64), (700, 9), (500, 12)])
def test_index_finds_every_pair_within_two_bits(n, spread):
    rng = random.Random(n * spread)
    fps = np.array(sorted({rng.getrandbits(spread) for _ in range(n)}), np.uint64)
    index = simhash.GrayIndex(fps)
    q, node = index.search(index.fps)
    want = {(i, j) for i, a in enumerate(index.fps.tolist()) for j, b in enumerate(index.fps.tolist()) if (a ^ b).bit_count() <= 2}
    assert set(zip(q.tolist(), node.tolist())) == want


def test_masks_cover_and_cut():
    masks = simhash._masks((1 << 64) - 1)
    assert masks[0] | masks[1] | masks[2] == (1 << 64) - 1 and not masks[0] & masks[1]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 6)  # so that shared patterns are refined here too
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(n)] for n in (5, 40, 40, 200, 200, 2_000)]
    rows, i = [], 0
    for b in base:
        for k in range(9):
            t = list(b)
            if k > 1:
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t), "x", "y"))
            i += 1
    rows += [(100, None, "x", "y"), (101, "", "x", "y"), (102, " \t\n", "x", "y"), (None, "one two", "x", "y"), (103, "One  two", "x", "y"), (103, "One  two", "x", "y"), (104, "a", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root string").repartition(3)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)
    fps = [brute_fp(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], fps)
    assert got == sorted(((r[0], f"{fps[k]:016x}", comp[k]) for k, r in enumerate(rows)), key=repr)
    kept = simhash.deduplicated(df).collect()
    want = {comp[k] for k in range(len(rows))}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(w for w in want if w is not None)
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "root"}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == got[299] == 299


def test_components_that_have_not_settled_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    with pytest.raises(RuntimeError, match="settled"):
        simhash.components(edges, rounds=1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == [] and simhash.deduplicated(df).collect() == []
