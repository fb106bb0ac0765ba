"""Packs of an index's postings: their limits, odd documents, and that they move once."""

from tessera.operators import fulltext


def test_postings_are_packed_and_move_once(spark, monkeypatch):
    texts = {0: "b a b", 1: None, 2: "", 3: "é b " * 40, 4: "a"} | {k: f"w{k % 3} b w{k % 3}" for k in range(5, 60)}
    df = spark.createDataFrame(list(texts.items()), "id int, body string").coalesce(1)
    index = fulltext.build(df, "id", ["body"])
    want = {}
    for k, t in texts.items():
        for at, w in enumerate((t or "").split()):
            want.setdefault((w, k), []).append(at)
    assert {(r.word, r.key): r.positions for r in index.postings(spark).collect()} == want
    stored = spark.read.parquet(index.path)
    assert stored.count() == stored.select("word").distinct().count() < len(want)


def test_packs_keep_to_their_limits(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fulltext, "PACK", 4)
    monkeypatch.setattr(fulltext, "PACK_WORDS", 6)
    rows = [(k, ["x"] * n) for k, n in enumerate([1, 0, 2, 9, 3, 3, 1, 0, 0, 0, 0, 0, 7])]
    table = pa.table({"key": [k for k, _ in rows], "words": pa.array([w for _, w in rows], pa.list_(pa.string()))})
    for size in (1, 3, 5, 13):
        packs = [p.column("words").to_pylist() for p in fulltext._packs(table.to_batches(max_chunksize=size))]
        assert [w for p in packs for w in p] == [w for _, w in rows]
        assert all(len(p) <= 4 and (len(p) == 1 or sum(map(len, p)) <= 6) for p in packs)
        out = list(fulltext._packed(table.to_batches(max_chunksize=size)))
        assert sum(len(k) for b in out for k in b.column("keys").to_pylist()) == sum(n > 0 for n in map(len, dict(rows).values()))
