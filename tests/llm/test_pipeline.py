"""The pipeline against plain recomputations, on the driver's smallest tables and on rows made to be awkward."""

import hashlib
import os
import random
import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def brute_groups(rows):
    """Places of the rows that stay: one of each group linked by 5-word shingles at a similarity of 0.8, the smallest id first, rows without one last."""
    sets, root = [], list(range(len(rows)))
    for r in rows:
        w = (r.text or "").lower().split()
        sets.append({tuple(t) for t in zip(*(w[k:] for k in range(5)))} if len(w) >= 5 else {tuple(w)} if w else set())

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [min(g, key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0)) for g in groups.values()]


def check_stages(spark, docs, labels, sf):
    import corpus_pipeline as pipeline
    from tessera.llm import mixing, quality_rules, toxicity
    from tessera.llm.common import stored
    from tessera.llm.queries import byte_bpe

    key = lambda r: (r.doc_id, r.text)
    stages = [f for _, f in pipeline.STAGES]
    rows = docs.collect()
    one = stored(stages[0](spark, docs, sf), "t")
    verdicts = Counter((r.doc_id, r.kept) for r in quality_rules.rules(docs, labels).collect())
    kept = one.collect()
    assert one.columns == docs.columns and Counter(r.doc_id for r in kept) == Counter({i: n for (i, k), n in verdicts.items() if k})
    assert not Counter(map(key, kept)) - Counter(map(key, rows))
    two = stored(stages[1](spark, one, sf), "t")
    clean = two.collect()
    toxic = Counter((r.doc_id, r.toxic) for r in toxicity.toxicity(one, labels).collect())
    assert two.columns == docs.columns and Counter(r.doc_id for r in clean) == Counter({i: n for (i, t), n in toxic.items() if not t})
    three = stored(stages[2](spark, two, sf), "t")
    single = three.collect()
    assert three.columns == docs.columns and sorted((r.doc_id for r in single), key=repr) == sorted((clean[i].doc_id for i in brute_groups(clean)), key=repr)
    four = stored(stages[3](spark, three, sf), "t")
    mixed = four.collect()
    words = Counter()
    for r in mixed:
        words[r.source] += len(r.text.encode().split())
    target = {}
    by_id = {r.doc_id: r.source for r in single}
    longest = max((len((r.text or "").encode().split()) for r in single), default=0)
    for r in mixing.mixed(three).collect():
        target[by_id[r.doc_id]] = r.target
    assert four.columns == docs.columns and all(abs(words[s] - t) <= longest / 2 + 1 for s, t in target.items())
    five = stages[4](spark, four, sf).collect()
    import tiktoken

    b = byte_bpe()
    enc = tiktoken.Encoding("own", pat_str=b.pattern, mergeable_ranks=b.ranks, special_tokens={})
    want = Counter()
    for r in mixed:
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, five)) == want
    return five


@here
def test_stages_follow_each_other(spark):
    import corpus_pipeline as pipeline
    from tessera.llm.common import table

    pytest.importorskip("tiktoken")
    five = check_stages(spark, table(spark, SF, "documents"), table(spark, SF, "labels"), SF)
    assert Counter(map(tuple, pipeline.run(spark, SF).collect())) == Counter(map(tuple, five))


def awkward(n=150, seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(52, 160))]
        if i % 11 == 0:
            t += ["grumpwort", "snarlfen"] * 3
        rows.append((i, " ".join(t), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 1))
    long = " ".join(rng.choice(words) for _ in range(4_000))
    rows += [(200, None, "en", "a", 1), (201, "", None, None, None), (202, " \n\t", "", "b", 2), (None, rows[3][1] + " tail", "en", "a", 3), (None, " ".join(words[:80]), None, "c", 3)]  # nulls, empties
    rows += [(203, rows[5][1], "en", "b", 9), (5, rows[5][1], rows[5][2], rows[5][3], 1), (204, long, "de", "c", 0), (205, "x" * 3_000 + " " + " ".join(words[100:190]), "en", "a", 0)]  # copies, a repeated row, long texts
    rows += [(7, " ".join(reversed(words[:100])), "en", "a", 4)]  # an id on another text
    return rows


@pytest.fixture
def awkward_tables(spark, tmp_path):
    docs = spark.createDataFrame(awkward(), "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' AS row", "1.5D AS size", "'y' AS bins", "true AS toxic", "'k' AS key")  # columns that the operators use by the same names
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 11 == 0)) for i in range(0, 150)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_awkward_rows_go_through(spark, awkward_tables):
    from tessera.llm.common import table

    pytest.importorskip("public_tokenizers")
    five = check_stages(spark, table(spark, awkward_tables, "documents"), table(spark, awkward_tables, "labels"), awkward_tables)
    assert five


def test_empty_tables_go_through(spark, tmp_path):
    import corpus_pipeline as pipeline

    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


@here
def test_entry_registers_everything():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))] == list(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
