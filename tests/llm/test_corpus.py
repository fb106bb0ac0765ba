import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import maxent, merkle, mixing, warc


def texts(n=120, seed=4):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["The", "cat", "sat", "on", "a", "mat", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(1, 80))) + rng.choice(["", "\nnew line here", "\n\n"]), f"s{rng.randrange(5)}") for i in range(n)]


EDGE = [(900, None, "s1"), (901, "", None), (902, " \n", "s9"), (None, "the cat", "s1"), (903, "dup dup", "s2"), (903, "dup dup", "s2"), (904, "long " * 30_000, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = texts() + EDGE
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, row int").repartition(3)


def test_language_model(docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(maxent, "HOT_WORDS", 20)  # so that counts come by both ways
    tok = [((t or "").encode().lower().split() + [b"\n"]) for _, t, _ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    c = Counter(w for ws, h in zip(tok, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for r, ws, h in zip(rows, tok, held)), key=repr)
    got = maxent.language_model_scores(df).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and all(r.score < 0 for r in got)
    again = maxent.language_model_scores(df.repartition(5)).collect()
    assert sorted(round(r.score, 4) for r in got) == pytest.approx(sorted(round(r.score, 4) for r in again), abs=1e-3)


def test_model_is_a_distribution():
    w = maxent.Weights()
    rng = np.random.default_rng(0)
    for k in ("bias", "near", "skip", "pair", "member", "near_member"):
        getattr(w, k)[...] = rng.normal(size=getattr(w, k).shape)
    for near in (0, 7):
        assert np.exp(w.class_log(near)).sum(1) == pytest.approx(np.ones(maxent.SKIP))
        assert np.exp(w.member_log(near)).reshape(maxent.CLASSES, -1).sum(1) == pytest.approx(np.ones(maxent.CLASSES))


def test_language_model_on_nothing(spark):
    assert maxent.language_model_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, active, target = sum(sizes.values()), set(names), {}
    while active:
        total = sum(w[s] for s in active)
        over = [s for s in active if left * w[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            target |= {s: left * w[s] / total for s in active}
            break
        for s in over:
            target[s] = 3 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        active -= set(over)
    return target


def test_mix(docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(mixing, "BLOCK", 16)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    sizes = {s: sizes[s] for _, _, s in rows}
    target = water_fill(sizes)
    got = mixing.mixed(df).collect()
    by = {(i, len((t or "").encode().split())): s for i, t, s in rows}
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        s = by[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 3 * 16 + 0.01 * t
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed(df.repartition(7)).collect()), key=repr)
    copies = Counter(r.doc_id for r in mixing.drawn(df).collect())
    for r in got:
        if r["size"] and r.doc_id not in (None, 903):
            assert copies[r.doc_id] == math.floor(r.taken / r["size"] + 0.5)


def test_schedule_is_even(spark):
    rows = [(0, "a", 4_000, 1.0, 2_000.0), (1, "b", 2_000, 2.0, 4_000.0)]
    plan = mixing.schedule(spark.createDataFrame(rows, "sid long, source string, source_size long, weight double, target double"), 6_000).orderBy("slot").collect()
    assert [r.slot for r in plan] == sorted({r.slot for r in plan})
    for n in (8, 16):  # every stretch holds the sources nearly as they weigh
        assert abs(sum(r.sid == 0 for r in plan[:n]) - n / 3) <= 2


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(df).collect() == [] and mixing.drawn(df).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mixed(blank).collect()] == [0, 0]


PAGES = [(5, "http://a/ä b", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "u", None), (4, "u", ""), (8, "u\r\nEvil: 1", "é" * 10), (7, "u", "é" * 10), (7, "u", "é" * 10), (6, "u", "solo"), (None, "u", "solo"), (None, "u", "alone"), (5, "w", "é" * 10)]


@pytest.mark.parametrize("least", [0, 5])
def test_archive(spark, tmp_path, least):
    df = spark.createDataFrame([(*p, b"z") for p in PAGES], "page_id long, url string, html string, payload binary").repartition(3)
    path = str(tmp_path / "archive")
    warc.write_archive(df, path, least_bytes=least)
    got = warc.records(spark, path).collect()
    first = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        first[b] = min([x for x in (first.get(b), i) if x is not None], default=None)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        revisit = len(b) >= least and first[b] is not None and first[b] != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", str(first[b]) if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = warc.parse_header(head)
        assert block.endswith(b"\r\n\r\n") and int(fields["content-length"]) == len(block) - 4
        assert block[:-4] == (b"" if r.record_type == "revisit" else bytes(r.payload)) and fields["warc-payload-digest"] == "sha1:" + r.payload_digest
    stored = spark.read.parquet(f"{path}/payloads").collect()
    assert len(stored) == len({bytes(r.payload) for r in stored}) == len({(h or "") for _, _, h in PAGES})


def test_archive_notices_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "size", "CAST('b' AS BINARY) AS payload").collect()
    spark.createDataFrame(bad, "digest binary, size long, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.records(spark, path).collect()


def test_archive_of_nothing(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_fingerprints(spark, docs):
    rows, df = docs
    rows = [r for r in rows if r[0] != 903] + [(903, "dup dup", "s2")] * 2
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = merkle.digests(df).collect()
    want = []
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(merkle.tree(t)), str(merkle.tree(edited))))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint)
        assert (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint)
    assert sorted(map(tuple, merkle.fingerprints(df).collect()), key=repr) == sorted(((i, str(merkle.tree(t or ""))) for i, t, _ in rows), key=repr)


def test_trees_tell_and_locate_edits():
    lines = [f"paragraph {i} " + "word " * (i % 7) for i in range(60)]
    a = "\n".join(lines)
    lines[31] += "!"
    lines.insert(50, "new one")
    b = "\n".join(lines)
    assert merkle.edits(a, a) == [] and merkle.edits(a, b) == [(31, 32, 31, 32), (50, 50, 50, 51)]
    same, less = merkle.likeness(str(merkle.tree(a)), str(merkle.tree(a))), merkle.likeness(str(merkle.tree(a)), str(merkle.tree(b)))
    assert same == 1.0 and 0.9 < less < 1.0
    for x, y in (("a", "a\n"), ("", "\n"), ("ab", "a\nb"), ("x" * 64, "x" * 65)):
        assert str(merkle.tree(x)) != str(merkle.tree(y)) and merkle.likeness(str(merkle.tree(x)), str(merkle.tree(y))) < 1


def test_fingerprints_of_one_and_of_none(spark):
    assert merkle.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (r,) = merkle.digests(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
