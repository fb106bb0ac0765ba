"""Operators against plain, independent recomputations on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import maxent, merkle, mixing, quality_rules, ranker, toxicity, warc

# --- op10: trees and likeness ------------------------------------------------------


def plain_leaves(line):
    """Words with the space after them, gathered until a word's hash ends the leaf; cut before 256 code points are passed."""
    out, run = [], ""
    words = line.split(" ")
    for i, w in enumerate(words):
        piece = w + (" " if i < len(words) - 1 else "")
        if len(run + piece) > 256:
            if run:
                out.append(run)
            run = ""
            while len(piece) > 256:
                out.append(piece[:256])
                piece = piece[256:]
        run += piece
        if zlib.crc32(w.encode()) % 8 == 0 and run:
            out.append(run)
            run = ""
    return out + [run] * bool(run)


def plain_tree(text):
    h = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    sections, run = [], []
    for line in text.split("\n"):
        leaves = plain_leaves(line)
        p = h(b"p" + b"".join(h(x.encode()) for x in leaves))
        run.append((p, leaves))
        if p[0] % 8 == 0:
            sections.append(run)
            run = []
    sections += [run] * bool(run)
    root = h(b"r" + b"".join(h(b"s" + b"".join(p for p, _ in s)) for s in sections))
    return root, [[leaves for _, leaves in s] for s in sections]


def plain_likeness(a, b):
    (ra, sa), (rb, sb) = plain_tree(a), plain_tree(b)
    if ra == rb:
        return 1.0
    size = lambda x: len(x) if isinstance(x, str) else sum(map(size, x))
    freeze = lambda x: x if isinstance(x, str) else tuple(map(freeze, x))
    x, y, shared = [freeze(s) for s in sa], [freeze(s) for s in sb], 0
    for _ in range(3):
        left = []
        y = list(y)
        for s in x:
            if s in y:
                y.remove(s)
                shared += size(s)
            else:
                left.append(s)
        x, y = [c for s in left for c in s if not isinstance(s, str)], [c for s in y for c in s if not isinstance(s, str)]
    n = size(sa) + size(sb)
    return min(2 * shared / n, 1 - 1 / (n + 1)) if n else 0.0


def texts(n=60, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    out = []
    for _ in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 25))]
        out.append("\n".join(lines))
    return [*out, "", "\n", " ", "x" * 2_000, "a " * 700, "é" * 300 + " ü", "one\ntwo"]


def test_trees_and_likeness_equal_a_plain_walk():
    all_texts = texts()
    for t in all_texts:
        root, sections = plain_tree(t)
        own = merkle.tree(t)
        assert own.root == root and "".join(x for line in t.split("\n") for x in merkle.cut(line)) == t.replace("\n", "")
        assert [n for _, n in own.leaves] == [len(x) for s in sections for p in s for x in p]
    for a, b in zip(all_texts, [*all_texts[1:], all_texts[0]]):
        mixed = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        for other in (b, mixed, a):
            assert merkle.likeness(str(merkle.tree(a)), str(merkle.tree(other))) == pytest.approx(plain_likeness(a, other), abs=1e-12)


def test_an_insertion_in_front_changes_few_leaves():
    line = " ".join(f"word{i}" for i in range(400))
    a, b = str(merkle.tree(line)), str(merkle.tree("x " + line))
    assert merkle.likeness(a, b) > 0.9


def test_spans_locate_edits_in_a_line():
    a = " ".join(f"word{i}" for i in range(300)) + "\nsecond line"
    b = a.replace("word150 ", "WORD150 ")
    (s, e, u, v), *rest = merkle.spans(a, b)
    assert not rest and s <= a.index("word150") and e >= a.index("word150") + 7 and e - s < 300 and a[:s] + b[u:v] + a[e:] == b
    assert merkle.spans(a, a) == []


def test_digests_equal_a_plain_recomputation(spark):
    rows = list(enumerate(texts(30)))
    got = {r.doc_id: r for r in merkle.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.near_edited == pytest.approx(plain_likeness(t, edited)) and r.near_next == pytest.approx(plain_likeness(t, after))
        assert r.fingerprint.split(":")[0] == plain_tree(t)[0].hex() and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


# --- op3: the model's score -------------------------------------------------------------


def test_scores_equal_a_loop_over_tokens(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(100, None)]
    kept = {}
    real = maxent.trained

    def spy(*a, **k):
        kept["w"] = real(*a, **k)
        return kept["w"]

    monkeypatch.setattr(maxent, "trained", spy)
    got = maxent.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    w = kept["w"]
    tok = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in rows}
    c = Counter(x for i, ws in tok.items() if zlib.crc32(str(i).encode()) % 10 for x in ws)
    total, slot_n, slot_v = sum(c.values()), Counter(), Counter()
    for x, n in c.items():
        slot_n[zlib.crc32(x) % maxent.SLOTS] += n
        slot_v[zlib.crc32(x) % maxent.SLOTS] += 1
    for r in got:
        log, h = 0.0, [0, 0]
        for x in tok[r.doc_id]:
            crc = zlib.crc32(x)
            slot, near, skip = crc % maxent.SLOTS, (h[-1] >> 10) % maxent.NEAR, (h[-2] >> 18) % maxent.SKIP
            cls = slot // maxent.MEMBERS
            scores = [w.bias[k] + w.near[near, k] + w.skip[skip, k] + w.pair[(near * 40_503 + skip * 9_973) % maxent.PAIR, k] for k in range(maxent.CLASSES)]
            p = math.exp(scores[cls]) / sum(map(math.exp, scores))
            inside = [math.exp(w.member[s] + w.near_member[near, s]) for s in range(cls * maxent.MEMBERS, (cls + 1) * maxent.MEMBERS)]
            p *= inside[slot % maxent.MEMBERS] / sum(inside)
            p *= (c[x] + 0.1) / (slot_n[slot] + 0.1 * (slot_v[slot] + 1))
            log += math.log10(p)
            h.append(crc)
        assert r.score == pytest.approx(log, rel=1e-4, abs=1e-3) and r.train_tokens == total


def test_probabilities_of_a_slot_sum_to_one():
    """Known tokens of a slot and one unknown share it: (c + 0.1) over n + 0.1 (v + 1)."""
    counts = [5, 1, 9]
    assert sum((c + 0.1) / (sum(counts) + 0.1 * (len(counts) + 1)) for c in [*counts, 0]) == pytest.approx(1)


# --- op5: the verdict -----------------------------------------------------------------------


def binomial_upper(k, n, delta):
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        if sum(map(math.exp, logs)) > delta:
            low = p
        else:
            high = p
    return high


def test_kept_equals_a_plain_ladder(spark):
    rng = random.Random(3)
    docs, labels = [], []
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    words = [a + b + c for a in words for b in words for c in ("", "s", "ing")]
    for i in range(2_600):
        good = rng.random() > 0.3
        t = [rng.choice(words) for _ in range(rng.randrange(55, 90))]
        share = 0.002 if good else rng.choice([0.02, 0.3])
        t = [w + rng.choice(["%", "#", "", "!"]) if rng.random() < share else w for w in t]
        docs.append((i, " ".join(t), "en" if i % 3 else "de"))
        labels.append((i, int(good)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.rules(d, lab).collect()}
    half = {r.doc_id: r.h for r in d.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'half'), 2) AS h").collect()}
    bins = {i: [math.floor(math.sqrt(x) * quality_rules.BINS) for x in quality_rules.measure(t.encode())[1]] for i, t, _ in docs}
    lang, good = {i: g for i, _, g in docs}, dict(labels)
    fine = [i for i, r in got.items() if not r.base_failed]
    strata = sorted({lang[i] for i in fine})
    cuts = {}
    for s in strata:
        first = [i for i in fine if lang[i] == s and half[i] == 0]
        second = [i for i in fine if lang[i] == s and half[i] == 1 and good[i]]
        g, b = [bins[i] for i in first if good[i]], [bins[i] for i in first if not good[i]]
        for share in quality_rules.LADDER:
            level = []
            for k in range(len(quality_rules.RATIOS)):
                at = next(c for c in range(quality_rules.BINS + 1) if sum(x[k] > c for x in g) <= share / len(quality_rules.RATIOS) * len(g))
                lift = sum(x[k] > at for x in b) / max(len(b), 1) >= quality_rules.LEAST_LIFT * max(sum(x[k] > at for x in g), 1) / max(len(g), 1)
                level.append(at if lift and at < quality_rules.BINS else quality_rules.BINS)
            rejected = sum(any(x > c for x, c in zip(bins[i], level)) for i in second)
            if binomial_upper(rejected, len(second), quality_rules.DELTA / len(strata)) > quality_rules.ALPHA:
                break
            cuts[s] = level
    assert cuts
    for i, r in got.items():
        over = lang[i] in cuts and any(x > c for x, c in zip(bins[i], cuts[lang[i]]))
        assert r.kept == (not r.base_failed and not over)
    assert 0 < sum(not r.kept for r in got.values()) < len(got)


# --- op7: the schedule -----------------------------------------------------------------------


def test_taken_equals_a_schedule_in_memory(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "STRETCH", 100)
    rng = random.Random(11)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(150)] + [(500, "x " * 3, "tiny"), (501, "y " * 4_000, "huge")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in mixing.mixed(df).collect()}
    draws = {r.doc_id: r.d for r in df.selectExpr("doc_id", "xxhash64(20240229, doc_id, xxhash64(text), CAST(size(filter(split(text, ' '), x -> x <> '')) AS BIGINT)) AS d").collect()}
    names = sorted({s for *_, s in rows if s}) + [None]
    total = sum(len(t.split()) for _, t, _ in rows)
    bits = max(0, math.ceil(math.log2(total / 16)))
    n, edge, taken, slots_of = 1 << bits, 0.0, Counter(), {}
    for s in names:
        own = [(i, len(t.split())) for i, t, x in rows if x == s and t.split()]
        size, target = sum(k for _, k in own), next(r.target for i, r in got.items() if dict((a, c) for a, _, c in rows)[i] == s)
        low, edge = edge, edge + target / total * n
        lo, hi = min(math.ceil(low - 1e-6), n), min(math.ceil(edge - 1e-6), n)
        if lo >= hi:
            lo = min(lo, n - 1)
            hi = lo + 1
        points = sorted(int(format(k, f"0{bits}b")[::-1], 2) for k in range(lo, hi)) if bits else [0]
        slots_of[s] = points
        words, m = math.floor(target + 0.5), len(points)
        stream = []
        own.sort(key=lambda x: draws[x[0]] % (1 << 64))  # unsigned: the stretches are its highest bits
        for i, k in own:
            stream += [i] * k
        for rank in range(m):  # the slot of rank r takes block r of the stream, read over and over
            for place in range(rank * words // m, (rank + 1) * words // m):
                taken[stream[place % size]] += 1
    for i, r in got.items():
        assert r.taken <= 3 * r["size"]
    by_source = Counter()
    for i, t, s in rows:
        by_source[s] += got[i].taken
    for s in names:
        assert by_source[s] == math.floor(next(r.target for i, r in got.items() if dict((a, c) for a, _, c in rows)[i] == s) + 0.5)
    sources = mixing.stored(mixing.targets(mixing.sized(df)), "t")
    plan = mixing.schedule(sources, total).collect()
    ids = {r.sid: r.source for r in sources.collect()}
    for s in names:
        own = sorted((r.rank, r.slot) for r in plan if ids[r.sid] == s)
        assert [r for r, _ in own] == list(range(len(own))) and [x for _, x in own] == slots_of[s]
    assert {i: r.taken for i, r in got.items() if r.taken} == dict(taken)


def test_draws_keep_the_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice("abc")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {}
    for r in mixing.mixed(df).collect():
        want[rows[r.doc_id][2]] = r.target
    got = Counter()
    for r in mixing.drawn(df).collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - t) <= 60 for s, t in want.items())


# --- op9 and op1: the fits ------------------------------------------------------------------------


def test_best_quantile_is_the_best():
    rng = np.random.default_rng(2)
    s, good = rng.normal(size=300), rng.random(300) < 0.6
    s[good] += 1.5
    cut, q = ranker.best_quantile(s, good)
    wrong = lambda c: (good & (s < c)).sum() / good.sum() + (~good & (s >= c)).sum() / (~good).sum()
    assert wrong(cut) == min(wrong(np.quantile(s, k / ranker.STEPS)) for k in range(ranker.STEPS + 1)) and cut == np.quantile(s, q)


def test_quality_scores_equal_a_plain_formula(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + (rng.choice(["%%", "##"]) if i % 4 == 0 else "") for _ in range(60))) for i in range(300)] + [(900, None)]
    labels = [(i, int(i % 4 != 0)) for i in range(300)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    r = ranker.fit(d, lab)
    assert 0 <= r.quantile <= 1
    for got in ranker.quality_scores(d, lab).collect():
        x = ranker.features((dict(rows)[got.doc_id] or "").encode())
        strength = sum((float(v) - m) / s * w for v, m, s, w in zip(x, r.mean, r.scale, r.weights))
        want = 1 / (1 + math.exp(-max(-40, min(40, strength - r.cut + math.log(0.3 / 0.7)))))
        assert got.score == pytest.approx(want, abs=1e-6) and got.predicted == (got.score >= 0.3)
        if got.held_out and got.doc_id < 300:
            assert got.predicted == dict(labels)[got.doc_id]


def plain_features(text):
    words = text.lower().split()
    counts = Counter()
    for w in words:
        w = w.strip(".,;:!?\"'()[]{}*&%$#|<>-_")
        if w:
            for k in ["w" + w] + [f"{n}{w[:n]}" for n in (4, 5, 6) if len(w) >= n]:
                counts[zlib.crc32(k.encode()) % (1 << 22)] += 1
    out = set()
    for f, n in counts.items():
        steps = [0] + ([7_919] if n >= 2 else []) + ([104_729] if n >= 2 and n * 200 >= len(words) else []) + ([2 * 104_729] if n >= 2 and n * 60 >= len(words) else [])
        out |= {(f + s) % (1 << 22) for s in steps}
    return out


def test_chain_equals_a_plain_selection_and_sum(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}x" for k in range(50)]
    rows, labels = [], []
    for i in range(240):
        bad, toxic = rng.random() < 0.4, rng.random() < 0.3
        t = [rng.choice(vocabulary) for _ in range(40)] + ["junkword"] * (3 * bad) + ["rudeword", "rudest"] * toxic
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, int(not bad), int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(d, toxicity.chain_labels(lab), toxicity.CHAIN)
    feats = {i: plain_features(t) for i, t in rows}
    for k, target in enumerate(({i: 1 - q for i, q, _ in labels}, {i: x for i, _, x in labels})):
        n, n1 = len(rows), sum(target.values())
        strong = set()
        for f in set().union(*feats.values()):
            c, c1 = sum(f in x for x in feats.values()), sum(f in x and target[i] for i, x in feats.items())
            p = c / n
            z = abs(c1 / n1 - (c - c1) / (n - n1)) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
            if c >= 4 and z >= 5:
                strong.add(f)
        assert set(chain.links[k][0].tolist()) <= strong and chain.links[k][0].size
    for r in toxicity.toxicity(d, lab).collect():
        out = []
        for kept, w in chain.links:
            s = sum(x for f, x in zip(kept.tolist(), w) if f in feats[r.doc_id]) + w[len(kept)] + sum(a * b for a, b in zip(w[len(kept) + 1 :], out))
            out.append(1 / (1 + math.exp(-max(-40, min(40, s)))))
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(tuple(out), abs=1e-6)
    toxic = {i: x for i, _, x in labels}
    assert sum(r.toxic == bool(toxic[r.doc_id]) for r in toxicity.toxicity(d, lab).collect()) >= 235


def test_repeated_labelled_rows_count_once(spark):
    """A labelled id on thousands of rows does not fill the driver: one row an id is learnt from."""
    rows = [(1, "good text here")] * 3_000 + [(2, "bad %% ##")] + [(i, "good text again") for i in range(3, 9)]
    labels = [(i, int(i != 2), int(i == 2)) for i in range(1, 9)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert ranker.quality_scores(d, lab).count() == len(rows) and toxicity.toxicity(d, lab).count() == len(rows)


# --- op2: exact records --------------------------------------------------------------------------------


def test_records_are_rebuilt_exactly(spark):
    pages = [(3, "http://a", "<p>x</p>"), (5, None, "<p>x</p>"), (9, "u", None), (4, "u  v", "é")]
    got = {r.page_id: r for r in warc.archive_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, url, html in pages:
        b = (html or "").encode()
        r = got[i]
        head = warc.record_header(i, url, len(b), r.payload_digest, r.refers_to, r.record_type)
        assert r.record_sha256 == hashlib.sha256(head + (b if r.record_type == "response" else b"") + b"\r\n\r\n").hexdigest()
    assert got[5].refers_to == 3


def test_a_missing_payload_is_an_error(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string"), path)
    rows = spark.read.parquet(f"{path}/payloads").limit(1).collect()
    spark.createDataFrame(rows, "digest binary, size long, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="missing"):
        warc.records(spark, path).collect()


def test_fixed_words_are_plain():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x1cb c") == ["a\x1cb", "c"]
