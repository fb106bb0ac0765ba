"""Base spans against Python's own regular expressions; votes, reliabilities and added spans on small cases."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = [int(d) for d in value if d.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]
    listed = [f"{k}:{a}:{b}" for k, a, b in spans]
    return [sum(s[0] == k for s in spans) for k in PATTERNS], hashlib.sha256(",".join(listed).encode()).hexdigest(), set(listed)


def luhn(first):
    for last in "0123456789":
        if holds("card", first + last):
            return first + last


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("spans", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("bits", F.lit(1))
    return {r.doc_id: r for r in pii.personal_data(df).collect()}


def test_base_spans_equal_plain_expressions(spark):
    rnd = random.Random(4)
    bits = ["a", ".", "-", "@", "1", "23", "4.5", "255.1.2.3", "300.1", "+", "(", ")", " ", "  ", "%", "_", "é", "🙂", "\n", "x@y.z", "+1 (843) 555-7672", luhn("411111111111111"), luhn("41111111111111 1"), "4111-1111", "1" * 15]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 30))) for _ in range(3000)] + ["", None, "a@b.c_d@e.f.@g.h", "1.2.3.4.5.6.7.8", "🙂 a@b.c 🙂 1.2.3.4"]
    got = found(spark, texts)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        counts, sha, spans = plain(text)
        r = got[i]
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (counts, sha), text
        assert spans <= set(r.spans.split(",")) or not spans


def test_long_texts(spark):
    """Long runs of each pattern's characters, and a text of many thousands of spans."""
    texts = ["a@" + "b." * 60000 + "c", "1" * 20000, "1 " * 60000, "1." * 60000, "+1" + "-" * 100000, "x@y.zz 10.0.0.1 " * 6000, "at dot " * 20000]
    texts += ["a." * 60000 + "@", "word " * 10 + "b" * 100000]  # no spans; Python's own expression takes a square of their length
    got = found(spark, texts)
    for i, text in enumerate(texts):
        counts, sha, _ = plain(text) if i < 7 else plain("")
        assert ([got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone], got[i].base_sha256) == (counts, sha), text[:20]


def test_adds_what_the_rules_miss_and_leaves_clean_texts_alone(spark):
    card = luhn("453201511283036")
    clean = ["The report of version 2.0.1 has 1200 words.", "At noon the dot moved.", "Build 20240101123456 of 3.11, order 1234 5678.", "", None]
    plainly = ["Write to ann@mail.example.com.", f"Card {card}.", "Call +1 (843) 555-7672.", "Host 170.106.47.218 is up."] * 20
    hidden = ["Contact ann (at) mail (dot) example (dot) com today.", "Call +1 (843) 555-7672 170.106.47.218", f"Card {card} {card}."]
    got = found(spark, clean + plainly + hidden)
    n = len(clean) + len(plainly)
    assert [got[i].spans for i in range(len(clean))] == [""] * len(clean)
    assert got[n].spans == "email:8:45" and got[n].n_email == 0
    assert got[n + 1].spans == "ip:23:37,phone:5:22" and got[n + 1].n_phone == 0
    assert got[n + 2].spans == "card:5:21,card:22:38" and got[n + 2].n_card == 0


def test_reliabilities_follow_the_votes():
    """Six labelers of known accuracy vote on 4,000 spans; the estimate orders them and finds the truth better than the plain majority."""
    rnd = random.Random(1)
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.6, 0.55]
    counts, truth = {}, []
    for _ in range(4000):
        right = rnd.random() < 0.5
        bits = 0
        for j, a in enumerate(accuracy):
            said = right if rnd.random() < a else not right
            bits |= 1 << (2 * j if said else 2 * j + 1)
        counts[bits] = counts.get(bits, 0.0) + 1
        truth.append((bits, right))
    right, shares = pii.reliabilities(counts)
    assert [abs(s[1][0] - a) < 0.05 for s, a in zip(shares, accuracy)] == [True] * 6
    majority = sum((sum(1 - pii._vote(b, j) for j in range(6)) > 0) == r for b, r in truth)
    assert sum((right[b] > 0.5) == r for b, r in truth) > majority
    assert pii.reliabilities({5: 1.0})[0][5] > 0.5


def test_empty_table_and_repeated_rows(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([(None, "a@b.cd"), (None, "a@b.cd")], "doc_id bigint, text string")
    assert [tuple(r)[:2] for r in pii.personal_data(df).collect()] == [(None, 1), (None, 1)]
