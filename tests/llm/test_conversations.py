"""Repaired conversations against a search over whole edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from tessera.llm import conversations

NEXT = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}
WORD = "[^\x20\x09-\x0d]"


def plain(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by a shortest-path search whose keys are (cost, audit)."""
    convs = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        deal = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if deal == 1 else re.sub("[.!?]", "", x) if deal == 2 else x
        convs[c] += [(t, "user" if deal == 4 else r, x)] * (0 if deal == 0 else 2 if deal == 3 else 1)
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2].encode()))
        faults, seen = [], set()
        for _, r, x in turns:
            said = re.findall(WORD, x)
            faults.append("blank" if not said else "duplicate" if (r, x) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((r, x))
        initials = [r[:1] for _, r, _ in turns]
        dated = [t for t, *_ in turns if t is not None]
        queue, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, state, lines = heapq.heappop(queue)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(turns) and state in ("", "a"):
                break
            role, after = NEXT[state]
            heapq.heappush(queue, (cost + 2, audit + "I", i, after, lines + (role + ":",)))
            if i < len(turns):
                _, r, x = turns[i]
                heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, lines))
                if faults[i] in ("", "truncated"):
                    more = faults[i] == "truncated"
                    heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, after, lines + (f"{role}:{x}",)))
                    if r[:1] == after or r[:1] == "s" and state == "":
                        heapq.heappush(queue, (cost + more, audit + "K", i + 1, r[:1], lines + (f"{r}:{x}",)))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rows(seed=5):
    rnd = random.Random(seed)
    texts = ["hi.", "hi", "", None, "a b! ", " ", "x?", "long one\n", "ok.", "é.\x0b", "…"]
    out = []
    for c in [None, *range(150)]:
        for i in range(rnd.choice([1, 2, 3, 5, 9, 30])):
            turn = rnd.choice([None, i, i, i, i, 2 * i, rnd.randrange(5), -i])
            out.append((c, turn, rnd.choice(["user", "assistant", "system", None, "", "user", "assistant", "tool", "under"]), rnd.choice([*texts, *[f"u{rnd.random()}."] * 10])))
    out += [(1000, i, rnd.choice(["user", "assistant", "system"]), f"t{rnd.randrange(900)}" + rnd.choice(["", "."])) for i in range(2000)]  # most of all rows
    out += out[:20]
    rnd.shuffle(out)
    return out


def got(df):
    found = conversations.repaired_digests(df).collect()
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: tuple(r)[1:] for r in found}


def test_equals_a_search_over_edits(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5).withColumn("audit", F.lit(1)).withColumn("seq", F.lit("clash")).withColumn("conv", F.lit(0))
    assert got(df) == plain(data)


def test_conversations_over_many_ranges(spark):
    """Without the merging of small ranges the long conversation, most of all rows, is split; short ones at the edges are too."""
    data = rows(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        df = spark.createDataFrame(data, SCHEMA).repartition(4)
        turns = conversations.ordered(conversations.damaged(df, "conv_id", "turn", "role", "text"))
        assert turns.where("conv = 1000").select(conversations._range()).distinct().count() > 5
        assert got(df) == plain(data)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "hi.")], SCHEMA)
    assert got(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(spark.createDataFrame([], SCHEMA)) == {}


def test_text_ids(spark):
    data = [(f"c{i % 3}", i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(30)]
    assert got(spark.createDataFrame(data, SCHEMA.replace("conv_id bigint", "conv_id string"))) == plain(data)


def test_layers_reach_every_state():
    """A stack never needs more layers than it has, whatever turns it is built of."""
    layers = conversations.Layers()
    todo = [layers.end]
    while todo:
        stack = todo.pop()
        assert layers.stacks[stack][-1] == conversations.FULL
        known = len(layers.stacks)
        for code in range(16):
            layers.step(stack, code)
        todo += range(known, len(layers.stacks))
    assert len(layers.stacks) < 200
