"""The mix has an order, and the schedule makes it."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(2_000, "", "a"), (2_001, None, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


def worst(pieces, slots):
    """The largest gap, in blocks, between what a beginning of the mix holds of a source and that beginning's share of the source's words."""
    total = Counter()
    for _, source, words in pieces:
        total[source] += words
    block = sum(total.values()) / slots
    by_slot, seen, gap = {}, Counter(), 0.0
    for slot, source, words in pieces:
        by_slot.setdefault(slot, []).append((source, words))
    for k in range(slots):
        for source, words in by_slot.get(k, []):
            seen[source] += words
        gap = max([gap, *(abs(seen[s] - total[s] * (k + 1) / slots) / block for s in total)])
    return gap


def pieces_of(df):
    return [(r.slot, r.source, r.words) for r in mixing.placed(df).collect()]


def test_every_beginning_of_the_mix_is_in_proportion(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    sizes = mixing.mixed(docs)
    total = sizes.agg(F.sum("size")).first()[0]
    slots = 1 << mixing.slot_bits(total)
    pieces = pieces_of(docs)
    assert sum(w for *_, w in pieces) == sizes.agg(F.sum("taken")).first()[0]
    bound = math.log2(slots) / 2 + 2  # of an interval's count among the first points of the sequence, and two blocks that are not whole
    assert worst(pieces, slots) <= bound
    # the same blocks on a schedule that is no low-discrepancy one
    monkeypatch.setattr(mixing, "reversed_bits", lambda x, bits: x)
    assert worst(pieces_of(docs), slots) > 4 * bound
    monkeypatch.undo()
    monkeypatch.setattr(mixing, "BLOCK", 16)
    order = list(range(slots))
    random.Random(1).shuffle(order)
    assert worst([(order[k], s, w) for k, s, w in pieces], slots) > bound


def test_slots_of_documents(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    first, count = {}, Counter()
    for r in mixing.placed(docs).collect():
        first[r.doc_id] = min(first.get(r.doc_id, r.slot), r.slot)
        count[r.doc_id] += 1
    for r in mixing.mixed(docs).collect():
        assert r.first_slot == first.get(r.doc_id) and (r.n_slots >= count[r.doc_id]) and (r.n_slots == 0) == (r.taken == 0)


def test_drawn_documents_follow_the_schedule(docs, monkeypatch):
    """Documents in the order of the table: every beginning holds the sources in proportion, to the discrepancy and a document of each."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = mixing.drawn(docs).collect()
    total, seen, gap, past = Counter(), Counter(), 0.0, 0
    for r in rows:
        total[r.source] += len(r.text.split())
    every = sum(total.values())
    for r in rows:
        seen[r.source] += len(r.text.split())
        past += len(r.text.split())
        gap = max([gap, *(abs(seen[s] - total[s] * past / every) for s in total)])
    slots = 1 << mixing.slot_bits(every)
    assert gap <= (math.log2(slots) / 2 + 2) * every / slots + 4 * 40
    by_id = sorted(rows, key=lambda r: (str(r.source), r.doc_id))
    assert [r.doc_id for r in rows] != [r.doc_id for r in by_id]
