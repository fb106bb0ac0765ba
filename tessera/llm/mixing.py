"""Mixing sources to target weights on a low-discrepancy schedule.

The mix has 2^m slots.  Slot k stands at the van der Corput point of k (its
bits reversed); the sources' cumulative targets cut the unit interval, and the
part that holds the point names the slot's source.  So every stretch of the
schedule holds the sources nearly in proportion.  Slots are ranked per source,
in closed form from the bits of k.  A source's documents, shuffled by hash,
form one stream that is read over and over (its epochs) up to the target and
cut into as many equal blocks as the source has slots; the slot of rank r takes
block r.  So each source meets its target to the word, whatever its size, and
the slots say where in the mix each block stands: the first k of n slots hold
k/n of every target but for a few blocks (the discrepancy of the points).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, stored, texts

#: Tokens of a slot, about.
BLOCK = 256
WEIGHTS = (1, 2, 3)
#: A source is taken so many times at most.
EPOCHS = 3
#: Words of a stretch of a source's stream, about; each is ranked on its own.
STRETCH = 1 << 20
SEED = 20_240_229


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, mark, size): size is the number of words, mark a hash of the text; row numbers are fixed by writing the table."""

    def fn(batch):
        n = [len(t.split()) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("mark"), pa.array(n, pa.int64())], ["doc_id", "source", "mark", "size"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(map_arrow(rows, fn, f"doc_id {kind}, source string, mark long, size long").withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def targets(sizes: DataFrame) -> DataFrame:
    """(sid, source, source_size, weight, target), one row a source.

    Sources by code point, null last, weigh WEIGHTS over and over and share
    the total.  With sources in the order of size per weight, those that stop
    at EPOCHS times their size come first; the rest share what they leave.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = own.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * EPOCHS)
    order = W.orderBy(F.col("most") / F.col("weight"), "sid")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    own = own.withColumn("share", share).withColumn("full", F.col("most") <= F.col("share") * F.col("weight"))
    free = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "sid", "share"))).over(everything)["share"]
    return own.select("sid", "source", "source_size", "weight", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * free).alias("target"))


def reversed_bits(x, bits: int):
    """A column's lowest `bits` bits (up to 62) in reverse: the van der Corput point times 2^bits."""
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def slot_bits(total: int) -> int:
    """m: the schedule has 2^m slots for so many words."""
    return max(0, int(np.ceil(np.log2(max(1.0, total / BLOCK)))))


def rank_of(slot, low, high, bits: int):
    """How many slots before `slot` stand in [low, high) of the reversed numbers; all columns.

    Each bit of the slot that is set stands for a run of smaller slots with the
    higher bits the same, a 0 there and any lower bits: reversed, an arithmetic
    sequence, whose members in [low, high) can be counted.
    """

    power = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)

    def step(sofar, b):
        stride, most = power(F.lit(bits) - b), power(b)
        offset = F.col("_at").bitwiseAND(power(F.lit(bits) - b - 1) - 1)  # the higher bits, reversed
        upto = lambda x: F.greatest(F.lit(0).cast("long"), F.least(most, F.ceil((x - offset) / stride)))
        return F.when(slot.bitwiseAND(most) != 0, sofar + upto(high) - upto(low)).otherwise(sofar)

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), step) if bits else F.lit(0).cast("long")


def schedule(sources: DataFrame, total: int) -> DataFrame:
    """(slot, sid, rank, slots, words): one row a slot in use; slots: how many its source has, words: what they take together.

    A source whose part of the interval holds no point gets the slot at the
    part's start, beside the source that the slot has.  sources: targets().
    """
    bits = slot_bits(total)
    n = 1 << bits
    edge = F.sum("target").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)) / F.lit(float(max(total, 1))) * n
    cut = sources.withColumn("edge", edge).withColumn("before", F.coalesce(F.lag("edge").over(W.orderBy("sid")), F.lit(0.0)))
    point = lambda e: F.least(F.ceil(e - 1e-6), F.lit(n)).cast("long")
    cut = cut.withColumn("words", F.round("target").cast("long")).where("words > 0")
    cut = cut.select("sid", "words", point(F.col("before")).alias("lo"), point(F.col("edge")).alias("hi"))
    cut = cut.withColumn("lo", F.when(F.col("lo") < F.col("hi"), F.col("lo")).otherwise(F.least(F.col("lo"), F.lit(n - 1))))
    cut = cut.withColumn("hi", F.greatest(F.col("hi"), F.col("lo") + 1)).withColumn("slots", F.col("hi") - F.col("lo"))
    run = 1_024
    rows = cut.select("*", F.explode(F.sequence(F.floor(F.col("lo") / run), F.floor((F.col("hi") - 1) / run))).alias("run"))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, as a few runs would else be put into one task
    rows = rows.repartition(parts, "sid", "run").select("sid", "words", "slots", "lo", "hi", F.explode(F.sequence(F.greatest(F.col("lo"), F.col("run") * run), F.least(F.col("hi"), (F.col("run") + 1) * run) - 1)).alias("_at"))
    rows = rows.withColumn("slot", reversed_bits(F.col("_at"), bits))
    return rows.select("slot", "sid", rank_of(F.col("slot"), F.col("lo"), F.col("hi"), bits).alias("rank"), "slots", "words")


def _starts(rows: DataFrame, stretches: int) -> DataFrame:
    """rows with `start`: the words of the same source before each in the order of `draw`. Sums per stretch come first, so no source fills a task."""
    rows = rows.withColumn("_stretch", F.shiftrightunsigned("draw", 64 - (stretches.bit_length() - 1)) if stretches > 1 else F.lit(0).cast("long"))
    sums = rows.groupBy("sid", "_stretch").agg(F.sum("size").alias("_sum"))
    past = F.coalesce(F.sum("_sum").over(W.partitionBy("sid").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    past = sums.select(F.col("sid").alias("_sid"), F.col("_stretch").alias("_of"), past.alias("_past"))
    inside = F.coalesce(F.sum("size").over(W.partitionBy("sid", "_stretch").orderBy("draw", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_inside", inside).join(past.hint("merge"), (F.col("sid") == F.col("_sid")) & (F.col("_stretch") == F.col("_of")))
    return rows.withColumn("start", F.col("_past") + F.col("_inside")).drop("_sid", "_of", "_past", "_inside", "_stretch")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: one a document with its source's target; parts: row, turn, block, slot, part, one for each slot that a document stands in)."""
    sizes = sized(docs, id_col, text_col, source_col)
    sources = stored(targets(sizes), "mix-sources")
    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    plan = stored(schedule(sources, total), "mix-schedule").select(F.col("sid").alias("s"), F.col("rank").alias("r"), "slot")

    names = sources.select(F.col("source").alias("name"), "sid", "source_size", "target")
    rows = sizes.join(names, sizes.source.eqNullSafe(names.name)).drop("name")
    slots = plan.groupBy("s").count().select(F.col("s").alias("of"), F.col("count").alias("slots"))  # one row a source
    draw = F.xxhash64(F.lit(SEED), "doc_id", "mark", "size")  # row numbers, which the split of files may change, settle ties alone
    filled = rows.where("size > 0").withColumn("draw", draw)
    filled = _starts(filled, 1 << max(0, int(np.ceil(np.log2(max(1.0, total / STRETCH))))))
    filled = filled.join(slots, F.col("sid") == F.col("of")).withColumn("words", F.round("target").cast("long"))
    # each reading of a document that begins before the target, and of that the blocks that it meets
    readings = F.transform(F.sequence(F.lit(0), F.lit(EPOCHS - 1)), lambda e: F.col("start") + e * F.col("source_size"))
    turns = filled.select("row", "sid", "size", "slots", "words", F.posexplode(readings).alias("turn", "start")).where("start < words")
    wide = lambda c: c.cast("decimal(38,0)")
    block_of = lambda t: F.floor((wide(t + 1) * wide(F.col("slots")) - 1) / wide(F.col("words"))).cast("long")
    edge_of = lambda j: F.floor(wide(j) * wide(F.col("words")) / wide(F.col("slots"))).cast("long")
    end = F.least(F.col("start") + F.col("size"), F.col("words"))
    parts = turns.select("*", F.explode(F.sequence(block_of(F.col("start")), block_of(end - 1))).alias("block"))
    parts = parts.select("row", "sid", "turn", "block", (F.least(end, edge_of(F.col("block") + 1)) - F.greatest(F.col("start"), edge_of(F.col("block")))).alias("part"))
    # Spark takes exploded rows for few and would send them to all: both sides grow with the corpus
    return rows, parts.join(plan.hint("merge"), (F.col("sid") == F.col("s")) & (F.col("block") == F.col("r"))).drop("s", "r", "sid")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, mark, size, source_size, target, taken, first_slot, n_slots, turns), one row a document; turns: the slot that each reading of it begins in."""
    rows, parts = _placed(docs, id_col, text_col, source_col)
    begun = [F.min(F.when(F.col("turn") == e, F.struct("block", "slot")))["slot"] for e in range(EPOCHS)]
    taken = parts.groupBy(F.col("row").alias("of")).agg(
        F.sum("part").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"), F.array_compact(F.array(*begun)).alias("turns")
    )
    got = rows.join(taken.hint("merge"), rows.row == taken.of, "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return got.select("doc_id", "source", "mark", "size", "source_size", "target", none("taken"), "first_slot", none("n_slots"), "turns")


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(slot, doc_id, source, words): the mix in pieces, one row for each slot that a document stands in. Read by slot, every beginning of the mix holds the sources nearly as their targets are."""
    rows, parts = _placed(docs, id_col, text_col, source_col)
    pieces = parts.groupBy(F.col("row").alias("of"), "slot").agg(F.sum("part").alias("words"))
    return rows.join(pieces.hint("merge"), F.col("row") == F.col("of")).select("slot", "doc_id", "source", "words")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_slots), one row a document: the words of it that the mix takes, repeats counted, and where.

    first_slot is the lowest slot of the schedule that the document stands in
    (null where the mix leaves it out), n_slots how many pieces of it stand in
    slots.  The taken words of a source are its target, to the nearest whole.  A null
    or empty text has no words and is not taken.  A null source is a source.
    Reruns over the same rows agree; repeated rows are rows of their own.
    """
    return _mixed(docs, id_col, text_col, source_col).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents, in the order of the schedule: each as often as its taken words fill it, columns as they were.

    A copy stands where a reading of its document begins; partitions follow
    the order of slots and so do the rows of each, so the table that is
    written from them can be read from its start as a mix.  The target ends
    inside one document of each source, which is taken to the nearest whole;
    all others are taken whole, so a source is off its target by half a
    document at most.  A document that the mix leaves out goes; one without
    words goes too.  Rows with the same id, text and source are drawn alike, by
    the mean of their shares to the nearest whole.
    """
    share = _mixed(docs, id_col, text_col, source_col).where("size > 0")
    copies = share.groupBy("doc_id", "mark", "source").agg(F.floor(F.avg(F.col("taken") / F.col("size")) + 0.5).cast("int").alias("copies"), F.min("turns").alias("turns")).where("copies > 0")
    copies = stored(copies.select(F.col("doc_id").alias("mix_id"), F.col("mark").alias("mix_mark"), F.col("source").alias("mix_source"), F.col("copies").alias("mix_copies"), F.col("turns").alias("mix_turns")), "mix-copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(source_col).cast("string").alias("source"))
    got = rows.join(copies.hint("merge"), (F.col("mark") == F.col("mix_mark")) & F.col("id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")))
    slot = F.transform(F.sequence(F.lit(0), F.col("mix_copies") - 1), lambda i: F.coalesce(F.get(F.col("mix_turns"), i), F.element_at(F.col("mix_turns"), -1)))
    got = got.select("row", "mark", F.explode(slot).alias("slot"))
    return got.repartitionByRange("slot", "mark").sortWithinPartitions("slot", "mark").select("row.*")
