"""Full-text search: an inverted index as a table; boolean, phrase and natural queries over its postings, ranked by term statistics.

A word is a run of letters, digits and underscores, in lower case; there is no
stemming and no stop list, as nothing says which language a column is in.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

WORD = r"[\p{L}\p{N}_]+"


class SearchError(ValueError):
    """The text of a search is not well formed."""


# --- searches ---------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    """A word, the beginning of one, or a phrase of words."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Part:
    """A leaf or a group of parts with its operator: + must, - must not, > and < more or less weight, ~ counts against, '' may."""

    op: str
    item: object  # Leaf or tuple of Part


#: What a leaf's rank counts for under its operator.
WEIGHTS = {"+": 1.0, "": 1.0, ">": 1.5, "<": 2 / 3, "~": -0.5}


def split(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def natural(text: str) -> tuple[Part, ...]:
    """A search for any of the words; a word said twice counts once."""
    return tuple(Part("", Leaf((w,))) for w in dict.fromkeys(split(text)))


def boolean(text: str) -> tuple[Part, ...]:
    """A search with operators: +must -not may word* "a phrase" (a group) >more <less ~against."""
    toks = re.findall(r'"[^"]*"|[+\-><~()]|\w+\*?|\S', text.lower())
    parts, at = _group(toks, 0, False)
    return parts


def _group(toks: list[str], at: int, inner: bool) -> tuple[tuple[Part, ...], int]:
    out: list[Part] = []
    while at < len(toks):
        t = toks[at]
        if t == ")":
            if not inner:
                raise SearchError("a group ends that has not begun")
            return tuple(out), at + 1
        op = ""
        if t in "+-><~":
            op, at = t, at + 1
            t = toks[at] if at < len(toks) else ""
            if not t or t in "+-><~)":
                raise SearchError(f"{op} stands before no word")
        if t == "(":
            item, at = _group(toks, at + 1, True)
            if item:
                out.append(Part(op, item))
            continue
        at += 1
        words = tuple(split(t))
        if words:
            out.append(Part(op, Leaf(words, t.endswith("*"))))
    if inner:
        raise SearchError("a group does not end")
    return tuple(out), at


def leaves(parts: tuple[Part, ...]) -> list[Leaf]:
    """Every leaf once, in order."""
    out: dict[Leaf, None] = {}
    for p in parts:
        for leaf in leaves(p.item) if isinstance(p.item, tuple) else [p.item]:
            out.setdefault(leaf)
    return list(out)


def holds(parts: tuple[Part, ...], has) -> str:
    """The condition of a search as SQL text; has: leaf -> SQL of its presence. All that must, none that must not, and one that may where nothing must."""
    one = lambda p: holds(p.item, has) if isinstance(p.item, tuple) else has(p.item)
    must, never, may = [one(p) for p in parts if p.op == "+"], [one(p) for p in parts if p.op == "-"], [one(p) for p in parts if p.op not in "+-" or not p.op]
    if not must and not may:
        return "false"
    positive = " AND ".join(must) if must else "(" + " OR ".join(may) + ")"
    return "(" + " AND ".join([positive, *(f"NOT {n}" for n in never)]) + ")"


def weights(parts: tuple[Part, ...], factor: float = 1.0) -> dict[Leaf, float]:
    """Of each leaf that is wanted: what its rank counts for."""
    out: dict[Leaf, float] = {}
    for p in parts:
        if p.op == "-":
            continue
        own = factor * WEIGHTS[p.op]
        for leaf, w in weights(p.item, own).items() if isinstance(p.item, tuple) else [(p.item, own)]:
            out[leaf] = out.get(leaf, 0.0) + w
    return out


def rank_sql(parts: tuple[Part, ...], count, documents: str, holding) -> str:
    """The rank of a row as SQL text: over wanted leaves, weight x count x idf^2, where idf = log10(documents / documents holding the leaf), and log10(1.0001) where all hold it."""
    terms = []
    for leaf, w in weights(parts).items():
        idf = f"CASE WHEN {holding(leaf)} >= {documents} THEN log10(1.0001D) ELSE log10(try_divide({documents}, {holding(leaf)})) END"
        terms.append(f"coalesce({w!r}D * {count(leaf)} * power({idf}, 2), 0D)")
    return "(" + " + ".join(terms or ["0D"]) + ")"


# --- over a row's own words: no index ----------------------------------------


def words_sql(columns: list[str]) -> str:
    """The words of some text columns as SQL text; a null column has none."""
    return f"regexp_extract_all(lower(concat_ws(' ', {', '.join(columns)})), '[\\\\p{{L}}\\\\p{{N}}_]+', 0)"


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def count_sql(leaf: Leaf, words: str) -> str:
    """How often the words hold a leaf, as SQL text."""
    if len(leaf.words) == 1:
        test = f"startswith(w, {_quoted(leaf.words[0])})" if leaf.prefix else f"w = {_quoted(leaf.words[0])}"
        return f"size(filter({words}, w -> {test}))"
    follow = " AND ".join(f"get(ws, i + {k}) = {_quoted(w)}" for k, w in enumerate(leaf.words) if k)
    return f"aggregate(array({words}), 0, (n, ws) -> n + size(filter(transform(ws, (w, i) -> w = {_quoted(leaf.words[0])} AND {follow}), hit -> hit)))"


# --- over an index -------------------------------------------------------------


@dataclass(frozen=True)
class FullText:
    """An index: rows (word, keys, ends, positions), sorted by word and first key, so that a search reads the files and row groups of its words alone.

    A row holds a word's postings in up to PACK documents: the documents'
    keys and, one document after the other, the places of the word in them;
    ends says where each one's places end.
    """

    key: str
    columns: tuple[str, ...]
    path: str
    documents: int

    def postings(self, spark: SparkSession, condition: Column | None = None) -> DataFrame:
        """(word, key, positions), a row for each word and document."""
        rows = spark.read.parquet(self.path)
        rows = rows if condition is None else rows.where(condition)
        rows = rows.select("word", "ends", "positions", F.posexplode("keys").alias("nth", "key"))
        start = F.when(F.col("nth") == 0, 0).otherwise(F.get("ends", F.col("nth") - 1))
        return rows.select("word", "key", F.slice("positions", start + 1, F.get("ends", "nth") - start).alias("positions"))

    def search(self, spark: SparkSession, parts: tuple[Part, ...], name: str | None = None) -> DataFrame:
        """(key, score) of the documents that a search finds, in no order.

        Postings of the search's words alone are read and grouped by key once;
        a frequent word has a posting a document, so its postings lie in many
        files and no key fills a task.  How many documents hold each leaf is
        counted over the same groups: a row with a number a leaf.
        """
        name = name or self.key
        wanted = leaves(parts)
        if not wanted:
            return self.postings(spark).select(F.col("key").alias(name), F.lit(0.0).alias("score")).where("false")
        rows = self.postings(spark, _any_word(wanted))
        at = lambda leaf, k: f"max(CASE WHEN {_is(leaf, k)} THEN positions END)"
        slots = {}
        for i, leaf in enumerate(wanted):
            if leaf.prefix and len(leaf.words) == 1:
                slots[f"n{i}"] = f"sum(CASE WHEN {_is(leaf, 0)} THEN size(positions) END)"
            for k in range(len(leaf.words)) if f"n{i}" not in slots else ():
                slots[f"p{i}_{k}"] = at(leaf, k)
        found = rows.groupBy("key").agg(*[F.expr(sql).alias(c) for c, sql in slots.items()])
        counts = {}
        for i, leaf in enumerate(wanted):
            if f"n{i}" in slots:
                counts[leaf] = f"coalesce(n{i}, 0)"
            elif len(leaf.words) == 1:
                counts[leaf] = f"coalesce(size(p{i}_0), 0)"
            else:
                follow = " AND ".join(f"array_contains(p{i}_{k}, p + {k})" for k in range(1, len(leaf.words)))
                every = " AND ".join(f"p{i}_{k} IS NOT NULL" for k in range(len(leaf.words)))
                counts[leaf] = f"CASE WHEN {every} THEN size(filter(p{i}_0, p -> {follow})) ELSE 0 END"
        found = found.select("key", *[F.expr(counts[leaf]).alias(f"c{i}") for i, leaf in enumerate(wanted)])
        number = {leaf: i for i, leaf in enumerate(wanted)}
        holding = found.agg(*[F.count_if(F.col(f"c{i}") > 0).alias(f"h{i}") for i in range(len(wanted))])
        rank = rank_sql(parts, lambda leaf: f"c{number[leaf]}", str(self.documents), lambda leaf: f"h{number[leaf]}")
        kept = found.where(holds(parts, lambda leaf: f"c{number[leaf]} > 0")).crossJoin(F.broadcast(holding))  # a single row
        return kept.select(F.col("key").alias(name), F.expr(rank).alias("score"))


def _is(leaf: Leaf, k: int) -> str:
    word = _quoted(leaf.words[k])
    return f"startswith(word, {word})" if leaf.prefix and k == len(leaf.words) - 1 and len(leaf.words) == 1 else f"word = {word}"


def _any_word(wanted: list[Leaf]) -> Column:
    plain = sorted({w for leaf in wanted for w in leaf.words if not (leaf.prefix and len(leaf.words) == 1)})
    out = F.col("word").isin(plain) if plain else F.lit(False)
    for leaf in wanted:
        if leaf.prefix and len(leaf.words) == 1:
            out = out | F.col("word").startswith(leaf.words[0])
    return out


#: Documents, and words of documents, whose postings are packed together at most.
PACK, PACK_WORDS = 10_000, 2_000_000


def _packs(batches):
    """Batches of (key, words) put together up to a pack; a longer document is a pack by itself."""
    held, rows, words = [], 0, 0
    for batch in batches:
        at = 0
        ends = np.cumsum(np.diff(np.asarray(batch.column(1).offsets))) if len(batch) else np.zeros(0, int)
        while at < len(batch):
            base = int(ends[at - 1]) if at else 0
            upto = int(np.searchsorted(ends, base + PACK_WORDS - words, "right"))
            end = min(len(batch), max(upto, at + (not rows)), at + PACK - rows)
            if end > at:
                held.append(batch.slice(at, end - at))
                rows, words = rows + end - at, words + int(ends[end - 1]) - base
            if end < len(batch):
                yield pa.Table.from_batches(held)
                held, rows, words = [], 0, 0
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _packed(batches):
    """(word, keys, ends, positions) of each pack: words sorted, their documents by key, places ascending."""
    for pack in _packs(batches):
        pack = pack.sort_by("key").combine_chunks()
        keys, lists = pack.column("key").combine_chunks(), pack.column("words").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            keys, lists = keys.chunk(0), lists.chunk(0)
        sizes = np.diff(np.asarray(lists.offsets))
        coded = lists.flatten().dictionary_encode()
        codes = np.asarray(coded.indices)
        if not len(codes):
            continue
        document = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(codes, kind="stable")  # documents and places of a word stay in order
        codes, document, place = codes[order], document[order], place[order]
        fresh = np.concatenate([[True], (codes[1:] != codes[:-1]) | (document[1:] != document[:-1])])
        first = np.flatnonzero(fresh)  # of each posting
        begins = np.flatnonzero(np.concatenate([[True], codes[first][1:] != codes[first][:-1]]))  # of each word, among postings
        starts = first[begins]  # among places
        ends = np.append(first[1:], len(codes)) - np.repeat(starts, np.diff(np.append(begins, len(first))))
        by_posting = pa.array(np.append(begins, len(first)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(codes[starts])),
                pa.ListArray.from_arrays(by_posting, keys.take(pa.array(document[first]))),
                pa.ListArray.from_arrays(by_posting, pa.array(ends, pa.int32())),
                pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)), pa.int32()), pa.array(place, pa.int32())),
            ],
            ["word", "keys", "ends", "positions"],
        )


def build(df: DataFrame, key: str, columns: list[str], path: str | None = None) -> FullText:
    """Writes the index of some text columns and returns it.

    Texts of several columns are one text; null columns have no words, and a
    row without words counts as a document that nothing finds.  Rows without
    a key are left out; rows that share one would be taken for one document
    and are an error.  The postings of some PACK documents are packed by word
    before they move, once, into ranges of words; a word of many documents has
    many rows, so it may fill several ranges.
    """
    spark = df.sparkSession
    path = path or os.path.join(shared_dir(spark), f"fulltext-{uuid.uuid4().hex}")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.expr(words_sql([f"`{c}`" for c in columns])).alias("words"))
    total, distinct = rows.agg(F.count(F.lit(1)), F.count_distinct("key")).first()
    if total != distinct:
        raise ValueError(f"{key} is not a key: {total - distinct} rows repeat one")
    schema = f"word string, keys array<{rows.schema['key'].dataType.simpleString()}>, ends array<int>, positions array<int>"
    packed = rows.mapInArrow(_packed, schema)
    packed.repartitionByRange("word", F.get("keys", F.lit(0))).sortWithinPartitions("word", F.get("keys", F.lit(0))).write.parquet(path)
    return FullText(key, tuple(columns), path, total)
