"""Byte-level BPE by folds in Spark's higher-order functions.

A token is held as one character, its id plus 256, so a sequence of tokens is
a string and a pair of tokens a string of two.  The rank map, a literal, sends
a pair to the token that it merges to; ids are ranks, so the least result is
the pair to merge first.  A second literal has the one pair that merges to a
token, so the least result says what to replace and nobody looks for its
place.  A fold over the bytes of a word replaces that pair, left to right,
until no pair is in the map.  A fold takes as many steps over as
many pairs, so a word of more than LONG bytes (a blob, a run of spaces) is
merged with a heap when its tokens are gathered, by the same pairs.

Texts are split by the pattern in the JVM.  A task gathers some millions of
words, numbers the distinct ones and has only those folded; the texts, as word
numbers, follow in the same stream and pick their tokens up.  Nothing is
shuffled.  Decoding concatenates the tokens' binary pieces.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

_OFF = 256
#: Buckets of the rank map; a lookup scans one bucket.
BUCKETS = 1 << 15
#: Words that a task gathers before their distinct ones are folded, and distinct words in a row on the way to the fold.
GATHER, ROW = 6_000_000, 512
#: Words of a text in a row at most, so that an Arrow batch is small however long the texts; rows whose words are numbered at a time.
PIECE, STEP = 32, 10_000
#: Tokens that are looked up at a time.
TOKENS = 1_000_000
#: Words of more bytes are merged with a heap.
LONG = 128
#: Marks of a token string: all merges done; none done.
_DONE, _RAW = "\x01", "\x02"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes, then its rank, on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The last merge of every longer token: the pair of ids that its own encoding ends with. Other pairs that spell the token never meet."""
    out = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:])]
            i = found.index(min(found))
            if found[i] == len(ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out[ranks[parts[0]], ranks[parts[1]]] = rank
    return out


def merged(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """ids with all merges of `pairs` done, the least result first and of equal ones the leftmost, in time n log n."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ids = list(ids)
    heap = [(c, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (c := pairs.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        c, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = c, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (d := pairs.get((c, ids[k]))) is not None:
                heapq.heappush(heap, (d, i, c, ids[k]))
        h = before[i]
        if h >= 0 and (d := pairs.get((ids[h], c))) is not None:
            heapq.heappush(heap, (d, h, ids[h], c))
    return [x for x in ids if x >= 0]


def _bucket(s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


class ByteBPE:
    """A vocabulary as the expressions that encode with it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) + _OFF >= 0xD800:
            raise ValueError("ids must fit below the surrogates")
        self.ranks, self.pattern = ranks, pattern
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        self.pairs = merge_pairs(ranks)
        merges = [""] * (max(ranks.values()) + 1)
        for (a, b), c in self.pairs.items():
            pair = chr(a + _OFF) + chr(b + _OFF)
            buckets[_bucket(pair)][pair] = c
            merges[c] = pair + chr(c + _OFF)
        self.rank_map = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
        self.merges = F.from_json(F.lit(json.dumps(merges)), "array<string>")
        self.raw = "".join(map(chr, range(256)))
        self.first = "".join(chr(ranks[bytes([x])] + _OFF) for x in range(256))

    def split(self, text):
        """A text column's words by the pattern; white space as Unicode has it."""
        return F.regexp_extract_all(text, F.lit(f"(?U){self.pattern}"), F.lit(0))

    def encode_words(self, words):
        """An array of words as an array of token strings; a word of more than LONG bytes as its bytes' tokens after a mark."""

        def let(x, f):
            return F.element_at(F.transform(F.array(x), f), 1)

        def with_maps(ranks, merges):
            def look(pair):
                return F.try_element_at(F.get(ranks, F.pmod(F.xxhash64(pair), F.lit(BUCKETS)).cast("int")), pair)

            def step(tokens, _):
                pairs = F.transform(F.sequence(F.lit(1), F.length(tokens) - 1), lambda i: F.substring(tokens, i, F.lit(2)))

                def merged(merge):
                    return F.when(merge.isNull(), F.concat(F.lit(_DONE), tokens)).otherwise(F.replace(tokens, F.substring(merge, 1, 2), F.substring(merge, 3, 1)))

                return F.when(F.startswith(tokens, F.lit(_DONE)) | (F.length(tokens) == 1), tokens).otherwise(let(F.get(merges, F.array_min(F.transform(pairs, look))), merged))

            def encode(word):
                raw = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), self.raw, self.first)
                fold = lambda r: F.aggregate(F.sequence(F.lit(1), F.length(r)), r, step, lambda t: F.replace(t, F.lit(_DONE), F.lit("")))
                return let(raw, lambda r: F.when(F.length(r) > LONG, F.concat(F.lit(_RAW), r)).otherwise(fold(r)))

            return F.transform(words, encode)

        return let(self.rank_map, lambda ranks: let(self.merges, lambda merges: with_maps(ranks, merges)))


class Pieces:
    """Binary pieces by id, for decoding."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {i: t for t, i in ranks.items()}
        self.by_id = pa.array(map(by_id.get, range(max(by_id) + 1)), pa.large_binary())

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes that ids stand for, cut where `ends` says that a text's ids end."""
        found = self.by_id.take(pa.array(ids))
        if found.null_count:
            raise ValueError("an id without a piece")
        places, data = _flat(found)
        return _cut(data, places[np.r_[0, ends]])


def _flat(binary: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Where the rows of an array of large binary begin and end, and the bytes they lie in."""
    _, places, data = binary.buffers()
    return np.frombuffer(places, "<i8")[binary.offset : binary.offset + len(binary) + 1], data or pa.py_buffer(b"")


def _cut(data: pa.Buffer, places: np.ndarray) -> pa.Array:
    """Rows of binary that lie one after the other in `data`, from each place to the next."""
    return pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(np.ascontiguousarray(places, "<i8")), data]).cast(pa.binary())


def encoded(docs: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row; ids: little-endian unsigned 32-bit integers. decode: also `decoded`, the bytes that the ids stand for.

    A null text counts as empty: no tokens.  Repeated rows come back as often
    as they are, in the order of the input.
    """
    kind = docs.schema[id_col].dataType
    words = docs.select(F.col(id_col).alias("doc_id"), bpe.split(F.coalesce(F.col(text_col), F.lit(""))).alias("all"))
    places = F.sequence(F.lit(1), F.greatest(F.size("all"), F.lit(1)), F.lit(PIECE))
    words = words.select("doc_id", "all", F.explode(places).alias("at"))  # the pieces of a text stay together, in order
    words = words.select("doc_id", F.slice("all", F.col("at"), PIECE).alias("words"), (F.col("at") + PIECE > F.size("all")).alias("last"))

    def number(batches):
        """Rows of distinct words first, then the pieces of texts as numbers of words (2, and 3 for a text's last); again for each GATHER words."""
        strings = pa.list_(pa.string())

        def out(held):
            numbered = pa.chunked_array([h[2] for h in held]).unify_dictionaries()
            distinct = numbered.chunk(0).dictionary
            fresh = 1
            for i in range(0, len(distinct), ROW * 64):
                end = min(i + ROW * 64, len(distinct))
                at = np.r_[np.arange(i, end, ROW), end].astype(np.int32)
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([pa.nulls(n, held[0][0].type), pa.array([fresh] + [0] * (n - 1), pa.int32()), pa.nulls(n, pa.binary()), pa.ListArray.from_arrays(pa.array(at), distinct).cast(strings)], ["doc_id", "fresh", "index", "words"])
                fresh = 0
            for (ids, ends, _, last), chunk in zip(held, numbered.chunks):
                index = chunk.indices.to_numpy().astype("<i4", copy=False)
                parts = _cut(pa.py_buffer(index), np.r_[0, ends] * 4)
                yield pa.RecordBatch.from_arrays([ids, pa.array(2 + last.astype(np.int32)), parts, pa.nulls(len(parts), strings)], ["doc_id", "fresh", "index", "words"])

        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, STEP):  # word by word texts are large: only their numbers are kept
                part = b.slice(i, STEP)
                words = part.column("words")
                numbers = pc.list_flatten(words).dictionary_encode()
                held.append((pa.concat_arrays([part.column("doc_id")]), np.cumsum(pc.list_value_length(words).to_numpy()), numbers, part.column("last").to_numpy(zero_copy_only=False)))
                size += len(numbers)
                del part, words, numbers
                if size >= GATHER:
                    yield from out(held)
                    held, size = [], 0
            del b
        if held:
            yield from out(held)
        del held
        tidy()

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fresh", T.IntegerType()), T.StructField("index", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType()))])
    folded = words.mapInArrow(number, schema).select("doc_id", "fresh", "index", F.when(F.col("fresh") < 2, bpe.encode_words(F.col("words"))).alias("tokens"))
    ranks, pairs = (docs.sparkSession.sparkContext.broadcast(x) for x in (bpe.ranks if decode else None, bpe.pairs))  # the vocabulary

    def gather(batches):
        pieces = Pieces(ranks.value) if decode else None

        def rows_of(tokens):
            """Token strings as ids, and how many each has."""
            words = tokens.flatten()
            raw = np.flatnonzero(pc.starts_with(words, _RAW).to_numpy(zero_copy_only=False))
            if len(raw):
                words = words.to_pylist()
                for i in raw.tolist():
                    words[i] = "".join(chr(x + _OFF) for x in merged([ord(x) - _OFF for x in words[i][1:]], pairs.value))
                words = pa.array(words, pa.string())
            text = b"".join(words.cast(pa.binary()).to_pylist()).decode()
            return np.frombuffer(text.encode("utf-32-le"), "<u4") - np.uint32(_OFF), pc.utf8_length(words).to_numpy()

        def texts(ids, states, index):
            """Rows of what the pieces of texts come to, some TOKENS at a time."""
            nonlocal begun
            where = np.frombuffer(index.buffers()[1], "<i4")[index.offset : index.offset + len(index) + 1] // 4
            words = np.frombuffer(index.buffers()[2] or b"", "<i4")[: where[-1]]
            size = np.diff(_flat(table)[0]) // 4
            upto = np.r_[0, np.cumsum(size[words[where[0] :]])][where - where[0]]  # tokens before each piece
            cuts = np.flatnonzero(np.diff(upto[:-1] // TOKENS)) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(index)]):
                got = np.frombuffer(_flat(table.take(pa.array(words[where[s] : where[e]])))[1], "<u4")[: upto[e] - upto[s]]
                ended = np.flatnonzero(states[s:e] == 3)
                if not len(ended):
                    begun.append(got)
                    continue
                ends = upto[s + 1 + ended] - upto[s] + sum(map(len, begun))
                got = np.concatenate([*begun, got])
                begun = [got[ends[-1] :].copy()]
                cols = [ids.take(pa.array(s + ended)), pa.array(np.diff(np.r_[0, ends])), _cut(pa.py_buffer(got), np.r_[0, ends] * 4)]
                if decode:
                    cols.append(pieces.decode(got[: ends[-1]], ends))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids"] + ["decoded"] * decode)

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        table = None
        begun: list[np.ndarray] = []  # the pieces so far of a text
        for b in batches:
            states = b.column("fresh").to_numpy()
            is_doc = states >= 2
            cuts = np.flatnonzero(np.r_[True, is_doc[1:] != is_doc[:-1], True]) if b.num_rows else np.zeros(0, int)
            for s, e in zip(cuts, cuts[1:]):
                if not is_doc[s]:
                    if table is not None:
                        parts, table = [], None
                    parts.append(rows_of(b.column("tokens").slice(s, e - s)))
                    continue
                if table is None:
                    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(n for _, n in parts)])) * 4
                    table = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([np.zeros(0, "<u4"), *(i for i, _ in parts)]))])
                    parts = []
                yield from texts(b.column("doc_id").slice(s, e - s), states[s:e], b.column("index").slice(s, e - s))
        del parts, table, begun
        tidy()

    final = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return folded.mapInArrow(gather, final.add("decoded", "binary") if decode else final)


def decoded(tokens: DataFrame, bpe: ByteBPE, ids_col: str = "ids") -> DataFrame:
    """tokens with `decoded`: the concatenated pieces of ids (little-endian unsigned 32-bit integers); of null ids, null."""
    ranks = tokens.sparkSession.sparkContext.broadcast(bpe.ranks)

    def fn(batches):
        pieces = Pieces(ranks.value)
        for b in batches:
            ids = [np.frombuffer(x or b"", "<u4") for x in b.column(ids_col).to_pylist()]
            text = pieces.decode(np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pc.if_else(b.column(ids_col).is_null(), pa.scalar(None, pa.binary()), text)], [*b.schema.names, "decoded"])

    tokens = tokens.drop("decoded")
    return tokens.mapInArrow(fn, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, bpe: ByteBPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded(), decoded again."""
    both = encoded(docs, bpe, id_col, text_col, decode=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
