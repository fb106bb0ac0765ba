"""Token counts for a sentencepiece BPE model, by a whole-token shortcut.

The model's pieces tell where merges can never cross: a space mark never
follows another character inside a piece, and some characters are in no longer
piece at all.  A text falls apart at those places into pre-tokens that encode
alone.  Offline, once, the merges are run on each piece of the vocabulary; those
that come out as one token form the table of whole tokens.  A pre-token in the
table counts one, with no merging; the rest are merged, once per distinct
pre-token and worker.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SPACE = "▁"
LIMIT = 4_096
#: Distinct pre-tokens that a worker remembers.
CACHE = 400_000
#: Longer pre-tokens are merged with a heap instead of scans.
SHORT = 24


class PieceCounter:
    """Counts tokens as the model does, without begin, end or control tokens."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or train.model_type != 2:
            raise ValueError("only BPE models with the identity normaliser, a leading space mark and kept white space are known")
        kinds = proto.ModelProto.SentencePiece if hasattr(proto, "ModelProto") else pb.ModelProto.SentencePiece
        normal = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not known")
        self.score = normal
        self.bytes = train.byte_fallback
        long = [p for p in normal if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            raise ValueError("a piece has a space mark inside; pre-tokens would not be independent")
        self.joined = {c for p in long for c in p}
        self.newline_alone = "\n" not in self.joined
        self.whole = {p for p in normal if self.merge(p) == 1}
        self.cache: dict[str, int] = {}

    def cost(self, symbol: str) -> int:
        """Tokens of a symbol that no merge takes in."""
        return 1 if symbol in self.score or not self.bytes else len(symbol.encode())

    def merge(self, unit: str) -> int:
        """Tokens of a pre-token by its merges: the best score first, then the leftmost."""
        if len(unit) > SHORT:
            return self._merge_long(unit)
        parts, score = list(unit), self.score
        ranks = [score.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = score.get(parts[at] + parts[at + 1])
        return sum(map(self.cost, parts))

    def _merge_long(self, unit: str) -> int:
        total, run = 0, []
        for c in unit:  # characters in no longer piece stand alone
            if c in self.joined:
                run.append(c)
                continue
            total += self.cost(c) + (self._merge_run(run) if run else 0)
            run = []
        return total + (self._merge_run(run) if run else 0)

    def _merge_run(self, parts: list[str]) -> int:
        n, score = len(parts), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, parts[i], parts[i + 1]) for i in range(n - 1) if (s := score.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (s := score.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (-s, h, parts[h], parts[i]))
        return sum(self.cost(p) for p in parts if p)

    def unit(self, u: str) -> int:
        if u in self.whole:
            return 1
        got = self.cache.get(u)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[u] = self.merge(u)
        return got

    def count(self, text: str) -> int:
        """Tokens of a text; none in an empty one."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        total, unit = 0, self.unit
        if self.newline_alone:
            parts = text.split("\n")
            total = (len(parts) - 1) * self.cost("\n")
        else:
            parts = [text]
        marked: Counter[str] = Counter()  # words after one space mark, without it
        whole, cache = self.whole, self.cache
        for part in parts:
            if SPACE * 2 in part or part.endswith(SPACE):
                total += sum(map(unit, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", part)))
                continue
            first, *rest = part.split(SPACE)
            if first:
                total += unit(first)
            marked.update(rest)
        for w, n in marked.items():
            u = SPACE + w
            if u in whole:
                total += n
            else:
                c = cache.get(u)
                total += n * (unit(u) if c is None else c)
        return total


def token_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; null counts as empty: no bytes and no tokens.

    `model` is the content of the model file (half a MB), sent with the tasks.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def fn(batch):
        counter = _counter(model)
        got = [counter.count(t) for t in batch.column("text").to_pylist()]
        size = [len(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(got, pa.int64()), pa.array([g > limit for g in got])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(rows, fn, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


_COUNTERS: dict[int, PieceCounter] = {}


def _counter(model: bytes) -> PieceCounter:
    """One counter a worker process and model."""
    key = hash(model)
    if key not in _COUNTERS:
        _COUNTERS[key] = PieceCounter(model)
    return _COUNTERS[key]
