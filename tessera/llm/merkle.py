"""Document fingerprints: Merkle trees over paragraphs and sections.

Leaves are runs of words of a paragraph (a line) that end where a word's hash
says so, so every character is in one leaf and an insertion moves no later
border.  A paragraph's digest is that of its leaves; a section is a run of
paragraphs that ends where a paragraph's digest says so; the root digests the
sections.  Equal roots mean equal texts.  Where roots differ, only branches
that differ are followed, down to the leaves, which tells how alike two texts
are and locates the edits.

A fingerprint is the root's digest and, after a colon, the tree: each leaf as
its short digest and its length; ``.`` ends a paragraph and ``/`` a section.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_column

#: One word in so many ends a leaf; code points of a leaf at most.
LEAF, LONGEST = 8, 256
#: One paragraph in so many ends a section.
SECTION = 8
#: Hexadecimal digits of a leaf in a fingerprint: of its digest, and of its length less one.
_SHORT, _SIZE = 6, 2


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass
class Tree:
    """root; for each section its digest and paragraphs; for each paragraph its digest and leaves (digest and code points)."""

    root: bytes
    sections: list[tuple[bytes, list[tuple[bytes, list[tuple[bytes, int]]]]]]

    @property
    def leaves(self) -> list[tuple[bytes, int]]:
        return [x for _, paragraphs in self.sections for _, leaves in paragraphs for x in leaves]

    def __str__(self) -> str:
        return self.root.hex() + ":" + "/".join(".".join("".join(f"{x.hex()[:_SHORT]}{n - 1:02x}" for x, n in leaves) for _, leaves in ps) for _, ps in self.sections)


def cut(line: str) -> list[str]:
    """The leaves of a paragraph; an empty one has none."""
    words = line.split(" ")
    last = len(words) - 1
    ends = [zlib.crc32(w.encode()) % LEAF == 0 for w in words]
    out, start, at = [], 0, 0
    for i, w in enumerate(words):
        size = len(w) + (i < last)
        if at + size - start > LONGEST:  # too long: cut before the word, and a long word in itself
            if at > start:
                out.append(line[start:at])
                start = at
            while at + size - start > LONGEST:
                out.append(line[start : start + LONGEST])
                start += LONGEST
        at += size
        if ends[i] and at > start:
            out.append(line[start:at])
            start = at
    if at > start:
        out.append(line[start:at])
    return out


def tree(text: str) -> Tree:
    """The tree of a text; an empty text is one paragraph with no leaf."""
    sections, run = [], []
    blake = hashlib.blake2b
    for line in text.split("\n"):
        leaves = [(blake(x.encode(), digest_size=16).digest(), len(x)) for x in cut(line)]
        own = _digest(b"p" + b"".join(x for x, _ in leaves))
        run.append((own, leaves))
        if own[0] % SECTION == 0:
            sections.append((_digest(b"s" + b"".join(p for p, _ in run)), run))
            run = []
    if run:
        sections.append((_digest(b"s" + b"".join(p for p, _ in run)), run))
    return Tree(_digest(b"r" + b"".join(s for s, _ in sections)), sections)


def _split(branches: list[str], level: int) -> list[str]:
    """The children of branches: of sections their paragraphs, of paragraphs their leaves."""
    if level == 0:
        return [p for s in branches for p in s.split(".")]
    width = _SHORT + _SIZE
    return [p[i : i + width] for p in branches for i in range(0, len(p), width)]


def _points(branch: str) -> int:
    """Code points under a branch."""
    width = _SHORT + _SIZE
    return sum(int(p[i + _SHORT : i + width], 16) + 1 for p in branch.split(".") for i in range(0, len(p), width))


def likeness(a: str, b: str) -> float:
    """Code points that two trees share, as a share of all (Dice, repeats counted): 1 for equal roots, else below 1.

    Sections that both have are shared whole; of the others the paragraphs are
    compared, and of those that differ the leaves.
    """
    root_a, _, rest_a = a.partition(":")
    root_b, _, rest_b = b.partition(":")
    if root_a == root_b:
        return 1.0
    x, y = rest_a.split("/"), rest_b.split("/")
    shared = 0
    for level in range(3):
        own, other = Counter(x), Counter(y)
        both = own & other
        shared += sum(n * _points(branch) for branch, n in both.items())
        if level < 2:
            x, y = _split(list((own - both).elements()), level), _split(list((other - both).elements()), level)
    n = sum(map(_points, rest_a.split("/"))) + sum(map(_points, rest_b.split("/")))
    return min(2 * shared / n, 1 - 1 / (n + 1)) if n else 0.0


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where texts a and b differ: (first paragraph, end) in a and in b of each differing stretch, found by following differing branches."""
    from difflib import SequenceMatcher

    x, y = tree(a), tree(b)
    if x.root == y.root:
        return []
    out, at_a, at_b = [], [0], [0]
    for at, t in ((at_a, x), (at_b, y)):
        for _, ps in t.sections:
            at.append(at[-1] + len(ps))
    sections = SequenceMatcher(None, [s for s, _ in x.sections], [s for s, _ in y.sections], autojunk=False)
    for what, i, j, k, m in sections.get_opcodes():
        if what == "equal":
            continue
        pa_, pb = [p for _, ps in x.sections[i:j] for p, _ in ps], [p for _, ps in y.sections[k:m] for p, _ in ps]
        for kind, s, e, u, v in SequenceMatcher(None, pa_, pb, autojunk=False).get_opcodes():
            if kind != "equal":
                out.append((at_a[i] + s, at_a[i] + e, at_b[k] + u, at_b[k] + v))
    return out


def spans(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where texts a and b differ, in code points: (from, to) in a and in b of each differing run of leaves."""
    from difflib import SequenceMatcher

    lines_a, lines_b = a.split("\n"), b.split("\n")
    starts_a, starts_b = [0], [0]
    for starts, lines in ((starts_a, lines_a), (starts_b, lines_b)):
        for x in lines:
            starts.append(starts[-1] + len(x) + 1)
    out = []
    for i, j, k, m in edits(a, b):
        if j - i == m - k:
            for p, q in zip(range(i, j), range(k, m)):
                x, y = cut(lines_a[p]), cut(lines_b[q])
                at_x, at_y = [starts_a[p]], [starts_b[q]]
                for at, leaves in ((at_x, x), (at_y, y)):
                    for leaf in leaves:
                        at.append(at[-1] + len(leaf))
                for what, s, e, u, v in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                    if what != "equal":
                        out.append((at_x[s], at_x[e], at_y[u], at_y[v]))
        else:
            out.append((min(starts_a[i], len(a)), min(starts_a[j], len(a)), min(starts_b[k], len(b)), min(starts_b[m], len(b))))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row; null counts as empty."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def fn(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([str(tree(t)) for t in b.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(fn, T.StructType([T.StructField("doc_id", kind), T.StructField("fingerprint", T.StringType())]))


def _bucket(cuts: list[int], value):
    """How many of the ascending `cuts` are at most the value, by bisection."""
    if not cuts:
        return F.lit(0)
    own = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(own, mid) <= value
        moved = F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, step, lambda s: s["lo"])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Rows (part, tail, doc_id, h, packed) dealt so that the next document's row is near: parts are ranges of ids, each
    sorted; a row with tail = 1 at the end of a part is the first row of the part after (after the last: of the first).

    Texts move once, packed by zlib. Ids must be integers; null ids come first, and rows that repeat an id follow by a hash of the text.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [F.lit(i / parts) for i in range(1, parts)]
    got = rows.agg(F.percentile_approx("doc_id", F.array(*shares), 100_000)).first()[0] if shares else []
    cuts = sorted(set(got or []))  # fewer than `parts`
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket(cuts, F.col("doc_id"))).cast("int")
    rows = rows.withColumn("part", part)
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("doc_id").isNotNull().alias("some"), F.xxhash64("text").alias("h"))
    first = {r.part: (r.k.id, r.k.some, r.k.h) for r in rows.groupBy("part").agg(F.min(key).alias("k")).collect()}  # one row a part
    there = sorted(first)
    lead = spark.createDataFrame([(p, there[i - 1], *first[p]) for i, p in enumerate(there)], "p int, before int, id long, some boolean, h long")
    met = rows.join(F.broadcast(lead), F.col("part") == F.col("p"))  # a row a part
    is_first = F.col("doc_id").eqNullSafe(F.when(F.col("some"), F.col("id"))) & (F.xxhash64("text") == F.col("h"))
    own, ahead = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("part"), F.lit(1).alias("tail"))
    packed = arrow_column(lambda column: pa.array([zlib.compress(t, 1) for t in column.cast(pa.binary()).to_pylist()], pa.binary()), "binary")
    dealt = met.select(F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own))).alias("at"), "doc_id", F.xxhash64("text").alias("h"), packed("text").alias("packed"))
    dealt = dealt.select("at.part", "at.tail", "doc_id", "h", "packed").repartitionById(len(cuts) + 1, F.col("part"))
    return dealt.sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "h")


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next), one row a document.

    The edited text has the last half of the code points replaced by as many
    of the next document's first (or all of them).  A null text counts as
    empty; a table of one row is its own next document.
    """

    def fn(batches):
        held = None
        out: list[tuple] = []

        def pair(a, b):
            (doc, text, mark), (_, after, mark_b) = a, b
            n = len(text)
            edited = text[: n - n // 2] + after[: n // 2]
            mark_e = mark if edited == text else str(tree(edited))
            return doc, n, edited, mark, mark_e, likeness(mark, mark_e), likeness(mark, mark_b)

        names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            return batch

        for b in batches:
            for part, tail, doc, packed in zip(*(b.column(c).to_pylist() for c in ("part", "tail", "doc_id", "packed"))):
                if tail and (held is None or held[0] != part):
                    continue  # the part's last row has met its next one
                text = zlib.decompress(packed).decode()
                row = (doc, text, str(tree(text)))
                if held is not None:
                    out.append(pair(held[1], row))
                held = None if tail else (part, row)
                if len(out) >= 500:
                    yield flush()
        if out:
            yield flush()

    return with_next(docs, id_col, text_col).mapInArrow(fn, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """edit_likeness() with edited_sha256 in place of the edited text."""
    got = edit_likeness(docs, id_col, text_col)
    return got.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
