"""SimHash near-duplicates linked through a Gray-order hierarchical index.

Fingerprints are sorted by their rank in the reflected Gray code, so that
neighbours differ in few bits.  Runs of neighbours form the nodes of a tree: a
node holds the bits on which everything below it agrees, each bit in the
highest node where it is shared.  A search adds up differences on the way down
and drops a whole group once they exceed the bound.

Across executors the first level of the tree is fixed: of three masks that cut
the 64 bits into blocks, two fingerprints that differ in at most two bits agree
under one at least.  Rows meet per masked pattern, and a tree is built there.
A pattern shared by more than ``HOT`` fingerprints is refined by masks over the
remaining bits (again three, again exact) before rows meet.

``similar_groups`` links by the similarity of 5-word shingles instead.  There
the index is built over wider fingerprints and only proposes: at a similarity
of 0.8 two fingerprints differ in 15 of 100 bits, masks that such a distance
leaves whole are too short to part documents, and so rows meet by bands of
minima of their shingles' hashes.  What the index proposes is verified on the
shingles themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, texts, tidy

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Children of a node of the index.
FAN = 8
#: A masked pattern with more fingerprints is refined before its rows meet in a task.
HOT = 2_000
#: Refinements at most; what is left is searched in one task, in blocks of queries.
LEVELS = 4
_CHUNK = 65_536


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the 3-word shingles (repeats included); 0 without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(t) for t in zip(words, words[1:], words[2:])]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(shingles), _CHUNK):
        h = np.array([digest(s, SEED) for s in shingles[i : i + _CHUNK]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row a document; fp is the fingerprint as a signed long."""

    def fn(batch):
        fps = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, fn, f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Rank of each word in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """The tree over uint64 fingerprints (a row of words each, or one word); see the module's docstring.

    segments: a number a fingerprint; only fingerprints of one segment (a
    masked pattern) stand under a common node, so many small trees are built
    and searched at once.
    """

    def __init__(self, fps: np.ndarray, segments: np.ndarray | None = None):
        seg = np.zeros(len(fps), np.int64) if segments is None else segments
        ranks = gray_rank(fps.reshape(len(fps), -1))
        self.order = np.lexsort((*ranks.T[::-1], seg))
        self.fps, seg = fps[self.order], seg[self.order]
        self.segments = seg
        pattern = self.fps.reshape(len(fps), -1)
        mask = np.full(pattern.shape, ~np.uint64(0))
        #: From the leaves up: pattern and mask of own bits; the first child of each node and the end of its children.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        low, high = np.arange(len(seg)), np.arange(1, len(seg) + 1)
        while True:
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]][: len(seg)])
            size = np.diff(np.r_[first, len(seg)])
            place = np.arange(len(seg)) - np.repeat(first, size)
            if size.max(initial=0) <= FAN:
                break
            starts = place % FAN == 0
            at, of = np.flatnonzero(starts), np.cumsum(starts) - 1
            every, some = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
            common = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
            self.levels.append((pattern, mask & ~common[of], low, high))
            pattern, mask, seg = every & common, common, seg[at]
            low, high = at, np.r_[at[1:], len(of)]
        self.levels.append((pattern, mask, low, high))
        self.tops = seg[first] if len(seg) else seg, first, size

    def search(self, queries: np.ndarray, most: int = MAX_BITS, segments: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query's place, fingerprint's place) of every pair within `most` bits; segments: that of each query."""
        if not len(self.fps):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        queries = queries.reshape(len(queries), -1)
        names, first, size = self.tops
        at = np.searchsorted(names, np.zeros(len(queries), np.int64) if segments is None else segments)
        q, node = _ranges(np.arange(len(queries)), first[at], first[at] + size[at])
        far = np.zeros(len(q), np.uint16)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask, low, high = self.levels[depth]
            for word in range(pattern.shape[1]):  # a word at a time: most groups fall at the first
                far = far + np.bitwise_count((queries[q, word] ^ pattern[node, word]) & mask[node, word])
                keep = far <= most
                q, node, far = q[keep], node[keep], far[keep]
            if depth:
                count = high[node] - low[node]
                q, far, node = np.repeat(q, count), np.repeat(far, count), _ranges(node, low[node], high[node])[1]
        return q, node


def _ranges(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each name with each number from its low to before its high."""
    count = high - low
    past = np.cumsum(count) - count
    return np.repeat(names, count), np.arange(count.sum()) - np.repeat(past - low, count)


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root with the components of a and b joined, pair by pair; the smallest place names a component."""
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low < high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != root[root]).any():
            root = root[root]
    return root


def local_links(fps: np.ndarray, segments: np.ndarray | None = None, most: int = MAX_BITS, pairs: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group of linked fingerprints of one segment: (a fingerprint's place, the place of the group's first one).

    pairs: about so many are looked at at a time.
    """
    index = GrayIndex(fps, segments)
    n = len(fps)
    root = np.arange(n)
    names, first, size = np.unique(index.segments, return_index=True, return_counts=True)
    past = np.cumsum(np.repeat(size, size))  # pairs that the queries so far may meet
    block = 0
    while block < n:
        end = max(block + 1, int(np.searchsorted(past, (past[block - 1] if block else 0) + pairs, "right")))
        q, other = index.search(index.fps[block:end], most, index.segments[block:end])
        q = q + block
        root = _roots(root, q[other > q], other[other > q])
        block = end
    linked = np.flatnonzero(root != np.arange(n))
    return index.order[linked], index.order[root[linked]]


def _buckets(batches, key: str, rows: int = 1 << 17):
    """Batches sorted by `key`, as tables that hold whole keys and about `rows` rows."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            together = pa.Table.from_batches(held).combine_chunks()
            keys = together.column(key).to_numpy()
            cut = int(np.searchsorted(keys == keys[-1], True))  # False ... True: where the last key begins
            if cut:
                yield together.slice(0, cut)
            held = together.slice(cut).to_batches()
            size = len(keys) - cut
            rows = max(rows, 2 * size)  # a key of its own beyond `rows` is gathered in doubling steps
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _met(words: list[str], most: int):
    """For mapInArrow over rows (key, node, words) sorted by key: stars (a, b) of nodes that a key's index links."""

    def fn(batches):
        for t in _buckets(batches, "key"):
            _, seg, size = np.unique(t.column("key").to_numpy(), return_inverse=True, return_counts=True)
            many = np.flatnonzero(size[seg] > 1)
            if len(many):
                node = t.column("node").to_numpy()[many]
                fps = np.column_stack([t.column(w).to_numpy()[many] for w in words]).view(np.uint64)
                a, b = local_links(fps, seg[many], most)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])
        tidy()

    return fn


def _masks(bits: int) -> list[int]:
    """Three masks that cut the set bits of `bits` into runs of about the same number."""
    at = [i for i in range(64) if bits >> i & 1]
    cut = [0, len(at) // 3, 2 * len(at) // 3, len(at)]
    return [sum(1 << i for i in at[a:b]) for a, b in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, bits_free: list[tuple[str, int]]) -> DataFrame:
    """Rows (fp, path): each once per mask under its path; path names the masks so far."""
    options = []
    for path, free in bits_free:
        full = ~free & (1 << 64) - 1
        ways = [
            F.struct(F.lit(f"{path}{k}").alias("path"), F.xxhash64(F.lit(f"{path}{k}"), F.col("fp").bitwiseAND(F.lit(_signed(full | m)))).alias("key"))
            for k, m in enumerate(_masks(free))
        ]
        options.append((path, F.array(*ways)))
    ways = options[0][1] if len(options) == 1 else F.coalesce(*[F.when(F.col("path") == p, w) for p, w in options])
    return rows.select("fp", F.explode(ways).alias("way")).select("fp", "way.path", "way.key")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): edges over distinct fingerprints whose components are those of all links of at most MAX_BITS bits."""
    rows, level = fps.select("fp", F.lit("").alias("path")), 0
    free = [("", (1 << 64) - 1)]
    ready = []
    while True:
        keyed = _keyed(rows, free)
        level += 1
        if level == LEVELS:
            ready.append(keyed.select("fp", "key"))
            break
        keyed = stored(keyed, "simhash-keys")
        hot = stored(keyed.groupBy("key").count().where(F.col("count") > HOT).select("key"), "simhash-hot")
        if hot.isEmpty():
            ready.append(keyed.select("fp", "key"))
            break
        marked = keyed.join(hot.withColumn("hot", F.lit(True)), "key", "left")
        ready.append(marked.where(F.col("hot").isNull()).select("fp", "key"))
        rows = marked.where(F.col("hot")).select("fp", "path")
        free = [(f"{p}{k}", f & ~m) for p, f in free for k, m in enumerate(_masks(f))]
    together = ready[0]
    for r in ready[1:]:
        together = together.unionByName(r)

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = together.select("key", F.col("fp").alias("node")).repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_met(["node"], MAX_BITS), "a long, b long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node of each component with an edge, by alternating large and small stars.

    Each round moves edges toward smaller nodes through grouped minima and a
    join; no neighbour list is gathered, so a node with many edges does not
    fill a task.  Ends when a round changes nothing; an error if `rounds` rounds
    do not get there.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")

    def state(e):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()

    before = state(edges)
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        edges = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = stored(edges, "cc-large")
        low = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        near = edges.join(low, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = near.union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
        edges = stored(edges, "cc-small")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints link at MAX_BITS or fewer differing bits.

    component_id is the smallest id reachable over links, the row's own
    included.  A null text counts as empty; texts without words have the
    fingerprint zero, linked like any other.  A row without an id is linked but
    never names a component (null where no row of the component has an id).
    Repeated rows come back as often as they are.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "simhash-rows")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    comp = stored(components(links(distinct)), "simhash-components")
    named = comp.join(distinct, comp.node == distinct.fp).select("fp", "root", "first")
    named = stored(named, "simhash-named")
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    moved = named.join(least, "root").select(F.col("fp").alias("node"), "component_id")
    ids = stored(distinct.join(moved, distinct.fp == moved.node, "left").select(F.col("fp").alias("node"), F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id")), "simhash-ids")
    return rows.join(ids, rows.fp == ids.node).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle and least similarity for similar_groups().
LONG_SHINGLE, LEAST = 5, 0.8
#: Bands of minima by which rows meet: a pair of similarity s shares none with a chance of (1 - s**WIDTH)**BANDS, 3 in a million at 0.8.
BANDS, WIDTH = 32, 5
#: Words of a wide fingerprint. At LEAST two of them differ in 19 of 128 bits on average; four standard deviations more are looked at.
WIDE, FAR = 2, 36
#: Nodes of a cluster that meet all others in one task; nodes of each cluster that all its blocks meet.
BLOCK, LEADS = 256, 8
#: Rows of a band that meet in one task; a band of more is dealt in pairs of blocks.
BAND_ROWS = 8_192

_rng = np.random.default_rng(SEED)
_odd = lambda *shape: _rng.integers(0, 1 << 63, shape, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES, _JOIN, _MIX = _odd(BANDS * WIDTH), _odd(BANDS, WIDTH), _odd(WIDE)


def shingles(text: bytes, length: int = LONG_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles, lower case; a shorter text is one shingle, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    rows = zip(*(words[k:] for k in range(length))) if len(words) >= length else [words]
    return np.unique(np.fromiter((digest(join(t), SEED) for t in rows), np.uint64))


def minima(h: np.ndarray) -> np.ndarray:
    """The least product of the hashes with each of _TIMES; all ones for an empty set."""
    low = np.full(len(_TIMES), ~np.uint64(0))
    for i in range(0, len(h), 8_192):
        np.minimum(low, (h[i : i + 8_192, None] * _TIMES).min(0), out=low)
    return low


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes in WIDE words: each word counts bits of another product of the hashes."""
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(h), 8_192):
        x = h[i : i + 8_192, None] * _MIX
        ones += np.unpackbits((x ^ x >> np.uint64(32)).view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h)).view(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _sketched(rows: DataFrame) -> DataFrame:
    """(row, digest, bands, w0, ...) from (row, text): digest of the set of shingles; one key a band; the wide fingerprint."""
    names = [f"w{k}" for k in range(WIDE)]

    def fn(batch):
        digest, low, fps = [], np.empty((batch.num_rows, BANDS * WIDTH), np.uint64), np.empty((batch.num_rows, WIDE), np.uint64)
        for i, t in enumerate(texts(batch)):
            h = shingles(t)
            digest.append(xxhash.xxh3_128_digest(h.tobytes()))
            low[i], fps[i] = minima(h), wide_fingerprint(h)
        keys = (low.reshape(-1, BANDS, WIDTH) * _JOIN).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
        cols = [batch.column("row"), pa.array(digest, pa.binary()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))]
        cols += [pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(WIDE)]
        return pa.RecordBatch.from_arrays(cols, ["row", "digest", "bands", *names])

    return map_arrow(rows, fn, "row long, digest binary, bands array<long>, " + ", ".join(f"{w} long" for w in names))


def _block_pairs(rows: DataFrame, size: str, block: int) -> DataFrame:
    """rows as often as their block meets a block of the same `key`; the key then names the pair of blocks. size: the key's rows."""
    n = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("key", F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_n", "_own", "_other")


def proposed(nodes: DataFrame) -> DataFrame:
    """(a, b): stars of nodes that share a band and whose fingerprints differ in FAR bits at most. nodes: (node, bands, w0, ...), stored."""
    words = [f"w{k}" for k in range(WIDE)]
    keyed = nodes.select("node", F.explode("bands").alias("key"), *words)
    hot = stored(keyed.groupBy("key").count().where(F.col("count") > BAND_ROWS), "simhash-hot")
    if not hot.isEmpty():
        marked = keyed.join(hot, "key", "left")
        pairs = _block_pairs(marked.where("count is not null"), "count", BAND_ROWS // 2)
        keyed = marked.where("count is null").drop("count").unionByName(pairs.drop("count"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_met(words, FAR), "a long, b long")


def _alike(batches):
    """For mapInArrow over (key, node, known, hashes, w0, ...) sorted by key: a star (smallest node, node) for each group of a key's nodes
    that links of alike sets hold together.

    Nodes with the same `known` are linked already.  Closest fingerprints come
    first, and pairs that are linked by then are not compared.
    """
    for t in _buckets(batches, "key", 4_096):
        keys = t.column("key").to_numpy()
        node, known = t.column("node").to_numpy(), t.column("known").to_numpy()
        fps = np.column_stack([t.column(f"w{k}").to_numpy() for k in range(WIDE)]).view(np.uint64)
        hashes = t.column("hashes")
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        links: list[tuple[int, int]] = []
        for s, e in zip(cuts, cuts[1:]):
            if e - s > 1:
                links += _alike_in(node[s:e], known[s:e], fps[s:e], hashes.slice(s, e - s).to_pylist())
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    tidy()


def _alike_in(node, known, fps, hashes) -> list[tuple[int, int]]:
    _, same = np.unique(known, return_index=True)
    root = same[np.searchsorted(known[same], known)]  # the first place with the same `known`
    size = np.array([len(h) // 8 for h in hashes])
    found, sets = [], {}

    def of(i):
        if i not in sets:
            sets[i] = set(np.frombuffer(hashes[i], np.uint64).tolist())
        return sets[i]

    x, y = [], []
    for i in range(0, len(node), 64):
        far = sum(np.bitwise_count(fps[i : i + 64, None, k] ^ fps[None, :, k]).astype(np.int64) for k in range(WIDE))
        small, large = np.minimum(size[i : i + 64, None], size), np.maximum(size[i : i + 64, None], size)
        q, o = np.nonzero((far <= FAR) & (small >= LEAST * large) & (root[i : i + 64, None] != root))
        ahead = o > q + i
        x.append(np.c_[q[ahead] + i, o[ahead]])
        y.append(far[q[ahead], o[ahead]])
    x, y = np.concatenate(x), np.concatenate(y)
    root = root.tolist()

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in x[np.argsort(y, kind="stable")].tolist():
        a, b = find(i), find(j)
        if a == b:
            continue
        both = len(of(i) & of(j))
        if both >= LEAST * (size[i] + size[j] - both):
            root[max(a, b)] = min(a, b)
            found.append(i)
    touched = {find(i) for i in found}
    first: dict[int, int] = {}
    groups = [find(i) for i in range(len(node))]
    for g, x in zip(groups, node.tolist()):
        first[g] = min(x, first.get(g, x))
    return [(first[g], x) for g, x in zip(groups, node.tolist()) if g in touched and x != first[g]]


def verified(nodes: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root), for nodes that are not their own root at least: groups of nodes linked by a similarity of LEAST or more, of all pairs in a component of `links`.

    nodes: (node, w0, ...); rows: (row, text), a node is the row of its number.
    A component of up to BLOCK nodes is compared in one task.  In a larger one
    each block is compared in itself and with LEADS nodes of the component;
    then nodes outside the component's main group meet all nodes in pairs of
    blocks.
    """
    words = [f"w{k}" for k in range(WIDE)]
    own = nodes.select(F.col("node").alias("of"), *words)
    clusters = stored(components(links), "simhash-clusters").withColumnRenamed("root", "cluster")

    def sets(batch):
        blobs = [shingles(t).tobytes() for t in texts(batch)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "cluster")), pa.array(blobs, pa.binary()), *(batch.column(w) for w in words)], ["node", "cluster", "hashes", *words])

    held = rows.join(clusters, rows.row == clusters.node).join(own, F.col("node") == F.col("of")).select("node", "cluster", "text", *words)
    held = stored(map_arrow(held, sets, "node long, cluster long, hashes binary, " + ", ".join(f"{w} long" for w in words)), "simhash-sets")
    sizes = held.groupBy("cluster").agg(F.count("*").alias("size"), F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(LEADS)], F.min("node")).alias("leads"))
    sizes = stored(sizes.select(F.col("cluster").alias("c"), "size", F.array_distinct("leads").alias("leads")), "simhash-sizes")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(dealt):
        dealt = dealt.select("key", "node", "known", "hashes", *words)
        return dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_alike, "a long, b long")

    met = held.join(sizes, held.cluster == sizes.c).withColumn("n", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("known", F.col("node"))
    whole = compared(met.where("n = 1").withColumn("key", F.col("cluster"))).select(F.col("b").alias("node"), F.col("a").alias("root"))
    large = stored(sizes.where(F.col("size") > BLOCK).select("c"), "simhash-large")
    if large.isEmpty():
        return whole

    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("n")).cast("int")
    every = F.sequence(F.lit(0), F.col("n") - 1)
    at = F.when(F.array_contains("leads", F.col("node")), every).otherwise(F.array(block))
    found = stored(compared(met.where("n > 1").withColumn("at", F.explode(at)).withColumn("key", F.xxhash64("cluster", "at"))), "simhash-links")
    root = stored(components(found), "simhash-groups").select(F.col("node").alias("of"), "root")
    left = held.join(large, held.cluster == large.c, "left_semi")
    left = left.join(root, left.node == root.of, "left").select("node", "cluster", "hashes", *words, F.coalesce("root", "node").alias("known"))
    left = stored(left, "simhash-left")
    counts = left.groupBy("cluster", "known").count()
    main = counts.groupBy("cluster").agg(F.max_by("known", F.struct("count", "known")).alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n_all"))
    main = stored(main.where("n_main < n_all").select(F.col("cluster").alias("c"), "main", F.ceil(F.col("n_main") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int").alias("aparts")), "simhash-main")
    dealt = left.join(main, left.cluster == main.c)
    is_main = F.col("known") == F.col("main")
    block = F.pmod(F.xxhash64("node", F.lit("again")), F.when(is_main, F.col("mains")).otherwise(F.col("aparts"))).cast("int")
    # names of pairs: two blocks of apart nodes (low, high), or one and, after all those, one of the main group
    aparts = F.sequence(F.lit(0), F.col("aparts") - 1)
    beside = F.transform(aparts, lambda j: F.struct(F.least(j, block).alias("i"), F.greatest(j, block).alias("j")))
    before = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: F.struct(block.alias("i"), (j + F.col("aparts")).alias("j")))
    under = F.transform(aparts, lambda i: F.struct(i.alias("i"), (block + F.col("aparts")).alias("j")))
    pair = F.when(is_main, under).otherwise(F.concat(beside, before))
    second = compared(dealt.withColumn("pair", F.explode(pair)).withColumn("key", F.xxhash64("cluster", "pair.i", "pair.j")))
    return whole.unionByName(components(found.union(stored(second, "simhash-links"))))


def similar_groups(rows: DataFrame) -> DataFrame:
    """(row, root) from (row, text): rows of one group share a root, the smallest row of the group.

    Rows link where the Jaccard similarity of their sets of LONG_SHINGLE-word
    shingles is LEAST or more.  Rows with one set are one node from the start;
    a null text counts as empty, and texts without words are one group.
    """
    sketched = stored(_sketched(rows.select("row", "text")), "simhash-sketches")
    sets = stored(sketched.groupBy("digest").agg(F.min("row").alias("node")), "simhash-distinct")
    own = sketched.select("row", "digest").join(sets, "digest").select("row", "node")
    nodes = sketched.join(sets, sketched.row == sets.node, "left_semi").withColumnRenamed("row", "node").drop("digest")
    nodes = stored(nodes, "simhash-nodes")
    links = stored(proposed(nodes), "simhash-proposed")
    root = stored(verified(nodes, links, rows), "simhash-groups").select(F.col("node").alias("of"), "root")
    return own.join(root, own.node == root.of, "left").select("row", F.coalesce("root", "node").alias("root"))


def _firsts(docs: DataFrame, groups, id_col: str, text_col: str) -> DataFrame:
    """One row of each group, with all columns: the one with the smallest id, then the first stored. groups: (row, text) -> (row, root)."""
    # the rows are written with their numbers, so that both readings below agree on them
    rows = stored(docs.select(F.struct(*docs.columns).alias("doc")).withColumn("row", F.monotonically_increasing_id()), "simhash-numbered")
    of = groups(rows.select("row", F.col(f"doc.{text_col}").alias("text"))).withColumnRenamed("row", "of")
    of = of.join(rows.select("row", F.col(f"doc.{id_col}").alias("doc_id")), F.col("of") == F.col("row"))
    first = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    first = stored(first.select(F.col("first.row").alias("kept")), "simhash-kept")
    return rows.join(first.hint("merge"), rows.row == first.kept, "left_semi").select("doc.*")  # as many as documents: never broadcast


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near_duplicates(), with all columns: the one with the smallest id, then the first stored.

    A row without an id stays only where no row of its group has one.  Rows
    that repeat an id are rows of their own.
    """
    return _firsts(docs, lambda rows: near_duplicates(rows, "row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("root")), id_col, text_col)


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The like for similar_groups(): one row of each group of documents linked by a similarity of LEAST or more."""
    return _firsts(docs, similar_groups, id_col, text_col)
