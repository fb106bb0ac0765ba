import base64
import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tessera.llm import bpe, token_counts  # noqa: E402
from tessera.llm.queries import byte_bpe  # noqa: E402

RNG = random.Random(5)
TEXTS = [
    None, "", " ", "  ", "\n", "a", "Hello world, it's 2024!  double  spaces\n\n\ttabs", "don't they'll I'm we've x's", "Ünïcode ñandú 日本語のテキスト 한국어 עברית", "emoji 👩‍👩‍👧‍👦 👍🏽 é", "<s> </s> <|endoftext|> <unk>",
    " nbsp em　ideo\u0085nel\x1cfs", "▁ lower block ▁▁x", "\x00nul\x00", "a" * 300, "ab" * 400, "1234567890" * 20, "!?" * 100, "    leading and trailing    ", "x" + " " * 40 + "y", "\r\nwindows\r\n", "ſ ﬁ Ⅷ ²", "".join(chr(RNG.choice([*range(32, 127), 0xE9, 0x4E2D, 0x1F600, 10, 9])) for _ in range(3_000)), " ".join(RNG.choice(["the", "onthanen", "réeux", "ing", "tionhe."]) for _ in range(5_000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "x y", "c", 2), (3, "again", "c", 2), (3, "again", "c", 2)], "doc_id long, text string, words string, ids int").repartition(3)


def test_counts_equal_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        got = token_counts.token_counts(docs, f.read(), limit=1_000).collect()
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 1_000) for i, t in [*enumerate(TEXTS), (None, "x y"), (3, "again"), (3, "again")]), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_whole_tokens_are_proved():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        counter = token_counts.PieceCounter(f.read())
    assert len(counter.whole) > 30_000
    rng = random.Random(1)
    for p in rng.sample(sorted(p for p in counter.whole if p.startswith("▁") and len(p) > 1 and p.strip("▁")), 300):
        assert len(sp.encode(p[1:])) == 1
    for n in (3, 30, 200):  # both ways of merging agree
        u = "".join(rng.choice("abtheing") for _ in range(n))
        assert counter._merge_long(u) == len(sp.encode(u, out_type=str)) - (sp.encode(u, out_type=str)[0] == "▁") or counter.count(u) == len(sp.encode(u))
        assert counter.count(u) == len(sp.encode(u))


def test_bytes_encode_and_decode(docs):
    import tiktoken

    b = byte_bpe()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    rows = [*enumerate(TEXTS), (None, "x y"), (3, "again"), (3, "again")]
    want = []
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(docs, b).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    tokens = bpe.decoded(bpe.encoded(docs, b), b).collect()
    assert sorted(bytes(r.decoded) for r in tokens) == sorted((t or "").encode() for _, t in rows)


def test_long_words(spark):
    """Words far beyond the fold: blobs of letters, digits and spaces, encoded as the library does."""
    import tiktoken

    b = byte_bpe()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    rng = random.Random(9)
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(20_000))
    rows = [blob, blob[:127], blob[:128], blob[:129], "a" * 20_000, " " * 5_000 + "x", "the" * 700, "日本" * 900, "x " + blob[5_000:9_000] + " y"]
    got = {r.doc_id: r for r in bpe.encoded(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), b, decode=True).collect()}
    for i, t in enumerate(rows):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == enc.encode_ordinary(t) and bytes(got[i].decoded) == t.encode()


def test_small_gathers_number_words_anew(docs, monkeypatch):
    monkeypatch.setattr(bpe, "GATHER", 50)
    monkeypatch.setattr(bpe, "ROW", 7)
    b = byte_bpe()
    got = bpe.encoded(docs, b, decode=True).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for t in [*TEXTS, "x y", "again", "again"])


def test_pieces_are_looked_up_many_at_a_time(docs, monkeypatch):
    """Cuts inside texts and inside runs of texts, and no search for a pair's place in the fold."""
    import tiktoken

    monkeypatch.setattr(bpe, "TOKENS", 40)
    monkeypatch.setattr(bpe, "GATHER", 500)
    b = byte_bpe()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    df = bpe.encoded(docs, b, decode=True)
    got = sorted((repr(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in df.collect())
    rows = [*enumerate(TEXTS), (None, "x y"), (3, "again"), (3, "again")]
    want = [(repr(i), np.array(enc.encode_ordinary(t or ""), "<u4"), (t or "").encode()) for i, t in rows]
    assert got == sorted((i, len(ids), ids.tobytes(), t) for i, ids, t in want)
    assert "array_position" not in df._jdf.queryExecution().analyzed().toString()


def test_tokens_may_be_null_or_unknown(spark):
    b = byte_bpe()
    ids = np.array([b.ranks[b"h"], b.ranks[b"i"]], "<u4").tobytes()
    rows = spark.createDataFrame([(1, ids), (2, None), (3, b"")], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in bpe.decoded(rows, b).collect()} == {1: b"hi", 2: None, 3: b""}
    sparse = bpe.Pieces({b"a": 0, b"b": 2})
    assert sparse.decode(np.array([2, 0, 2], "<u4"), np.array([1, 1, 3])).to_pylist() == [b"b", b"", b"ab"]
    with pytest.raises(ValueError):
        sparse.decode(np.array([1], "<u4"), np.array([1]))


def test_last_merges_rebuild_every_token():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    pairs = bpe.merge_pairs(ranks)
    by_id = {i: t for t, i in ranks.items()}
    assert len(pairs) == len(ranks) - 256 and all(by_id[a] + by_id[b] == by_id[c] for (a, b), c in pairs.items())
    assert base64.b64encode(b"") == b""


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(df, byte_bpe()).collect() == []
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        assert token_counts.token_counts(df, f.read()).collect() == []
