import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken

from loomkv.llm import bpe as B
from loomkv.llm import text as T

PIECES, MERGES = B.vocabulary()
PEER = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks={x: k for k, x in enumerate(PIECES) if x}, special_tokens={})
DIR = "/root/testdata/sf0.001"


def merged(word: bytes) -> list[int]:
    """The leftmost pair of the lowest rank, one at a time."""
    of = {(a, b): r for a, b, r in MERGES.tolist()}
    parts = [PIECES.index(bytes([x])) for x in word]
    while pairs := [(of[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in of]:
        rank, k = min(pairs)
        parts[k : k + 2] = [rank]
    return parts


def columns(texts):
    return next((d, o) for _, _, d, o in T.slices(pa.array(texts), 1 << 40))


def test_words_are_those_of_the_pattern():
    random.seed(1)
    texts = ["".join(random.choice(" \n\t'sdmtlverL9é 　 !?😀x²") for _ in range(random.randint(0, 60))) for _ in range(5000)]
    data, offsets = columns(texts)
    starts, counts = B.segment(data, offsets)
    want = [[w.encode() for w in regex.findall(B.PATTERN, x)] for x in texts]
    assert [data[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(data)))] == [w for x in want for w in x]
    assert counts.tolist() == [len(x) for x in want]


def test_tokens_of_words_long_and_short():
    random.seed(2)
    words = [b"aaaaaaa", b"a", bytes(range(256)), b"ab" * 200, b"a" * 301, b"xyxyxyx" * 30, *("".join(random.choice("theringo ") for _ in range(n)).encode() for n in (3, 127, 128, 129, 400))]
    e = B.Encoder(PIECES, MERGES)
    sizes = np.array([len(w) for w in words])
    tokens, counts = B.encode_words(e.con, e.byte_ids, np.frombuffer(b"".join(words), np.uint8), sizes)
    ends = np.cumsum(counts)
    assert [tokens[b - n : b].tolist() for b, n in zip(ends, counts)] == [merged(w) for w in words]
    assert e.decode(tokens, counts) == words


def test_against_a_peer_and_edges(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    rows = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "<|endoftext|> \0 ÿ 漢字 😀"), (10**6 + 3, "word " * 100_000), (10**6 + 4, "a" * 50_000), (None, "x"), (0, "x"), (0, "x")]
    both = docs.union(spark.createDataFrame(rows, docs.schema)).withColumn("tokens", B.F.lit("clash"))
    got = B.encoded(both)
    texts = sorted(((r.doc_id or -1, r.text) for r in both.collect()), key=str)
    have = sorted(((r.doc_id or -1, None if r.tokens is None else PEER.decode(r.tokens)) for r in got.collect()), key=str)
    assert have == texts
    by = {r.doc_id: r for r in got.collect() if r.doc_id != 0}
    for i, t in ((r.doc_id, r.text) for r in both.collect()):
        if i != 0:
            assert by[i].tokens == (None if t is None else PEER.encode_ordinary(t)) and by[i].same == (None if t is None else 1)
    back = B.decoded(got.select("doc_id", "tokens"))
    assert sorted(((r.doc_id or -1, r.text) for r in back.collect()), key=str) == texts
    assert B.encoded(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        B.decoded(spark.createDataFrame([(1, [10**7])], "doc_id long, tokens array<int>")).collect()


def test_equal_hashes_do_not_change_tokens(spark, monkeypatch):
    """Were all words of one hash, texts that came out wrong would be encoded again."""
    monkeypatch.setattr(T, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    e = B.Encoder(PIECES, MERGES)
    data, offsets = columns(["red cat", "bad hen"])
    tokens, counts = e.encode(data, offsets)
    assert e.decode(tokens, counts)[1] != b"bad hen" and PEER.encode_ordinary("bad hen") == e.encode_alone(data[offsets[1] : offsets[2]]).tolist()
