from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomkv.llm import index_repeats, repeats, suffix_repeats
from loomkv.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.01"
BOTH = [index_repeats.index_repeats, suffix_repeats.suffix_repeats]


def brute(rows, most=repeats.MIN_WORDS):
    """From all grams of (doc, text); a null doc comes first."""
    key = lambda d: (d is not None, d or 0)
    docs = defaultdict(set)
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - most + 1):
            docs[tuple(w[i : i + most])].add(d)
    out = set()
    for d, t in rows:
        w, run = (t or "").split(), None
        for i in range(len(w) - most + 1):
            if len(have := docs[tuple(w[i : i + most])]) > 1:
                least = min(have, key=key)
                if run and i <= run[1]:
                    run = (run[0], i + most, min(run[2], least, key=key))
                else:
                    out |= {(d, *run)} if run else set()
                    run = (i, i + most, least)
        out |= {(d, *run)} if run else set()
    return out


@pytest.mark.parametrize("name", ["op1_index_repeats", "op7_suffix_repeats"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{DIR}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES[name](spark, DIR).collect())
    assert len(got) > 50 and got == sorted(con.execute(ORACLE[name]).fetchall())


@pytest.mark.parametrize("f", BOTH)
@pytest.mark.parametrize("hot", [repeats.HOT_BYTES, 600])
def test_planted_passages(spark, f, hot, monkeypatch):
    """A passage in a third of the rows with different words around it, near copies, loops of words, and rows of odd kinds; with texts of hot anchors counted by grams too."""
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage, long = words(57), words(700)
    rows = []
    for i in range(60):
        w = words(rng.integers(0, 150))
        if i % 3 == 0:
            at = rng.integers(0, len(w) + 1)
            w = [*w[:at], *passage, *w[at:]]
        if i % 7 == 0:
            copy = list(long)
            copy[rng.integers(0, 700)] = f"x{i}"
            w += copy
        rows.append((i, " ".join(w)))
    rows += [(100, "at " * 400), (101, "at at\n" * 90), (102, "of " * 300), (103, None), (104, ""), (105, " ".join(passage[:49])), (None, " ".join(passage)), (None, " ".join(long)), (3, rows[3][1]), (3, " ".join(long[:80]))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, first_doc string")
    got = [tuple(r) for r in f(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 25
    assert f(docs.limit(0)).count() == 0


def shard(rng):
    """A shard over a small vocabulary, grams of six words."""
    base, texts = rng.integers(0, rng.integers(2, 40), 400), []
    for _ in range(rng.integers(2, 60)):
        a = rng.integers(0, 380)
        x = base[a : a + rng.integers(8, 20)].copy()
        for _ in range(rng.integers(0, 3)):
            x[rng.integers(0, len(x))] = rng.integers(0, 40)
        texts.append(" ".join(f"w{i}" for i in x).encode())
    texts = list(dict.fromkeys(texts))
    lo = rng.integers(0, 8, len(texts))
    hi = np.maximum(lo, np.where(rng.random(len(texts)) < 0.2, rng.integers(0, 12, len(texts)), lo))
    return texts, lo, hi, repeats.Shard(pa.array(texts, pa.binary()), lo, hi)


def test_array_prefixes_and_statistics(monkeypatch):
    """Suffix array, bounded prefixes and matching statistics against their definitions."""
    monkeypatch.setattr(repeats, "MIN_WORDS", 6)
    rng = np.random.default_rng(0)
    for _ in range(20):
        texts, lo, hi, sh = shard(rng)
        t, sa = sh.text.tolist(), sh.suffixes()
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        shared = lambda i, j: next(k for k in range(len(t)) if t[i + k] != t[j + k])
        assert repeats.bounded_prefixes(sh.text[sa - 1], 6).tolist() == [0] + [min(6, shared(a, b)) for a, b in zip(sa, sa[1:])]
        docs = defaultdict(set)
        for k, x in enumerate(texts):
            w = x.split()
            for i in range(len(w)):
                for n in range(1, min(6, len(w) - i) + 1):
                    docs[tuple(w[i : i + n])] |= {lo[k], hi[k]}
        length, first = index_repeats.statistics(sh)
        hits, first7 = suffix_repeats.by_expansion(sh)
        for k, x in enumerate(texts):
            w = x.split()
            for i in range(len(w)):
                p = sh.starts[k] + i
                assert length[p] == max([0] + [n for n in range(1, min(6, len(w) - i) + 1) if len(docs[tuple(w[i : i + n])]) > 1])
                assert hits[p] == (length[p] == 6)
                if hits[p]:
                    assert first[p] == first7[p] == min(docs[tuple(w[i : i + 6])])


def test_rank_of_the_wavelet_tree():
    rng = np.random.default_rng(9)
    s = rng.integers(0, 300, 1000)
    c, at = rng.integers(0, 300, 400), rng.integers(0, 1001, 400)
    assert index_repeats.WaveletTree(s).rank(c, at).tolist() == [int((s[:p] == x).sum()) for x, p in zip(c, at)]
