import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomkv.llm import language as L

DIR = "/root/testdata/sf0.01"


def brute(text: bytes, train: bytes) -> int:
    """Phrases of one window, each the longest prefix of the rest that occurs in train, or one symbol."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and train.find(text[i : j + 1]) >= 0:
            j += 1
        i, n = max(j, i + 1), n + 1
    return n


def test_phrases_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    train = rng.integers(97, 101, 300).astype(np.uint8)
    texts = ["".join(chr(x) for x in rng.integers(97, 102, n)) for n in (0, 1, 5, 255, 256, 257, 5000)]
    column = pa.array(texts)
    (_, _, data, offsets), = L.T.slices(column, 1 << 30)
    got = L.phrases(data, offsets, [L.automaton(L.symbols(train))])[0][:, 0]
    key = L.symbols(train).tobytes()
    want = [sum(brute(L.symbols(np.frombuffer(t[k : k + L.WINDOW].encode(), np.uint8)).tobytes(), key) for k in range(0, len(t), L.WINDOW)) for t in texts]
    assert got.tolist() == want


def test_held_out_accuracy():
    t = duckdb.sql(f"select lang, text from '{DIR}/documents.parquet' order by doc_id").to_arrow_table()
    lang, text = t["lang"].to_pylist(), t["text"].to_pylist()
    names = sorted(set(lang))
    train = [" ".join(x for g, x in zip(lang[:300], text[:300]) if g == n).lower().encode()[: L.TRAIN_BYTES] for n in names]
    found, rate, good = L.judge(L.lowered(pa.array(text[300:])), names, [L.automaton(L.symbols(np.frombuffer(x, np.uint8))) for x in train])
    assert np.mean([a == b for a, b in zip(found, lang[300:])]) > 0.98 and good.all()


def test_edges(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang").withColumn("language", L.F.lit("clash"))
    rng = np.random.default_rng(1)
    noise = "".join(chr(x) for x in rng.integers(97, 123, 3000))
    at = {x: [r.text for r in docs.where(f"language is not null and lang = '{x}'").orderBy("doc_id").limit(3).collect()] for x in ("en", "es")}
    mixed = " ".join(at["en"] + at["es"])
    rows = [(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "123 !?", None), (10**6 + 3, noise, None), (10**6 + 4, "und der die " * 60000, None), (10**6 + 5, mixed, "en"), (None, "the and of the with", None), (0, "the and of the with", "en")]
    got = L.language(docs.union(spark.createDataFrame([(*r, "x") for r in rows], docs.schema)), docs).collect()
    assert len(got) == docs.count() + len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 10**6}
    assert [(by[10**6 + i].language is None, by[10**6 + i].accepted) for i in range(6)] == [(True, 0), (True, 0), (True, 0), (False, 0), (False, 1), (False, 1)]
    assert by[10**6 + 4].language == "de" and by[None].language == "en" and sum(r.doc_id == 0 for r in got) == 2
    assert L.language(docs.limit(0), docs).count() == 0
    assert L.language(docs.limit(0)).count() == 0 and L.accepted(docs.limit(0).selectExpr("doc_id", "text", "lang", "lang source", "1 n_chars")).count() == 0
    untaught = L.language(docs.limit(5), docs.limit(0)).collect()
    assert [(r.language, r.rate, r.accepted) for r in untaught] == [(None, 1.0, 0)] * 5
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        L.language(docs)
