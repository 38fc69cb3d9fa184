import re
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline as C
from loomkv.llm import bpe, language, mixture, near_copies

DIR = "/root/testdata/sf0.001"
KINDS = {"EMAIL": r"\w+\.\d+@mail\d\.example\.com", "PHONE": r"\+1 \(\d{3}\) \d{3}-\d{4}", "CARD": r"(?<!\d)\d{16}(?!\d)", "IP": r"\d+\.\d+\.\d+\.\d+", "SECRET": r"(?i)(?<=\")[0-9a-f]{40}(?=\")"}


def one_of_each_class(rows):
    """By all pairs of fingerprints: the least doc_id of each connected class."""
    fp = near_copies.fingerprints(language.pa.array([r.text for r in rows], language.pa.string()))
    d = np.bitwise_count((fp[:, None, :] ^ fp[None, :, :]).view(np.uint64))
    near = (d.min(2) <= near_copies.RADIUS) & (d.sum(2) <= near_copies.MOST)
    label = ids = np.array([r.doc_id for r in rows])
    while True:
        new = np.array([label[x].min() for x in near])
        if (new == label).all():
            return {int(i) for i, x in zip(ids, label) if i == x}
        label = new


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rng = np.random.default_rng(1)
    noise = "".join(chr(x) for x in rng.integers(97, 123, 3000))
    odd = [(10**6, None, "en", "src1", 0), (10**6 + 1, "", "en", "src1", 0), (10**6 + 2, "12 34", None, None, 5), (10**6 + 3, noise, "en", "src1", 3000), (10**6 + 4, "the and of is with that this", None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    before, columns = docs.collect(), docs.columns
    kept = []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
        assert k == len(C.STAGES) - 1 or docs.columns == columns
    assert {r.doc_id for r in kept[0]} == {r.doc_id for r in before} - {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3} and len(kept[0]) == len(before) - 4
    text = {r.doc_id: r.text for r in before}
    lang = {r.doc_id: r.lang for r in before}
    assert all(r.text == text[r.doc_id] for r in kept[0]) and np.mean([r.lang == lang[r.doc_id] for r in kept[0]]) > 0.97
    assert Counter(r.doc_id for r in kept[1]) == Counter(one_of_each_class(kept[0])) and len(kept[1]) < len(kept[0]) - 10
    clean = {}
    for r in kept[1]:
        clean[r.doc_id] = r.text
        for kind, x in KINDS.items():
            clean[r.doc_id] = re.sub(x, f"[{kind}]", clean[r.doc_id], flags=re.I)
    assert {r.doc_id: r.text for r in kept[2]} == clean and all(r.n_chars == len(r.text) for r in kept[2]) and any("[EMAIL]" in x for x in clean.values())
    n = Counter()
    for r in kept[2]:
        n[r.source or ""] += len(r.text.split())
    epochs = {r.source: r.epochs for r in mixture.epochs(spark.createDataFrame([(s, x, float(x) ** 0.5) for s, x in n.items()], "source string, n long, w double")).collect()}
    draws = {r.doc_id: int(epochs.get(r.source or "", 0) + ((r.doc_id % 2**31 * 2654435761 + mixture.SEED) % 2**32) / 2**32) for r in kept[2]}
    assert Counter(r.doc_id for r in kept[3]) == +Counter(draws) and len(kept[3]) != len(kept[2])
    pieces, _ = bpe.vocabulary()
    peer = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={x: k for k, x in enumerate(pieces) if x}, special_tokens={})
    assert Counter((r.doc_id, tuple(r.tokens), r.same) for r in kept[4]) == Counter((r.doc_id, tuple(peer.encode_ordinary(r.text)), 1) for r in kept[3])


def test_near_copies_of_texts_that_drift(spark, monkeypatch):
    """Each text is the one before it but for one word, in no order of ids: few rounds of joins, and one of each class stays."""
    frame, rounds = type(spark.range(1)), []
    ended = frame.isEmpty

    def counted(df):
        rounds.append(1)
        assert len(rounds) <= 14
        return ended(df)

    monkeypatch.setattr(frame, "isEmpty", counted)
    rng = np.random.default_rng(2)
    words, rows = [f"w{x}" for x in rng.integers(0, 20000, 60)], []
    for i in rng.permutation(1000).tolist():
        words[rng.integers(60)] = f"w{rng.integers(0, 20000)}"
        rows.append((i, " ".join(words), "en", "src1", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in C.without_near_copies(spark, docs, DIR).collect()]
    assert sorted(kept) == sorted(one_of_each_class(docs.collect())) and len(kept) < 10


def test_second_stage_gives_the_driver_few_jobs_however_long_the_chain(spark):
    """A text drifts through 600 others: what the driver keeps of jobs does not grow with the rounds that such a chain takes."""
    rng = np.random.default_rng(6)
    words, rows = [f"w{x}" for x in rng.integers(0, 20000, 60)], []
    for i in rng.permutation(600).tolist():
        words[rng.integers(60)] = f"w{rng.integers(0, 20000)}"
        rows.append((i, " ".join(words), "en", "src1", 1))
    docs, sc = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.sparkContext
    sc.setJobGroup("second stage", "")
    try:
        kept = C.without_near_copies(spark, docs, DIR).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r.doc_id for r in kept} == one_of_each_class(docs.collect()) and len(kept) < 10
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("second stage")) <= 40


def test_second_stage_does_not_send_the_balls_through_the_driver(spark, monkeypatch):
    """By the plans that ran: no explode is broadcast, though Spark's estimate of its bytes is far below the threshold."""
    plans, cut = [], near_copies.checkpointed

    def kept(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(near_copies, "checkpointed", kept)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = C.without_near_copies(spark, docs, DIR).collect()
    assert {r.doc_id for r in got} == one_of_each_class(docs.collect())
    balls = [p for p in plans if "explode" in p]
    assert len(balls) == 1 and "BroadcastExchange" not in balls[0] and "SortMergeJoin" in balls[0]


def test_run_is_the_stages_in_turn(spark):
    got = C.run(spark, DIR).collect()
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, DIR)
    assert Counter((r.doc_id, tuple(r.tokens)) for r in got) == Counter((r.doc_id, tuple(r.tokens)) for r in docs.collect()) and len(got) > 100


def test_edges(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("class_id", near_copies.F.lit(1)).withColumn("words", near_copies.F.lit(2))
    odd = [(None, "the and of is", "en", None, 1, 1, 1), (None, "the and of is", "en", None, 1, 1, 1), (5, "the and that for is of", "en", "p", 1, 1, 1), (5, "the and that for is of", "en", "p", 1, 1, 1), (7, None, None, None, None, 1, 1)]
    docs = docs.where("doc_id >= 100").unionByName(spark.createDataFrame(odd, docs.schema))
    kept = C.without_near_copies(spark, C.by_language(spark, docs, DIR), DIR)
    rows = kept.collect()
    assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 5 for r in rows) == 1 and not any(r.doc_id == 7 for r in rows)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert C.as_tokens(spark, C.mixed_sources(spark, C.without_private_data(spark, kept, DIR), DIR), DIR).count() > 0
    empty = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, DIR).count() == 0
