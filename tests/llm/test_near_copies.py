import numpy as np
import pytest

from loomkv.llm import near_copies as N


def brute(ids, fp):
    """class_id and links of each row from all pairs."""
    d = np.bitwise_count((fp[:, None, :] ^ fp[None, :, :]).view(np.uint64))
    near = (d.min(2) <= N.RADIUS) & (d.sum(2) <= N.MOST)
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    texts = [tuple(x) for x in fp.tolist()]
    return {ids[i]: (int(label[i]), len({texts[j] for j in np.flatnonzero(near[i])} - {texts[i]})) for i in range(len(ids))}


def test_against_all_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = "the quick brown fox jumps over the lazy dog while nine old sailors count silver coins near an empty harbour wall at noon before rain comes in from the grey western sea and every gull turns home".split()
    planted = [" ".join(words), " ".join(words), " ".join([*words[:10], "ten", *words[11:]]), "", "", "###", None, "a" * 300_000 + " b" * 300_000]
    docs = table.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(planted)], "doc_id long, text string"))
    got = [tuple(r) for r in N.near_copies(docs).collect()]
    at = docs.toArrow()
    want = brute(at["doc_id"].to_pylist(), N.fingerprints(at["text"]))
    assert len(got) == len(want) and {a: (b, c) for a, b, c in got} == want
    assert [want[10**6 + i] for i in range(8)] == [(10**6, 1), (10**6, 1), (10**6, 1), (10**6 + 3, 0), (10**6 + 3, 0), (10**6 + 5, 0), (10**6 + 3, 0), (10**6 + 7, 0)]
    assert sum(c > 0 for _, c in want.values()) > 20


def test_random_fingerprints_near_the_radius(spark):
    """Distances of 6 to 10 in one half, any number in the other; each pair once."""
    rng = np.random.default_rng(7)
    base = rng.integers(-(2**63), 2**63 - 1, (300, 2))
    rows = [(int(i), int(f), int(g)) for i, (f, g) in enumerate(base)]
    for i, (f, g) in enumerate(base.tolist()):
        for half, n in ((0, 6 + i % 5), (1, rng.integers(0, 14))):
            for b in rng.choice(64, n, replace=False).tolist():
                x = (1 << b) - (1 << 64 if b == 63 else 0)
                f, g = (f ^ x, g) if half == 0 else (f, g ^ x)
        rows.append((300 + i, f, g))
    got = sorted(tuple(r) for r in N.links(spark.createDataFrame(rows, "c long, f long, g long")).collect())
    fp = np.array([r[1:] for r in rows])
    d = np.bitwise_count((fp[:, None, :] ^ fp[None, :, :]).view(np.uint64))
    near = (d.min(2) <= N.RADIUS) & (d.sum(2) <= N.MOST)
    assert got == sorted((int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j) and len(got) > 100


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 2), (2, 3), (5, 9)], {1: 1, 2: 1, 3: 1, 5: 5, 9: 5}), ([(i, i + 1) for i in range(40)], dict.fromkeys(range(41), 0))])
def test_components(spark, edges, want):
    got = N.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.c: r.class_id for r in got.collect()} == want


def test_components_of_a_long_chain_in_no_order(spark, monkeypatch):
    """Few rounds, and the plan's estimate of bytes, whose digits once doubled in each, is that of a table."""
    frame, rounds = type(spark.range(1)), []
    ended = frame.isEmpty

    def counted(df):
        rounds.append(1)
        assert len(rounds) <= 16
        return ended(df)

    monkeypatch.setattr(frame, "isEmpty", counted)
    order = np.random.default_rng(3).permutation(500).tolist()
    got = N.components(spark.createDataFrame([*zip(order, order[1:]), (1000, 1001)], "a long, b long"))
    assert int(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 30
    assert {r.c: r.class_id for r in got.collect()} == dict.fromkeys(range(500), 0) | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("one_task", [1 << 21, 0])
def test_no_join_goes_through_the_driver(spark, monkeypatch, one_task):
    """By the plans of all tables that are made: none is broadcast, though all are far below the threshold here."""
    plans = []

    def seen(made):
        def f(df, *at):
            out = made(df, *at)
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return out

        return f

    monkeypatch.setattr(N, "ONE_TASK", one_task)
    monkeypatch.setattr(N, "checkpointed", seen(N.checkpointed))
    monkeypatch.setattr(N, "written", seen(N.written))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = N.near_copies(docs)
    rows = [tuple(r) for r in got.collect()]
    at = docs.toArrow()
    want = brute(at["doc_id"].to_pylist(), N.fingerprints(at["text"]))
    assert len(rows) == len(want) and {a: (b, c) for a, b, c in rows} == want
    kept = N.unique(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(a for a, (b, _) in want.items() if a == b)
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (got, kept)]
    assert len(plans) >= 12 and sum("SortMergeJoin" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)


def some_pairs():
    """Random pairs, a chain in no order and numbers paired only with themselves; and their classes, one pair at a time."""
    rng = np.random.default_rng(4)
    order = (10**12 + rng.permutation(60)).tolist()
    pairs = [tuple(sorted(x)) for x in rng.integers(-200, 200, (150, 2)).tolist()] + [*zip(order, order[1:])] + [(999, 999), (-999, -999)]
    label = {x: x for pair in pairs for x in pair}
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {x: new if y == old else y for x, y in label.items()}
    return pairs, label


@pytest.mark.parametrize("one_task", [1 << 21, 0])
def test_components_in_one_task_and_by_rounds(spark, monkeypatch, one_task):
    monkeypatch.setattr(N, "ONE_TASK", one_task)
    pairs, label = some_pairs()
    got = [tuple(r) for r in N.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()]
    assert len(got) == len(label) and dict(got) == label


@pytest.mark.parametrize("held", [1, 40, 150, 1 << 20])
def test_stars_keep_the_classes(monkeypatch, held):
    """Also where a task gives its stars in parts."""
    monkeypatch.setattr(N, "HELD", held)
    pairs, label = some_pairs()
    batches = [N.pa.record_batch([N.pa.array(x) for x in zip(*pairs[k : k + 7])], ["a", "b"]) for k in range(0, len(pairs), 7)]
    stars = list(N._stars(iter(batches)))
    got = [row for x in N._classes(iter(stars)) for row in zip(x["c"].to_pylist(), x["class_id"].to_pylist())]
    assert len(got) == len(label) and dict(got) == label and sum(map(len, stars)) <= len(pairs)


def test_edges(spark):
    assert N.near_copies(spark.createDataFrame([], "doc_id long, text string, links string")).count() == 0
    got = N.near_copies(spark.createDataFrame([(None, "x y", 1, "z"), (4, "x y", 1, "z"), (4, "x y", 1, "z"), (None, "q", 1, "z")], "doc_id long, text string, links long, class_id string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 4, 0), (4, 4, 0), (4, 4, 0), (None, None, 0)]))
