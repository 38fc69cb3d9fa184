from collections import Counter

import duckdb

from loomkv.llm import mixture as M
from loomkv.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{DIR}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op4_mixture"](spark, DIR).collect())
    assert len(got) == 200 and got == sorted(con.execute(ORACLE["op4_mixture"]).fetchall())


def filled(n, w, most, more=0):
    """Clamp, redistribute in proportion, again until it fits."""
    budget, fixed = float(sum(n.values()) + more), {}
    while True:
        rest = [s for s in n if s not in fixed]
        level = (budget - sum(fixed.values())) / (sum(w[s] for s in rest) or 1)
        over = [s for s in rest if level * w[s] >= most * n[s]]
        if not over:
            return {s: round((fixed[s] if s in fixed else level * w[s]) / n[s], 6) for s in n}
        fixed |= {s: most * n[s] for s in over}


def test_level_is_that_of_clamping_in_rounds(spark):
    n = {"a": 1_000_000, "b": 10_000, "c": 90_000, "d": 400, "f": 12_345}
    even = {f"s{k}": 1000 + 7 * k for k in range(20)}
    got = {r.source: r.epochs for r in M.epochs(spark.createDataFrame([(s, x, float(x) ** 0.5) for s, x in even.items()], "source string, n long, w double")).collect()}
    want = filled(even, {s: x**0.5 for s, x in even.items()}, M.MAX_EPOCHS)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 2e-6 for s in want)
    for w in ({s: x**0.5 for s, x in n.items()}, {"a": 1, "b": 50, "c": 3, "d": 50, "f": 0.5}, dict.fromkeys(n, 1)):
        got = {r.source: r.epochs for r in M.epochs(spark.createDataFrame([(s, n[s], float(w[s])) for s in n] + [("e", 0, 1.0), ("g", 5, 0.0)], "source string, n long, w double")).collect()}
        want = filled(n, w, M.MAX_EPOCHS, 5)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) < 2e-6 for s in want)


def test_edges(spark, monkeypatch):
    rows = [(1, "x y", "en", "p", 3), (2, None, "en", "p", 0), (3, "", None, None, 0), (4, "z", None, None, 1), (None, "q r", "de", "p", 3), (2**62, "s " * 100_000, "de", "big", 9), (5, "t", "de", "p", 1), (5, "t", "de", "p", 1)]
    docs = spark.createDataFrame([(*r, 7, 8.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, own_copy int, epochs double")
    got = M.mixture(docs).collect()
    assert sorted((r.doc_id or -1, r.words) for r in got) == sorted([(1, 2), (2, 0), (3, 0), (4, 1), (-1, 2), (2**62, 100_000), (5, 1), (5, 1)])
    for most in (M.MOST_SENT, 0):
        monkeypatch.setattr(M, "MOST_SENT", most)
        want = Counter({(r.doc_id, r.source or ""): 0 for r in got})
        for r in got:
            want[r.doc_id, r.source] += r.copies
        out = M.mixed(docs).collect()
        assert Counter((r.doc_id, r.source or "") for r in out) == +want and set(out) <= {tuple(r) for r in rows}
    assert M.mixture(docs.limit(0)).count() == 0 and M.mixed(docs.limit(0)).count() == 0
    only = M.mixture(docs, spark.createDataFrame([("p", 1.0)], "source string, weight double")).collect()
    assert {r.epochs for r in only if r.source != "p"} == {0.0} and {r.epochs for r in only if r.source == "p"} == {M.MAX_EPOCHS}
