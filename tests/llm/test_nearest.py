import duckdb
import numpy as np
import pytest

from loomkv.llm import nearest as N
from loomkv.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("dims,scale", [(64, 0.05), (64, 3.0), (5, 1.0), (1, 1.0), (37, 0.0)])
def test_bounds_never_lose_a_neighbour(dims, scale):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, dims))[rng.integers(0, 40, 700)] + scale * rng.normal(size=(700, dims))
    x[5] = x[600]
    ids = rng.permutation(700)
    a, b, d = N.top_k(ids[:300], x[:300], ids, x)
    full = np.sqrt(((x[:300, None] - x[None]) ** 2).sum(2))
    full[np.arange(300), np.arange(300)] = np.inf
    want = {(int(ids[i]), int(ids[j])) for i in range(300) for j in np.lexsort((ids, full[i]))[:10]}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == 3000


def test_bounds_are_below_the_distance():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 48)), rng.normal(size=(200, 48)) * 2 + 1
    full, before = ((x - y) ** 2).sum(1), 0
    for n in N._levels(48):
        bound = ((N.statistics(x, n) - N.statistics(y, n)) ** 2).sum(1)
        assert (bound <= full + 1e-9).all() and (bound >= before - 1e-9).all()
        before = bound


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{DIR}/embeddings.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op2_nearest"](spark, DIR).collect())
    assert len(got) >= 50 and got == sorted(con.execute(ORACLE["op2_nearest"]).fetchall())


def test_edges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BLOCK", 3)
    monkeypatch.setattr(N, "ROW_BLOCK", 7)
    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, (40, 4)).astype(float).tolist()
    rows = [(i, x, "z") for i, x in enumerate(v)] + [(50, None, "z"), (None, v[0], "z"), (51, [1.0, None, 2.0, 3.0], "z"), (52, [], "z"), (53, [1.0, 2.0], "z"), (3, v[3], "z"), (3, v[3], "z")]
    schema = "vec_id long, embedding array<double>, rank string"
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.vec_id, r["rank"], r.neighbor_id, r.distance) for r in N.nearest(df, df).collect())
    usable = [(i, x) for i, x, _ in rows if i is not None and x and None not in x]
    want = []
    for i, x in {(i, tuple(x)) for i, x in usable}:
        near = sorted((float(np.sqrt(((np.array(x) - y) ** 2).sum())), j) for j, y in usable if j != i and len(y) == len(x))
        want += [(i, n, j, round(d, 6)) for n, (d, j) in enumerate(near[: N.K], 1)]
    assert got == sorted(want)
    assert N.nearest(df.limit(0), df).count() == 0 and N.nearest(df, df.limit(0)).count() == 0
