import numpy as np

from loomkv.llm import toxicity as X

DIR = "/root/testdata/sf0.01"


def test_scores_are_those_of_all_pairs():
    """The linear-time form against the sum over all pairs of features."""
    rng = np.random.default_rng(3)
    w, v = rng.normal(size=6), rng.normal(size=(6, 4))
    z, _ = X._forward(np.array([0, 0, 0, 2, 2]), np.array([1, 3, 5, 0, 2]), 3, 0.5, w, v)
    pairs = lambda xs: 0.5 + sum(w[x] for x in xs) + sum(v[x] @ v[y] for x in xs for y in xs if x < y)
    assert np.allclose(z, [pairs([1, 3, 5]), 0.5, pairs([0, 2])])


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(4)
    rows, at, y = np.array([0, 0, 1, 1, 1, 2]), np.array([0, 1, 1, 2, 3, 3]), np.array([1.0, 0.0, 1.0])
    w0, w, v = 0.1, rng.normal(size=4), rng.normal(size=(4, 3))

    def loss():
        z, _ = X._forward(rows, at, 3, w0, w, v)
        return (np.log1p(np.exp(z)) - y * z).mean() + 0.5 * X.L2 * ((w**2).sum() + (v**2).sum())

    z, sums = X._forward(rows, at, 3, w0, w, v)
    _, dw, dv = X.gradient(rows, at, (1 / (1 + np.exp(-z)) - y) / 3, sums, w, v)
    for a, g in ((w, dw), (v, dv)):
        for k in np.ndindex(a.shape):
            old = a[k]
            a[k] = old + 1e-5
            up = loss()
            a[k] = old - 1e-5
            down = loss()
            a[k] = old
            assert np.isclose((up - down) / 2e-5, g[k], atol=1e-6)


def test_pairs_that_no_sum_of_weights_can_tell(monkeypatch):
    """Toxic if exactly one of two words is there: half of it is missed without interactions."""
    monkeypatch.setattr(X, "FACTOR_RATE", 0.1)
    monkeypatch.setattr(X, "EPOCHS", 400)
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2, (2, 400))
    rows, at = [], []
    for k in range(400):
        for word, on in enumerate((a[k], 1 - a[k], b[k], 1 - b[k])):
            if on:
                rows.append(k), at.append(word)
    rows, at, y = np.array(rows), np.array(at), (a ^ b).astype(float)
    _, w0, w, v = X.fit(np.arange(4, dtype=np.uint64), rows, at, y)
    z, _ = X._forward(rows, at, 400, w0, w, v)
    assert ((z > 0) == y).all()
    flat, _ = X._forward(rows, at, 400, w0, w, v * 0)
    assert np.mean((flat > 0) == y) < 0.8


def test_held_out_and_planted_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "toxic")
    rest = {r.doc_id: r.toxic for r in labels.where("doc_id % 4 = 0").collect()}
    long = "the er onthe with " * 50_000
    planted = [(10**6, "Onthe er, you idiot moron! Trash of the worthless."), (10**6 + 1, long + "idiot. Worthless, pathetic clown, stupid moron"), (10**6 + 2, long), (10**6 + 3, ""), (10**6 + 4, None), (None, "idiot moron worthless trash scum"), (0, "x"), (0, "x")]
    both = docs.union(spark.createDataFrame(planted, docs.schema)).withColumn("score", X.F.lit("clash"))
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0), (10**9, 1)], "doc_id long, toxic int")
    rows = X.toxicity(both, labels.where("doc_id % 4 > 0").unionByName(odd)).collect()
    got = {r.doc_id: r.toxic for r in rows}
    assert len(rows) == docs.count() + len(planted)
    assert [got[10**6 + i] for i in range(5)] == [1, 1, 0, 0, 0] and got[None] == 1
    right = [got[k] == v for k, v in rest.items()]
    assert np.mean(right) > 0.9 and sum(got[k] for k, v in rest.items() if not v) <= 2
    assert X.toxicity(docs.limit(0).union(docs), labels).count() == docs.count()
    assert X.toxicity(docs.limit(0), labels).count() == 0
    unknown = X.toxicity(docs.limit(5), labels.limit(0)).collect()
    assert [(r.score, r.toxic) for r in unknown] == [(None, None)] * 5
