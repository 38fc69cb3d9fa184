import re

import numpy as np
import pytest

from loomkv.llm import private as P

DIR = "/root/testdata/sf0.01"
TEXTS = ["7 b@c.d", "+1 (22) 33", "a1-b2", "10.0.0.1", "x"]


def every(n, spans, allowed):
    """All sequences of (segment, kind) that cover n tokens."""
    def go(i):
        if i == n:
            yield []
            return
        for k, (a, b) in enumerate(spans.tolist()):
            if a == i:
                for kind in np.flatnonzero(allowed[k]).tolist():
                    for rest in go(b):
                        yield [(k, kind), *rest]
    return list(go(0))


def weight(way, s, follow):
    return sum(s[k, kind] + follow[before, kind] for (k, kind), before in zip(way, [0, *(x for _, x in way)]))


@pytest.mark.parametrize("text", TEXTS)
def test_sums_and_best_are_those_of_enumeration(text):
    rng = np.random.default_rng(len(text))
    model = (rng.normal(size=(P.BUCKETS, len(P.KINDS))), rng.normal(size=(len(P.KINDS),) * 2))
    x = P.Island(text)
    spans, features, allowed = x.segments()
    s = P.scores(model, features, allowed)
    ways = every(x.n, spans, allowed)
    w = np.array([weight(way, s, model[1]) for way in ways])
    z = np.log(np.exp(w - w.max()).sum()) + w.max()
    assert np.isclose(P._log_sum(P.forward(x.n, spans, s, model[1])[x.n], 0), z)
    assert np.isclose(P.backward(x.n, spans, s, model[1])[0, 0], z)
    top = [(*map(int, spans[k]), kind) for k, kind in ways[int(w.argmax())] if kind]
    assert P.best(model, x.n, spans, features, allowed) == top


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(3)
    model = (rng.normal(size=(P.BUCKETS, len(P.KINDS))), rng.normal(size=(len(P.KINDS),) * 2))
    x = P.Island("call 7 b@c.d, 10")
    spans, features, allowed = x.segments()
    s, follow = P.scores(model, features, allowed), model[1]
    right = P.truth(spans, {(2, 7): 1})
    assert [tuple(spans[k]) for k, _ in right] == [(0, 1), (1, 2), (2, 7), (7, 8), (8, 9)]
    total, by_span, by_follow = P.gradient(x.n, spans, s, follow, right)
    assert total < 0
    for a, g in ((s, by_span), (follow, by_follow)):
        for _ in range(25):
            at = tuple(rng.integers(0, n) for n in a.shape)
            if a is s and not allowed[at]:
                continue
            old, step = a[at], 1e-5
            a[at] = old + step
            up = P.gradient(x.n, spans, s, follow, right)[0]
            a[at] = old - step
            down = P.gradient(x.n, spans, s, follow, right)[0]
            a[at] = old
            assert np.isclose((up - down) / (2 * step), g[at], atol=1e-4)


def test_held_out_examples():
    f = P.Finder(P.train())
    rest = P.examples(P.TRAIN_ISLANDS + 400)[P.TRAIN_ISLANDS :]
    assert np.mean([f.island(t, c) == s for t, c, s in rest]) > 0.98


def test_documents_and_edges(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    mail, phone, ip, card, key = "jo.li77@mail.example.org", "+1 (555) 010-9999", "10.20.30.40", "4111111111111111", "deadbeef0123456789abcdef0123456789abcdef"
    plain = "Version 2.0. In 1999, 3 of 10 (30%) paid $5.00 at 12:30."
    rows = [(10**6, f"é {mail}, or call {phone}. From {ip} {card}\ntoken = \"{key}\"!"), (10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, "at the end " * 50_000 + mail), (10**6 + 4, "12 " * 3000), (10**6 + 5, plain), (None, mail), (0, mail), (0, mail)]
    got = P.private(docs.union(spark.createDataFrame(rows, docs.schema)).withColumn("spans", P.F.lit("clash"))).collect()
    assert len(got) == docs.count() + len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 0}
    assert by[10**6].text == 'é [EMAIL], or call [PHONE]. From [IP] [CARD]\ntoken = "[SECRET]"!'
    assert [(rows[0][1][s.first : s.last], s.kind) for s in by[10**6].spans] == [(mail, "EMAIL"), (phone, "PHONE"), (ip, "IP"), (card, "CARD"), (key, "SECRET")]
    assert (by[10**6 + 1].text, by[10**6 + 1].n_spans, by[10**6 + 2].text) == (None, 0, "")
    assert by[10**6 + 3].text == "at the end " * 50_000 + "[EMAIL]" and by[10**6 + 5].text == plain and by[None].text == "[EMAIL]"
    assert sum(r.doc_id == 0 and r.text == "[EMAIL]" for r in got) == 2
    kinds = {"EMAIL": r"\w+\.\d+@mail\d\.example\.com", "PHONE": r"\+1 \(\d{3}\) \d{3}-\d{4}", "CARD": r"(?<!\d)\d{16}(?!\d)", "IP": r"\d+\.\d+\.\d+\.\d+", "SECRET": r"(?i)(?<=\")[0-9a-f]{40}(?=\")"}
    for r in docs.collect():
        want = sorted((m.start(), m.end(), k) for k, x in kinds.items() for m in re.finditer(x, r.text, re.I))
        if r.doc_id:
            assert [tuple(s) for s in by[r.doc_id].spans] == want
    assert P.private(docs.limit(0)).count() == 0
