"""Cross-polytope search against exact search, and I-Match fingerprints against a plain version."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import cross_polytope, fingerprints


def vectors(n, d, seed):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


def search(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows],
                               "id long, v array<float>, rank int").repartition(3)
    return cross_polytope.search(df, "id", "v", F.col("id") % 20 == 0, **kw).collect()


def test_recall_and_scores(spark):
    x = vectors(600, 24, 1)
    got = search(spark, list(enumerate(x)), k=10)
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(exact[q, r["id"]], abs=1e-12) for r in mine)
        assert [(-r["score"], r["id"]) for r in mine] == sorted((-r["score"], r["id"]) for r in mine)
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-exact[q, i], i))[:10]
        hits += len({r["id"] for r in mine} & set(order))
    assert hits >= 0.9 * 300


def test_copies_ties_and_invalid_vectors(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BUCKET_ROWS", 16)
    monkeypatch.setattr(cross_polytope, "QUERY_ROWS", 2)
    x = vectors(40, 8, 2)
    rows = [(i, x[i]) for i in range(40)] + [(100 + i, x[0]) for i in range(70)]  # one vector for most rows
    rows += [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [1.0, None] * 4), (280, []), (300, [1.0] * 3), (None, x[1])]
    got = search(spark, rows, k=20, tables=16, probes=16)
    assert {r["query_id"] for r in got} == {0, 20, 100, 120, 140, 160, 300}
    best = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == 120)
    copies = [0, *range(100, 170)]
    copies.remove(120)
    assert [i for _, i in best] == copies[:20]


def test_every_query_gets_as_many_as_there_are(spark):
    r = np.random.default_rng(3)
    rows = [(i + 1, [1.0, *(r.normal(size=15) * 1e-3)]) for i in range(399) if (i + 1) % 20] + [(20, [-1.0] + [0.0] * 15), (40, [0.0, 1.0] + [0.0] * 14)]
    got = search(spark, rows, k=20, tables=2, probes=1)
    exact = {q: sorted((-sum(a * b for a, b in zip(np.float32(v).tolist(), np.float32(x).tolist(), strict=True)), i) for i, x in rows if i != q)[:20] for q, v in rows[-2:]}
    for q in (20, 40):
        mine = sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])
        assert len(mine) == 20
        if q == 20:  # it found nothing at first, so it probed all
            assert [x["id"] for x in mine] == [i for _, i in exact[q]]


def test_ids_with_several_vectors(spark):
    x = vectors(30, 8, 5)
    rows = [(i + 1, x[i]) for i in range(30)] + [(20, x[0] * 2), (20, x[19])]
    got = [r for r in search(spark, rows, k=5, tables=4, probes=64) if r["query_id"] == 20]
    asks = min(x[19].tolist(), (x[0] * 2).tolist())
    want = sorted((-float(np.float64(asks) @ np.float64(v)), i) for i, v in rows if i != 20)[:5]
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [i for _, i in want]


def test_products_grow_slower_than_the_table(spark):
    r = np.random.default_rng(8)
    share = []
    for n in (400, 6400):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(n, 24)))], "id long, v array<double>")
        rows, asking, done = cross_polytope.products(df, "v", F.col("id") % 20 == 0)
        assert (rows, asking) == (n, n // 20)
        share.append(done / asking / n)
    assert share[1] < 0.5 * share[0]


def test_few_or_no_vectors(spark):
    got = search(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])], k=20)
    assert [tuple(r) for r in got] == [(0, 1, 1, 4.0)]
    assert search(spark, []) == []


def test_hadamard_is_orthonormal():
    h = cross_polytope.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


WORDS = [f"w{i}" for i in range(400)]


def texts():
    r = np.random.default_rng(3)
    out = [" ".join(r.choice(WORDS, r.integers(1, 80))) for _ in range(120)]
    return [*out, out[0], out[0].upper(), "", None, "one", "ä ö\tü\n\nx", "é" * 501, "  "]


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_edits_follow_the_next_document(spark, buckets):
    rows = [(i * 3, t) for i, t in enumerate(texts())] + [(6, "same id"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "id long, text string, own int").repartition(4)
    got = fingerprints.with_next(df.select(F.col("id").alias("key"), F.coalesce("text", F.lit("")).alias("text")), "key", ["text"], buckets)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = [(k, t or "", order[(i + 1) % len(order)][1] or "") for i, (k, t) in enumerate(order)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_fingerprints(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "id long, text string, fingerprint int").repartition(4)
    got = {r["id"]: r for r in fingerprints.fingerprint_edits(df, "id", "text").collect()}
    ids = sorted(got, reverse=True)
    by_text = {}
    for n, k in enumerate(ids):
        text, after = rows[k][1] or "", rows[ids[(n + 1) % len(ids)]][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[k]["n_chars"] == len(text) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
        assert by_text.setdefault(text, got[k]["fingerprint"]) == got[k]["fingerprint"]
    assert got[0]["fingerprint"] == got[121]["fingerprint"]  # letter case does not count
    near = np.mean([r["near_edited"] for r in got.values()])
    assert near > 3 * np.mean([r["near_next"] for r in got.values()])


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert fingerprints.fingerprint_edits(df, "id", "text").collect() == []
