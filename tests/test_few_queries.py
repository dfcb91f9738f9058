"""Nearest vectors of a few queries, found where the vectors are, against the comparison in blocks; and the texts a model gets."""

import numpy as np
import pandas as pd
import pytest

from memspark.operators import models, vector_search as vs

DDL = "doc_id string, row_id long, doc_type string, project string, scope string, embedding array<float>"


def _tables(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        # every other vector is one of three, so that many documents tie
        e = np.eye(4)[i % 3] if i % 2 else r.normal(size=4) * (i % 50 > 0)
        rows.append((f"v{i}", i, "x", [None, "a", "b", "c"][i % 4], ["project", "global", None][i % 3], [float(x) for x in e]))
    vectors = spark.createDataFrame(rows, DDL).repartition(3).cache()
    asked = [(i, [None, "a", "b", "zz"][i % 4], [float(x) for x in (np.eye(4)[i % 3] if i % 2 else r.normal(size=4))]) for i in range(12)]
    return vectors, spark.createDataFrame(asked, "query_id long, project string, embedding array<float>")


@pytest.mark.parametrize("by_project", [True, False])
def test_few_queries_find_what_blocks_find_without_a_shuffle_of_vectors(spark, monkeypatch, by_project):
    vectors, queries = _tables(spark)

    def hits():
        h = vs.knn_join(queries, vectors, 7, by_project=by_project)
        return h, sorted((r.query_id, r.rank, r.doc_id, r.row_id, round(r.similarity, 9)) for r in h.collect())

    found, few = hits()
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(vs, "FEW_QUERIES", 0)
    blocks, many = hits()
    assert "FlatMapCoGroups" in blocks._jdf.queryExecution().toString()
    assert few == many and len(few) > 60


def test_no_queries(spark):
    vectors, queries = _tables(spark)
    assert vs.knn_join(queries.limit(0), vectors, 3, by_project=False).count() == 0


def test_a_model_gets_equal_texts_once(spark, tmp_path):
    log = str(tmp_path / "seen")

    def embed(texts: pd.Series) -> list:
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return [np.array([len(t), 1.0]) for t in texts]

    model = models.Embedder("lengths", "lengths-2", 2, embed)
    docs = spark.createDataFrame([(i, ["same", "other", "", None][i % 4]) for i in range(40)], "id long, content string").coalesce(1)
    got = {r.id: list(r.embedding) for r in models.embed_docs(docs, embedder=model).collect()}
    assert got == {i: [[4.0, 1.0], [5.0, 1.0], [0.0, 0.0], [0.0, 0.0]][i % 4] for i in range(40)}
    assert sorted(open(log).read().split("\n")) == ["", "", "other", "same"]


def test_words_of_texts_with_other_letters():
    """The bytes of other letters part words, as the pattern [a-z0-9_]+ has it."""
    import hashlib
    import re
    for text in ("Größe_1 naïve ÅB2 x", "İstanbulK K", "日本 a\x00b", "\x1c_-_"):
        want = np.zeros(64)
        for w in re.findall("[a-z0-9_]+", text.lower()):
            want[int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % 64] += 1
        assert np.array_equal(models.HASHED.embed(pd.Series([text]))[0], want / np.linalg.norm(want))


def test_a_vector_is_shuffled_once_per_large_block_of_queries(spark):
    """600,000 queries ask 600,000 vectors in blocks that a worker can hold; with blocks of 512 queries 700 million vectors moved."""
    copies = 600_000 // vs.QUERY_BLOCK
    assert copies * 600_000 < 30_000_000 and vs.VECTOR_BLOCK <= 65_536


@pytest.mark.parametrize("cells", [40, 2_000_000])
def test_best_pairs_in_single_precision_are_verified(cells, monkeypatch):
    """Similarities that differ less than single precision can tell, ties, vectors of length zero, and vectors to be skipped."""
    monkeypatch.setattr(vs, "CELLS_AT_ONCE", cells)
    monkeypatch.setattr(vs, "PAIRS_AT_ONCE", 7)
    r = np.random.default_rng(5)
    base = r.normal(size=6)
    v = np.array([base + r.normal(size=6) * (10.0 ** -r.integers(1, 7)) for _ in range(300)] + [base] * 9 + [np.zeros(6)] * 3)
    q = np.array([*r.normal(size=(6, 6)), base, -base, np.zeros(6)])
    v, q = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (v, q))
    v_skip, q_skip = r.integers(-1, 3, len(v)), np.array([-2, 0, 1, 2])[np.arange(len(q)) % 4]
    i, j, raw = vs._tops(q, v, q_skip, v_skip, 5)
    for n in range(len(q)):
        sim = 0.5 + (v @ q[n]) / 2
        want = sorted((x for x in range(len(v)) if v_skip[x] < 0 or v_skip[x] != q_skip[n]), key=lambda x: (-round(sim[x], 9), x))[:5]
        assert j[i == n].tolist() == want and np.allclose(raw[i == n], sim[want], atol=1e-12)
