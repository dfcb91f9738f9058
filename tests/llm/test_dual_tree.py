"""Dual-tree vector codes against Lloyd's rounds over all pairs in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from memspark.llm import dual_tree


def lloyd(rows, parts=8, k=16, rounds=6, scale=4096):
    """(key, label, code, error) of every kept row and the codebooks' hash, by comparing every part with every entry."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    whole = [[math.floor(scale * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1], kept[i][2] or 0))[:k]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for v in cut:
                own[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)]
    out = []
    for (key, _, label), v in zip(kept, cut, strict=True):
        best = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((key, label, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "id long, v array<double>, label int, code string, error int, key int")
    got = dual_tree.compress(df.repartition(3), "id", "v", "label", **more).collect()
    want, sha = lloyd(rows, **{"k" if a == "entries" else a: b for a, b in more.items()})
    per_label = {}
    for _, label, _, error in want:
        per_label[label] = per_label.get(label, 0) + error
    assert sorted(((r["id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == sorted(
        ((i, code, error, per_label[label]) for i, label, code, error in want), key=str)
    assert {r["codebooks_sha256"] for r in got} <= {sha}
    return got


def vectors(n, dims, seed, grid=None):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    out = []
    for i in range(n):
        v = [c + r.gauss(0, 0.05) for c in r.choice(centres)]
        out.append((i * 3 % n, [round(x * grid) / grid for x in v] if grid else v, r.choice([None, 1, 2, 3])))
    return out


def test_like_lloyd_over_all_pairs(spark):
    check(spark, vectors(300, 16, 1))
    check(spark, vectors(200, 40, 2), parts=4, entries=7, rounds=3, scale=100)


def test_ties_and_repeated_rows(spark):
    rows = vectors(200, 8, 4, grid=2)  # few distinct parts, so equal entries and equal distances
    check(spark, rows + rows[:50] + [(0, [0.0] * 8, 1)] * 40)


def test_edges(spark):
    odd = [(1, None, 1), (2, [0.5, None], 1), (3, [float("nan"), 1.0], 2), (4, [float("-inf")] * 3, None)]
    assert check(spark, odd) == []
    assert check(spark, []) == []
    uneven = [(None, [0.25] * 9, None), (7, [], None), (7, [-0.1], 4), (7, [-0.1], 4), (9, [0.3] * 5, 4), (2, [1e-9, -1e-9], 5)]
    assert len(check(spark, odd + uneven)) == len(uneven)
    with pytest.raises(ValueError):
        check(spark, [(1, [1e12] * 8, 1)])


def test_blocks_and_leaves_do_not_matter(spark, monkeypatch):
    rows = vectors(120, 8, 6)
    monkeypatch.setattr(dual_tree, "BLOCK_VALUES", 200)
    check(spark, rows)


def test_trees_prune_and_assign_whole_nodes():
    r = np.random.default_rng(5)
    centres = r.integers(-4000, 4000, (2, 16, 4))
    points = np.stack([c[r.integers(0, 16, 5000)] for c in centres]) + r.integers(-60, 60, (2, 5000, 4))
    tree, entries = dual_tree.build(points, 16), dual_tree.build(centres, 1)
    found = dual_tree.assign(tree, entries)
    assert found.compared < 0.02 * 2 * 5000 * 16 and min(level for level, *_ in found.whole) <= len(tree.bounds) - 3
    code, error = dual_tree.codes(tree, entries)
    gap = ((points[:, :, None] - centres[:, None]) ** 2).sum(3)
    assert (code == gap.argmin(2)).all() and (error == gap.min(2)).all()
    count, total = dual_tree.sums(tree, entries)
    for p in range(2):
        for e in range(16):
            own = points[p][code[p] == e]
            assert count[p, e] == len(own) and (total[p, e] == own.sum(0)).all()
