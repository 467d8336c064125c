"""The dual-tree search against a plain one over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as module
from millrace.llm.hard_negatives import Block, dual_tree, hard_negatives, interval

SCHEMA = "vec_id long, embedding array<float>, label int, score long, ids string"


def brute(rows, every, positives=5, negatives=3):
    usable = {}
    for vec_id, vec, label, *_ in rows:
        if vec_id is None or label is None or not vec or any(x is None or not np.isfinite(x) for x in vec):
            continue
        row = label, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in vec]
        usable[vec_id] = min(usable.get(vec_id, row), row)
    out = []
    for a, (label, vec) in usable.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v, strict=True)), i, own) for i, (own, v) in usable.items() if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(n, j) for n, j, own in scored if own != label and -50 * p <= -100 * n <= -95 * p][:negatives]
            out += [(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(fits, 1)]
    return sorted(out)


def some_rows(n, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + rng.normal(size=dims) * 0.5).tolist(), int(rng.integers(labels)), 1, "x") for i in range(n)]
    hot = [0.5, *[0.25] * (dims - 1)]
    rows += [(n + i, hot, i % 3 % 2, 1, "x") for i in range(n // 2)]
    rows += [(7 * n, None, 1, 1, "x"), (7 * n + 1, [None, *hot[1:]], 1, 1, "x"), (None, hot, 1, 1, "x"), (50, hot, 1, 1, "x"), (50, hot, 1, 1, "x")]
    return [*rows, (7 * n + 2, [float("nan"), *hot[1:]], 1, 1, "x"), (7 * n + 3, [float("inf"), *hot[1:]], 1, 1, "x"), (7 * n + 4, hot, None, 1, "x"), (7 * n + 5, [], 1, 1, "x")]


@pytest.mark.parametrize("levels", [None, 3])
def test_equals_all_pairs(spark, monkeypatch, levels):
    if levels:
        monkeypatch.setattr(module, "BLOCK", 32)
        monkeypatch.setattr(module, "ANCHOR_BLOCK", 8)
        monkeypatch.setattr(module, "LEAF", 4)
    rows = some_rows(240, 5, 3)
    found = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, F.col("label"), levels=levels)
    want = brute(rows, 10)
    assert len(want) > 100
    assert sorted(map(tuple, found.collect())) == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty, F.col("vec_id") % 10 == 0, F.col("label")).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1, 1, "x")], SCHEMA)
    assert hard_negatives(alone, F.col("vec_id") % 10 == 0, F.col("label")).collect() == []
    assert hard_negatives(alone, F.col("vec_id") % 10 == 1, F.col("label")).collect() == []


def test_intervals_hold_all_products():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 6)) * 100, rng.normal(size=(50, 6)) * 100 + 30
    low, high = interval(x.mean(axis=0)[None], np.array([np.linalg.norm(x - x.mean(axis=0), axis=1).max()]), y.mean(axis=0)[None], np.array([np.linalg.norm(y - y.mean(axis=0), axis=1).max()]))
    assert low[0, 0] <= (x @ y.T).min() and (x @ y.T).max() <= high[0, 0]


def test_groups_are_dropped_without_scoring(monkeypatch):
    """Candidates far from all that is wanted are never scored."""
    near, far = np.full((256, 4), 100), np.full((256, 4), -100)
    blob = lambda x: module.squeeze(x.ravel(), np.zeros(len(x), np.int64), np.arange(len(x) + 1), np.arange(len(x)))
    a, b = Block(blob(near[:8])), Block(blob(np.concatenate([near, far])))
    scored = []
    monkeypatch.setattr(module, "products", lambda a, rows, b, at, own=module.products: scored.append(len(at)) or own(a, rows, b, at))
    found = dual_tree(a, np.full((8, 1), 1), np.full((8, 1), 10**9), b, True, 3)
    assert len(found) == 24 and all(f[2] == 40_000 for f in found)
    assert sum(scored) <= 512 and max(scored) <= 256 + 64


def test_both_trees_against_all_products():
    rng = np.random.default_rng(2)
    blob = lambda x, labels: module.squeeze(x.ravel(), labels, np.arange(len(x) + 1), np.arange(len(x)) * 3 % len(x))
    x, y = rng.integers(-9, 10, (301, 3)), rng.integers(-9, 10, (700, 3))
    x, y = x[module.in_order(x)], y[module.in_order(y)]
    own, other = rng.integers(0, 3, len(x)), rng.integers(0, 3, len(y))
    a, b = Block(blob(x, own)), Block(blob(y, other))
    assert a.levels == 2 and b.levels == 3
    least, most = rng.integers(-50, 20, (len(x), 2)), rng.integers(0, 150, (len(x), 2))
    for same in (True, False):
        found = dual_tree(a, least, most, b, same, 4)
        want = []
        for i in range(len(x)):
            scores = sorted((-int(s), int(k)) for s, k, lab in zip(y @ x[i], b.ids, other, strict=True) if (lab == own[i]) == same)
            for j in range(2):
                want += [(i, j, -s, k) for s, k in [s for s in scores if least[i, j] <= -s[0] <= most[i, j]][:4]]
        assert sorted(found) == sorted(want)
