"""Mined negatives against brute force, and the tree's bounds."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, row int, vector string, block int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "i", 1, "v", 2) for r in rows], SCHEMA).repartition(parts)


def mined(spark, rows, **options):
    points = negatives.whole_vectors(frame(spark, rows), "vec_id", F.col("label"), "embedding")
    got = negatives.mine(points, points.filter("id % 10 = 0"), **options)
    return sorted(map(tuple, got.collect()))


def expected(rows, k=5, n=5, low=80, high=100):
    usable = set()
    for i, vector, label in rows:
        if i is not None and vector is not None and label is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for anchor in [u for u in usable if u[0] % 10 == 0]:
        scored = sorted((-sum(x * y for x, y in zip(anchor[2], v, strict=False)), i, lab) for i, lab, v in usable - {anchor})
        for score, positive, _ in [s for s in scored if s[2] == anchor[1]][:k]:
            hits = [s for s in scored if s[2] != anchor[1] and -low * score <= -100 * s[0] <= -high * score][:n]
            out += [(anchor[0], positive, r + 1, s[1], -score, -s[0]) for r, s in enumerate(hits)]
    return sorted(out)


def vectors(seed, count, width=8, groups=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, width))
    made = centres[rnd.integers(0, groups, count)] + rnd.normal(size=(count, width)) * rnd.choice([0.01, 0.3, 1.0], (count, 1))
    return [(i, [float(x) for x in v], int(rnd.integers(0, 4))) for i, v in enumerate(made)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    """Several cells, blocks and levels; copies, ties, and rows that take no part."""
    for name, value in (("CELL_ROWS", 32), ("LEAF_ROWS", 3), ("ANCHOR_BLOCK", 7), ("PIVOT_CELLS", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(seed, 400)
    same = rows[0][1]
    rows += [(1000 + i, same, i % 2) for i in range(120)]  # one very common vector
    rows += [(5000 + i, [0.0] * 8, 1) for i in range(12)] + [(30, [1.0, 2.0], 2), (30, [1.0, 2.0], 3), (31, [], 2)]
    rows += [(40, None, 1), (50, same, None), (None, same, 1), (60, [None, *same[1:]], 1), (70, [float("nan"), *same[1:]], 1)]
    rows += [(80, [float("inf"), *same[1:]], 1), rows[10], rows[10], (90, [-v for v in same], 9)]
    assert mined(spark, rows) == expected(rows)
    assert mined(spark, rows, positives=2, negatives=7, low_percent=50, high_percent=95) == expected(rows, 2, 7, 50, 95)


def test_many_anchors_are_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 5)
    monkeypatch.setattr(negatives, "HELD_BYTES", 100)
    monkeypatch.setattr(negatives.sizing, "MAX_BROADCAST_BYTES", 0)
    settle = negatives.sizing.settle
    monkeypatch.setattr(negatives.sizing, "settle", lambda rows, most=0: (settle(rows)[0], False))
    rows = vectors(3, 300, 5)
    assert mined(spark, rows) == expected(rows)


def test_empty_and_single(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, [1.0, 0.5], 1)]) == []
    assert mined(spark, [(11, [1.0, 0.5], 1), (12, [1.0, 0.5], 2)]) == []


def test_tree_is_nested_covering_and_skips():
    """Every point lies within its ancestors' radii; nets are separated; windows skip leaves."""
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-2000, 2000, (12, 16))
    points = (centres[rnd.integers(0, 12, 900)] + rnd.integers(-20, 20, (900, 16))).astype(float)
    most = float((points * points).sum(axis=1).max())
    tree = negatives.CoverTree.build(np.arange(900), points, most)
    full, nodes = negatives._augmented(tree.points, most), negatives._augmented(tree.centres, most)
    owner = np.repeat(np.arange(len(tree.centres)), np.diff(tree.offsets))
    for level in range(len(tree.sizes) - 1, -1, -1):
        distance = np.linalg.norm(full - nodes[owner], axis=1)
        assert (distance <= tree.radii[level][owner] + 1e-3).all()
        assert tree.sizes[level] > (tree.sizes[level - 1] if level else 0)
        owner = tree.parents[level][owner]
    anchors = tree.points[:5]
    norms = (anchors * anchors).sum(axis=1)
    true = anchors @ tree.points.T
    best = negatives.Best(np.full((5, 1), -np.inf), np.full((5, 1), np.inf), 3)
    negatives.descend(tree, anchors, norms, None, best, np.arange(5))
    assert np.array_equal(best.scores[:, 0], -np.sort(-true, axis=1)[:, :3])
    low, high = norms * 0.98, norms
    anchor, leaf, _ = tree.leaves(anchors, norms, low, high)
    assert len(anchor) < 0.5 * 5 * len(tree.centres)
    seen = {(a, p) for a, j in zip(anchor, leaf, strict=True) for p in range(tree.offsets[j], tree.offsets[j + 1])}
    assert {(a, p) for a in range(5) for p in np.flatnonzero((true[a] >= low[a]) & (true[a] <= high[a]))} <= seen
