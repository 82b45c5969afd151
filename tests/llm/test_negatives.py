"""Hard negatives against all inner products."""

import math
from collections import Counter

import numpy as np
import pytest

from siltworks.llm.hard_negatives import best, bit_planes, hard_negatives, scores, subset_tables, values_of

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, row int, planes int"


def brute_force(rows, relabel_every=None, n=5):
    """Result rows as a multiset; rows are (id, vector, label)."""
    own = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        numbers = [math.floor(256 * float(np.float32(x))) for x in v]
        if numbers and max(map(abs, numbers)) ** 2 * len(numbers) >= 2**62:
            continue
        if relabel_every and i is not None and i % relabel_every == 0:
            label = (label + 1) % 10
        own.append((i, numbers, label))
    out = Counter()
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for k, (anchor, a, label) in enumerate(own):
        if anchor is None or anchor % 100:
            continue
        scored = [(i, sum(x * y for x, y in zip(a, v, strict=True)), other) for j, (i, v, other) in enumerate(own) if j != k and len(v) == len(a)]
        negatives = sorted((r for r in scored if r[2] != label), key=order)
        for positive, p, _ in sorted((r for r in scored if r[2] == label), key=order)[:n]:
            inside = [r for r in negatives if 80 * p <= 100 * r[1] <= 100 * p][:n]
            out.update((anchor, positive, rank, i, p, s) for rank, (i, s, _) in enumerate(inside, 1))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)
    return Counter(map(tuple, hard_negatives(df, **options).collect()))


@pytest.mark.parametrize("largest", [0, 1, 2, 150, 2**27])
def test_lookups_are_inner_products(largest):
    rng = np.random.default_rng(largest)
    for dims in (1, 8, 13):
        a, c = (rng.integers(-largest, largest + 1, (n, dims)) for n in (5, 40))
        assert (values_of(bit_planes(a), dims) == a).all()
        assert (scores(subset_tables(a, np.int64), bit_planes(c)) == c @ a.T).all()


def test_planes_of_negative_and_positive_numbers_only():
    for row in ([-1, -1], [-4, -3], [3, 0], [0, 0], [-128, 127]):
        assert values_of(bit_planes(np.array([row])), 2).tolist() == [row]


def test_best_breaks_ties_by_id():
    score, ids = np.array([5, 7, 5, 7, 5, 1]), np.arange(6)
    assert best(score, ids, 3).tolist() == [1, 3, 0]
    assert best(score, ids, 9).tolist() == [1, 3, 0, 2, 4, 5]


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 40)])
def test_negatives_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(8)
    base = rng.normal(0, 0.2, (7, 20))
    rows = [(int(i) * 5, (base[rng.integers(7)] + rng.normal(0, 0.1, 20)).tolist(), int(rng.integers(4))) for i in range(300)]
    expected = brute_force(rows, 7)
    assert len(expected) > 50
    options = {"anchor_block": blocks[0], "candidate_block": blocks[1], "strip": 50, "relabel_every": 7}
    assert found(spark, rows, **options) == expected


def test_negatives_of_edge_cases(spark):
    one, nan, inf = [0.5, 0.5, 0.25], [0.5, float("nan"), 0.1], [0.5, float("inf"), 0.1]
    rows = [
        (0, one, 1), (0, one, 1), (100, one, 1), (3, one, 1), (3, one, 1), (None, one, 1), (5, [0.5, 0.5, 0.2], 2), (6, [0.5, 0.5, 0.2], 2),
        (None, [0.5, 0.5, 0.2], 2), (8, [0.5, 0.5, 0.2], 2), (9, [0.5, 0.4, 0.2], 3), (10, None, 1), (11, one, None), (12, nan, 1), (13, inf, 2),
        (14, [0.5, None, 0.1], 2), (15, [3e38, 0.1, 0.1], 2), (200, [], 1), (201, [], 1), (202, [], 2), (300, [0.1], 5), (400, [0.0, 0.0, 0.0], 7),
        (401, [0.0, 0.0, 0.0], 7), (-100, [-0.5, -0.5, -0.3], 1), (-7, [-0.5, -0.5, -0.3], 9),
    ]
    for every in (None, 7):
        expected = brute_force(rows, every)
        assert found(spark, rows, relabel_every=every) == expected
        assert {anchor for anchor, *_ in expected} >= {0, 100, 200}
    # A third of all rows equal: ties by id, and no group that one task must hold.
    many = [(i, one, i % 2) for i in range(400)] + [(i, [0.1 * (i % 7), 0.3, 0.1], 3) for i in range(400, 900)]
    assert found(spark, many, candidate_block=100) == brute_force(many)


def test_negatives_of_no_rows(spark):
    assert not found(spark, [])
    assert not found(spark, [(1, [0.5], 1), (2, [0.5], 2)])
