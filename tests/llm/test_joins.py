"""N-gram join, embedding near-dedup and components against brute force."""

import random

import numpy as np
import pytest
from cases import EDGE_TEXTS, by_id

from siltworks.llm import ngram_join
from siltworks.llm.components import connected_components, forest
from siltworks.llm.embedding_dedup import cells_of, links, near_duplicate_vectors, pivots_from
from siltworks.llm.ngram_join import ngram_components


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_force(texts):
    """{id: (set size, component)} by comparing all pairs of word tuples."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc_id, text in texts:
        words = (text or "").translate(table).encode().split()
        k = min(5, len(words))
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    ids = sorted(i for i in sets if i is not None and sets[i])
    edges = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) < 0.7 * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                edges.append((a, b))
    found = roots(ids, edges)
    return {i: (len(s), found.get(i, i)) for i, s in sets.items()}


def as_pairs(df):
    return {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(df).items()}


def test_ngram_edge_cases(edge_docs, no_docs):
    found = as_pairs(ngram_components(edge_docs))
    assert found == brute_force(EDGE_TEXTS)
    assert found[9][1] == 8 and found[10][1] == 8 and found[7][1] == 6 and found[5][1] == 4 and found[19][1] == 18
    assert ngram_components(no_docs).count() == 0


def near_copies(seed, n_groups=6, copies=30, words=60):
    """Families of near copies whose pairs lie on both sides of the threshold, and texts that share a long passage."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    texts, passage = [], rng.choices(vocabulary, k=40)
    for _ in range(n_groups):
        base = rng.choices(vocabulary, k=words)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    for _ in range(40):
        texts.append(" ".join(passage + rng.choices(vocabulary, k=rng.randrange(1, 30))))
    rng.shuffle(texts)
    return [(i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block_rows", [8, 512])
@pytest.mark.parametrize("bits", [18, 26])
def test_ngram_components_equal_brute_force(spark, monkeypatch, block_rows, bits):
    """Also with buckets that many shingles share, and with families of many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(ngram_join, "BUCKET_BITS", bits)
    texts = near_copies(block_rows + bits)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert as_pairs(ngram_components(docs)) == brute_force(texts)


def test_ngram_components_of_documents(documents):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    assert as_pairs(ngram_components(documents)) == brute_force(texts)


def test_overlaps_are_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 8000, 8500, 3)]
    for a, b in ((sets, sets), (sets[2:3], sets)):
        expected = [[len(np.intersect1d(x, y)) for y in b] for x in a]
        assert ngram_join.overlaps(a, b).tolist() == expected


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1500)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    edges = [(a, b) for a, b in edges if a != b]
    rng.shuffle(edges)
    df = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long").repartition(6)
    nodes = {n for e in edges for n in e}
    found = {r.node: r.component for r in connected_components(df, "test").collect()}
    assert found == roots(nodes, edges)
    assert connected_components(df.limit(0), "none").count() == 0


def test_forest_keeps_components():
    child, root = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert sorted(zip(child.tolist(), root.tolist(), strict=True)) == [(3, 1), (5, 1), (9, 8)]


def vectors(seed, n=700, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    noise = rng.choice([0.02, 0.15, 0.22, 1.0], n)[:, None]
    return (centres[rng.integers(0, 12, n)] + noise * rng.normal(size=(n, dim))).astype(np.float32)


def exact_links(rows, threshold=0.95):
    wide = rows.astype(np.float64)
    unit = wide / np.linalg.norm(wide, axis=1)[:, None]
    return np.triu(unit @ unit.T >= threshold, 1)


def test_tile_links_equal_double_precision():
    rows = vectors(1).astype(np.float64)
    p, q = links(rows, None, 0.95)
    assert set(zip(p.tolist(), q.tolist(), strict=True)) == set(zip(*np.nonzero(exact_links(rows)), strict=True))
    p, q = links(rows[:300], rows[300:], 0.95)
    found = np.zeros((300, 400), bool)
    found[p, q] = True
    assert (found == exact_links(rows)[:300, 300:]).all()


def test_cells_hold_every_linked_pair():
    rows = vectors(2).astype(np.float64)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    home, visits = cells_of(unit, pivots_from(rows, 9), np.sqrt(0.1))
    for i, j in zip(*np.nonzero(exact_links(rows)), strict=True):
        high, low = (i, j) if home[i] > home[j] else (j, i)
        assert home[i] == home[j] or visits[high, home[low]]


@pytest.mark.parametrize("block_rows", [40, 8192])
def test_near_duplicate_vectors(spark, block_rows):
    rows = vectors(3)
    rows[50:80] = rows[50]
    data = [(int(i) + 10, [float(x) for x in v], 1, "x") for i, v in enumerate(rows)]
    odd = [(1, None), (2, []), (3, [0.0] * 24), (4, [1.0] * 23 + [float("nan")]), (5, [float("inf")] * 24), (6, [None] + [1.0] * 23), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (None, data[0][1])]
    df = spark.createDataFrame(data + [(i, v, 0, "y") for i, v in odd], "vec_id long, embedding array<float>, label int, vector string").repartition(4)
    found = by_id(near_duplicate_vectors(df, block_rows=block_rows, max_cells=7, sample_rows=300), "vec_id")
    near = exact_links(rows)
    near[50:80, 50:80] |= np.triu(np.ones((30, 30), bool), 1)  # equal vectors, whatever rounding says
    component = roots(range(len(rows)), list(zip(*np.nonzero(near), strict=True)))
    degree = near.sum(0) + near.sum(1)
    for i in range(len(rows)):
        assert found[i + 10] == {"vec_id": i + 10, "n_links": degree[i], "component_id": component[i] + 10, "kept": component[i] == i}
    for i in (1, 2, 3, 4, 5, 6):
        assert found[i] == {"vec_id": i, "n_links": 0, "component_id": i, "kept": True}
    assert found[8]["component_id"] == 7 and found[7]["n_links"] == 1
    assert found[None] == {"vec_id": None, "n_links": 0, "component_id": None, "kept": True}


def test_near_duplicates_of_no_vectors_and_bad_threshold(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_duplicate_vectors(none).count() == 0
    with pytest.raises(ValueError):
        near_duplicate_vectors(none, threshold=0)
