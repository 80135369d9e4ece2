import math
import tracemalloc

import numpy as np

from opslake.llm import queries, vectors


def brute(rows):
    """(n_links, component) of each id, by all pairs."""
    ids = [i for i, _, _ in rows]
    links = {i: 0 for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    usable = [(i, l, np.array(v, float)) for i, v, l in rows if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for k, (a, la, va) in enumerate(usable):
        for b, lb, vb in usable[k + 1 :]:
            if la == lb and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= vectors.COSINE:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (links[i], find(i)) for i in ids}


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as rep", "1 as cell")
    return vectors.near_duplicates(df, **options).collect()


def test_every_link_whatever_the_cells(spark):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=8)
        for _ in range(20):
            rows.append((len(rows), (centre + rng.normal(size=8) * 0.2).tolist(), int(rng.integers(2))))
    copies = [(len(rows) + k, [2 * x for x in rows[0][1]], rows[0][2]) for k in range(30)]
    rows += copies
    got = result(spark, rows, cell_rows=4)
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum(n for n, _ in want.values()) > 500


def test_blocks_of_one_cell(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=6)
    rows = [(i, (centre + rng.normal(size=6) * 0.15).tolist(), 1) for i in range(90)]
    monkeypatch.setattr(vectors, "BLOCK", 16)
    got = result(spark, rows, cell_rows=30)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_pairs_meet_in_a_shared_cell():
    rng = np.random.default_rng(9)
    units = vectors._unit(rng.normal(size=(500, 12)))
    near = vectors._unit(units + rng.normal(size=units.shape) * 0.04)
    centroids = vectors.spherical_kmeans(units, 40)
    a, b = vectors.cells_of(units, centroids), vectors.cells_of(near, centroids)
    linked = np.flatnonzero((units * near).sum(axis=1) >= vectors.COSINE)
    assert len(linked) > 200 and all(vectors._first_shared(a[i], b[i]) >= 0 for i in linked)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e200, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1),
    ]
    got = result(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id in (1, 2, 12):
            assert (r.n_links, r.component_id, r.kept) == (2, 1, r.vec_id == 1)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert result(spark, []) == []


def test_query_against_all_pairs(spark):
    directory = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in queries.table(spark, directory, "embeddings").collect()]
    got = queries.op6_vectors(spark, directory).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_large_cells_are_split_and_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(60):
        centre = rng.normal(size=8)
        for _ in range(int(rng.integers(2, 12))):
            rows.append((len(rows), (centre + rng.normal(size=8) * 0.15).tolist(), 1))
    clump = rng.normal(size=8)
    rows += [(len(rows) + k, (clump + rng.normal(size=8) * 0.01).tolist(), 1) for k in range(80)]
    monkeypatch.setattr(vectors, "CENTROID_BYTES", 8 * 8 * 3)  # three cells at most
    monkeypatch.setattr(vectors, "SPLIT_CELLS", 2)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    told = []
    inner = vectors._split_cells
    monkeypatch.setattr(vectors, "_split_cells", lambda *a: told.append(inner(*a)) or told[-1])
    got = result(spark, rows, cell_rows=8)
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert sum(n for n, _ in want.values()) > 80 * 79
    parts = {(r.cell, r.part) for r in told[0].select("cell", "part").collect()}
    assert len(parts) > 10 and len({c for c, _ in parts}) <= 3


def test_memory_does_not_grow_with_the_centroids():
    rng = np.random.default_rng(5)
    units = vectors._unit(rng.normal(size=(256, 8)))
    for k in (1_000, 100_000):
        centroids = vectors._unit(rng.normal(size=(k, 8)))
        tracemalloc.start()
        found = vectors.cells_of(units, centroids)
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert len(found) == 256 and peak < 300 << 20
    # As with all distances at hand.
    centroids = centroids[:500]
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    scores = units @ centroids.T
    gap = scores.max(axis=1)[:, None] - scores
    want = gap <= np.sqrt((1 - vectors.COSINE) / 2) * apart[scores.argmax(axis=1)] + 1e-9
    assert all(np.array_equal(cells, np.flatnonzero(row)) for cells, row in zip(vectors.cells_of(units, centroids), want, strict=True))
