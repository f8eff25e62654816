"""The operators on vectors against brute force, and on odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from loregrid.llm import vector_dedup, vector_search
from loregrid.llm.vectors import lists, unit

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, cell int, copies int, kind int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    near = np.concatenate([base[:5].repeat(30, 0) + 0.12 * rng.normal(size=(150, 16)), base])
    out = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(near)]
    out += [(1000 + i, out[7][1]) for i in range(40)]  # copies
    out += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (2005, []), (2006, [1.0] * 3), (None, out[7][1]), (2007, (np.array(out[7][1]) * 1000).tolist())]
    return out


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "v", 3, 4, 5) for i, v in vectors], SCHEMA).repartition(3)


def good(vectors):
    keep = [(i, v) for i, v in vectors if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return np.array([i for i, _ in keep]), np.array([v for _, v in keep], np.float64)


@pytest.mark.parametrize("block", [4096, 16])
def test_near_vectors(table, vectors, block, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    ids, x = good(vectors)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = ids.copy()
    for _ in range(len(ids)):
        new = np.minimum(root, np.where(link, root[None, :], 1 << 60).min(1))
        if (new == root).all():
            break
        root = new
    want = {i: (n, r) for i, n, r in zip(ids.tolist(), link.sum(1).tolist(), root.tolist(), strict=True)}
    out = vector_dedup.near_vectors(table).collect()
    assert len(out) == len(vectors)
    for r in out:
        n, c = want.get(r.vec_id, (0, r.vec_id))
        assert (r.n_links, r.component_id, r.kept) == (n, c, r.vec_id == c or r.vec_id is None)


@pytest.mark.parametrize("block, shuffled", [(4096, 0), (64, 10**9), (70, 10**9), (16, 0)])
def test_every_pair_meets_once(table, vectors, block, shuffled, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "SHUFFLED", shuffled)
    monkeypatch.setattr(vector_dedup, "PAIRS", 500)
    ids, x = good(vectors)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    want = dict(zip(ids.tolist(), ((u @ u.T >= 0.9).sum(1) - 1).tolist(), strict=True))
    assert {r.vec_id: r.n_links for r in vector_dedup.near_vectors(table).collect() if r.vec_id in want} == want


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_vectors_of_any_numbers_and_columns_in_any_case(spark, kind):
    rows = [(0, [3.0, 4.0]), (1, [4.0, 3.0]), (2, [-4.0, 3.0])]
    found = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", f"CAST(embedding AS array<{kind}>) AS embedding")
    assert sorted(tuple(r) for r in vector_dedup.near_vectors(found, 0.9, "VEC_ID", "Embedding").collect()) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]


def test_dealing_to_cells_repeats_no_vector():
    x = np.random.default_rng(7).normal(size=(4000, 64))
    points = vector_dedup.pivots(unit(x))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(np.ones(4000, np.int64)), lists(x)], ["id", "copies", "v"])
    out = list(vector_dedup._assign(points, 0.9)([batch]))
    assert len(points) == vector_dedup.PIVOTS and sum(b.num_rows for b in out) == 4000
    assert max(b.nbytes for b in out) <= 2 * batch.nbytes and sum(b.nbytes for b in out) <= 6 * batch.nbytes


@pytest.mark.parametrize("rows", [10**5, 615_384])
def test_pivots_that_prune_little_are_not_worth_their_replicas(rows):
    sample = unit(np.random.default_rng(8).normal(size=(4096, 64)))
    points = vector_dedup.chosen_pivots(sample, 0.9, rows)
    _, replicas, _ = vector_dedup._cells(np.arccos(np.clip(sample @ points.T, -1, 1)), 2 * np.arccos(0.9) + 1e-6)
    assert len(replicas) <= 32 * len(sample)


def test_units_hand_on_links_as_they_find_them():
    def batch(kind, low, n):
        v = lists(1.0 + 0.01 * np.random.default_rng(low).normal(size=(n, 64)))
        return pa.RecordBatch.from_arrays([*(pa.array(np.full(n, k, np.int32)) for k in (0, 0, kind)), pa.array(np.arange(low, low + n)), pa.array(np.ones(n, np.int64)), v], ["cell", "part", "kind", "id", "copies", "v"])

    out = list(vector_dedup._join(0.9)(batch(int(k > 0), 1000 * k, 1000) for k in range(12)))
    assert max(b.num_rows for b in out) <= 2 * vector_dedup.STRIP
    rows = [r for b in out for r in b.to_pylist()]
    assert sum(r["b"] is not None for r in rows) == 11_999  # a spanning tree
    assert sum(r["n"] for r in rows) == 2 * (1000 * 999 // 2 + 1000 * 11_000)


def test_nearest(table, vectors):
    ids, x = good(vectors)
    out = {}
    for r in vector_search.nearest(table, lambda i: i % 20 == 0).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(out) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q, found in out.items():
        found.sort()
        score = dict(zip(ids.tolist(), (x @ x[ids == q][0]).tolist(), strict=True))
        assert [r for r, *_ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(abs(score[v] - s) < 1e-6 * max(1, abs(s)) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        best = sorted((-s, i) for i, s in score.items() if i != q)[:20]
        hits += len({i for _, i in best} & {v for _, v, _ in found})
        total += 20
    assert hits >= 0.9 * total


def full(spark, x, is_query=lambda i: i % 20 == 0):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {}
    for r in vector_search.nearest(table, is_query).collect():
        out.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q, found in out.items():
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        assert len(found) == min(20, len(x) - 1)
        hits += len(found & set(best))
        total += len(best)
    assert set(out) == set(range(0, len(x), 20)) or len(x) == 1
    return hits / max(1, total)


@pytest.mark.parametrize("rows", [2, 5, 11, 40])
def test_every_query_returns_all_it_must(spark, rows):
    assert full(spark, np.random.default_rng(rows).normal(size=(rows, 64))) >= 0.9


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_recall_whatever_the_lengths(spark, spread):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)) * np.exp(spread * rng.normal(size=(3000, 1)))
    assert full(spark, x) >= 0.9


def test_queries_that_meet_too_few_are_completed(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "RECALL", 0.0)
    monkeypatch.setattr(vector_search, "TABLES", 1)
    rng = np.random.default_rng(5)
    monkeypatch.setattr(vector_search, "UNIT", 100)
    assert full(spark, rng.normal(size=(500, 64))) > 0.5


def test_clusters_take_two_axes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 64)).repeat(60, 0) + 0.1 * rng.normal(size=(3600, 64))
    assert vector_search.fit(x, float(np.log(np.sqrt((x * x).sum(1)).max())), 10**9, 10**7).axes == 2
    monkeypatch.setattr(vector_search, "PROBE_COST", 0)
    monkeypatch.setattr(vector_search, "UNIT", 500)
    assert full(spark, x) >= 0.9


def test_copies_are_found_by_smallest_id(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)] + [(500, [1.0, -1.0])], "vec_id long, embedding array<float>")
    out = vector_search.nearest(table, lambda i: i == 40).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(out, key=lambda r: r["rank"])] == [(k + 1, k) for k in range(20)]


def test_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in vector_search.nearest(table, lambda i: i % 20 == 0).collect()] == [(1, 0.5)]
    empty = table.limit(0)
    assert vector_search.nearest(empty, lambda i: i % 20 == 0).count() == 0
    assert vector_dedup.near_vectors(empty).count() == 0
    none = table.where("vec_id = 2")
    assert [tuple(r) for r in vector_dedup.near_vectors(none).collect()] == [(2, 0, 2, True)]
