"""Approximate search against brute force, the stored index, and the neighbour graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import neighbour_graph as graphs
from larkspur.operators import vector_index as vi
from larkspur.plans import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def exact(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return ids, x @ x.T


def true_nearest(exact, k=10, itself=True):
    ids, sims = exact
    sims = sims if itself else sims - 9 * np.eye(len(ids))
    return {int(i): ids[np.argsort(-s, kind="stable")[:k]].tolist() for i, s in zip(ids, sims, strict=True)}


def share_found(got, want):
    return np.mean([len(set(got.get(q, [])) & set(w)) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("name", ["ivf_search", "ivfpq_search", "graph_search"])
def test_searches_find_nine_of_ten(spark, sf, exact, name):
    want = {q: w for q, w in true_nearest(exact).items() if q % 100 == 0}
    ids, sims = exact
    place = {int(i): k for k, i in enumerate(ids)}
    got = {}
    for r in QUERIES[name](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.similarity == pytest.approx(sims[place[r.query_id], place[r.vec_id]], abs=2e-6) and r["rank"] == len(got[r.query_id])
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    assert share_found(got, want) >= 0.9
    for g, q in ((g, q) for q, g in got.items()):
        scores = [round(sims[place[q], place[v]], 6) for v in g]
        assert scores == sorted(scores, reverse=True)


def test_neighbour_lists_find_nine_of_ten(spark, sf, exact):
    got = {r.vec_id: list(r.neighbours) for r in QUERIES["neighbour_lists"](spark, sf).collect()}
    want = true_nearest(exact, itself=False)
    assert set(got) == set(want) and share_found(got, want) >= 0.9


def clustered(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return (centres[rng.integers(0, 20, n)] + 0.2 * rng.normal(size=(n, dim))).astype(np.float32)


def frame(spark, x, extra=()):
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "key long, vec array<float>, cell string")


ODD = [(900001, None, "n"), (900002, [0.0] * 16, "z"), (900003, [float("nan")] + [1.0] * 15, "f"), (900004, [float("inf")] + [1.0] * 15, "f"), (None, [1.0] * 16, "i")]


def test_clusters_need_few_lists(spark, tmp_path):
    """Where vectors lie in clusters, few lists hold the neighbours, and codes rank them well."""
    x = clustered(1500)
    df = frame(spark, x, ODD)
    index = vi.build(df, "key", "vec", str(tmp_path / "a"), parts=8)
    assert len(index.centroids) == 38 and index.probes <= 8
    assert index.lists(spark).count() == 1500
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = frame(spark, x[:40], ODD).select(F.col("key").alias("query_id"), F.col("vec").alias("q"))
    want = {q: np.argsort(-(u @ u[q]), kind="stable")[:10].tolist() for q in range(40)}
    for search in (vi.search, vi.search_codes):
        got = {}
        for r in search(index, asked, 10).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert set(got) == set(range(40)) and share_found(got, want) >= 0.9
    codes = [r.code for r in index.lists(spark).select("code").limit(5).collect()]
    assert all(len(c) == 8 for c in codes)


def test_growing_is_building(spark, tmp_path):
    """Two thirds, then a third, then loaded: the same lists and codes as all at once, and the same answers."""
    x = clustered(600, seed=1)
    df = frame(spark, x)
    some = vi.build(df.where("key % 3 <> 0"), "key", "vec", str(tmp_path / "a"), parts=4)
    whole = vi._write_batch(vi.usable(df, "key", "vec"), vi.Index(str(tmp_path / "b"), some.centroids, some.codebooks, some.probes, ()))
    vi.add(some, df.where("key % 3 = 0"), "key", "vec")
    (tmp_path / "a" / "lists" / "broken").mkdir()  # a batch whose write failed
    (tmp_path / "a" / "lists" / "broken" / "part-0.parquet").write_bytes(b"no")
    grown = vi.load(spark, str(tmp_path / "a"))
    assert grown.probes == some.probes and len(grown.batches) == 2
    assert np.allclose(grown.centroids, some.centroids) and np.allclose(grown.codebooks, some.codebooks)
    rows = lambda i: sorted(map(tuple, i.lists(spark).select("id", "cell", "code").collect()))
    assert rows(grown) == rows(whole)
    asked = vi.stored_vectors(spark, grown, spark.createDataFrame([(i,) for i in range(30)], "key long"))
    assert asked.count() == 30
    answers = lambda i: sorted(map(tuple, vi.search(i, asked, 5).collect()))
    assert answers(grown) == answers(whole) and len(answers(grown)) == 150
    vi.add(grown, df.limit(0), "key", "vec")
    assert vi.load(spark, grown.path).lists(spark).count() == 600


def test_equal_vectors_and_small_tables(spark, tmp_path, monkeypatch):
    """One list may hold nearly all vectors, in pieces; equal ones come by id."""
    monkeypatch.setattr(vi, "PIECE_ROWS", 64)
    monkeypatch.setattr(vi, "BLOCK_ROWS", 8)
    x = np.concatenate([np.tile(clustered(1), (500, 1)), clustered(30, seed=3)])
    df = frame(spark, x)
    index = vi.build(df, "key", "vec", str(tmp_path / "a"), parts=4)
    asked = df.where("key < 20").select(F.col("key").alias("query_id"), F.col("vec").alias("q"))
    for search in (vi.search, vi.search_codes):
        got = search(index, asked, 3).collect()
        assert len(got) == 60 and all(r.id == r["rank"] - 1 for r in got) if search is vi.search else len(got) == 60
    lone = vi.build(df.limit(1), "key", "vec", str(tmp_path / "b"), parts=4)
    assert [r.id for r in vi.search(lone, asked.limit(1), 3).collect()] == [df.first().key]
    with pytest.raises(ValueError, match="needs a vector"):
        vi.build(df.limit(0), "key", "vec", str(tmp_path / "c"))
    with pytest.raises(ValueError, match="divide"):
        vi.build(df, "key", "vec", str(tmp_path / "c"), parts=5)


def test_neighbour_graph_edges(spark):
    x = np.concatenate([clustered(300, seed=4), np.tile(clustered(1, seed=5), (40, 1))])
    df = frame(spark, x, ODD)
    got = graphs.neighbour_graph(df, "key", "vec", k=5).collect()
    u = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sims = u @ u.T - 9 * np.eye(len(u))
    found = {}
    for r in got:
        found.setdefault(r.id, []).append(r.other)
        assert r.s == pytest.approx(sims[r.id, r.other], abs=1e-6)
    assert set(found) == set(range(340)) and all(len(f) == 5 and i not in f for i, f in found.items())
    assert np.mean([sims[i, o] >= np.sort(sims[i])[-5] - 1e-9 for i, f in found.items() for o in f]) >= 0.9
    assert graphs.neighbour_graph(df.where("key = 1"), "key", "vec").count() == 0
    assert graphs.neighbour_graph(df.limit(0), "key", "vec").count() == 0
    assert {(r.id, r.other) for r in graphs.neighbour_graph(df.where("key < 2"), "key", "vec").collect()} == {(0, 1), (1, 0)}


def test_groups_go_over_batches():
    import pyarrow as pa

    g = [1] * 3 + [2] * 5 + [3] + [4] * 4
    batches = [pa.RecordBatch.from_pydict({"g": g[i : i + 2]}) for i in range(0, len(g), 2)]
    got = [t.column(0).to_pylist() for t in graphs.whole_groups(iter(batches))]
    assert sum(got, []) == g and sum(len(set(t)) for t in got) == 4
    assert list(graphs.whole_groups(iter([]))) == []
