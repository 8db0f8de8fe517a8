"""Cases that only show beyond the smallest tables: several shuffle partitions, other alphabets, whole results."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from larkspur.operators import entities, retrieval, validity
from larkspur.operators import exact_search as exact
from larkspur.operators import neighbour_graph as graphs
from larkspur.operators import vector_index as vi
from larkspur.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def no_coalescing(spark):
    """Shuffles keep all their partitions, as they do on large tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def same_as_sql(spark, folder, name, *tables):
    """Rows of a query over ``folder``, which are those of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if (folder / f'{t}.parquet').is_dir() else ''}'")
    got = QUERIES[name](spark, str(folder))
    rows = sorted((tuple(r[c] for c in got.columns) for r in got.toArrow().to_pylist()), key=repr)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert rows == sorted(want, key=repr)
    return rows


def test_lists_meet_all_queries_across_partitions(spark, tmp_path, no_coalescing):
    x = np.random.default_rng(5).normal(size=(600, 32)).astype(np.float32)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = vi.build(e, "vec_id", "embedding", str(tmp_path / "index"))
    asked = e.where("vec_id < 4").selectExpr("vec_id AS query_id", "embedding AS q")
    found = vi.search(index, asked, 600, probes=len(index.centroids))
    assert found.groupBy("query_id").count().where("count = 600").count() == 4


@pytest.mark.parametrize(("name", "bound"), [("authority_boost", 0.1), ("medical_rerank", 0), ("pipeline_rerank", 0)])
def test_reranks_give_every_match(spark, sf, name, bound):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toArrow()
    x = np.array(e.column("embedding").to_pylist(), dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked = x[e.column("vec_id").to_numpy() % 100 == 0]
    assert QUERIES[name](spark, sf).count() == (asked @ x.T > bound).sum()


def test_units_end_where_words_end(spark, tmp_path):
    """RE2 ends a word before a letter that isn't ASCII; 5 st\u00df has no unit, and \u00e45 % no number of its own."""
    texts = ["a 5 st\u00df b 6 st c 7 st. 8 main", "x\u00e45 % y 6 % \u00e9not so. We have it. not\u00e9 that", None, "1 st 2 st 3 of"]
    folder = tmp_path / "tables"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    rows = same_as_sql(spark, folder, "fact_extraction", "documents")
    assert sum(r[1] == "measure" for r in rows) == 6 and sum(r[1] == "percent" for r in rows) == 1


@pytest.mark.parametrize("k", [3, None])
def test_exact_search_over_many_pieces(spark, monkeypatch, no_coalescing, k):
    """Small pieces, blocks and strips, copies at the edge of the best, vectors without a length, groups without a name."""
    for name, most in (("PIECE_ROWS", 7), ("BLOCK_ROWS", 3), ("STRIP", 2)):
        monkeypatch.setattr(exact, name, most)
    x = np.random.default_rng(6).normal(size=(60, 4)).astype(np.float32)
    x[20:40] = x[0]
    vectors = [None if i == 50 else [0.0] * 4 if i == 51 else v.tolist() for i, v in enumerate(x)]
    e = spark.createDataFrame([(i, v, None if i % 5 == 0 else i % 5, 1.0 + i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, f double")
    asked = e.where("vec_id % 10 = 0 AND vec_id < 50").selectExpr("vec_id AS query_id", "embedding AS q")
    found = exact.search(e, asked, "vec_id", k, factor=e["f"], above=-0.5, group="label")
    got = sorted((r.query_id, r.vec_id, r.score) for r in found.collect())
    want = []
    x[50:52] = 0
    for q in range(0, 50, 10):
        n = np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])
        sim = np.divide(x.astype(float) @ x[q].astype(float), n, out=np.zeros(60), where=n > 0)
        raw = {i: sim[i] * (1 + i % 3) for i in range(60) if sim[i] > -0.5}
        best = {g: max(s for i, s in raw.items() if i % 5 == g) for g in range(5)}
        rows = sorted((-round(s / best[i % 5], 6) if best[i % 5] > 0 else -round(s, 6), i) for i, s in raw.items())
        want += [(q, i, -s) for s, i in rows[:k]]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], atol=2e-6)


def test_ids_on_a_stream_keep_their_digits(spark, tmp_path):
    folder = tmp_path / "tables"
    spark.sql("SELECT 1152921504606846977 + id AS event_id, id % 3 AS user_id, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id * 37 % 200 AS INT)) AS ts FROM range(30)").coalesce(1).write.parquet(str(folder / "events.parquet"))
    rows = same_as_sql(spark, folder, "stream_recent", "events")
    assert len(rows) == 30 and any(True in r for r in rows)


def test_streams_keep_rows_without_user_time_or_id(spark, tmp_path):
    """Null users are a user, rows without a time come last, and times before 1970 and in a gap of the session's zone count as they are."""
    folder = tmp_path / "tables"
    ts = "CASE WHEN id % 7 = 0 THEN null WHEN id % 5 = 0 THEN timestamp_ntz '1969-12-31 20:00:00.000500' ELSE timestamp_ntz '2024-03-31 00:00:00.000500' END + make_dt_interval(0, 0, CAST(id * 37 % 200 AS INT))"
    spark.sql(f"SELECT CASE WHEN id % 11 > 0 THEN id END AS event_id, CASE WHEN id % 3 > 0 THEN id % 3 END AS user_id, {ts} AS ts FROM range(300)").coalesce(1).write.parquet(str(folder / "events.parquet"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = same_as_sql(spark, folder, "stream_recent", "events")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(rows) == 300 and sum(True in r for r in rows) > 100


def test_orders_settle_without_a_call_each(spark):
    """Each group is settled by expressions, without a Python worker."""
    df = spark.createDataFrame([(0, 1, "x", 0.9), (0, 1, "y", 0.5), (0, 2, "x", 0.8), (0, 2, "z", 0.4), (1, 2, "x", 0.2), (1, 1, "x", 0.4)], "g int, r int, i string, s double")
    found = retrieval.exclusive_assignment(df, "g", "r", "i", "s", 0.3, each=2)
    assert {tuple(x) for x in found.collect()} == {(0, 1, "x", 0.9), (0, 1, "y", 0.5), (0, 2, "z", 0.4), (1, 1, "x", 0.4)}
    assert "Pandas" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("measure", ["jaccard", "overlap"])
def test_set_search_over_many_pieces(spark, monkeypatch, no_coalescing, measure):
    """Small pieces, repeated members, a member of all sets, empty and null sets and members."""
    for name, most in (("PIECE_ROWS", 7), ("BLOCK_ROWS", 3), ("STRIP", 2)):
        monkeypatch.setattr(exact, name, most)
    sets = [None if i == 40 else [] if i == 41 else ["all", "all", None, f"a{i % 3}", f"b{i % 7}", f"c{i}"][: 3 + i % 4] for i in range(42)]
    df = spark.createDataFrame(list(enumerate(sets)), "i long, members array<string>")
    asked = df.where("i % 10 = 0 OR i = 41").selectExpr("i AS query_id", "members AS q")
    want = []
    for q in (0, 10, 20, 30):
        b, rows = set(sets[q]) - {None}, []
        for i, own in enumerate(sets):
            if a := set(own or ()) - {None}:
                s = round(len(a & b) / (len(a | b) if measure == "jaccard" else min(len(a), len(b))), 6)
                rows += [(-s, i)] if s >= 0.3 else []
        want += [(q, i, -s) for s, i in sorted(rows)[:5]]
    got = exact.set_search(df, asked, "i", 5, 0.3, measure)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_equal_sets_meet_once(spark, monkeypatch):
    """Of 900 rows with three sets in any order, a search over the four best of each set gives the best of all."""
    sets = [["a", "b"], ["b", "a", "c"], ["d"]]
    df = spark.createDataFrame([(i, sets[i % 3][:: 1 if i % 2 else -1]) for i in range(900)], "i long, members array<string>")
    seen, packed = [], exact.packed
    monkeypatch.setattr(exact, "packed", lambda df, key, most, rows, *a: seen.append(rows) or packed(df, key, most, rows, *a))
    found = exact.set_search(df, df.where("i % 10 = 0").selectExpr("i AS query_id", "members AS q"), "i", 4, 0.5)
    want = {0: [(i, 1.0) for i in (0, 3, 6, 9)], 1: [(i, 1.0) for i in (1, 4, 7, 10)], 2: [(i, 1.0) for i in (2, 5, 8, 11)]}
    assert sorted(map(tuple, found.collect())) == [(q, i, s) for q in range(0, 900, 10) for i, s in want[q % 3]]
    assert seen == [12, 3]


def test_mentions_of_small_groups_meet_without_words(spark, monkeypatch, no_coalescing):
    """Pairs are those of all mentions compared, whether groups are small, large or both; small ones rank no words."""
    rows = [(f"{i:02}", i % 3 if i < 30 else None, f"s{i % 4}", "%" if i % 5 else "mm", float(i * 7 % 40), ["all", f"a{i % 2}", f"b{i % 3}", "all"]) for i in range(36)]
    df = spark.createDataFrame(rows, "id string, topic int, src string, unit string, value double, words array<string>")
    want = []
    for a in rows[:30]:
        for b in rows[:30]:
            gap = abs(a[4] - b[4]) * (1 if a[3] == "%" else 100 / (max(a[4], b[4]) or 1))
            if a[0] < b[0] and a[1] == b[1] and a[3] == b[3] and a[2] != b[2] and len(set(a[5]) & set(b[5])) >= 2 and gap > (3 if a[3] == "%" else 20):
                want.append((a[0], b[0], a[4], b[4]))
    asked, ranked = [], validity.rare_words
    monkeypatch.setattr(validity, "rare_words", lambda *a: asked.append(a) or ranked(*a))
    for most, times in ((256, 0), (1, 1), (4, 2)):
        monkeypatch.setattr(validity, "TOGETHER", most)
        found = validity.number_conflicts(df).collect()
        assert sorted((r.a, r.b, r.av, r.bv) for r in found) == sorted(want) and len(asked) == times


@pytest.mark.parametrize("most", [2, 100_000])
def test_pairs_come_once_without_a_distinct(spark, monkeypatch, no_coalescing, most):
    """Facts that share several rare words, with words that are frequent and others."""
    monkeypatch.setattr(entities, "FREQUENT", most)
    rows = [(f"{i}", "mg", float(1 + i % 4), ["all", f"a{i % 2}", f"b{i % 3}", f"c{i}"]) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, unit string, value double, words array<string>")
    found = entities.fact_conflicts(df.where("id % 2 = 0"), df.where("id % 3 = 0"), shared=2)
    want = [(a[0], b[0]) for a in rows for b in rows if int(a[0]) % 2 == 0 and int(b[0]) % 3 == 0 and len(set(a[3]) & set(b[3])) >= 2 and abs(a[2] - b[2]) > 0.15 * max(a[2], b[2])]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Deduplicate" not in (plan := found._jdf.queryExecution().logical().toString()) and "Distinct" not in plan


def recall_of_lists(spark, x, k=10, **parameters):
    """Share of the places in lists that are as near as the exact ones, of some vectors; lists have no vector twice or itself."""
    e = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x.astype(np.float32))}))
    got = graphs.neighbour_graph(e, "vec_id", "embedding", k, **parameters).toArrow()
    ids, others = got.column("id").to_numpy(), got.column("other").to_numpy()
    assert len(ids) == k * len(x) and len(np.unique(ids * len(x) + others)) == len(ids) and (ids != others).all()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    some = np.arange(0, len(x), max(1, len(x) // 200))
    s = u[some] @ u.T
    s[np.arange(len(some)), some] = -9
    bar = np.partition(s, -k, axis=1)[:, -k]
    place = np.full(len(x), -1)
    place[some] = np.arange(len(some))
    mine = place[ids] >= 0
    return (s[place[ids[mine]], others[mine]] >= bar[place[ids[mine]]] - 1e-6).sum() / (k * len(some))


def test_neighbour_lists_of_vectors_without_structure(spark):
    """Rounds from random groups lost a fifth of these."""
    assert recall_of_lists(spark, np.random.default_rng(8).normal(size=(24000, 64))) >= 0.9


@pytest.mark.parametrize(("trees", "enough"), [(64, 0.0), (2, 2.0)])
def test_neighbour_lists_with_many_copies(spark, monkeypatch, no_coalescing, trees, enough):
    """Leaves that copies crowd are dealt into pieces; few trees are followed by rounds."""
    for name, value in (("LEAF_ROWS", 128), ("MOST_TREES", trees), ("ENOUGH", enough), ("STRIP", 16), ("ENTRIES", 1000)):
        monkeypatch.setattr(graphs, name, value)
    x = np.random.default_rng(9).normal(size=(2000, 16))
    x[500:1200] = x[0]
    assert recall_of_lists(spark, x) >= 0.9


def test_walks_carry_their_best_nodes_alone(spark, monkeypatch, no_coalescing):
    """A walk over a graph with a hub ends as one in plain Python does, and no more than the beam goes from round to round."""
    x = np.random.default_rng(10).normal(size=(300, 8)).astype(np.float32)
    links = {(i, j) for i in range(300) for j in ((i * 7 + 1) % 300, (i + 1) % 300, 5) if i != j}
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    asked = nodes.where("id < 6").selectExpr("id AS query_id", "v AS q").unionByName(spark.createDataFrame([(900, [0.0] * 8), (901, None)], "query_id long, q array<float>"))
    sizes, cut = [], graphs.cut_lineage
    monkeypatch.setattr(graphs, "EDGES", 2, raising=False)
    monkeypatch.setattr(graphs, "cut_lineage", lambda df: (sizes.append(df.groupBy("query_id").count().agg({"count": "max"}).first()[0]) if "fresh" in df.columns else None, cut(df))[1])
    got = graphs.graph_search(nodes, spark.createDataFrame(sorted(links), "id long, other long"), asked, k=4, beam=12, entries=3).collect()
    starts = [r.id for r in vi.least_hashes(nodes, 3).collect()]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    beside = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in range(300)}
    want = []
    for q in range(6):
        s, seen, looked = u @ u[q], set(starts), set()
        best = lambda: sorted(seen, key=lambda i: (-s[i], i))[:12]  # noqa: B023, E731
        while front := set(best()) - looked:
            looked |= front
            seen |= set().union(*(beside[i] for i in front))
        want += [(q, i, n) for n, i in enumerate(best()[:4], 1)]
    assert sorted((r.query_id, r.id, r["rank"]) for r in got) == sorted(want)
    assert max(sizes) <= 12
