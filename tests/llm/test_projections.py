import numpy as np
import pytest

from larkspur.llm import projections


def plain(rows, cosine=0.98):
    def good(v, label):
        return v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(v, dtype=np.float32).astype(float) / np.linalg.norm(np.array(v, dtype=np.float32).astype(float)) if good(v, label) else None for _, v, label in rows]
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], least.get(root(i)), rows[i][0] is not None and rows[i][0] == least[root(i)]) for i in range(n)]


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(1500, 4096), (20, 16)])
def test_matches_brute_force(spark, cell_rows, block_rows):
    rng = np.random.default_rng(0)
    vectors = [rng.standard_normal(24) for _ in range(60)]
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(vectors)]
    for k in range(120):
        base, label = vectors[k % 5], k % 5 % 3
        rows.append((100 + k, (base + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.1, 0.3])).tolist(), label))
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, [None] * 24, 1), (304, [float("inf")] + [1.0] * 23, 1), (305, rows[0][1], None), (306, rows[0][1][:10], 0)]
    rows += [(307, (vectors[1] * 1e30).tolist(), 1), (308, (-vectors[1]).tolist(), 1), (None, rows[1][1], 1), rows[1]]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, links int")
    got = projections.near_vectors(df, cell_rows=cell_rows, block_rows=block_rows).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows)))


def test_empty_table(spark):
    assert projections.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_scheme_reaches_its_recall():
    for largest in (0, 1_000, 100_000, 10**8):
        scheme = projections.scheme_for(largest, 0.98, 0.995, 24, 1_500, 3)
        assert scheme.recall() >= 0.995 and scheme.least > 10


def test_recall_on_the_whole_table(spark, sf):
    from larkspur.llm.queries import op2_embedding_collisions

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: r for r in op2_embedding_collisions(spark, sf).collect()}
    want = plain(rows)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(w[1] for w in want)
    assert all(got[i].n_links <= n for i, n, _, _ in want)
