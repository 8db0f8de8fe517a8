import zlib
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import sharding


def shuffled(spark, n, shards=4, seed=1, **kw):
    df = spark.createDataFrame([(i if i % 5 else None, f"t{i}", 9) for i in range(n)], "doc_id long, text string, shard int").repartition(3)
    return sharding.shuffle_to_shards(df, shards, seed, **kw).collect()


@pytest.mark.parametrize("rows_each", [2048, 3])
def test_every_row_once_in_gapless_shards(spark, rows_each):
    rows = shuffled(spark, 103, rows_each=rows_each)
    assert sorted(r.text for r in rows) == sorted(f"t{i}" for i in range(103))
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_few_or_no_rows_and_repeats(spark):
    assert shuffled(spark, 0) == []
    assert len(shuffled(spark, 2, 5)) == 2
    df = spark.createDataFrame([(1, "a")] * 10, "doc_id long, text string")
    assert Counter(r.shard for r in sharding.shuffle_to_shards(df, 5).collect()) == Counter(dict.fromkeys(range(5), 2))


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(i, -i, str(i), 7, i) for i in range(30)], "`_key` long, `_row` long, `a.b` string, slot int, c1 long")
    rows = sharding.shuffle_to_shards(df, 3).collect()
    assert sorted((r["_key"], r["_row"], r["a.b"], r["c1"]) for r in rows) == [(i, -i, str(i), i) for i in range(30)]
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(3) for k in range(10)]


def test_seed_decides(spark):
    a, b, c = (shuffled(spark, 60, seed=s) for s in (1, 1, 2))
    place = lambda rows: {r.text: (r.shard, r.slot) for r in rows}
    assert place(a) == place(b) != place(c)


def test_matrix_has_exact_sums_and_the_right_means():
    sizes = [10, 0, 7, 23]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = sharding.communication_matrix(sizes, 3, seed)
        assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == [14, 13, 13]
        total += m
    assert np.abs(total / 400 - np.outer(sizes, [14, 13, 13]) / 40).max() < 0.35


def test_large_hypergeometric_draws():
    rng = np.random.default_rng(0)
    draws = np.array([sharding.hypergeometric(rng, 2 * 10**9, 6 * 10**9, 10_000) for _ in range(600)])
    assert abs(draws.mean() - 2500) < 6 and abs(draws.std() - np.sqrt(10_000 * 0.25 * 0.75)) < 4
    small = np.array([sharding.hypergeometric(rng, 40, 60, 10) for _ in range(600)])
    assert abs(small.mean() - 4) < 0.3


def test_uniform_over_places(spark):
    seen = Counter()
    df = spark.createDataFrame([(i,) for i in range(8)], "doc_id long").repartition(2).cache()
    for seed in range(60):
        for r in sharding.shuffle_to_shards(df, 2, seed).collect():
            seen[r.doc_id, r.shard] += 1
    assert all(12 < n < 48 for n in seen.values()) and len(seen) == 16


def test_whole_table(spark, sf):
    from larkspur.llm.queries import op1_shard_hypergeometric

    rows = op1_shard_hypergeometric(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.size for r in rows} == {d: len(t.encode()) + 1 for d, t in docs.items()}
    assert {r.shard for r in rows} == set(range(16)) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert all(r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows) and len(rows) == len(docs)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(16) for k in range(sizes[s])]
