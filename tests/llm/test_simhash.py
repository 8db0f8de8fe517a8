import xxhash

from larkspur.llm import simhash


def plain_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return [(d, f"{p:016x}", ids.get(root(i))) for i, (d, p) in enumerate(zip((r[0] for r in rows), prints))]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(df)
    return out.select("doc_id", simhash.hex_fingerprint(out.fp).alias("f"), "component_id", "kept").collect()


def test_matches_brute_force_on_edges(spark):
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  B"), (8, "a b c d e"), (9, "a b c d f"), (10, long), (11, long + " tail"), (11, long + " tail"), (None, "one"), (12, "É é"), (13, "é É")]
    got = run(spark, rows)
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, plain_components(rows)))
    assert sum(r.kept for r in got) == len({r.component_id for r in got})


def test_chains_and_balls(spark):
    base = 0x0123456789ABCDEF
    chain = [base]
    for b in range(0, 24, 2):
        chain.append(chain[-1] ^ (3 << b))
    star = [~base & (2**64 - 1) ^ (1 << b) for b in range(64)]
    signed = [x - (1 << 64) if x >> 63 else x for x in chain + star]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from larkspur.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.near_links(df, 2)).collect()}
    assert len({got[x] for x in signed[: len(chain)]}) == 1
    assert len({got[x] for x in signed[len(chain) :]}) == 1
    assert len(set(got.values())) == 2


def test_empty_table(spark):
    assert run(spark, []) == []


def test_whole_table_against_brute_force(spark, sf):
    from larkspur.llm.queries import op8_simhash_ball

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in op8_simhash_ball(spark, sf).collect()]
    assert sorted(got) == sorted(plain_components([tuple(r) for r in docs]))
