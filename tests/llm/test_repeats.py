import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import column_bwt, repeats


def plain(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "eps", "zeta", "eta"]) + str(rng.randint(0, 99)) for _ in range(n))


def cases():
    rng = random.Random(5)
    passage, line = prose(rng, 60), prose(rng, 14)
    docs = [prose(rng, rng.randint(0, 150)) for _ in range(25)]
    docs += [docs[0], docs[1][:150] + "X" + docs[1][150:], docs[2] + docs[2], None, "", "short", "a" * 1000, "b" * 150 + "a" * 700, "é" * 400, "xyz, " * 90, "0123456789" * 21]
    docs += [f"{prose(rng, 5)} {passage} {prose(rng, 40)}" for _ in range(12)] + [f"{prose(rng, 30)} {line} {prose(rng, 30)}" for _ in range(12)]
    docs += [prose(rng, 8000)[:60_000] + passage, docs[0]]
    return docs


@pytest.mark.parametrize("most", [2_048, 2, 0])
def test_matches_brute_force(spark, most):
    docs = cases()
    rows = [(i if i % 7 else None, d, "en") for i, d in enumerate(docs)] + [(3, docs[3], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)
    got = repeats.remove_repeats(df, bucket_most=most).drop("text").collect()
    want = [(r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table_and_carried_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    out = repeats.remove_repeats(df, carry=("lang",))
    assert out.columns == ["doc_id", "lang", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    assert out.collect() == []


def test_transform_is_the_sorted_suffixes():
    rng = random.Random(2)
    for _ in range(60):
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 8))]
        suffixes = sorted(((s[i:], k) for k, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda x: (tuple(c + 10 for c in x[0]) + (0, x[1])))
        symbols = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int32)
        occurrences, common = column_bwt.transform(symbols, np.array([len(s) for s in strings], dtype=np.int64))
        lcp = [0] * bool(strings)
        for (p, _), (q, _) in zip(suffixes, suffixes[1:]):
            n = 0
            while n < min(len(p), len(q)) and p[n] == q[n]:
                n += 1
            lcp.append(n)
        assert common.tolist() == lcp
        before = [(strings[k][-len(s) - 1], i) for i, (s, k) in enumerate(suffixes) if len(s) < len(strings[k])]
        assert [(x >> column_bwt.PLACE_BITS, x & (1 << column_bwt.PLACE_BITS) - 1) for x in occurrences.tolist()] == sorted(before)


@pytest.mark.parametrize("length", [8, 12, 6, 3])
def test_repeated_starts_at_any_place_in_a_word(length):
    rng = random.Random(length)
    for _ in range(60):
        part = bytes(rng.choice(b"ab") for _ in range(20))
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) + part[: rng.randint(0, 20)] for _ in range(rng.randint(0, 8))] + [bytes(range(256))]
        count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1] for s in strings]
        assert [x.tolist() for x in column_bwt.repeated_starts(strings, length)] == want


def test_whole_table(spark, sf):
    from larkspur.llm.queries import op4_suffix_columns

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(d.doc_id, *p) for d, p in zip(docs, plain([d.text for d in docs]))]
    assert sorted(map(tuple, op4_suffix_columns(spark, sf).collect())) == sorted(want)
