import hashlib
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest

from larkspur.llm import periodic


def plain_runs(x, fewest=6, repeats=4):
    """Every period one after the other; a stretch within a run of a smaller period isn't one."""
    n, out = len(x), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if length >= max(fewest, repeats * q) and not any(a <= i and i + length <= a + m for a, m, _ in out):
                out.append((i, length, q))
            i = j
    return sorted(out)


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    return runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


@pytest.mark.parametrize("points", [2, 64, 128, 8192, 1 << 17])
def test_transform_is_undone(points):
    x = np.random.default_rng(0).integers(0, periodic.PRIME, (2, points)).astype(float)
    assert (periodic.reduced(periodic.backward(periodic.forward(x)) - x) == 0).all()


@pytest.mark.parametrize("block", [1, 4, 16, 256])
def test_block_places(block):
    x = np.random.default_rng(block).integers(0, 2 if block > 1 else 5, 700)
    x[300:650] = np.resize(x[: block + block // 2], 350)
    got = {(int(s), int(d)) for a, b in periodic.zero_mismatches(x, block, block) for s, d in zip(a, b, strict=True)}
    n = len(x)
    assert got == {(s, d) for s in range(0, n - block + 1, block) for d in range(block, 2 * block) if s + d + block <= n and (x[s : s + block] == x[s + d : s + d + block]).all()}


def test_runs_of_random_sequences():
    rng = random.Random(1)
    for _ in range(500):
        x, k = [], rng.choice([1, 2, 2, 3, 8])
        while len(x) < 150:
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 20))]
            times = rng.choice([1, 1, 3, 4, 5, 9])
            x += (unit * times)[: len(unit) * times - rng.randint(0, len(unit) - 1)]
        x = np.array(x[: rng.randint(0, 150)], dtype=np.int64)
        for widest in (1 << 19, 4, 1):
            assert sorted(periodic.runs_of(x, widest=widest)) == plain_runs(x.tolist())


def test_long_sequences():
    rng = np.random.default_rng(0)
    began = time.monotonic()
    assert periodic.runs_of(np.zeros(400_000, dtype=np.int64)) == [(0, 400_000, 1)]
    period = np.resize(rng.integers(0, 300, 70_001), 400_000)
    assert (0, 400_000, 70_001) in periodic.runs_of(period)
    assert periodic.runs_of(np.arange(400_000)) == []
    assert time.monotonic() - began < 60


def test_long_texts(monkeypatch):
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", 3)
    for text in (b"", b"  ", b"a", b" a b  c ", b"a b c d e f g", b"a b c d e f \x0b\x0cg\x1c "):
        ids, words = periodic.read_words(text)
        assert [words[i] for i in ids] == text.split() and periodic.kept_text(ids, words, np.ones(len(ids), bool)) == b" ".join(text.split())


def test_edges(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "a b c " * 4, "a b c " * 4 + "a", "é É " * 5, "a a " * 6, "a\x1ca " * 6, "a " * 5 + "b " * 6 + "a " * 6, "a a b a a b a a b a a b " * 4, "w " * 30_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[5], None), (None, texts[5], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = periodic.periodic_runs(df).collect()
    assert sorted(((r.doc_id, r.text, r.lang, [(x.start, x.length, x.period) for x in r.word_runs], r.run_collapsed) for r in got), key=str) == sorted(((d, t, s, *plain(t)) for d, t, s in rows), key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="in the way"):
        periodic.periodic_runs(df.withColumnRenamed("lang", "word_runs"))


def test_whole_table(spark, sf):
    from larkspur.llm.queries import op11_run_convolution

    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h, n = crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs, left = plain(" ".join(words))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    got = op11_run_convolution(spark, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(w[1] > 1 for w in want)
