import math
import random
import time
from zlib import crc32

import numpy as np
import pytest

from larkspur.llm import quality


def test_features_of_small_texts():
    assert quality.measured(b"")[:10] == [0] * 10 and not any(map(math.isnan, quality.measured(b"")))
    got = dict(zip(quality.FEATURES, quality.measured("Ab cd, Ab é!\n\nab 12 $$\nAb cd, Ab é!".encode()), strict=True))
    assert len(got) == len(quality.FEATURES)
    assert got["log_words"] == pytest.approx(math.log(12)) and got["distinct_words"] == pytest.approx(6 / 11) and got["commonest_word"] == pytest.approx(4 / 11)
    assert got["repeated_lines"] == pytest.approx(1 / 3) and got["ended_lines"] == pytest.approx(2 / 3) and got["marked_words"] == pytest.approx(1 / 11)
    assert got["repeated_fives"] == 0 and dict(zip(quality.FEATURES, quality.measured(b"a b c " * 10), strict=True))["repeated_fives"] == pytest.approx(1 - 3 / 26)
    assert got["capital_words"] == pytest.approx(4 / 11)
    for text in (b"x", b"\n", b" ", b"\xff\xfe", b"a b", b"a b c d", b"a b c d e"):
        assert np.isfinite(quality.measured(text)).all()


def test_long_text():
    began = time.monotonic()
    assert np.isfinite(quality.measured(b"word " * 1_000_000 + b"x" * 3_000_000)).all()
    assert time.monotonic() - began < 20


def test_best_cut_and_trees():
    rng = np.random.default_rng(0)
    for _ in range(100):
        g, h = rng.normal(size=7), rng.uniform(0.5, 2, 7)
        gains = [g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1) for k in range(1, 7)]
        gain, at = quality.best_cut(g, h, 1.0, 0.0)
        assert (gain, at) == ((pytest.approx(max(gains)), int(np.argmax(gains)) + 1) if max(gains) > 0 else (0.0, 0))
        values = quality.shallow(g, h, 3, 1.0, 0.0)
        assert len(np.unique(values)) <= 3


def test_learns_shapes_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, len(quality.FEATURES)))
    y = ((np.abs(x[:, 0]) > 0.5) ^ (rng.uniform(size=4000) < 0.02)).astype(float)
    m = quality.learn(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.94  # a shape that no line has
    y = (x[:, 2] * x[:, 3] > 0).astype(float)
    m = quality.learn(x[:3000], y[:3000], rounds=60)
    assert (2, 3) in m.pairs and ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.85  # a pair that no sum of shapes has
    by_hand = m.start + sum(t[np.searchsorted(c, v, side="right")] for t, c, v in zip(m.tables, m.cuts, x[0], strict=True))
    by_hand += sum(t[np.searchsorted(m.cuts[i], x[0, i], side="right"), np.searchsorted(m.cuts[j], x[0, j], side="right")] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
    assert m.score(x[:1])[0] == pytest.approx(1 / (1 + math.exp(-by_hand)))


def test_edges(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "slowly", "past", "old", "mills"]) for _ in range(rng.randint(5, 60))).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "!!!"]) + "$$$" for _ in range(rng.randint(5, 60)))
    rows = [(i, good() if i % 2 else bad(), "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _y string")
    labels = spark.createDataFrame([(i, i % 2, 0.1) for i in range(200)] + [(None, 1, 0.1), (5, None, 0.1), (7, 1, 0.1)], "doc_id long, quality int, x double")
    model = quality.fit(docs, labels, "quality")
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 2 == 1) for i in range(200, 300))
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, rows[1][1], 5.0), (3, "é" * 100_000, 5.0), (3, "é" * 100_000, 5.0)], "doc_id long, text string, quality_score double")
    scores = [r.quality_score for r in quality.score(odd, model).collect()]
    assert scores[0] == scores[1] and scores[3] == scores[4] and scores[2] == got[1] and all(0 <= s <= 1 for s in scores)
    assert quality.score(odd.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1")):
        m = quality.fit(docs, some, "quality")
        assert len({r.quality_score for r in quality.score(docs, m).collect()}) == 1
    assert len(quality.fit(docs, labels, "quality", sample_rows=10).cuts) == len(quality.FEATURES)


def test_held_out(spark):
    from larkspur.llm.queries import op13_quality_additive

    sf = "/root/testdata/sf0.01"
    got = op13_quality_additive(spark, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95
