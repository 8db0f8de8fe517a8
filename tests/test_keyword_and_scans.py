"""Keyword search and rules against plain versions, scans of changing folders, and values that live on a stream."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.operators import keyword
from larkspur.sources import files
from larkspur.streaming import logs, recent


def words(text):
    return [w.lower() for w in re.findall(r"\w+", text or "")]


def plain_bm25(docs, queries, k):
    lists = {d: Counter(words(t)) for d, t in docs.items() if words(t)}
    mean = sum(sum(c.values()) for c in lists.values()) / max(1, len(lists))
    n = Counter(w for c in lists.values() for w in c)
    out = []
    for q, terms in queries.items():
        scores = {}
        for d, c in lists.items():
            hit = [w for w in set(terms) if w in c]
            if hit:
                scores[d] = round(sum(math.log(1 + (len(lists) - n[w] + 0.5) / (n[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in hit), 6)
        out += [(q, d, pytest.approx(s, abs=2e-6), i + 1) for i, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


@pytest.mark.parametrize("k", [1, 3, 50])
def test_bm25_prunes_nothing_that_matters(spark, k):
    """Words of very different frequency, texts of different lengths, repeats, and ties."""
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = {i: " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 3, 10, 60]))) for i in range(300)} | {900: None, 901: "", 902: "w3 w3 w7", 903: "w3 w3 w7"}
    queries = {q: rng.choices(vocabulary, weights, k=rng.choice([1, 4, 20])) for q in range(12)} | {50: [], 51: ["unknown"], 52: ["w3", "w7", "w3"]}
    df = spark.createDataFrame([(*r, 1.0) for r in docs.items()], "key long, text string, score double")
    q = spark.createDataFrame(list(queries.items()), "query_id long, q array<string>")
    got = [(r.query_id, r.id, r.score, r["rank"]) for r in keyword.keyword_search(keyword.bm25_index(df, "key", "text"), q, k).orderBy("query_id", "rank").collect()]
    assert got == plain_bm25(docs, queries, k)


def test_rules(spark):
    rng = random.Random(7)
    docs = {i: " ".join(rng.choices("abcdefghij", k=rng.randint(0, 9))) for i in range(80)} | {90: None}
    rules = [(r, r % 4, rng.randint(0, 3), r % 3) for r in range(40)]
    conditions = [(r, rng.choice("ABCDEFGHIJ"), rng.random() < 0.2) for r in range(40) for _ in range(4)]
    named = {(r, t.lower(), f) for r, t, f in conditions}
    want = []
    for d, text in docs.items():
        best = {}
        for r, topic, needed, priority in rules:
            need, no = ({t for x, t, f in named if x == r and f == flag} for flag in (False, True))
            met = len(need & set(words(text)))
            if met >= max(needed, 1) and not no & set(words(text)):
                key = (priority, len(need) - met, -r)
                if topic not in best or key > best[topic][0]:
                    best[topic] = (key, (d, topic, r, priority, met, len(need) - met))
        want += [b[1] for b in best.values()]
    df = spark.createDataFrame([(*r, "x") for r in docs.items()], "doc long, text string, term string")
    got = keyword.rule_findings(df, "doc", "text", spark.createDataFrame(rules, "rule_id long, topic long, needed long, priority long"), spark.createDataFrame(conditions, "rule_id long, term string, forbidden boolean"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 50


def test_scan_reads_what_changed(spark, tmp_path):
    names = ["a.txt", "b.txt", "c [1].txt", "d{x}.txt", "sub/e.txt"]
    (tmp_path / "sub").mkdir()
    for n in names:
        (tmp_path / n).write_text(f"one {n}")
    nothing = spark.createDataFrame([], "path string, size long, modified timestamp, content_hash string")
    scan = lambda last: {os.path.relpath(r.path.removeprefix("file:").replace("%20", " ").replace("//", "/"), tmp_path): r for r in files.scan_changes(spark, str(tmp_path), last, "*.txt", page=2).collect()}
    first = files.scan_changes(spark, str(tmp_path), nothing, "*.txt", page=2)
    last = files.cut_lineage(first.select("path", "size", "modified", "content_hash"))
    assert first.count() == 5 and {r.state for r in first.collect()} == {"new"}
    assert {r.content_hash for r in last.collect()} == {hashlib.sha256(f"one {n}".encode()).hexdigest() for n in names}
    (tmp_path / "b.txt").write_text("two")
    os.utime(tmp_path / "c [1].txt", (1, 1))
    (tmp_path / "a.txt").unlink()
    (tmp_path / "f.txt").write_text("new")
    again = scan(last)
    assert {n: r.state for n, r in again.items()} == {"a.txt": "gone", "b.txt": "changed", "c [1].txt": "touched", "d{x}.txt": "same", "sub/e.txt": "same", "f.txt": "new"}
    assert again["b.txt"].content_hash == hashlib.sha256(b"two").hexdigest()
    held = spark.createDataFrame([(r.path, r.size, r.modified, "kept unread") for r in last.collect()], last.schema)
    assert scan(held)["d{x}.txt"].content_hash == "kept unread"


def test_values_live_on_a_stream(spark, tmp_path):
    """Two batches with one state; what is older than its time is gone, and rows far behind are dropped."""
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    minute = lambda rows: spark.createDataFrame(rows, "id long, key long, m long").select("id", "key", F.timestamp_seconds(F.col("m") * 60).alias("ts"))
    batches = [[(1, 7, 100), (2, 7, 105), (3, 8, 100), (4, None, 100)], [(5, 7, 114), (6, 7, 130), (7, 8, 130), (8, 9, 30), (9, 9, 131)]]
    provider = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(provider)
    spark.conf.set(provider, recent.PROVIDER)
    try:
        for rows in batches:
            minute(rows).coalesce(1).write.mode("append").parquet(source)
            stream = recent.recent(logs.read_log(spark, source), "ts", "key", "id", 10 * 60 * 1000, late="30 minutes")
            stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", state).format("parquet").option("path", out).start().awaitTermination()
    finally:
        spark.conf.set(provider, held)
    got = {r.id: (r.key, r.hit, r.served) for r in spark.read.parquet(out).collect()}
    assert got == {1: (7, False, None), 2: (7, True, 1), 3: (8, False, None), 5: (7, True, 2), 6: (7, False, None), 7: (8, False, None), 9: (9, False, None)}


def test_bm25_index_has_a_row_for_each_piece(spark):
    """Postings aren't rows, so neither the index nor a search exchanges one for each word of a text; scores don't depend on the pieces."""
    docs = {i: f"w{i % 7} w{i % 3} common common" for i in range(400)}
    df = spark.createDataFrame([(f"{i:03d}", t) for i, t in docs.items()], "key string, text string")
    queries = {1: ["w1", "common", "w1"], 2: ["w6"], 3: ["common"]}
    q = spark.createDataFrame(list(queries.items()), "query_id long, q array<string>")
    index = keyword.bm25_index(df.repartition(5), "key", "text")
    assert index.count() <= 5
    got = [(r.query_id, int(r.id), r.score, r["rank"]) for r in keyword.keyword_search(index, q, 8).orderBy("query_id", "rank").collect()]
    assert got == plain_bm25(docs, queries, 8)
