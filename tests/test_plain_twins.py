"""Queries that SQL can't express against plain versions."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import learning
from larkspur.plans import registry

QUERIES = registry.queries()


def unit(v):
    v = np.float32(v).astype(float)
    return v / np.linalg.norm(v)


def picks(relevance, units, k, lam):
    """One candidate after the other, each the best by relevance and distance to all chosen."""
    chosen = []
    while len(chosen) < min(k, len(units)):
        best = None
        for i in range(len(units)):
            if i not in chosen:
                near = max((float(units[i] @ units[j]) for j in chosen), default=0.0)
                value = lam * relevance[i] - (1 - lam) * near
                if best is None or value > best[0] + 1e-12:
                    best = (value, i)
        chosen.append(best[1])
    return chosen


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return {r.vec_id: (r.label, unit(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}


def test_mmr_select(spark, sf, vectors):
    got = defaultdict(list)
    for r in QUERIES["mmr_select"](spark, sf).collect():
        got[r.label].append((r["rank"], r.place))
    for label in {x for x, _ in vectors.values()}:
        own = {i: v for i, (x, v) in vectors.items() if x == label}
        q = own[min(own)]
        near = sorted(own, key=lambda i: (-round(float(own[i] @ q), 12), i))[:100]
        order = picks([float(own[i] @ q) for i in near], [own[i] for i in near], 10, 0.7) if len(near) > 10 else range(len(near))
        assert [p for _, p in sorted(got[label])] == [i + 1 for i in order]


def test_synthesis_retrieval(spark, sf, vectors):
    got = defaultdict(list)
    for r in QUERIES["synthesis_retrieval"](spark, sf).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    for q in (i for i in vectors if i % 100 == 0):
        sims = {i: round(float(v @ vectors[q][1]), 9) for i, (_, v) in vectors.items()}
        near = sorted(sims, key=lambda i: (-sims[i], i))[:40]
        units = [vectors[i][1] for i in near]
        order = picks([float(u @ vectors[q][1]) for u in units], units, 20, 0.7)
        kept = [near[i] for i in order if 1 + near[i] % 3 <= 2][:10]
        assert [v for _, v in sorted(got[q])] == kept


def test_diverse_edges(spark, sf, vectors):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey", "l_partkey", "l_returnflag").agg((F.max("l_discount") * 10).cast("double").alias("c")).collect()
    edges = defaultdict(list)
    for r in lines:
        edges[f"S{r.l_suppkey}"].append((-r.c, f"P{r.l_partkey}", r.l_returnflag))
    got = defaultdict(list)
    for r in QUERIES["diverse_edges"](spark, sf).collect():
        got[r.s].append((r["rank"], r.place))
    assert set(got) == set(edges)
    for s, own in edges.items():
        first = sorted(own)[:50]
        part = [int(t[1:]) % len(vectors) for _, t, _ in first]
        score = [0.6 * (v % 10) / 10 + 0.2 * -c + 0.2 * 0.7 for v, (c, _, _) in zip(part, first, strict=True)]
        by = sorted(range(len(first)), key=lambda i: (-score[i], i))
        order = picks([score[i] for i in by], [vectors[part[i]][1] for i in by], 15, 0.7)
        assert [p for _, p in sorted(got[s])] == [by[i] + 1 for i in order]


def test_exclusive_figures(spark, sf):
    best = defaultdict(dict)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").collect():
        own = best[r.l_orderkey]
        own[r.l_linenumber, r.l_partkey] = max(own.get((r.l_linenumber, r.l_partkey), 0), r.l_discount)
    want = set()
    for order, own in best.items():
        taken = set()
        for line in sorted({n for n, _ in own}):
            free = sorted((-s, p) for (n, p), s in own.items() if n == line and s >= 0.03 and p not in taken)
            if free:
                taken.add(free[0][1])
                want.add((order, line, free[0][1]))
    assert {(r.l_orderkey, r.l_linenumber, r.l_partkey) for r in QUERIES["exclusive_figures"](spark, sf).collect()} == want


def test_load_balance(spark, sf):
    cards = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.to_date("ts").alias("day"), "value").collect():
        cards[r.user_id].append((r.day, r.value, r.event_id))
    want = set()
    for user, own in cards.items():
        days = sorted({d for d, _, _ in own})
        cap = max(1, math.ceil(len(own) / len(days) * 1.2))
        load = {d: sum(x[0] == d for x in own) for d in days}
        for day, _, card in sorted(own):
            to = next((d for d in days if d > day and load[d] < cap), day) if load[day] > cap else day
            load[day] -= 1
            load[to] += 1
            want.add((user, card, to))
    assert {(r.user_id, r.event_id, r.day) for r in QUERIES["load_balance"](spark, sf).collect()} == want


def remembered(reviews):
    """State, reps, lapses, difficulty, stability and days to wait after the reviews (rating, day) of a card, by the rules of the memory model."""
    w, minutes = learning.W, {"learning": (1, 10), "relearning": (10,)}
    state, step, lapses, difficulty, stability, wait, last = "new", 0, 0, 0.0, 0.0, 0.0, None
    bound = lambda x: min(10.0, max(1.0, x))
    for rating, day in reviews:
        lapses += rating == 1
        review = False
        if state == "new":
            difficulty, stability = bound(w[4] - (rating - 3) * w[5]), w[rating - 1]
            state, step, wait = "learning", int(rating == 3), (1, 1, 10, 0)[rating - 1] / 1440
            review = rating == 4
        elif state == "review":
            recall = 1 / (1 + max(0, int(day - last)) / (9 * stability))
            harder = bound(w[7] * w[4] + (1 - w[7]) * (difficulty - w[6] * (rating - 3)))
            if rating == 1:
                stability = max(0.1, w[11] * difficulty ** -w[12] * ((stability + 1) ** w[13] - 1) * math.exp(w[14] * (1 - recall)))
                state, step, wait = "relearning", 0, 10 / 1440
            else:
                gain = math.exp(w[8]) * (11 - difficulty) * stability ** -w[9] * (math.exp(w[10] * (1 - recall)) - 1)
                stability, review = max(0.1, stability * (1 + gain * {2: w[15], 3: 1, 4: w[16]}[rating])), True
            difficulty = harder
        else:
            steps = minutes[state]
            step = 0 if rating == 1 else step + (rating == 3)
            review = rating == 4 or step >= len(steps)
            wait = steps[min(step, len(steps) - 1)] / 1440
            # recall is certain within a step, so nothing is gained
        if review:
            state, step, wait = "review", 0, min(365, max(1, round(stability)))
        last = day
    return state, len(reviews), lapses, difficulty, stability, wait


def test_fsrs_fold_walks_each_card(spark, sf):
    got = QUERIES["fsrs_fold"](spark, sf).collect()
    seen = defaultdict(list)
    from larkspur.plans.learning import reviews

    for r in reviews(spark, sf).select("user_id", "ts", "event_id", "rating", (F.get_json_object("props", "$.k").cast("int") % 10).alias("card"), F.datediff("day", F.lit("2024-01-01").cast("date")).alias("at")).collect():
        seen[r.user_id, r.card].append((r.ts, r.event_id, r.rating, r["at"]))
    assert len(got) == len(seen)
    for r in got:
        want = remembered([(rating, at) for _, _, rating, at in sorted(seen[r.user_id, r.card])])
        assert (r.state, r.reps, r.lapses) == want[:3], (r.user_id, r.card)
        assert (r.difficulty, r.stability, r.wait_days) == pytest.approx(want[3:])


def test_chunk_greedy_keeps_all_sentences(spark, sf):
    from larkspur.operators.documents import sentences

    docs = {r.doc_id: list(r.s) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    chunks = defaultdict(list)
    for r in QUERIES["chunk_greedy"](spark, sf).orderBy("doc_id", "chunk_index").collect():
        assert r.words == len(r.content.split())
        chunks[r.doc_id].append(r.content)
    for d, parts in docs.items():
        own = chunks.get(d, [])
        joined = "\n".join(own)
        if own or sum(map(len, parts)) >= 60:
            assert all(s in joined for s in parts), d
        assert all(len(c.split()) <= 200 + max((len(s.split()) for s in parts), default=0) + 30 for c in own)


def test_chunk_quality_adds_up(spark, sf):
    for r in QUERIES["chunk_quality"](spark, sf).collect():
        total = 0.20 * r.readability + 0.25 * r.coherence + 0.35 * r.completeness + 0.20 * r.type_specific
        assert r.quality == pytest.approx(max(0.0, total - 0.20) if r.orphan else total)
        assert r.acceptable == (r.quality >= 0.5) and 0 <= r.coherence <= 1
