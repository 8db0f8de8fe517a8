"""Phrase dictionaries, near concepts, spans in order and relations, against plain versions."""

import bisect
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from larkspur.operators import documents, phrases, relations
from larkspur.plans import phrases as plans
from larkspur.plans import registry

QUERIES = registry.queries()


def words(text):
    return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text or "")]


def plain_hits(text, terms):
    """Every place, the longest term first."""
    known = {tuple(w for w, _, _ in words(t)) for t in terms} - {()}
    spans, out, i, most = words(text), [], 0, max(map(len, known), default=0)
    while i < len(spans):
        n = next((n for n in range(min(most, len(spans) - i), 0, -1) if tuple(w for w, _, _ in spans[i : i + n]) in known), 0)
        if n:
            out.append((spans[i][1], spans[i + n - 1][2], i, n, " ".join(w for w, _, _ in spans[i : i + n])))
        i += max(n, 1)
    return out


def test_phrase_hits(spark):
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "d", "é", "Große", "x1", "no"]
    terms = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 6))) for _ in range(60)] + ["", None, "  ", "a-b", "A b", "zz a"]
    texts = [" ".join(rng.choices(vocabulary + ["other,", "(b)"], k=rng.randint(0, 60))) for _ in range(60)] + [None, "", "A  B, c.d-é GROSSE große", "😀 a 😀 b c"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc long, text string, term string")
    got = phrases.phrase_hits(df, "doc", "text", spark.createDataFrame([(t, 1) for t in terms], "name string, start int"), "name")
    want = [(d, *m) for d, t in rows for m in plain_hits(t, [t for t in terms if t])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert phrases.phrase_hits(df.limit(0), "doc", "text", spark.createDataFrame([("a",)], "term string")).count() == 0
    assert phrases.phrase_hits(df, "doc", "text", spark.createDataFrame([], "term string")).count() == 0


def grams(s):
    p = f" {s} "
    return {p[i : i + 3] for i in range(max(1, len(p) - 2))}


@pytest.mark.parametrize("least", [0.5, 0.7, 1.0])
def test_set_join(spark, least):
    rng = random.Random(2)
    sets = [[(f"{side}{i}", rng.choices("abcdefghij", k=rng.randint(0, 9))) for i in range(120)] for side in "xy"]
    a, b = (spark.createDataFrame(s, "id string, members array<string>") for s in sets)
    want = {(i, j): len(set(p) & set(q)) / len(set(p) | set(q)) for i, p in sets[0] for j, q in sets[1] if p and q}
    got = {(r.a, r.b): r.similarity for r in phrases.set_join(a, b, least).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= least - 1e-12})


def test_near_concepts(spark):
    """Brute force over all runs of words and all names, at 0.7."""
    rng = random.Random(3)
    names = ["middle cerebral artery", "basal ganglia", "optic nerve", "cortex", "Facial  Nerve", "optic tract", "a", "glioma", ""]
    vocabulary = [(f"C{i}", n, "T%d" % (i % 3)) for i, n in enumerate(names)] + [("C99", None, "T0"), ("C98", "glioma", "T2")]
    weights = {"T0": 0.9, "T1": 0.4}

    def typo(n):
        k = rng.randrange(len(n))
        return n[:k] + rng.choice(["", "x", n[k] * 2]) + n[k + 1 :]

    texts = [" and ".join(typo(n) if n and rng.random() < 0.6 else n for n in rng.sample([n.lower() for n in names if n], 4)) + " of it." for _ in range(40)] + [None, "", "Cortex cortex CORTEX"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc long, text string, score int")
    got = phrases.near_concepts(df, "doc", "text", spark.createDataFrame(vocabulary, "concept string, name string, class string"), spark.createDataFrame(list(weights.items()), "class string, weight double"), longest=3)
    want = []
    for doc, text in enumerate(texts):
        spans, found = words(text), []
        for i in range(len(spans)):
            for n in range(1, min(3, len(spans) - i) + 1):
                gram = " ".join(w for w, _, _ in spans[i : i + n])
                best = None
                for concept, name, kind in vocabulary:
                    norm = " ".join(w for w, _, _ in words(name))
                    if norm:
                        s = len(grams(gram) & grams(norm)) / len(grams(gram) | grams(norm))
                        if s >= 0.7 and (best is None or (-s, concept, kind) < best):
                            best = (-s, concept, kind)
                if best and -best[0] * weights.get(best[2], 1.0) >= 0.3:
                    score = -best[0] * weights.get(best[2], 1.0)
                    found.append((spans[i][1], -score, -spans[i + n - 1][2], best))
        end = 0
        for start, score, stop, (s, concept, kind) in sorted(found):
            if start >= end:
                end = -stop
                want.append((doc, start, end, concept, kind, round(-s, 9), round(-score, 9)))
    assert sorted((r.doc, r.start, r.stop, r.concept, r["class"], round(r.similarity, 9), round(r.score, 9)) for r in got.collect()) == sorted(want) and len(want) > 60


def test_spans_of_a_hot_key(spark):
    """A hundred thousand spans of one key, and null ends."""
    rng = random.Random(4)
    spans = [("hot", a := rng.randrange(10**6), a + rng.randint(1, 300), round(rng.random(), 3), i) for i in range(100_000)] + [("null", None, 5, 0.9, 1), ("null", 3, None, 0.9, 2), ("null", 3, 4, 0.9, 3), ("low", 1, 2, 0.1, 4)]
    df = spark.createDataFrame(spans, "doc string, a long, z long, conf double, id long")
    began = time.monotonic()
    for surest in (False, True):
        got = [(r.doc, r.id) for r in documents.keep_apart(df, ["doc"], "a", "z", "conf", surest=surest).collect()]
        want, end = [("null", 3)], -1
        for _, a, z, c, i in sorted((s for s in spans if s[0] == "hot" and s[3] >= 0.3), key=lambda s: (s[1], -s[3] if surest else 0, -s[2], s[3], s[4])):
            if a >= end:
                want, end = [*want, ("hot", i)] if len(want) < 0 else want + [("hot", i)], z
        assert sorted(got) == sorted(want)
    assert time.monotonic() - began < 60


def test_merged_phases(spark):
    kinds = "doc long, start int, stop int, confidence double, text string"
    exact = spark.createDataFrame([(1, 0, 5, 0.95, "e"), (1, 10, 14, 0.8, "e")], kinds)
    pattern = spark.createDataFrame([(1, 0, 5, 0.97, "p"), (1, 3, 9, 0.99, "p"), (1, 10, 16, 0.8, "p"), (1, 20, 22, 0.2, "p")], kinds)
    assert sorted((r.start, r.text) for r in phrases.merged(exact, pattern, "doc").collect()) == [(0, "p"), (10, "p")]


def plain_relations(texts, spans, patterns, expected, apart, cues, terminators):
    out = {}
    for doc, text in texts.items():
        own = sorted(s for s in spans if s[0] == doc)
        events = [(a, 0, w if w in [" ".join(x for x, _, _ in words(c)) for c in cues] else None) for a, _, _, _, w in plain_hits(text, [*cues, *terminators])]
        events += [(m.start(), 0, None) for m in re.finditer(r"[.!?](?=\s+[A-Z])", text or "") if not re.search(r"\b(Dr|Fig|No|al|vs|Vol|pp|Ch|Sec)$", text[: m.start()])]

        events.sort(key=lambda e: e[0])

        def cue(start, events=events, places=[e[0] for e in events]):  # noqa: B006
            k = bisect.bisect_right(places, start)
            return events[k - 1][2] if k else None

        for i, (_, a1, z1, c1, k1) in enumerate(own):
            for _, a2, _, c2, k2 in own[i + 1 :]:
                if a2 - z1 > apart:
                    break
                if a2 <= a1 or a2 < z1:
                    continue
                context, best = text[z1:a2].lower(), None
                for rel, listed in patterns.items():
                    if any(re.search(p, context) for p in listed):
                        typed = any({k1, k2} == {x, y} if x != y else k1 == k2 == x for x, y in expected.get(rel, ()))
                        worth = min(1.0, 0.65 + (0.1 if len(context) < 50 else 0) + (0.15 if typed else 0))
                        best = (rel, worth) if best is None or worth > best[1] + 1e-12 else best
                if best:
                    said = cue(a1) or cue(a2)
                    key = (c1, c2, best[0], said is not None)
                    conf, n = out.get(key, (0, 0))
                    out[key] = (max(conf, best[1]), n + 1)
    return {hashlib.md5(f"{a}:{b}:{r}:{str(neg).lower()}".encode()).hexdigest(): (a, b, r, neg, round(c, 9), n) for (a, b, r, neg), (c, n) in out.items()}


def test_relations_of_sentences(spark):
    text = {
        1: "The middle cerebral artery supplies the basal ganglia. There is no evidence that the basilar artery supplies the cortex.",
        2: "The vein does not drain into the sinus, but the tumor causes edema near the cortex. Edema in the cortex.",
        3: "Without the artery the cortex is fed by Dr. Vein and arises from the sinus.",
        4: None,
        5: "cortex",
    }
    names = {"middle cerebral artery": "T023", "basal ganglia": "T023", "basilar artery": "T023", "artery": "T023", "cortex": "T029", "vein": "T023", "sinus": "T023", "tumor": "T047", "edema": "T184"}
    spans = [(d, a, z, w, names[w]) for d, t in text.items() for a, z, _, _, w in plain_hits(t, names)]
    df = spark.createDataFrame(list(text.items()), "doc long, text string")
    s = spark.createDataFrame(spans, "doc long, start int, stop int, concept string, class string")
    got = {r.hash: (r.source, r.target, r.relation, r.is_negated, round(r.confidence, 9), r.mentions) for r in relations.entity_relations(df, "doc", "text", s).collect()}
    assert got == plain_relations(text, spans, relations.PATTERNS, relations.EXPECTED, 200, relations.NEGATION_CUES, relations.TERMINATORS)
    by = {(g[0], g[1], g[2]): g for g in got.values()}
    assert by["middle cerebral artery", "basal ganglia", "supplies"][3:5] == (False, 0.9)
    assert by["basilar artery", "cortex", "supplies"][3] and by["vein", "sinus", "drains_to"][3] and not by["tumor", "edema", "causes"][3]
    assert relations.entity_relations(df.limit(0), "doc", "text", s.limit(0)).count() == 0


def test_entity_relations_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = [r.term for r in plans.passage_terms(spark, sf).collect()]
    known = set(names)
    spans = [(d, a, z, w, "even" if len(w) % 2 == 0 else "odd") for d, t in docs.items() for w, a, z in words(t) if w in known]
    want = plain_relations(docs, spans, plans.BETWEEN, {"part_of": (("even", "odd"),)}, 60, plans.DENIALS, plans.LIMITS_OF_DENIAL)
    got = {r.hash: (r.source, r.target, r.relation, r.is_negated, round(r.confidence, 9), r.mentions) for r in QUERIES["entity_relations"](spark, sf).collect()}
    assert got == want and len(want) > 1


def test_concept_words_by_column(spark):
    name = spark.createDataFrame([("ab",), ("abcd",)], "x string").select(phrases.letter_grams(F.col("x")).alias("g")).collect()
    assert [set(r.g) for r in name] == [grams("ab"), grams("abcd")]


def test_texts_meet_only_terms_that_are_in_them(spark):
    """Terms of common words: a text brings up no term for one of its words alone; terms longer than a key are found as well."""
    long = " ".join(f"a{i}" for i in range(12))
    terms = spark.createDataFrame([(t.split(),) for t in ("red fine box", "red box", "box", long)], "t array<string>")
    keyed = phrases.term_keys(terms)
    assert {(r.n, len(r.t)) for r in keyed.collect()} == {(3, 3), (2, 2), (1, 1), (8, 12)}
    texts = spark.createDataFrame([(1, "Red fine red box"), (2, "red fine"), (3, f"x {long} y")], "_h long, _text string")
    met = phrases.text_keys(texts, [1, 2, 3, 8]).join(keyed, ["n", "k"]).select("h", F.array_join("t", " ").alias("t"))
    assert {(r.h, r.t) for r in met.collect()} == {(1, "red box"), (1, "box"), (3, long)}
    got = phrases.phrase_hits(texts.toDF("doc", "text"), "doc", "text", terms.select(F.array_join("t", " ").alias("term")))
    assert {(r.doc, r.token, r.tokens) for r in got.collect()} == {(1, 2, 2), (3, 1, 12)}


@pytest.mark.parametrize("held", [0, phrases.MOST_HELD])
def test_small_and_large_dictionaries_find_the_same(spark, monkeypatch, held):
    """A dictionary that tasks hold whole, and one that meets the texts by joins; a small one exchanges nothing for its texts."""
    monkeypatch.setattr(phrases, "MOST_HELD", held)
    texts = spark.createDataFrame([(1, "The Große Box, a red BOX"), (2, "ΑΣ'Α İx red"), (3, None), (4, ""), (6, "red box red box box"), (5, "bx red")], "doc long, text string")
    terms = spark.createDataFrame([("red box",), ("box",), ("große",), ("ας",), ("red fine box",)], "term string")
    hits = phrases.phrase_hits(texts, "doc", "text", terms)
    want = [(d, *m) for d, t in ((r.doc, r.text) for r in texts.collect()) for m in plain_hits(t, ["red box", "box", "große", "ας", "red fine box"])]
    assert sorted(map(tuple, hits.collect())) == sorted(want) and len(want) == 7
    assert held == 0 or "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    vocabulary = spark.createDataFrame([("C1", "red box", "T"), ("C2", "große", "T")], "concept string, name string, class string")
    near = phrases.near_concepts(texts, "doc", "text", vocabulary, spark.createDataFrame([], "class string, weight double"), longest=2)
    assert sorted((r.doc, r.start, r.stop, r.concept) for r in near.collect()) == [(1, 4, 9, "C2"), (1, 17, 24, "C1"), (6, 0, 7, "C1"), (6, 8, 15, "C1")]


def test_runs_are_given_once_by_a_task(spark, monkeypatch):
    """Texts of the same words bring their runs up once, not once a place, before anything is exchanged."""
    seen = []
    real = phrases._mapped

    def watched(df, columns, schema, *rest):
        out = real(df, columns, schema, *rest)
        if schema == "gram string":
            seen.append(out.count())
        return out

    monkeypatch.setattr(phrases, "_mapped", watched)
    texts = spark.createDataFrame([(i, "red box red box") for i in range(100)], "doc long, text string").coalesce(1)
    vocabulary = spark.createDataFrame([("C1", "box", "T")], "concept string, name string, class string")
    got = phrases.near_concepts(texts, "doc", "text", vocabulary, spark.createDataFrame([], "class string, weight double"), longest=1)
    assert got.count() == 200 and seen == [2]


def test_scopes_change_only_where_the_cue_does():
    trie = phrases.trie_of([["not"], ["but"]])
    assert relations.scopes("It is. Not here, not there but so. Then not. Not so", trie, {"not": "not", "but": None}) == [(7, "not"), (27, None), (40, "not"), (43, None), (45, "not")]
    assert relations.scopes("It is. It is so. Then", trie, {"not": "not", "but": None}) == []
