"""Operators on hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.functions.vector import cosine
from larkspur.operators import analytics, documents, graph, learning, linking, relational, retrieval, validity
from larkspur.sources import files


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_mmr_follows_the_formula():
    q, v = np.array([0.1, 0.2, 0.3]), np.array([[0.1, 0.2, 0.3], [0.1, 0.2, 0.35], [0.5, 0.6, 0.7]])
    assert retrieval.maximal_marginal_relevance(q, v, 2) == [0, 1]
    assert retrieval.maximal_marginal_relevance(q, v, 3) == [0, 1, 2]
    assert retrieval.maximal_marginal_relevance(q, np.zeros((4, 3)), 2) == [0, 1]


def test_rank_fusion(spark):
    def ranked(names):
        return spark.createDataFrame([(q, n, 1.0 - i / 10) for q in (1, 2) for i, n in enumerate(names)], "q int, id string, s double")

    got = retrieval.reciprocal_rank_fusion([(ranked("abx"), 0.7), (ranked("bcy"), 0.3)], "q", "id", "s", 2, 3).collect()
    for q in (1, 2):
        own = sorted((r for r in got if r.q == q), key=lambda r: -r.score)
        assert [r.id for r in own] == ["b", "a", "c"]
        assert [r.score for r in own] == pytest.approx([0.7 / 62 + 0.3 / 61, 0.7 / 61, 0.3 / 62])


def test_many_queries_against_all_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(40)] + [(40, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(r.query_id, r.id): r.similarity for r in retrieval.scored(df, queries).collect()}
    assert len(got) == 5 * 41
    for (q, i), s in got.items():
        a, b = (np.float32(rows[k][1]).astype(float) for k in (q, i))
        assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)) if a.any() and b.any() else 0.0)
    top = retrieval.top_k(retrieval.scored(df, queries), "similarity", "id", 3, key=["query_id"]).collect()
    assert {(r.query_id, r.id) for r in top} == {k for q in range(0, 41, 10) for k in sorted(((q, i) for i in range(41)), key=lambda k: (-got[k], k[1]))[:3]}


def test_boosts_and_scores(spark):
    got = values(
        spark, retrieval.authority_boost(F.lit(1.0), F.lit("x")), retrieval.authority_boost(F.lit(0.7), F.lit("x")), retrieval.authority_boost(F.lit(0.0), F.lit("x")), retrieval.authority_boost(F.lit(1.0), F.lit("front_matter")),
        retrieval.linear_boost(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))), retrieval.step_boost(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))), cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))
    assert got == pytest.approx([1.045, 1.0, 1.0, 0.1, 1.1, 1.2, 0.0])
    assert values(spark, retrieval.detect_intent(F.lit("Where is the surgical step")), retrieval.detect_intent(F.lit("WHERE IS it")), retrieval.detect_intent(F.lit("x"))) == ["procedure", "anatomy", None]


def test_similarity_before_and_after_the_limit(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.9, 0.2, 0.8, 0.1])], "id int, s double")
    assert retrieval.top_k(df, "s", "id", 3, 0.5, "after").count() == 2
    assert retrieval.top_k(df, "s", "id", 3, 0.15).count() == 3
    assert retrieval.top_k(df, "s", "id", 9, 0.0).count() == 4


def test_texts(spark):
    got = values(spark, tx.citations(F.lit("x [1] y [2,3] z [5-7] [9-8]")), tx.token_estimate(F.lit("a " * 10)), tx.jaccard(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd"))), tx.jaccard(F.array(), F.array(F.lit("a"))), tx.word_count(F.lit(None).cast("string")))
    assert got == [[1, 2, 3, 5, 6, 7], 13, 0.5, 0.0, 0]
    text = "First sentence here. Second one is cut off somewhere in the middle of it"
    assert values(spark, tx.cut_to_tokens(F.lit(text), 6), tx.cut_to_tokens(F.lit("short"), 7), tx.cut_to_tokens(F.lit("word " * 20), 4), tx.cut_to_tokens(F.lit("x" * 50), 4)) == ["First sentence here.", "short", "word word word...", "x" * 16 + "..."]
    assert values(spark, tx.last_place(F.lit("a.b.c"), "."), tx.last_place(F.lit("abc"), "."), tx.tier(F.lit("Red Bolt"), "red bolt"), tx.tier(F.lit("Red Bolt"), "bolt")) == [4, 0, 1.0, 0.5]


def test_documents(spark):
    assert values(spark, documents.sentences(F.lit("See Fig. 3 of it. Next one? Yes! no. Dr. Who."))) == [["See Fig. 3 of it.", "Next one?", "Yes! no.", "Dr. Who."]]
    assert values(spark, documents.step_number(F.lit("Step 12 do")), documents.step_number(F.lit("3. do")), documents.step_number(F.lit("second")), documents.step_number(F.lit("no"))) == [12, 3, 2, None]
    assert values(spark, documents.is_orphan(F.lit("Then cut")), documents.is_orphan(F.lit("The cut"))) == [True, False]
    assert values(spark, documents.best_of(F.lit("skin incision and dura"), documents.PHASES, "other")) == ["exposure"]
    assert values(spark, documents.recover_json(F.lit('x ```json\n{"a": {"b": 1}}\n``` y')), documents.recover_json(F.lit("none"))) == ['{"a": {"b": 1}}', None]
    name, score = documents.authority(F.lit("Rhoton atlas"), {"RHOTON": (1.0, ["rhoton"]), "ATLAS": (0.8, ["atlas"])})
    assert values(spark, name, score) == ["RHOTON", 1.0]


def test_greedy_chunks():
    parts = [f"Sentence number {i} has exactly seven words." for i in range(40)]
    chunks = documents.chunk_texts(parts, target=70, most=100, least=20, overlap=2)
    assert all(len(c.split()) <= 100 for c in chunks)
    assert chunks[1].startswith(parts[8]) and chunks[0].endswith(parts[9])
    kept = documents.chunk_texts(["A b c d e f g h i j k l m n o p q r s t."] * 3 + ["This depends on what stands before it."], target=60, most=90, least=5)
    assert len(kept) == 1
    assert documents.chunk_texts([]) == []


def test_spans_that_do_not_overlap(spark):
    df = spark.createDataFrame([("d", 0, 5, 0.9), ("d", 0, 9, 0.9), ("d", 8, 12, 0.9), ("d", 9, 11, 0.9), ("d", 20, 30, 0.1), ("e", 1, 2, 0.5)], "doc string, a long, z long, conf double")
    got = documents.keep_apart(df, ["doc"], "a", "z", "conf").collect()
    assert sorted((r.doc, r.a, r.z) for r in got) == [("d", 0, 9), ("d", 9, 11), ("e", 1, 2)]


def test_small_sections_merge_forward(spark):
    long = "word " * 40
    rows = [("d", 1, "Intro", 2, "few"), ("d", 2, "Body", 1, long), ("d", 3, "End", 1, "bye"), ("e", 1, "A b", 2, "x"), ("e", 2, "C d e", 1, ""), ("e", 3, "Tail", 3, "y"), ("f", 1, "one two three four five", 2, ""), ("f", 2, "S" * 90, 4, "x"), ("f", 3, "T" * 90, 3, long)]
    df = spark.createDataFrame(rows, "doc string, n int, title string, level int, text string")
    got = sorted((r.doc, r.position, r.title, r.level, r.text) for r in documents.merge_sections(df, "doc", "n").collect())
    want = [("d", 0, "Intro / Body", 1, f"few\n\n{long}\n\nEnd\nbye"), ("e", 0, "A b / C d e / Tail", 1, "x\n\ny"), ("f", 0, "one two three four five", 2, ""), ("f", 1, "S" * 90 + " / " + "T" * 7, 3, f"x\n\n{long}")]
    assert got == want


def test_learning(spark):
    got = values(spark, learning.retrievability(F.lit(9), F.lit(1.0)), learning.interval(F.lit(2.4)), learning.probability(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.25)), learning.standard_error(F.lit(0.0)), learning.normal_percentile(F.lit(0.0)))
    assert got == pytest.approx([0.5, 2, 0.625, 1.0, 50.0], abs=1e-5)


def test_memory_fold_agrees_with_the_columns(spark):
    df = spark.createDataFrame([("u", 0, 4, 0), ("u", 1, 3, 12), ("u", 2, 1, 40), ("v", 0, 1, 0), ("w", 0, 3, 0), ("w", 1, 3, 0)], "user string, n int, rating int, day int")
    got = {r.user: r for r in learning.memory(df, ["user"], ["n"], "rating", "day").collect()}
    assert (got["u"].state, got["u"].lapses, got["u"].reps) == ("relearning", 1, 3)
    s0, d0 = 5.8, 4.93 - 0.94
    s1, d1 = values(spark, learning.stability_after_success(F.lit(s0), F.lit(d0), learning.retrievability(F.lit(12), F.lit(s0)), F.lit(3)), learning.next_difficulty(F.lit(d0), F.lit(3)))
    s2 = values(spark, learning.stability_after_lapse(F.lit(s1), F.lit(d1), learning.retrievability(F.lit(28), F.lit(s1))))[0]
    assert got["u"].stability == pytest.approx(s2)
    assert (got["v"].state, got["v"].lapses) == ("learning", 1)
    assert got["w"].state == "review"


def test_analytics(spark):
    df = spark.createDataFrame([(x,) for x in (0.05, 0.15, 0.15, 1.0)], "s double")
    assert {(r.bucket, r.n) for r in analytics.histogram(df, "s", 10).collect()} == {(0.0, 1), (0.1, 2), (1.0, 1)}
    days = spark.createDataFrame([("u", "2024-01-10"), ("u", "2024-01-09"), ("u", "2024-01-07"), ("v", "2024-01-09")], "user string, d string").withColumn("d", F.col("d").cast("date"))
    assert {r.user: r.streak for r in analytics.streaks(days, "user", "d", F.lit("2024-01-10").cast("date")).collect()} == {"u": 2, "v": 0}
    rated = spark.createDataFrame([(0.5,), (3.0,), (None,)], "v double")
    assert {r.bound: r.n for r in analytics.cumulative_histogram(rated, "v", [1, 5]).collect()} == {1.0: 1, 5.0: 2, None: 2}


def test_relational(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, x string")
    assert relational.find_by(df, {"x": ["a", "b"]}).count() == 2 and relational.find_by(df, {"x": None}).count() == 1
    with pytest.raises(ValueError):
        relational.find_by(df, {"y": 1})
    assert [r.id for r in relational.paged(df, "nonsense SIDEWAYS", "id DESC", "id", 2).collect()] == [3, 2]
    links = spark.createDataFrame([("c", i, s) for i, s in enumerate([0.9, 0.8, 0.7, 0.6, 0.4])], "chunk string, image int, score double")
    out = retrieval.attach_images(spark.createDataFrame([("c",), ("d",)], "chunk string"), links, "chunk", "image", "score").collect()
    assert {r.chunk: r.images for r in out} == {"c": [0, 1, 2], "d": []}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("c", "a", "r", 1.0), ("c", "d", "q", 0.2)], "s string, t string, rel string, conf double")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.s, r.t, r.hop) for r in graph.traverse(edges, seeds, 3).collect()} == {("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("c", "d", 3)}
    assert {(r.s, r.t) for r in graph.traverse(edges, seeds, 3, 0.5, ["r"]).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "node string, parent string")
    assert {(r.node, r.ancestor, r.distance) for r in graph.closure(tree, 3).collect()} == {("b", "a", 1), ("c", "b", 1), ("d", "c", 1), ("c", "a", 2), ("d", "b", 2), ("d", "a", 3)}


def test_figure_keys(spark):
    assert values(spark, *(linking.figure_key(F.lit(x)) for x in ("Fig. 3.2a", "FIGURE 7", "fig 7", "Figure  12"))) == ["figure 2a", "figure 7", "figure 7", "figure 12"]


def test_near_hashes_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 6)]
    rows = [(0, i * 10 + k, h ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False))) for i, h in enumerate(base) for k in range(9)]
    rows += [(0, 200 + i, rows[0][2]) for i in range(5)] + [(1, 300, rows[0][2]), (0, 400, -1), (0, 401, 2**63 - 1)]
    got = {r.id: (r.links, r[2]) for r in documents.near_hashes(spark.createDataFrame(rows, "g int, id int, h long"), "g", "id", "h").collect()}
    near = {a: {b for h, b, y in rows if h == g and a != b and ((x ^ y) & (2**64 - 1)).bit_count() <= 8} for g, a, x in rows}

    def least(a):
        seen, todo = {a}, [a]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    assert got == {a: (len(n), least(a)) for a, n in near.items()}
    assert got[400][0] == 1 and got[300] == (0, 300) and got[200][0] >= 5


def test_exclusive_assignment(spark):
    df = spark.createDataFrame([(0, 1, "x", 0.9), (0, 1, "y", 0.5), (0, 2, "x", 0.8), (0, 2, "y", 0.4), (0, 3, "y", 0.9)], "g int, r int, i string, s double")
    assert {(x.r, x.i) for x in retrieval.exclusive_assignment(df, "g", "r", "i", "s", 0.3).collect()} == {(1, "x"), (2, "y")}


def test_model_hook(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    assert [r.score for r in retrieval.score_in_batches(df, lambda rows: rows["x"] / 2.0, ["x"]).orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.pdf").write_bytes(b"abc")
    (tmp_path / "in" / "b.txt").write_bytes(b"x")
    found = files.scan_directory(spark, f"file://{tmp_path}/in").collect()
    assert [(r.size, r.content_hash[:8]) for r in found] == [(3, "ba7816bf")]
    chunk = spark.createDataFrame([("c1", "d1", [1.0], 4), ("c2", "d2", None, None)], "id string, document_id string, text_embedding array<float>, start_page int")
    files.append_chunks(chunk, f"{tmp_path}/chunks")
    back = {r.id: r for r in spark.read.parquet(f"{tmp_path}/chunks").collect()}
    assert [r.id for r in files.read_chunks(spark, f"{tmp_path}/chunks", "d1").collect()] == ["c1"] and files.read_chunks(spark, f"{tmp_path}/chunks").count() == 2
    assert back["c1"].embedding == [1.0] and back["c1"].page_number == 4 and back["c2"].embedding is None
    manifest = files.export_phase({"a": spark.range(7), "b": spark.range(2)}, f"{tmp_path}/export")
    assert {r.name: r.rows for r in manifest.collect()} == {"a": 7, "b": 2}
    files.write_catalog(spark.range(3), f"{tmp_path}/catalog")
    assert files.read_catalog(spark, f"{tmp_path}/catalog").count() == 3
    files.save_graph(spark.range(2), spark.range(3), f"{tmp_path}/graph")
    assert [x.count() for x in files.load_graph(spark, f"{tmp_path}/graph")] == [2, 3]


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(path, "s long, t long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "s long, t long")).collect() == []


def test_local_folders_only_where_all_is_local(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        files.shared_folder(Session())


def test_sure_spans_and_fragments(spark):
    df = spark.createDataFrame([("d", 0, 9, 0.5), ("d", 0, 9, 0.95), ("d", 0, 4, 0.9), ("d", 9, 11, 0.9), ("d", 10, 12, 0.99)], "doc string, a long, z long, conf double")
    assert sorted((r.a, r.z, r.conf) for r in documents.keep_apart(df, ["doc"], "a", "z", "conf", surest=True).collect()) == [(0, 9, 0.95), (9, 11, 0.9)]
    assert values(spark, documents.clean_sentences(F.lit("One  two three. Abc. Go on! Last part"))) == [["One two three.", "Go on!", "Last part."]]


def test_prohibitions_and_facts(spark):
    df = spark.createDataFrame([(1, "Never give the drug early. Do not stop. We never give the drug early, later. Avoid heat"), (2, None)], "id int, text string")
    got = validity.prohibitions(df, "id", "text", [("ABSOLUTE", r"\bnever\s+(.+?)(?:\.|,|\z)"), ("STRONG", r"\bavoid\s+(.+?)(?:\.|,|\z)")]).collect()
    assert sorted((r.severity, r.action) for r in got) == [("ABSOLUTE", "give the drug early"), ("STRONG", "heat")]
    text = spark.createDataFrame([(1, "About 12.5 % of 30 days. You should rest now.")], "id int, text string")
    got = validity.facts(text, ["id"], "text", ["days?"], ["should"], ["now"]).collect()
    assert sorted((r.kind, r.value, r.unit, r.is_temporal) for r in got) == [("measure", "30", "days", False), ("percent", "12.5", "%", False), ("recommendation", None, None, True)]
    near = validity.mentions(spark.createDataFrame([(1, "aa 5 days bb 7 days cc")], "id int, text string"), ["id"], "text", r"(\d+)\s*(days?)", 3, 3).collect()
    assert [(r.n, r.value, r.unit, r.words) for r in near] == [(0, 5.0, "day", ["aa", "5", "days", "bb"]), (1, 7.0, "day", ["bb", "7", "days", "cc"])]
