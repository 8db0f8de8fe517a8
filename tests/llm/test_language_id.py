from zlib import crc32

import pytest

from larkspur.llm import language_id


def small_model():
    return language_id.Model((("aa", language_id.prepared("lorem ipsum dolor sit amet consectetur " * 30)), ("bb", language_id.prepared("quick brown foxes jump over lazy dogs " * 30))), 0.02)


def test_rows(spark):
    rows = [(1, "Lorem IPSUM dolor sit!", "x"), (2, "quick brown foxes", "x"), (3, None, "x"), (4, "", "x"), (5, "123 --- 456", "x"), (None, "dolor sit amet", "x"), (6, "lazy dogs " * 20_000, "x"), (6, "lazy dogs " * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    out = language_id.classify(df, small_model())
    assert out.columns == ["doc_id", "text", "lang_pred", "lang_score", "lang_accepted"]
    got = [(r.doc_id, r.lang_pred, r.lang_accepted) for r in out.collect()]
    want = [(1, "aa", True), (2, "bb", True), (3, "und", False), (4, "und", False), (5, "und", False), (None, "aa", True), (6, "bb", True), (6, "bb", True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert all(0 <= r.lang_score <= 1 for r in out.collect())
    assert language_id.classify(df.limit(0), small_model()).collect() == []


def test_smallest_encoding_wins_and_ties_are_rejected():
    model = small_model()
    tie = language_id.Model((("aa", model.dictionaries[0][1]), ("bb", model.dictionaries[0][1])), 0.02)
    assert language_id.classify_text(tie, "lorem ipsum")[0::2] == ("aa", False)
    for text in ("lorem foxes dolor", "brown", "ipsum jump"):
        sizes = {k: len(c.compress(language_id.prepared(text))) for k, c in language_id.compressors(model)}
        assert sizes[language_id.classify_text(model, text)[0]] == min(sizes.values())


def test_narrow_margins_are_rejected():
    model = small_model()
    halves = ["lorem ipsum dolor sit amet consectetur quick brown foxes jump over lazy dogs " * n for n in (1, 2, 5)]
    own = ["lorem ipsum dolor sit amet consectetur", "quick brown foxes jump over lazy dogs"]
    for text in [*halves, *own, "zzzz qqqq", "lorem foxes"]:
        sizes = sorted(len(c.compress(language_id.prepared(text))) for _, c in language_id.compressors(model))
        assert language_id.classify_text(model, text)[2] == (sizes[1] - sizes[0] >= max(1, 0.02 * sizes[0])), text
    assert all(language_id.classify_text(model, x)[2] for x in own) and not language_id.classify_text(model, "zzzz qqqq")[2]
    wide = language_id.Model(model.dictionaries, 10.0)
    assert not any(language_id.classify_text(wide, x)[2] for x in [*halves, *own])


def test_the_sample_holds_every_language_whatever_its_rows(spark):
    rows = [("uno dos tres " * 50 + "abcdefghij"[i % 10] * (i + 1), "es") for i in range(3)]
    df = spark.range(20_000).selectExpr("concat('one two ', translate(cast(id as string), '0123456789', 'abcdefghij')) as text", "'en' as lang").union(spark.createDataFrame(rows, "text string, lang string"))
    model = dict(language_id.fit(df.repartition(5), sample_rows=16).dictionaries)
    assert set(model) == {"en", "es"} and model["en"].count(b"one two") == 16
    assert language_id.fit(df.repartition(3), sample_rows=16) == language_id.fit(df.coalesce(1), sample_rows=16)


def test_fit_is_bounded_and_needs_labels(spark):
    rows = [(f"word{i % 7} text{i}", "aa" if i % 2 else "bb") for i in range(400)] + [(None, "aa"), ("text", None)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), dictionary_bytes=2048)
    assert [k for k, _ in model.dictionaries] == ["aa", "bb"] and all(len(d) <= 2048 for _, d in model.dictionaries)
    empty = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert language_id.classify_text(empty, "some words") == ("und", 0.0, False)
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame(rows, "text string, lang string"), max_languages=1)


def test_a_rare_label_leaves_other_dictionaries_whole(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(f"word{i} text{i} ".translate(letters) * 20, "aa" if i % 2 else "bb") for i in range(400)] + [("short row", "cc")]
    model = dict(language_id.fit(spark.createDataFrame(rows, "text string, lang string"), dictionary_bytes=2048).dictionaries)
    assert len(model["cc"]) < 20 and len(model["aa"]) == len(model["bb"]) == 2048


def test_copies_do_not_displace_languages(spark):
    from pyspark.sql import functions as F

    texts = spark.range(5000).select(F.concat(F.lit("copied text "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    hot = texts.orderBy(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20))).first().text
    rows = [(hot, "aa")] * 2000 + [(f"word{'xyz'[i % 3] * (i + 1)}", "bb") for i in range(8)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string").coalesce(1), sample_rows=8)
    assert [k for k, _ in model.dictionaries] == ["aa", "bb"]


def test_held_out_accuracy(spark):
    from larkspur.llm.queries import op6_language_id

    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op6_language_id(spark, sf).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
    assert sum(r.accepted for r in rows) > 0.98 * len(rows)
