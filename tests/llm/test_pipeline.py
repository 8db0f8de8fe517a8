from tests.llm import test_packing, test_repeats, test_secrets

import corpus_pipeline
from larkspur.llm import language_id
from larkspur.llm.queries import language_model


def plain_redact(text):
    spans = [tuple(map(int, s.split(":")[1:])) for s in test_secrets.plain(text)[4].split(",") if s]
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def least_of_similar(texts):
    """The least document of each group that a similarity of 0.8 of five-word shingles links, all pairs compared."""
    words = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    sets = {d: {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else -1
            if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d for d in texts if root(d) == d}


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_model(docs)
    results, now = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        results.append(now.collect())
        if k < 4:
            assert now.columns == docs.columns
            assert len({r.doc_id for r in results[-1]}) == len(results[-1])

    wanted = {d: r.text for d, r in rows.items() if language_id.classify_text(model, r.text)[2]}
    assert {r.doc_id: r.text for r in results[0]} == wanted
    assert len(wanted) > 0.95 * len(rows)
    first = least_of_similar(wanted)
    kept = {r.doc_id: r.text for r in results[1]}
    assert all(kept[d] == wanted[d] for d in kept) and first <= set(kept)
    assert len(set(kept) - first) <= 0.1 * (len(wanted) - len(first)) and len(first) < len(wanted)
    wanted = {d: t for d, t in wanted.items() if d in kept}
    cut = test_repeats.plain(list(wanted.values()))
    assert {r.doc_id: len(r.text.encode()) for r in results[2]} == {d: n - gone for d, (n, gone, _, _) in zip(wanted, cut, strict=True)}
    assert {r.doc_id: r.text for r in results[3]} == {r.doc_id: plain_redact(r.text) for r in results[2]}
    assert all(r.n_chars == len(r.text) for r in results[3])
    tokens = {p.doc_id: p.doc_tokens for p in results[4]}
    assert tokens == test_packing.token_counts([(r.doc_id, r.text) for r in results[3]])
    assert sum(p.length for p in results[4]) == sum(tokens.values())


def test_run_is_the_stages(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0


def test_stages_on_odd_rows(spark):
    words = "the and of with that this from have been were they".split()
    text = " ".join(words[i * 7 % 11] + words[i * 5 % 7] for i in range(120))
    names = "doc_id long, text string, lang string, source string, n_chars long, secret_spans int, lang_pred string, n_bytes int, fp string, kept_sha256 string"
    extra = (7, "q", 8, "f", "k")
    rows = [(1, text, "en", "s", 5, *extra), (2, text, "en", None, 5, *extra), (2, text, "en", None, 5, *extra), (None, "token = 'abcdefgh' " + text[:300], None, "s", None, *extra), (4, None, None, None, None, *extra), (5, "", "en", "s", 0, *extra), (6, "word " * 9000, "en", "s", 1, *extra)]
    df = spark.createDataFrame(rows, names)
    now, counts = df, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == df.columns
        counts.append(now.count())
        assert all((r.secret_spans, r.lang_pred, r.n_bytes, r.fp, r.kept_sha256) == extra for r in now.collect())
        alone = stage(spark, df, "").collect()
        assert len(alone) <= len(rows)
        assert stage(spark, df.limit(0), "").collect() == []
    assert counts[1] == 3 and not any("abcdefgh" in r.text for r in now.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() >= 3
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() >= len(rows)
