import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def token_counts(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows}


def check(rows, pieces, window=2048):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = sorted((str(d), zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, t in rows)
    documents, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
        documents[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= window
    if len({d for d, _ in rows}) == len(rows):
        got = []
        for (d, n), parts in documents.items():
            ids = [i for p in sorted(parts, key=lambda p: p.start) for i in p.ids]
            assert len(ids) == n
            got.append((str(d), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert sorted(got) == wanted
    return sum(n for s in sequences.values() for _, n in s), len(sequences)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> x"), (4, "word " * 9000), (None, "é ü \n\n  z"), (5, "a" * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    check(rows, packing.pack_documents(df, PATH, public_tokenizers.PATTERN).collect())
    assert packing.pack_documents(df.where("doc_id = 3"), PATH, public_tokenizers.PATTERN).first().ids == [50256, 2124, 1]
    twice = packing.pack_documents(df.union(df), PATH, public_tokenizers.PATTERN).collect()
    assert sum(p.length for p in twice) == 2 * sum({(p.doc_id, p.start): p.length for p in twice}.values())
    assert packing.pack_documents(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_added_tokens_are_found_as_the_library_does():
    tokenizer, own = Tokenizer.from_file(PATH), packing.encoder(PATH, public_tokenizers.PATTERN)
    token = "<|endoftext|>"
    texts = [token, token * 3, f"a {token} b", f"in{token}side", f"  {token}\n\n  x  {token} ", f"<{token}>", token[:-1], token.upper(), f"don{token}'t", f"é😀{token}  {token}z", "<|" + token]
    for text in texts:
        assert own.encode(text, allowed_special="all") == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_whole_table_has_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pieces = packing.pack_documents(docs, PATH, public_tokenizers.PATTERN).collect()
    tokens, sequences = check([tuple(r) for r in docs.collect()], pieces)
    assert tokens / (sequences * 2048) > 0.96


def test_many_short_texts_fill_sequences(spark):
    rows = [(i, None if i % 3 else "a b" * (i % 7)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens, sequences = check(rows, packing.pack_documents(df, PATH, public_tokenizers.PATTERN).collect())
    assert sequences <= tokens / 2048 * 1.03 + 1


def test_other_normalizers_are_refused(tmp_path):
    import json

    whole = json.load(open(PATH, encoding="utf-8"))
    (tmp_path / "v.json").write_text(json.dumps(whole | {"normalizer": {"type": "Lowercase"}}), encoding="utf-8")
    with pytest.raises(ValueError):
        packing.encoder(str(tmp_path / "v.json"), public_tokenizers.PATTERN)


def test_plan_uses_up_the_histogram():
    rng = random.Random(1)
    for _ in range(20):
        histogram = {s: rng.randint(0, 500) for s in range(1, 33)}
        used = defaultdict(int)
        for combination, repeats in packing.plan(histogram, 32):
            assert sum(combination) <= 32 and repeats > 0
            for s in combination:
                used[s] += repeats
        assert dict(used) == {s: n for s, n in histogram.items() if n}


def test_least_squares_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(10):
        a, b = rng.random((8, 20)), rng.random(8)
        x = packing.nonnegative_least_squares(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and gradient.min() > -1e-7
        assert np.abs(gradient[x > 0]).max() == pytest.approx(0, abs=1e-7)
