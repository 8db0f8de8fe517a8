import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from larkspur.llm import bpe_tree

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabet = ["the", " ", "  ", "\n", "'s", "'", "ll", "é", "ß", "12", "9", "!!", "...", "日本", "🙂", "\t", " ", "x" * 9, "<|endoftext|>"]
    out = ["", " ", "a", "'s", " " * 300, "x" * 700, "日本語" * 90, "don't " * 80, "a" * 3000 + " " * 3000 + "b"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(150)]


@pytest.mark.parametrize("leaf", [1, 7, 64])
def test_tree_encodes_like_the_library_at_once(library, leaf):
    own = bpe_tree.codec(PATH, public_tokenizers.PATTERN)
    for t in texts():
        ids = own.encode(t, leaf)
        assert ids == library.encode_ordinary(t), t
        assert own.decode(ids, leaf) == t.encode()


def test_rows(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "don't  stop " * 4000, 5), (None, "é", 5), (4, "a", 5), (4, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe_tree.encode_texts(df, PATH, public_tokenizers.PATTERN).collect()
    want = [(d, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, t or "") for d, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe_tree.encode_texts(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_whole_table(spark, sf, library):
    from larkspur.llm.queries import op9_bpe_tree

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_bpe_tree(spark, sf).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_other_patterns_are_refused():
    with pytest.raises(ValueError, match="pattern"):
        bpe_tree.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), r"\w+|\W")
