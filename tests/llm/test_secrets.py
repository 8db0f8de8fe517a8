import hashlib
import math
import random
import re
import string
import time
from collections import Counter

from larkspur.llm import secrets


BASE64 = string.ascii_letters + string.digits + "+/"


def entropy(word, window):
    best = 0.0
    for i in range(len(word) - window + 1):
        counts = Counter(word[i : i + window]).values()
        best = max(best, -sum(c / window * math.log2(c / window) for c in counts))
    return best


def secret(word):
    if any(re.search(p, word) for p in secrets.ALLOWED) or all(re.fullmatch(r"([A-Za-z]{1,15}[0-9]{0,4}|[0-9]{1,8})?", x) for x in re.split(r"[/_=+-]+", word)):
        return False
    for c in secrets.CLASSES:
        if re.search(c.pattern, word):
            return entropy(word, c.window) >= c.bits - 1e-9
    return False


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(spans)
    spans += [(m.start(), 3, m.end(), "entropy") for m in re.finditer(secrets.CANDIDATE, text) if secret(m[0])]
    show = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(x))
    return (*(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(show(base).encode()).hexdigest(), show(spans))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, secret_spans string")
    found = secrets.scan(df)
    spans = secrets.joined_spans(found.secret_spans)
    counts = found.select("text", *map(secrets.count_of, ("assign", "access", "hex"))).collect()
    assert [tuple(r)[1:] for r in counts] == [plain(r.text)[:3] for r in counts]
    return [tuple(r) for r in found.select("doc_id", spans).collect()], [tuple(r) for r in secrets.redact(df).select("doc_id", "text").collect()]


def test_edges(spark):
    rng = random.Random(4)
    b64 = "".join(rng.choice(BASE64) for _ in range(40))
    texts = [None, "", "token=token : abcdef", "token = 'abc' secret:abcdef", "TOKEN: abcdefgh1 Api_Key='zzzzzz'", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B2" * 8, "f" * 24 + " " + "a" * 23, "é😀 token=abcdef " + "0123456789abcdef" * 3]
    texts += [b64, f"key {b64}\n{b64} end", "123e4567-e89b-12d3-a456-426614174000", "2024-01-02/2024-01-03-12345678", "path/to/file1/with_many_parts/x2", "sha256-" + b64, "word " * 20_000 + f"secret={b64}", "token=" * 50, "a1" * 300, "x" * 3000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    got, cleaned = run(spark, rows)
    assert sorted(map(str, got)) == sorted(str((d, plain(t)[4])) for d, t in rows)
    for d, t in cleaned:
        if t is not None:
            assert plain(t)[:3] == (0, 0, 0), (d, t)
    assert dict(cleaned)[0] is None and dict(cleaned)[19] == "x" * 3000
    assert run(spark, []) == ([], [])


def test_long_candidates_and_many_matches(spark):
    rng = random.Random(9)
    letters = "".join(rng.choice(string.ascii_letters) for _ in range(44))
    late = "".join(rng.choice(string.ascii_letters) for _ in range(90)) + "7" + "abcdef"
    blob = "".join(rng.choice(BASE64) for _ in range(30_000))
    mixed = " ".join(f"é token=abc{i}x {'f' * 24} AKIA{'Q' * 16} password: {i:024x}" for i in range(5_000))
    texts = ["ab1-" * 20_000, "token=abcdef1 " * 100_000, late, letters, "a" + blob + "é", mixed, "secret=" * 20_000, "getElementByIdAndClassNameOrNull", "x" * 200_000, f"x1{letters * 3}"]
    began = time.monotonic()
    got, cleaned = run(spark, list(enumerate(texts)))
    assert time.monotonic() - began < 120
    for (i, spans), text in zip(sorted(got), texts, strict=True):
        assert spans == plain(text)[4], i
    cleaned = dict(cleaned)
    assert cleaned[1] == "[SECRET] " * 100_000 and [cleaned[i] for i in (2, 3, 4)] == ["[SECRET]", "[SECRET]", "[SECRET]é"]
    assert cleaned[7] == texts[7] and cleaned[0] == texts[0]


def test_whole_table(spark, sf):
    from larkspur.llm.queries import op7_secret_entropy

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op7_secret_entropy(spark, sf).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    assert sorted(map(tuple, got)) == sorted((d, *plain(t)) for d, t in docs)
