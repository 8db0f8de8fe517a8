"""Dictionaries of phrases of any size against texts: exact terms by tries, near terms by set similarity."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.operators.documents import keep_apart
from larkspur.operators.exact_search import MOST_BROADCAST
from larkspur.sources.files import cut_lineage

#: Words of texts and terms.
TOKEN = regex.compile(r"[\p{L}\p{N}_]+")
#: The same in texts of ASCII characters alone, found faster.
ASCII_TOKEN = re.compile(r"[A-Za-z0-9_]+")
#: Rows handled as Python objects at once.
SLICE = 500
#: Words of a term that its key covers at most.
KEY_TOKENS = 8
#: Bytes of a dictionary that every task holds whole; a larger one meets the texts by joins.
MOST_HELD = 4 << 20
#: Different runs of words that a task remembers to have given.
MOST_SEEN = 1 << 17


def tokens(text: str | None) -> list[str]:
    if not text or text.isascii():
        return ASCII_TOKEN.findall(text.lower()) if text else []
    return [w.lower() for w in TOKEN.findall(text)]


def token_spans(text: str) -> list[tuple[int, int]]:
    """Where each of ``tokens`` starts and stops, in code points."""
    return [m.span() for m in (ASCII_TOKEN if text.isascii() else TOKEN).finditer(text)]


def _mapped(df: DataFrame, columns: Sequence[str], schema: str, convert: Callable[..., list[tuple]], once: Callable[[], Any] | None = None) -> DataFrame:
    """Rows that ``convert`` gives for each row of ``columns``, in small slices; what ``once`` makes in a task is its first argument."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (once(),) if once else ()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                rows = [x for own in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in convert(*given, *own)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(arrow), arrow.types, strict=True)], arrow.names)

    return df.select(*columns).mapInArrow(walk, schema)


def run_hashes(hashes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, h) for n = 1 to ``most``: a hash of the n tokens that begin at each place; places too near the end are left out."""
    h = hashes.copy()
    for n in range(1, min(most, len(hashes)) + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1 :]
        yield n, h


def token_hashes(lists: Sequence[Sequence[str]]) -> np.ndarray:
    """A 64-bit hash of each token of all ``lists``, one after another."""
    known: dict[str, int] = {}
    for own in lists:
        for w in own:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.fromiter((known[w] for own in lists for w in own), np.uint64)


def term_keys(terms: DataFrame) -> DataFrame:
    """(n, k, t): each term (array of tokens t) under a hash of its first n tokens, all of them or ``KEY_TOKENS``."""

    def keyed(t: list[str]) -> list[tuple]:
        *_, (n, h) = run_hashes(token_hashes([t[:KEY_TOKENS]]), KEY_TOKENS)
        return [(n, int(h[:1].view(np.int64)[0]), t)]

    return _mapped(terms, ["t"], "n int, k long, t array<string>", keyed)


def text_keys(texts: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(h, n, k): the hashes of all runs of ``lengths`` tokens in each text (_h, _text)."""
    wanted = set(lengths)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                lists = [tokens(t) for t in part.column(1).to_pylist()]
                row = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
                for n, h in run_hashes(token_hashes(lists), max(wanted, default=0)):
                    if n in wanted:
                        within = row[: len(h)] == row[n - 1 :]
                        keys = h[within].view(np.int64)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[: len(h)][within])), pa.array(np.full(len(keys), n), pa.int32()), pa.array(keys)], ["h", "n", "k"])

    return texts.select("_h", "_text").mapInArrow(walk, "h long, n int, k long")


def trie_of(terms: Sequence[Sequence[str]]) -> dict:
    """A trie over the tokens of ``terms``; the key None is there where one ends."""
    trie: dict = {}
    for t in terms:
        node = trie
        for w in t:
            node = node.setdefault(w, {})
        node[None] = True
    return trie


def longest_matches(text: str, trie: dict) -> list[tuple[int, int, int, int, str]]:
    """(start, stop, token, tokens, term) of the leftmost-longest matches of the terms of ``trie`` in ``text``; offsets in code points."""
    words = tokens(text)
    places, end = [], 0
    for i in [k for k, w in enumerate(words) if w in trie]:
        if i < end:
            continue
        node, best, j = trie, 0, i
        while j < len(words) and (node := node.get(words[j])) is not None:
            j += 1
            best = j - i if None in node else best
        if best:
            places.append((i, best))
            end = i + best
    spans = token_spans(text) if places else []
    return [(spans[i][0], spans[i + n - 1][1], i, n, " ".join(words[i : i + n])) for i, n in places]


def phrase_hits(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(id_col, start, stop, token, tokens, term): leftmost-longest matches of the terms in each text, by whole words in any case.

    Terms have any number of words, and there may be any number of terms. Up to ``MOST_HELD`` bytes of them
    are one trie in every task, and texts are read once and stay where they are. Of more, each stands under a
    hash of all its words, or of its first ``KEY_TOKENS``, and texts meet terms by a join on the hashes of their
    own runs of as many words. So a text's own trie has only terms that are in it (longer ones: that
    begin in it), however common their words are. A term without a word never matches; equal terms count once.
    Texts meet by a hash of their content, so equal ones are looked up once; a collision
    only makes a trie larger. Null and empty texts have no match; repeated rows have theirs each.
    """
    known = _mapped(terms.select(F.col(term_col).alias("t")).distinct(), ["t"], "t array<string>", lambda t: [(own,)] if (own := tokens(t)) else []).distinct()
    keyed = cut_lineage(term_keys(known))
    size = keyed.agg(F.collect_set("n"), F.sum(F.octet_length(F.array_join("t", " ")) + 64)).first()  # KEY_TOKENS lengths at most
    kind = df.schema[id_col].dataType.simpleString()
    found = f"{id_col} {kind}, start int, stop int, token int, tokens int, term string"
    texts = df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h")).where("_text is not null")
    if (size[1] or 0) <= MOST_HELD:
        held = df.sparkSession.sparkContext.broadcast([r.t for r in keyed.select("t").collect()])  # MOST_HELD bytes at most
        return _mapped(texts, [id_col, "_text"], found, lambda trie, i, text: [(i, *m) for m in longest_matches(text, trie)], lambda: trie_of(held.value))
    runs = text_keys(texts, size[0])
    met_terms = runs.join(F.broadcast(keyed), ["n", "k"]) if (size[1] or 0) <= MOST_BROADCAST else runs.distinct().join(keyed, ["n", "k"])
    own = met_terms.groupBy("h").agg(F.collect_set("t").alias("_terms"))
    met = texts.join(own, texts["_h"] == own["h"]).select(id_col, "_text", "_terms")
    return _mapped(met, [id_col, "_text", "_terms"], found, lambda i, text, own: [(i, *m) for m in longest_matches(text, trie_of(own))])


def shared_prefix(sets: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(id, m, n, members): each set under its rarest members, so many that two sets of Jaccard similarity ``least`` or more share one of these.

    Of a set of n, a similar one has ``least`` times n in common at least, so all but that many, and one, are enough.
    """
    each = sets.select("id", "members", F.size("members").alias("n"), F.explode("members").alias("m")).join(counts, "m")
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("texts", "m")))
    return ranked.where(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).drop("_r", "texts")


def set_join(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of all pairs of sets (id, members) of two sides with a Jaccard similarity of ``least`` or more; ids are unique in a side.

    Sets meet by a join on one of their rarest members, with sizes that allow the similarity, and
    only under the first rare member that they share, so a pair comes once; members that
    are everywhere bring nothing together. Empty sets are similar to nothing.
    """
    sides = [d.select("id", F.array_distinct("members").alias("members")).where(F.size("members") > 0) for d in (a, b)]
    counts = sides[0].unionByName(sides[1]).select(F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("texts"))
    x, y = (shared_prefix(d, counts, least) for d in sides)
    x = x.select("m", F.col("id").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    y = y.select("m", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    near = (F.col("na") >= F.col("nb") * least - 1e-9) & (F.col("nb") >= F.col("na") * least - 1e-9)
    shared = F.size(F.array_intersect("ma", "mb"))
    met = x.join(y, "m").where(near).select("a", "b", (shared / (F.col("na") + F.col("nb") - shared)).alias("similarity"))
    return met.where(F.col("similarity") >= least - 1e-12).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def word_runs(words: Sequence[str], most: int) -> Iterator[tuple[int, Iterator[str]]]:
    """(n, runs) for n = 1 to ``most``: the runs of n words that begin at each place, with single spaces; places too near the end are left out."""
    for n in range(1, most + 1):
        yield n, map(" ".join, zip(*(words[k:] for k in range(n)), strict=False))


def word_grams(text: str, most: int, known: set[str] | None = None) -> list[tuple[int, int, int, str]]:
    """(start, stop, words, gram): every run of up to ``most`` words, in lower case with single spaces, or those that are ``known``."""
    found = [(i, n, g) for n, runs in word_runs(tokens(text), most) for i, g in enumerate(runs) if known is None or g in known]
    spans = token_spans(text) if found else []
    return [(spans[i][0], spans[i + n - 1][1], n, g) for i, n, g in found]


def letter_grams(name: Column, width: int = 3) -> Column:
    """Distinct runs of three characters of a name with a space at either end."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - width + 1, F.lit(1))), lambda i: F.substr(padded, i, F.lit(width))))


def near_concepts(df: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame, weights: DataFrame, least: float = 0.7, least_score: float = 0.3, longest: int = 5) -> DataFrame:
    """(id_col, start, stop, concept, class, similarity, score): concepts whose names are written nearly as a run of words of the text.

    ``vocabulary`` has (concept, name, class), ``weights`` (class, weight); a class without a
    weight counts 1. Different runs of up to ``longest`` words meet different names by ``set_join`` on
    letter trigrams, so a run that is in many texts is compared once. Of several names of a run
    the nearest counts, then the concept that sorts first. The score is similarity times
    weight; below ``least_score`` a match is dropped. Texts are read twice: for their different runs, of which a
    task gives one again only when it has met many others, and for the places of those that are near a name;
    if these take more than ``MOST_HELD`` bytes, all runs meet them by a join. Of overlapping matches the leftmost stays, of
    those that start together the surest, then the longest. Null and empty texts and names match nothing.
    """
    names = vocabulary.select("concept", "class", F.lower(F.array_join(F.regexp_extract_all(F.coalesce("name", F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")).alias("name")).where("name <> ''")
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.where(F.col(text_col).isNotNull())

    def unseen(seen: set[str], text: str) -> list[tuple]:
        if len(seen) > MOST_SEEN:
            seen.clear()
        new = {g for _, own in word_runs(tokens(text), longest) for g in own} - seen
        seen |= new
        return [(g,) for g in new]

    runs = cut_lineage(_mapped(texts, [text_col], "gram string", unseen, set).distinct())
    sets = [d.select(F.col(c).alias("id")).distinct().withColumn("members", letter_grams(F.col("id"))) for d, c in ((runs, "gram"), (names, "name"))]
    near = set_join(*sets, least).join(names.withColumnRenamed("name", "b"), "b")
    best = near.groupBy(F.col("a").alias("gram")).agg(F.min(F.struct((-F.col("similarity")).alias("d"), "concept", "class")).alias("best"))
    scored = best.select("gram", "best.concept", "best.class", (-F.col("best.d")).alias("similarity")).join(weights.select("class", "weight"), "class", "left")
    scored = cut_lineage(scored.withColumn("score", F.col("similarity") * F.coalesce("weight", F.lit(1.0))).drop("weight").where(F.col("score") >= least_score))
    size = scored.agg(F.sum(F.octet_length("gram") + 64)).first()[0] or 0
    held = df.sparkSession.sparkContext.broadcast({r.gram for r in scored.select("gram").collect()} if size <= MOST_HELD else None)  # MOST_HELD bytes at most
    grams = _mapped(texts, [id_col, text_col], f"{id_col} {kind}, start int, stop int, gram string", lambda known, i, text: [(i, a, z, g) for a, z, _, g in word_grams(text, longest, known)], lambda: held.value)
    found = grams.join(F.broadcast(scored) if size <= MOST_HELD else scored, "gram")
    return keep_apart(found, [id_col], "start", "stop", "score", least_score, surest=True).select(id_col, "start", "stop", "concept", "class", "similarity", "score")


def merged(hits: DataFrame, others: DataFrame, group: str, least: float = 0.3) -> DataFrame:
    """Spans (group, start, stop, confidence, ...) of two phases that don't overlap: the leftmost, of those that start together the surest; of equal spans the surest stays."""
    return keep_apart(hits.unionByName(others), [group], "start", "stop", "confidence", least, surest=True)
