"""Chunks whose limits follow the kind and the complexity of a section, cut where sentences may be parted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators.documents import SLICE, chunk_texts

# Words of titles that tell a section's kind, the first list with a hit; (target, least, most) words and sentences of overlap of a kind.
TITLE_WORDS = {
    "procedure": ("technique", "approach", "procedure", "surgical", "step"),
    "anatomy": ("anatomy", "nerve", "artery", "vein"),
    "pathology": ("pathology", "tumor", "disease", "grade"),
    "clinical": ("clinical", "presentation", "management", "treatment"),
    "case": ("case", "patient"),
    "differential": ("differential", "versus"),
    "imaging": ("imaging", "mri", "ct"),
    "evidence": ("outcome", "evidence", "study"),
}
LIMITS = {
    "procedure": (750, 200, 1100, 2),
    "anatomy": (600, 150, 900, 3),
    "pathology": (700, 180, 1000, 2),
    "clinical": (650, 150, 950, 3),
    "case": (800, 250, 1200, 2),
    "general": (600, 150, 1000, 2),
    "differential": (650, 150, 900, 2),
    "imaging": (550, 120, 800, 2),
    "evidence": (600, 150, 900, 2),
    "comparative": (700, 180, 1000, 2),
    "grading_scale": (500, 100, 800, 2),
    "complication": (600, 150, 900, 3),
    "pearl_pitfall": (400, 80, 600, 2),
}
# Factors by the number of signals of complexity, and how far the upper limit grows.
FACTORS = ((5, 1.30), (3, 1.15), (1, 1.0), (0, 0.85))
MOST_FACTOR = 1.2
# Sentences that lean on what stands before them.
LEANING = (
    r"(?i)^(This|That|These|Those)\s",
    r"(?i)^(However|Therefore|Thus|Furthermore|Moreover|Additionally)\b",
    r"(?i)^(Step\s+\d|Then|Next|Finally|Subsequently)\b",
    r"(?i)^(It\s+is|They\s+are)\b",
)
# Pairs of sentences that stay together, as (patterns of the first, strings of the first, patterns of the second, strings of the second); strings are looked for in lower case.
TOGETHER = (
    ((r"(?i)Step\s+\d+", r"^\d+\.\s+"), (), (r"(?i)^\s*(This|The\s+\w+\s+is)",), ()),
    ((), ("bipolar", "suction", "dissector", "microscope", "retractor"), (), ("to coagulate", "to dissect", "to expose", "carefully")),
    ((), ("avoid", "caution", "warning", "critical"), (), ("can cause", "risk of", "to prevent")),
    ((), ("lateral to", "medial to", "superior to", "inferior to"), (), ("lateral to", "medial to", "and", "which is")),
    ((), ("arises from", "originates", "emerges"), (), ("courses", "travels", "terminates", "supplies")),
    ((r"(?i)(Grade|WHO|Spetzler)\s+[IVX\d]+",), (), (), ("characterized by", "defined as", "criteria")),
    ((), ("1p/19q", "mutation"), (), ("prognosis", "survival", "outcome")),
)
# Fixed value: where sentences end. The full stop comes first, so that abbreviations are looked for at full stops alone.
SENTENCE_END = r"\.(?<!\bDr\.)(?<!\bFig\.)(?<!\bNo\.)(?<!\bal\.)(?<!\bapprox\.)(?<!\bvs\.)(?<!\bet\.)(?<!\bi\.e\.)(?<!\be\.g\.)(?<!\bSt\.)(?<!\bVol\.)\s+(?=[A-Z])"


def kind_of(title: Column) -> Column:
    low, found = F.lower(F.coalesce(title, F.lit(""))), F.lit("general")
    for kind, listed in reversed(TITLE_WORDS.items()):
        hit = F.lit(False)
        for w in listed:
            hit = hit | low.contains(w)
        found = F.when(hit, kind).otherwise(found)
    return found


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def signals(text: Column, density: Column | None = None) -> Column:
    """How many signs of complexity a section has: steps count two, many directions one or two, grades, markers and measurements one each, and entities where ``density``, their number in 100 words, is above 15."""
    directions = _count(text, r"(?i)\b(lateral|medial|superior|inferior|anterior|posterior)\b")
    total = F.when(text.rlike(r"(?m)Step\s+\d|^\d+\.\s+"), 2).otherwise(0) + F.when(directions > 5, 2).when(directions > 2, 1).otherwise(0)
    total += F.when(text.rlike(r"(?i)(Grade|WHO|Spetzler|Hunt.Hess)\s+[IVX\d]+"), 1).otherwise(0)
    total += F.when(text.rlike(r"(?i)\b(IDH|MGMT|1p.?19q|EGFR|BRAF)\b"), 1).otherwise(0)
    total += F.when(_count(text, r"(?i)\d+\s*(mm|cm|degrees?|°)") > 3, 1).otherwise(0)
    return total if density is None else total + F.when(density > 15, 1).otherwise(0)


def factor(total: Column) -> Column:
    found = F.lit(FACTORS[-1][1])
    for least, value in reversed(FACTORS):
        found = F.when(total >= least, value).otherwise(found)
    return found


def limits(kind: Column, by: Column) -> list[Column]:
    """(target, least, most, overlap) of a kind, scaled by a factor; whole parts, and the upper limit grows by a fifth at most."""
    columns = [F.lit(0)] * 4
    for name, values in LIMITS.items():
        columns = [F.when(kind == name, v).otherwise(c) for v, c in zip(values, columns, strict=True)]
    target, least, most, overlap = columns
    return [(target * by).cast("int").alias("target"), (least * by).cast("int").alias("least"), (most * F.least(by, F.lit(MOST_FACTOR))).cast("int").alias("most"), overlap.alias("overlap")]


def section_sentences(text: Column) -> Column:
    """Sentences that end with a full stop before a capital letter; a mark is added where none ends one."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    parts = F.filter(F.transform(F.split(flat, SENTENCE_END), F.trim), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit("."))))


def tied(before: str, sentence: str) -> bool:
    """Whether a cut before ``sentence`` would part what belongs together."""
    if any(re.search(p, sentence) for p in LEANING):
        return True
    a, b = before.lower(), sentence.lower()
    for patterns, strings, next_patterns, next_strings in TOGETHER:
        first = any(re.search(p, before) for p in patterns) or any(s in a for s in strings)
        if first and (any(re.search(p, sentence) for p in next_patterns) or any(s in b for s in next_strings)):
            return True
    return False


def chunk_adaptive(df: DataFrame, id_col: str, title_col: str, text_col: str, density: Column | None = None) -> DataFrame:
    """(id_col, chunk_index, kind, factor, content, words): chunks of each section, limited by its kind and complexity.

    The kind comes from the title, limits from the kind and from signs of complexity in the
    whole section, all as Spark columns; the fold over sentences looks one ahead and
    doesn't part those that belong together, up to the upper limit. Sections without a sentence have no chunk.
    """
    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("_id"), kind_of(F.col(title_col)).alias("kind"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), factor(signals(F.coalesce(F.col(text_col), F.lit("")), density)).alias("factor"))
    ready = own.select("_id", "kind", "factor", *limits(F.col("kind"), F.col("factor")), section_sentences(F.col("_text")).alias("parts"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                made = [chunk_texts(parts, target, most, least, overlap, tied, 0) for target, least, most, overlap, parts in zip(*(c.to_pylist() for c in rows.columns[3:]), strict=True)]
                which = pa.array([k for k, chunks in enumerate(made) for _ in chunks], pa.int64())
                texts = [c for chunks in made for c in chunks]
                numbers = [k for chunks in made for k in range(len(chunks))]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(which), pa.array(numbers, pa.int32()), rows.column(1).take(which), rows.column(2).take(which), pa.array(texts, pa.string())], [id_col, "chunk_index", "kind", "factor", "content"])

    return ready.mapInArrow(fold, f"{id_col} {kind}, chunk_index int, kind string, factor double, content string").withColumn("words", tx.word_count(F.col("content")))
