"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from larkspur.llm.common import slices, text_bytes

#: The label of texts without a letter.
NO_LANGUAGE = "und"
#: Text is encoded in blocks of so many bytes, each beginning with the dictionary alone.
BLOCK = 16_384
LEVEL = 12
NO_LETTERS = re.compile(r"[\W\d_]+")
OUTPUTS = ("lang_pred", "lang_score", "lang_accepted")


@dataclass(frozen=True)
class Model:
    """Dictionaries by language. Its size is bounded by the parameters of ``fit``."""

    dictionaries: tuple[tuple[str, bytes], ...]
    min_margin: float
    """A text is rejected if the second-best dictionary needs less than this share of the best one's bytes more, or no byte."""


def prepared(text: str) -> bytes:
    """What is encoded: words in lower case with single spaces, so that layout and marks don't count."""
    return (" " + NO_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace")


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = 32_768, sample_rows: int = 640, max_languages: int = 256, min_margin: float = 0.02, seed: int = 17) -> Model:
    """Learn a dictionary for each language of labelled ``rows`` (those with null text or label are left out).

    The sample is bounded, at any size of the input: the different texts of a language are
    dealt into ``sample_rows`` buckets by a hash, and each bucket gives the text of its least
    hash, so copies count once and no language is lost. A text gives a piece from a place
    that its hash tells, up to its share of ``dictionary_bytes``. A language with little text
    has a short dictionary and leaves the others as they are. More than ``max_languages``
    labels are an error. One pass finds the least hashes, which are counts on longs, a second
    reads their texts; nothing else reaches the driver. No labelled row gives a model without
    languages, which calls every text ``und``.
    """
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    langs = [r["lang"] for r in rows.select("lang").distinct().limit(max_languages + 1).collect()]
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    each = max(256, dictionary_bytes * 2 // sample_rows)
    least = rows.groupBy("lang", F.pmod("h", F.lit(sample_rows)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h")
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.length("text") - each + 1)).cast("int")
    drawn = rows.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", begin + 1, F.lit(each))).alias("text"))
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in drawn.collect():
        parts.setdefault(r["lang"], []).append((r["h"], prepared(r["text"])))
    built = {lang: b"".join(dict.fromkeys(x for _, x in sorted(p)))[:dictionary_bytes] for lang, p in parts.items()}
    return Model(tuple(sorted(built.items())), min_margin)


@lru_cache(maxsize=4)
def compressors(model: Model) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """A compressor for each language, made once for each worker process."""
    made = []
    for lang, content in model.dictionaries:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return made


def classify_text(model: Model, text: str) -> tuple[str, float, bool]:
    """Label, score and acceptance of one text. Ties go to the label that sorts first."""
    if not model.dictionaries or not any(map(str.isalpha, text)):
        return NO_LANGUAGE, 0.0, False
    data = prepared(text)
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors(model))
    best = sizes[0][0]
    score = 1 / sum(math.exp2(max(-64.0, (best - s) / 2)) for s, _ in sizes)
    clear = len(sizes) < 2 or sizes[1][0] - best >= max(1, model.min_margin * best)
    return sizes[0][1], score, clear


def classify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred (string), lang_score (double, 0 to 1) and lang_accepted (boolean), from the whole text.

    The language whose dictionary encodes the text in the fewest bytes wins; the score says
    how far the others are behind. One pass without a shuffle. Null, empty and letterless
    texts are ``und`` with score 0 and not accepted; repeated rows get equal results; input
    columns with the names of the results are replaced, others pass through.
    """
    own = [f for f in df.schema.fields if f.name not in OUTPUTS]
    schema = StructType([*own, *(StructField(n, t) for n, t in zip(OUTPUTS, (StringType(), DoubleType(), BooleanType()), strict=True))])
    at = [f.name for f in own].index(text_col)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [classify_text(model, x.decode("utf-8", "replace")) for x in text_bytes(batch.column(at))]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [f.name for f in schema.fields])

    return df.select(*(F.col(f"`{f.name}`") for f in own)).mapInArrow(convert, schema)
