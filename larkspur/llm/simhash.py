"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from larkspur.llm.common import cut_lineage, slices, text_bytes
from larkspur.llm.components import connected_components

BITS = 64


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority of the hash bits of all word shingles of UTF-8 ``text``; 0 where there is no word.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. Fewer than
    ``width`` words make one shingle. A repeated shingle counts each time.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)])
    ones = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(n, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, the columns ``carry``, fp long) of each row, from whole texts; null text counts as empty."""
    own = [id_col, *carry]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x, width, seed) for x in text_bytes(batch.column(len(own)))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*own, "fp"])

    return df.select(*own, text_col).mapInArrow(convert, StructType([*(df.schema[c] for c in own), StructField("fp", LongType())]))


def ball(fp: Column, radius: int) -> Column:
    """All values that differ from ``fp`` in ``radius`` bits or fewer."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: fp.bitwiseXOR(m))


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that connect any two fingerprints of ``distinct`` (column fp) with ``radius`` or fewer differing bits.

    Every fingerprint emits the ball of half the radius around it. Two fingerprints within
    the radius share a variant, and all that share a variant are within the radius, so
    tying each to the least of its variant loses no link and makes no pairs within a group.
    A variant holds at most as many fingerprints as the ball has members, whatever the data.
    Fingerprints are spread over all partitions first, as each becomes many rows; they are
    dealt by a hash of their own, as rows grouped by fingerprint wouldn't be dealt again.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.select("fp").repartition(partitions, F.xxhash64("fp", F.lit(partitions)))
    emitted = spread.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("variant"))
    met = emitted.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> least")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius).select(F.col("fp").alias("u"), F.col("least").alias("v"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, the columns ``carry``, fp, component_id, kept) of each row.

    component_id is the smallest id reachable over links, the own one included; kept marks
    one row of each component, that of the smallest id (of repeated rows the first).
    Texts without a word, null included, have fingerprint 0 and are linked like any other.
    Rows without an id take part; where a component has no id at all, component_id is null.

    Rows shrink to (id, fingerprint) in one pass and are checkpointed; from then on equal
    fingerprints are one node, so a large group of copies costs one row and a grouped count.
    """
    rows = cut_lineage(fingerprints(df, id_col, text_col, width, seed, carry)).withColumn("_row", F.monotonically_increasing_id())
    first = F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), F.col("_row").alias("row"))).alias("first")
    nodes = rows.groupBy("fp").agg(first)
    links = connected_components(near_links(nodes, radius))
    named = nodes.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    names = cut_lineage(named.join(least, "component").select("fp", F.col("least.id").alias("component_id"), F.col("least.row").alias("_kept")))
    return rows.join(names, "fp").select(id_col, *carry, "fp", "component_id", (F.col("_row") == F.col("_kept")).alias("kept"))


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))
