"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.files import cut_lineage, shared_folder

__all__ = ["cut_lineage", "gapless_rank", "pieces_for", "row_hash", "slices", "stored", "text_bytes"]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the checkpoint folder and read again; lighter than a checkpoint for long rows."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def row_hash(*cols: str) -> list[Column]:
    """Two longs that stand for the contents of ``cols``; equal rows get equal values, and nulls differ from empty strings."""
    marked = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*marked), F.xxhash64(F.lit(7), *reversed(marked))]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts of ``rows`` at most, so that a worker holds few of them as Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def gapless_rank(df: DataFrame, key: list[str], order: list[str], group: str, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within each ``key``, in the order of (``group``, ``order``).

    ``group`` is an ordered number that splits a key into pieces of bounded size, so no
    task sorts a whole key: pieces are counted, their starts come from a running sum over
    the counts, and rows are numbered inside a piece only.
    """
    piece = [*key, group]
    counts = df.groupBy(*piece).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*piece, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = df.withColumn("_in", F.row_number().over(Window.partitionBy(*piece).orderBy(*order)))
    return ranked.join(starts, piece).withColumn(name, F.col("_start") + F.col("_in") - 1).drop("_start", "_in")


def pieces_for(rows: int, keys: int, rows_each: int) -> int:
    """A power of two: pieces per key so that one holds about ``rows_each`` of ``rows`` spread over ``keys``."""
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, rows / max(1, keys) / rows_each)))))
