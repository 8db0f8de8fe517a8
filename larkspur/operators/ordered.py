"""Folds over rows in order that keep or drop rows, with one state at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame


def kept_in_order(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str], values: Sequence[str], start: Any, step: Callable[..., tuple[Any, bool]]) -> DataFrame:
    """The rows of each ``key`` that ``step(state, *values) -> (state, keep)`` keeps, from ``start``, in ``order``.

    Rows are dealt out by key and sorted by Spark, which spills what doesn't fit; a worker
    reads them as they come and holds one state, so a key may have any number of rows.
    """
    names = rows.columns
    at = [names.index(c) for c in (*key, *values)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state = start
        for batch in batches:
            kept = []
            for own in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if own[: len(key)] != now:
                    now, state = own[: len(key)], start
                state, keep = step(state, *own[len(key) :])
                kept.append(keep)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(walk, rows.schema)
