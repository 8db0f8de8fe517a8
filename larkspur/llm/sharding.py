"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from larkspur.llm.common import cut_lineage, gapless_rank, pieces_for

#: The key that orders a shard is a random number of so many bits.
KEY_BITS = 62


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` out of ``good + bad``, for totals of any size."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    reach = int(14 * np.sqrt(drawn * share * (1 - share)) + 50)
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    ratios = np.log(good - k[:-1]) + np.log(drawn - k[:-1]) - np.log(k[1:]) - np.log(bad - drawn + k[1:])
    weights = np.concatenate([[0.0], np.cumsum(ratios)])
    weights = np.cumsum(np.exp(weights - weights.max()))
    return int(k[np.searchsorted(weights, rng.random() * weights[-1])])


def communication_matrix(sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows that each block sends to each shard: row sums are ``sizes``, column sums differ by one at most.

    This is how the counts of a uniform random permutation are distributed: each row is
    a multivariate hypergeometric draw from the room that is left in the shards.
    """
    rng, total = np.random.default_rng(seed), sum(sizes)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = np.zeros((len(sizes), n_shards), dtype=np.int64)
    for b, size in enumerate(sizes):
        left, others = size, sum(room)
        for s in range(n_shards):
            others -= room[s]
            matrix[b, s] = k = hypergeometric(rng, room[s], others, left)
            left -= k
        room = [r - int(k) for r, k in zip(room, matrix[b], strict=True)]
    return matrix


def shuffle_to_shards(df: DataFrame, n_shards: int, seed: int = 0, max_blocks: int = 65_536, rows_each: int = 2_048) -> DataFrame:
    """All rows of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard), in uniformly random order.

    The rows are first written to the checkpoint folder, so a lost executor finds the same
    blocks again; a block is a Spark partition, at most ``max_blocks`` of them, which bounds
    the matrix on the driver. Each block deals out exactly the counts of its matrix row in
    random order; after the exchange, a random key orders each shard. Pieces of about
    ``rows_each`` rows are sorted, never a whole shard.

    Null and repeated rows are rows like any other. An empty table gives an empty result.
    Input columns called shard or slot are replaced, all others pass through.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    own = [f"c{i}" for i in range(len(names))]
    base = df.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(names, own, strict=True)))
    pid = F.spark_partition_id().alias("_block")
    base = cut_lineage(base.coalesce(max_blocks))
    sizes = {r["_block"]: r["count"] for r in base.groupBy(pid).count().collect()}
    blocks = sorted(sizes)
    matrix = communication_matrix([sizes[b] for b in blocks], n_shards, seed)
    rows_of = df.sparkSession.sparkContext.broadcast({b: matrix[i] for i, b in enumerate(blocks)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = keys = None
        at = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if shards is None:
                block = batch.column("_block")[0].as_py()
                rng = np.random.default_rng([seed, block])
                shards = rng.permutation(np.repeat(np.arange(n_shards, dtype=np.int32), rows_of.value[block]))
                keys = rng.integers(0, 1 << KEY_BITS, len(shards))
            to = at + batch.num_rows
            columns = [*batch.columns[:-1], shards[at:to], keys[at:to], np.arange(at, to) + (block << 40)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [*own, "shard", "_key", "_row"])
            at = to
        if shards is not None and at != len(shards):
            raise RuntimeError(f"a block had {len(shards)} rows and now has {at}")

    extra = [StructField("shard", IntegerType()), StructField("_key", LongType()), StructField("_row", LongType())]
    dealt = base.select("*", pid).mapInArrow(deal, StructType([*base.schema.fields, *extra]))
    bits = pieces_for(sum(sizes.values()), n_shards, rows_each).bit_length() - 1
    dealt = dealt.withColumn("_piece", F.shiftright("_key", KEY_BITS - bits))
    return gapless_rank(dealt, ["shard"], ["_key", "_row"], "_piece", "slot").select(*(F.col(x).alias(c) for x, c in zip(own, names, strict=True)), "shard", "slot")
