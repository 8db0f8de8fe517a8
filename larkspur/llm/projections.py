"""Near-duplicate vectors by counting collisions on sorted one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, row_hash
from larkspur.llm.components import connected_components

#: Half-width of a window, in standard deviations of the projected difference of a pair at the threshold.
REACH = 1.2
#: A cell is told by the signs of so many projections at least.
LEAST_SIGNS = 6
#: Rows of cells that are dealt with at once, and collisions that are counted at once.
ROWS, COLLISIONS = 4_096, 2_000_000


@dataclass(frozen=True)
class Scheme:
    """Which projections there are, and what they are for.

    Each of ``tables`` has ``signs`` projections whose signs cut space into cells; ``counted``
    more are sorted within a cell, and a pair with ``least`` collisions or more is verified.
    """

    cosine: float
    tables: int
    signs: int
    counted: int
    least: int
    seed: int

    @property
    def window(self) -> float:
        """Half-width of a window: a pair at the threshold has projections that differ by a normal variable."""
        return REACH * math.sqrt(2 - 2 * self.cosine)

    def directions(self, dimension: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, dimension])
        return rng.standard_normal((dimension, self.counted + self.tables * self.signs))

    def meets(self) -> float:
        """Share of the pairs exactly at the threshold that share a cell in a table."""
        return 1 - (1 - (1 - math.acos(self.cosine) / math.pi) ** self.signs) ** self.tables

    def recall(self) -> float:
        """Share of the pairs exactly at the threshold that are verified."""
        p = math.erf(REACH / math.sqrt(2))
        return self.meets() * sum(math.comb(self.counted, i) * p**i * (1 - p) ** (self.counted - i) for i in range(self.least, self.counted + 1))


def scheme_for(largest: int, cosine: float, recall: float, counted: int, cell_rows: int, seed: int) -> Scheme:
    """Signs so that a cell of ``largest`` vectors in all directions has about ``cell_rows``, then tables and count for ``recall``.

    The chance to miss a pair is divided among both. Tables grow with a tenth power of ``largest``.
    """
    signs = max(LEAST_SIGNS, math.ceil(math.log2(max(1.0, largest / cell_rows))))
    tables = next(t for t in range(1, 1_000) if Scheme(cosine, t, signs, counted, counted, seed).meets() >= 1 - (1 - recall) / 2)
    fitting = (s for least in range(counted, 0, -1) if (s := Scheme(cosine, tables, signs, counted, least, seed)).recall() >= recall)
    if (found := next(fitting, None)) is None:
        raise ValueError("this recall can't be reached")
    return found


def unit_vectors(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column with one length, in double precision, scaled to length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def cells_of(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """The columns of ``nodes`` and cells: the number of the vector's cell in each table."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x = np.einsum("nd,dp->np", unit_vectors(part.column("v")), scheme.directions(int(size))[:, scheme.counted :])
                bits = (x > 0).reshape(part.num_rows, scheme.tables, scheme.signs)
                cells = bits @ (np.int64(1) << np.arange(scheme.signs))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(cells), pa.list_(pa.int64()))], [*part.schema.names, "cells"])

    names = f"node long, weight long, v {nodes.schema['v'].dataType.simpleString()}, size int, label string, cells array<long>"
    return nodes.select("node", "weight", "v", "size", "label").mapInArrow(convert, names)


def colliding(values: np.ndarray, group: np.ndarray, side: np.ndarray, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, datum) row numbers of the pairs within a group that collide on enough projections, some queries at a time.

    Rows of side 0 are queries, those of side 1 data; among rows of side 2 each pair comes
    once. A group's projections are moved apart from the next one's, so one sort does for all.
    """
    n = len(values)
    queries, data = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    placed = values + (group * (4 * np.abs(values).max(initial=0) + 4 * scheme.window + 1))[:, None]
    orders = [data[np.argsort(placed[data, j])] for j in range(scheme.counted)]
    low = np.stack([np.searchsorted(placed[o, j], placed[queries, j] - scheme.window, "left") for j, o in enumerate(orders)])
    high = np.stack([np.searchsorted(placed[o, j], placed[queries, j] + scheme.window, "right") for j, o in enumerate(orders)])
    widths = (high - low).sum(axis=0)
    part = np.cumsum(widths) // COLLISIONS
    for lo, hi in zip(*(np.searchsorted(part, np.unique(part), how) for how in ("left", "right")), strict=True):
        codes = []
        for order, first, count in zip(orders, low[:, lo:hi], high[:, lo:hi] - low[:, lo:hi], strict=True):
            at = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
            q, d = np.repeat(queries[lo:hi], count), order[at]
            once = (q < d) | (side[q] != 2)
            codes.append(q[once] * n + d[once])
        pairs, met = np.unique(np.concatenate(codes), return_counts=True)
        pairs = pairs[met >= scheme.least]
        yield pairs // n, pairs % n


def join_ends(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Make the ends of all edges (u, v) have one root in the forest ``parent``."""

    def roots(i: np.ndarray) -> np.ndarray:
        while ((up := parent[i]) != i).any():
            parent[i] = parent[up]
            i = up
        return i

    while len(u):
        u, v = roots(u), roots(v)
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))


def links_of(part: pa.Table, group: np.ndarray, scheme: Scheme) -> pa.RecordBatch:
    """(node, links, root) of the linked rows of whole groups: weight of the others, and the node that names its component here.

    Pairs that meet in an earlier table are left to that table.
    """
    nodes, weights, side, table = (np.array(part.column(c).to_numpy(), dtype=np.int64) for c in ("node", "weight", "side", "t"))
    units = unit_vectors(part.column("v").combine_chunks())
    cells = part.column("cells").combine_chunks().flatten().to_numpy().reshape(len(nodes), scheme.tables)
    links, parent, some = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes)), np.zeros(len(nodes), dtype=bool)
    earlier = np.arange(scheme.tables) < table[:, None]
    for q, d in colliding(units @ scheme.directions(units.shape[1])[:, : scheme.counted], group, side, scheme):
        for i in range(0, len(q), 50_000):
            u, v = q[i : i + 50_000], d[i : i + 50_000]
            good = (np.einsum("nd,nd->n", units[u], units[v]) >= scheme.cosine) & ~((cells[u] == cells[v]) & earlier[u]).any(axis=1)
            u, v = u[good], v[good]
            np.add.at(links, u, weights[v])
            np.add.at(links, v, weights[u])
            some[u] = some[v] = True
            join_ends(parent, u, v)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    some = np.flatnonzero(some)
    return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[parent[some]])], ["node", "links", "root"])


def linked(cells: DataFrame, scheme: Scheme, block_rows: int) -> DataFrame:
    """(node, links, root) from every cell. Crowded cells are split into blocks, each pair of which is one group."""
    key = ["size", "label", "t", "cell"]
    entered = cells.select("*", F.posexplode("cells").alias("t", "cell"))
    crowded = entered.groupBy(*key).count().where(F.col("count") > block_rows)
    crowded = cut_lineage(crowded.select(*key, F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")))
    rows = entered.join(crowded, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    side = lambda o: F.when(o == mine, 2).when(mine < o, 0).otherwise(1)
    dealt = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"), side(o).alias("side")))
    group = [*key, "i", "j"]
    dealt = rows.select("node", "weight", "v", "cells", *key, F.explode(dealt).alias("b")).select("node", "weight", "v", "cells", *key, "b.i", "b.j", "b.side")
    partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            """What is held but for its last group, which may go on in the next batch."""
            table = pa.Table.from_batches(held)
            new = np.zeros(table.num_rows, dtype=bool)
            for name in group:
                column = table.column(name).combine_chunks()
                codes = column.dictionary_encode().indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            stop = table.num_rows if last else int(starts[-1])
            sizes = table.column("size").to_numpy()
            cuts = [0]
            for s in [*starts[starts <= stop].tolist(), stop]:
                if s > cuts[-1] and (s - cuts[-1] >= ROWS or s == stop or sizes[s] != sizes[s - 1]):
                    cuts.append(s)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield links_of(table.slice(lo, hi - lo), np.cumsum(new[lo:hi]), scheme)
            held[:] = table.slice(stop).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= 2 * ROWS:
                    yield from whole(False)
        if held:
            yield from whole(True)

    return dealt.repartition(partitions, *group).sortWithinPartitions(*group).mapInArrow(settle, "node long, links long, root long")


def usable(v: Column) -> Column:
    """Whether a vector has a direction: numbers only, and not all zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, number) & F.exists(v, lambda x: x != 0)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, recall: float = 0.995, counted: int = 24, cell_rows: int = 128, block_rows: int = 2_048, seed: int = 3) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each vector; links join vectors of one label with at least ``cosine``.

    Vectors that are null, zero or have null or non-finite components, and vectors without a
    label, link with nothing, nor do vectors of different lengths. n_links counts the other
    rows linked directly; component_id is the smallest id reachable; kept says that it is
    the own one. Rows without an id take part and are never kept.

    Equal vectors of a label are one node with a weight. The signs of a few projections put
    a vector into one cell of each table. In a cell, the windows around a query's projections
    are runs of the sorted ones; the collisions in these runs are counted for each pair, and
    every pair with enough of them is verified in double precision. The number of tables and
    the count follow from ``recall``, which pairs exactly at the threshold have; closer ones
    have more. A cell has about ``cell_rows`` vectors at any size of the input; cells with
    more than ``block_rows`` are split in blocks, each pair of which is a group of its own,
    and their links are added up, so none is lost. A link is made in a cell and only its two
    ends' sums leave it, so large groups of near copies make no pairs.
    Only the largest label's size and the links' sums leave the executors.
    """
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    zero = F.lit(0).cast(kind)
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(vector_col, lambda x: x + zero).alias("v"))
    rows = rows.withColumn("good", F.col("label").isNotNull() & usable(F.col("v")))
    a, b = row_hash("label", "v")
    nodes = rows.where("good").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    nodes = cut_lineage(nodes.select("label", "v", "first", "weight", F.size("v").alias("size"), a.alias("_a"), b.alias("_b"))).withColumn("node", F.monotonically_increasing_id())
    largest = nodes.groupBy("label", "size").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    scheme = scheme_for(largest, cosine, recall, counted, cell_rows, seed)
    found = cut_lineage(linked(cells_of(nodes, scheme), scheme, block_rows))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    members = nodes.select("node", "first", "weight", "_a", "_b").join(links, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = members.groupBy("component").agg(F.min("first").alias("component_id"))
    named = cut_lineage(members.join(least, "component").select("_a", "_b", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    out = rows.select("id", "good", F.when(F.col("good"), a).alias("_a"), F.when(F.col("good"), b).alias("_b")).join(named, ["_a", "_b"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
