"""A graph of nearest neighbours, from trees of random cuts and through neighbours of neighbours, and search along it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import exact_search as exact
from larkspur.operators.vector_index import least_hashes, matrix, unit, usable
from larkspur.sources.files import cut_lineage

#: Groups handled together.
GROUPS_AT_ONCE = 256
#: Vectors of a leaf, vectors of the sample for each leaf, and most trees.
LEAF_ROWS, LEAF_SAMPLE, MOST_TREES = 4096, 128, 64
#: Share of the nearest that trees bring together, and one that needs no further rounds.
SHARE, ENOUGH = 0.96, 0.92
#: Most neighbours of a node in one row of the graph that is searched.
EDGES = 64
#: Members whose similarities a worker holds at once, parts of a row that give its bar, and entries of lists merged together.
STRIP, PARTS, ENTRIES = 128, 128, 1 << 20


class Forest(NamedTuple):
    """Trees of the same depth. At a level of a tree all nodes project on one direction, each cuts at its own bar."""

    directions: np.ndarray
    bars: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x`` in each tree, from 0."""
        trees, depth, dim = self.directions.shape
        at = (x @ self.directions.reshape(-1, dim).T).reshape(len(x), trees, depth)
        node = np.ones((len(x), trees), dtype=np.int64)
        for level in range(depth):
            node = 2 * node + (at[:, :, level] > self.bars[np.arange(trees), node])
        return node - (1 << depth)


def planted(sample: np.ndarray, depth: int, trees: int) -> Forest:
    """Trees of random directions that cut a bounded sample at its medians."""
    directions = np.random.default_rng(7).normal(size=(trees, depth, sample.shape[1]))
    bars = np.zeros((trees, 1 << depth))
    for t in range(trees):
        node = np.ones(len(sample), dtype=np.int64)
        for level in range(depth):
            at = sample @ directions[t, level]
            order = np.lexsort((at, node))
            some, starts, counts = np.unique(node[order], return_index=True, return_counts=True)
            bars[t, some] = at[order[starts + (counts - 1) // 2]]
            node = 2 * node + (at > bars[t, node])
    return Forest(directions, bars)


def fitted(nodes: DataFrame, depth: int, k: int) -> tuple[Forest, float]:
    """Trees enough to bring ``SHARE`` of the ``k`` nearest of 64 vectors, found exactly, into a leaf with them, and the share that they do."""
    sample = least_hashes(nodes, LEAF_SAMPLE << depth).toArrow().column("v")
    dim = len(sample[0])
    forest = planted(unit(matrix(sample, dim)), depth, MOST_TREES)
    asked = least_hashes(nodes, 64).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near = exact.search(nodes, asked, "id", k + 1, vector="v").where("id <> query_id")
    pairs = near.join(nodes, "id").join(asked, "query_id").select("v", "q").toArrow()
    met = forest.leaves(unit(matrix(pairs.column("v"), dim))) == forest.leaves(unit(matrix(pairs.column("q"), dim)))
    share = np.logical_or.accumulate(met, axis=1).mean(axis=0)
    trees = min(int(np.argmax(share >= SHARE)) + 1 if share[-1] >= SHARE else MOST_TREES, MOST_TREES)
    return Forest(forest.directions[:trees], forest.bars[:trees]), float(share[trees - 1])


def nearest_others(x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, cosine) of about the ``keep`` nearest other rows of each row of unit vectors; of equal ones the first.

    Single precision and the maxima of parts of a row find a bar that ``keep`` others reach; what reaches it is computed in double.
    """
    keep, small = min(keep, len(x) - 1), x.astype(np.float32)
    parts = min(max(PARTS, 4 * keep), len(x))
    each, found = len(x) // parts, []
    room, reached = np.empty((STRIP, len(x)), dtype=np.float32), np.empty((STRIP, len(x)), dtype=bool)  # fresh ones for each strip cost more than the product
    for start in range(0, len(x) if keep > 0 else 0, STRIP):
        some = small[start : start + STRIP]
        s, own = np.matmul(some, small.T, out=room[: len(some)]), np.arange(len(some))
        s[own, start + own] = -2
        top = s[:, : parts * each].reshape(len(s), each, parts).max(axis=1)
        bar = np.partition(top, parts - keep, axis=1)[:, parts - keep, None]
        row, other = np.divmod(np.flatnonzero(np.greater_equal(s, bar, out=reached[: len(some)])), len(x))
        if len(row) > 16 * keep * len(s):  # many equal ones
            row, other = np.repeat(own, keep), np.argpartition(-s, keep - 1, axis=1)[:, :keep].ravel()
        value = (x[start + row] * x[other]).sum(axis=1)
        order = np.lexsort((other, -value, row))
        row, other, value = row[order], other[order], value[order]
        best = np.arange(len(row)) - np.searchsorted(row, own)[row] < keep
        found.append((start + row[best], other[best], value[best]))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, np.zeros(0))


def lists_by(column: pa.Array, starts: np.ndarray) -> pa.ListArray:
    """``column`` cut at ``starts``."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(column)).astype(np.int32)), column)


def cuts(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, ends) of equal ``groups``."""
    order = np.argsort(groups, kind="stable")
    sorted_ = groups[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(groups) else np.zeros(0, dtype=np.int64)
    return order, starts, np.append(starts, len(groups))[1:]


def met_in_leaves(nodes: DataFrame, forest: Forest, n: int, keep: int) -> DataFrame:
    """(id, other, s): the ``keep`` nearest others of each of ``nodes`` (id, v) among those that share a leaf with it.

    Vectors go packed to the leaves of all trees, and what they find goes packed to parts of the ids, where lists are merged.
    Leaves of more than twice ``LEAF_ROWS``, which many equal vectors give, are dealt into pieces.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    trees, depth, dim = forest.directions.shape
    width = 1 << depth
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = nodes.withColumn("h", F.xxhash64("id", F.lit(5)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(trees * width, dtype=np.int64)
        for batch in batches:
            leaf = forest.leaves(unit(matrix(batch.column(0), dim))) + width * np.arange(trees)
            n += np.bincount(leaf.ravel(), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["leaf", "n"])

    sizes = np.zeros(trees * width, dtype=np.int64)
    known = nodes.select("v").mapInArrow(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    sizes[known.column("leaf").to_numpy()] = known.column("n").to_numpy()
    pieces = np.maximum(1, -(-sizes // (2 * LEAF_ROWS)))
    first = np.cumsum(pieces) - pieces
    groups, buckets = int(pieces.sum()), max(1, -(-n * trees * keep // ENTRIES))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, h = matrix(batch.column(1), dim), batch.column(2).to_numpy()
            leaves, raw = forest.leaves(unit(x)), x.astype(np.float32)
            for t in range(trees):
                leaf = leaves[:, t] + t * width
                mixed = (h.astype(np.uint64) * np.uint64(2 * t + 1)) >> np.uint64(24)
                g = first[leaf] + (mixed % pieces[leaf].astype(np.uint64)).astype(np.int64)
                order, starts, ends = cuts(g)
                own, v, hs = batch.column(0).take(pa.array(order)), raw[order], h[order]
                packed = [pa.array([a[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for a in (hs, v)]
                yield pa.RecordBatch.from_arrays([pa.array(g[order[starts]]), lists_by(own, starts), *packed], ["g", "ids", "h", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].values
                ids = part.field("ids").flatten()
                order = pc.sort_indices(ids)
                ids, at = ids.take(order), order.to_numpy()
                h = np.frombuffer(b"".join(part.field("h").to_pylist()), dtype=np.int64)[at]
                x = np.frombuffer(b"".join(part.field("v").to_pylist()), dtype=np.float32).reshape(-1, dim)[at]
                row, other, s = nearest_others(unit(x.astype(np.float64)), keep)
                b = ((h.astype(np.uint64) >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)[row]
                order, starts, ends = cuts(b)
                mine, theirs, s = ids.take(pa.array(row[order])), ids.take(pa.array(other[order])), s[order]
                packed = pa.array([s[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(b[order[starts]]), lists_by(mine, starts), lists_by(theirs, starts), packed], ["b", "ids", "others", "s"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].values
                ids, others = part.field("ids").flatten(), part.field("others").flatten()
                s = np.frombuffer(b"".join(part.field("s").to_pylist()), dtype=np.float64)
                a, o = ids.to_numpy(zero_copy_only=False), others.to_numpy(zero_copy_only=False)
                order = np.lexsort((o, -s, a))
                a, o = a[order], o[order]
                once = np.append(True, (a[1:] != a[:-1]) | (o[1:] != o[:-1]))[: len(a)]
                order, a = order[once], a[once]
                starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
                best = pa.array(order[np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) < keep])
                yield pa.RecordBatch.from_arrays([ids.take(best), others.take(best), pa.array(s).take(best)], ["id", "other", "s"])

    def together(df: DataFrame, key: str, most: int) -> DataFrame:
        """The packed rows of each ``key`` in one row."""
        tasks = max(min(partitions, most), -(-most // 32))
        return df.repartition(tasks, key).groupBy(key).agg(F.collect_list(F.struct(*(c for c in df.columns if c != key))).alias("_b")).select("_b")

    leaves = together(hashed.select("id", "v", "h").mapInArrow(dealt, f"g long, ids array<{kind}>, h binary, v binary"), "g", groups)
    found = leaves.mapInArrow(meet, f"b long, ids array<{kind}>, others array<{kind}>, s binary")
    return together(found, "b", buckets).mapInArrow(merged, f"id {kind}, other {kind}, s double")


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables of some hundred whole groups from batches sorted by column ``key``; a group is bounded, and one that goes on in the next batch waits for it."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        keys = now.column(key).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.zeros(1, dtype=np.int64)
        for i in range(0, len(starts) - 1, GROUPS_AT_ONCE):
            end = starts[min(i + GROUPS_AT_ONCE, len(starts) - 1)]
            yield now.slice(starts[i], end - starts[i])
        rest = now.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def met_in_groups(members: DataFrame, dim: int, keep: int) -> DataFrame:
    """(id, other, s): in each group (column g) the ``keep`` nearest others of each member (id, v) that are nearer than its ``bar``.

    Groups are bounded. They are sorted together by Spark and multiplied as stacks of small matrices.
    """
    kind = members.schema["id"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            g = table.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            group = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))
            place = np.arange(len(g)) - starts[group]
            wide = int(place.max()) + 1
            x = np.zeros((len(starts), wide, dim))
            x[group, place] = unit(matrix(table.column(2), dim))
            bar = np.full((len(starts), wide), np.inf)
            bar[group, place] = table.column(3).to_numpy()
            there = np.isfinite(bar) | (bar == -np.inf)
            s = x @ x.transpose(0, 2, 1)
            s[~(there[:, None, :] & there[:, :, None])] = -np.inf
            s[:, np.arange(wide), np.arange(wide)] = -np.inf
            most = min(keep, wide)
            best = np.argpartition(-s, most - 1, axis=2)[:, :, :most]
            value = np.take_along_axis(s, best, axis=2)
            a, b, c = np.nonzero((value > bar[:, :, None]) & (value > -np.inf))
            one, other = starts[a] + b, starts[a] + best[a, b, c]
            ids = table.column(1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(one)).combine_chunks(), ids.take(pa.array(other)).combine_chunks(), pa.array(value[a, b, c])], ["id", "other", "s"])

    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("g", "id", "v", "bar").repartition(partitions, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(meet, f"id {kind}, other {kind}, s double")


def best_lists(edges: DataFrame, width: int) -> DataFrame:
    """The ``width`` best others of each id, each once."""
    once = edges.groupBy("id", "other").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "other"))
    return once.withColumn("_n", rank).where(F.col("_n") <= width).drop("_n")


def neighbour_graph(df: DataFrame, id_col: str, vector_col: str, k: int = 10, width: int = 30, rounds: int = 8, settled: float = 0.001) -> DataFrame:
    """(id, other, s, rank): the ``k`` nearest neighbours of each vector by cosine, nearly all of them.

    Lists start in the leaves of trees of random cuts, as many as bring together ``SHARE`` of
    the nearest of a sample, ``MOST_TREES`` at most. Where these bring together less than ``ENOUGH``, lists of ``width`` are
    refined: in a round every vector brings the members of its list, and as many that have it in
    theirs, together; of each pair that meets, the nearer ones go into lists. So trees and rounds
    take bounded groups, whatever n is. Rounds end when fewer than ``settled`` of all places in lists change.

    Ids are unique. Null, zero and non-finite vectors have no list and are in none; a vector
    alone has no neighbour. Equal vectors are neighbours like any others. Ties go to the smaller id.
    """
    nodes = cut_lineage(usable(df, id_col, vector_col))
    n = nodes.count()
    if n < 2:
        kind = nodes.schema["id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"id {kind}, other {kind}, s double, rank int")
    dim = nodes.select(F.size("v")).first()[0]
    depth = max(0, round(np.log2(n / LEAF_ROWS)))
    forest, share = fitted(nodes, depth, k) if depth else (Forest(np.zeros((1, 0, dim)), np.zeros((1, 1))), 1.0)
    width = k if share >= ENOUGH else max(width, k)
    lists = cut_lineage(met_in_leaves(nodes, forest, n, width))
    if share >= ENOUGH:
        rounds = 0
    for _ in range(rounds):
        bars = lists.groupBy("id").agg(F.when(F.count("*") >= width, F.min("s")).otherwise(float("-inf")).alias("bar"))
        known = nodes.join(bars, "id", "left").select("id", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
        back = lists.withColumn("_n", F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("id", "other"), "id"))).where(F.col("_n") <= width)
        pairs = lists.select(F.col("id").alias("g"), F.col("other").alias("id")).union(back.select(F.col("other").alias("g"), "id")).union(nodes.select(F.col("id").alias("g"), "id")).distinct()
        found = met_in_groups(pairs.join(known, "id"), dim, width)
        now = cut_lineage(best_lists(lists.unionByName(found), width))
        changed = now.join(lists, ["id", "other"], "left_anti").count()
        lists = now
        if changed < settled * n * width:
            break
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "other"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k)


def graph_search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, k: int = 10, beam: int = 64, entries: int = 32, rounds: int = 20) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest of each of ``queries`` (query_id, q) that a walk along ``graph`` (id, other) meets.

    A walk starts at ``entries`` nodes, those of the least hashes, and looks at the neighbours, in
    both directions, of the ``beam`` best nodes met, until these have all been looked at. All queries walk together:
    a round is a join of their new nodes with the graph and the vectors, and ends in a checkpoint of the
    best nodes alone: one that isn't among these never is again, so it may be met twice.
    """
    both = graph.select("id", "other").union(graph.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    piece = ((F.row_number().over(Window.partitionBy("id").orderBy("other")) - 1) / EDGES).cast("int")
    edges = cut_lineage(both.withColumn("_piece", piece).groupBy("id", "_piece").agg(F.collect_list("other").alias("others")).drop("_piece"))
    nodes = cut_lineage(nodes)
    asked = cut_lineage(usable(queries, "query_id", "q").select(F.col("id").alias("query_id"), F.col("v").alias("q")))
    kinds = {f.name: f.dataType.simpleString() for f in (*nodes.schema.fields, *asked.schema.fields) if f.name.endswith("id")}
    one = asked.select(F.size("q")).first()
    dim, each = one[0] if one else 1, asked.count()

    def small(df: DataFrame, rows: int, width: int) -> DataFrame:
        return F.broadcast(df) if rows * width <= exact.MOST_BROADCAST else df

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, q = matrix(batch.column(2), dim), matrix(batch.column(3), dim)
            s = np.round((x * q).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (q * q).sum(axis=1)), 12)
            some = pa.array(np.flatnonzero(s >= batch.column(4).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(s).take(some), pa.array(np.ones(len(some), dtype=bool))], ["query_id", "id", "similarity", "fresh"])

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.select("query_id", "id", "v", "q", "bar").mapInArrow(scored, f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double, fresh boolean")

    def kept(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= beam)

    start = cut_lineage(least_hashes(nodes, entries))
    met = cut_lineage(kept(near(start.crossJoin(asked).withColumn("bar", F.lit(float("-inf"))))))  # a bounded number of nodes for each query
    for _ in range(rounds):
        fresh = met.where("fresh").count()
        if not fresh:
            break
        front = met.where("fresh").select("query_id", "id")
        reached = edges.join(small(front, fresh, 64), "id").select("query_id", F.explode("others").alias("id")).distinct().join(met.select("query_id", "id"), ["query_id", "id"], "left_anti")
        bars = met.groupBy("query_id").agg(F.when(F.count("*") >= beam, F.min("similarity")).otherwise(float("-inf")).alias("bar"))
        new = near(reached.join(nodes, "id").join(small(asked.join(bars, "query_id"), each, dim * 8), "query_id"))
        met = cut_lineage(kept(met.select("query_id", "id", "similarity", F.lit(False).alias("fresh")).unionByName(new)))
    return met.where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")


def to_nodes(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) as ``graph_search`` takes them."""
    return usable(df, id_col, vector_col)


def neighbour_ids(graph: DataFrame) -> DataFrame:
    """(id, neighbours): a row for each vector with its list in order."""
    pair: Column = F.struct("rank", "other")
    return graph.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["other"]).alias("neighbours"))
