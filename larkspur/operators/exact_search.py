"""Exact search of many queries against all rows, by vectors or sets: blocks of queries meet pieces of rows as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.retrieval import top_k
from larkspur.sources.files import cut_lineage

#: Rows of a piece, queries of a block, and queries whose scores a worker holds at once.
PIECE_ROWS, BLOCK_ROWS, STRIP = 2048, 1024, 128
#: Bytes of query vectors that are sent to all executors; more meet the pieces without.
MOST_BROADCAST = 64 << 20


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    scaled = x * 10.0**digits
    whole = np.trunc(scaled)
    with np.errstate(invalid="ignore"):
        return np.where(np.isinf(scaled), scaled, whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 10.0**digits


def comparable(vector: Column, dim: int) -> Column:
    """``vector``, or zeros, which are similar to nothing, where it or a component is null or it has another length."""
    fine = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull())
    return F.when(fine, vector).otherwise(F.array_repeat(F.lit(0.0), dim).cast("array<float>"))


def packed(df: DataFrame, key: str, most: int, rows: int, members: Column, name: str) -> DataFrame:
    """The ``rows`` rows of ``df`` in groups of about ``most``, each an array ``name`` of ``members``; groups are dealt to tasks by number, as their work isn't in their bytes."""
    groups = max(1, -(-rows // most))
    tasks = min(groups, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = df.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(groups)))
    return numbered.repartition(tasks, "_p").groupBy("_p").agg(F.collect_list(members).alias(name)).select(name)


def matrix(structs: pa.StructArray, name: str, dim: int) -> np.ndarray:
    return structs.field(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def numbers(structs: pa.StructArray, name: str) -> np.ndarray:
    return structs.field(name).to_numpy(zero_copy_only=False)


def groups_of(structs: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """The different groups of rows, null being one, and the place there of each row's."""
    coded = structs.field("g").dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy()


def best_places(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest of each row; of equal ones the first columns. NaN is largest, as Spark sorts it."""
    key = np.where(np.isnan(score), np.inf, score)
    if score.shape[1] <= k:
        return np.nonzero(key > -np.inf)
    bar = np.partition(key, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    above = key > bar
    level = (key == bar) & (bar > -np.inf)
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level)


def similarities(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``q`` with each of ``x``; 0 where one has no length."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        size = np.sqrt(np.outer((q * q).sum(axis=1), (x * x).sum(axis=1)))
        return np.where((size > 0) | np.isnan(size), (q @ x.T) / size, 0.0)


def search(
    df: DataFrame, queries: DataFrame, item: str, k: int | None = None, factor: Column | float = 1.0, offset: Column | float = 0.0, digits: int | None = 6,
    least: float | None = None, above: float | None = None, group: str | None = None, vector: str = "embedding", name: str = "score",
) -> DataFrame:
    """(query_id, item, ``name``): cosine times ``factor`` plus ``offset`` of each row of ``df`` for each of ``queries`` (query_id, q).

    ``factor`` and ``offset`` are columns of ``df``. Pairs with a cosine of ``least`` or more, or ``above`` a
    bound, count. Of each query the ``k`` best by the rounded score stay, then by ``item``; None
    keeps all. With ``group``, a score is over the best one of its query and group where that is positive.

    Queries are packed into blocks and rows into pieces, which a worker multiplies as matrices;
    the ``k`` best of a query leave a piece before anything is exchanged. Vectors have the length of the
    queries'; see ``comparable`` for others. A query and group have one best score, so groups are few.
    """
    one = queries.where("q IS NOT NULL").select(F.size("q")).first()
    dim, asked, rows = one[0] if one else 1, queries.count(), df.count()
    kinds = {f.name: f.dataType.simpleString() for f in (*df.schema.fields, *queries.schema.fields)}
    double = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    member = F.struct(F.col(item).alias("id"), double(factor).alias("f"), double(offset).alias("o"), (F.col(group) if group else F.lit(0)).alias("g"), "v")
    pieces = packed(df.withColumn("v", comparable(F.col(vector), dim)), item, PIECE_ROWS, rows, member, "_rows")

    def blocks(own: DataFrame, member: Column) -> DataFrame:
        each = packed(own, "query_id", BLOCK_ROWS, asked, member, "_qs")
        return F.broadcast(each) if asked * dim * 8 <= MOST_BROADCAST else each

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, pa.StructArray, np.ndarray]]:
        """(rows by id, some queries, their scores): -inf for pairs that don't count."""
        for batch in batches:
            for i in range(batch.num_rows):
                part, who = batch.column(0)[i].values, batch.column(1)[i].values
                part = part.take(pc.sort_indices(part.field("id")))
                x, q, f, o = matrix(part, "v", dim), matrix(who, "q", dim), numbers(part, "f"), numbers(part, "o")
                for start in range(0, len(q), STRIP):
                    sim = similarities(q[start : start + STRIP], x)
                    out = np.full(sim.shape, False)
                    if least is not None:
                        out |= sim < least
                    if above is not None:
                        out |= sim <= above
                    score = sim * f + o
                    score[out] = -np.inf
                    yield part, who.slice(start, STRIP), score

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, who, score in strips(batches):
            keys, codes = groups_of(part)
            for n in range(len(keys)):
                top = score[:, codes == n].max(axis=1)
                some = np.flatnonzero(top > -np.inf)
                yield pa.RecordBatch.from_arrays([who.field("query_id").take(pa.array(some)), keys.take(pa.array(np.full(len(some), n))), pa.array(top[some])], ["query_id", "g", "m"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, who, score in strips(batches):
            if group:
                keys, codes = groups_of(part)
                best = np.ones((len(who), len(keys)))
                place = {g: n for n, g in enumerate(keys.to_pylist())}
                for row, tops in enumerate(who.field("tops").to_pylist()):
                    for t in tops or ():
                        if t["g"] in place and t["m"] > 0:
                            best[row, place[t["g"]]] = t["m"]
                score = score / best[:, codes]
            if digits is not None:
                score = rounded(score, digits)
            at, places = best_places(score, k or score.shape[1])
            yield pa.RecordBatch.from_arrays([who.field("query_id").take(pa.array(at)), part.field("id").take(pa.array(places)), pa.array(score[at, places])], ["query_id", item, name])

    asking = queries.select("query_id", comparable(F.col("q"), dim).alias("q"))
    fields = ["query_id", "q"]
    if group:
        tops = pieces.crossJoin(blocks(asking, F.struct(*fields))).mapInArrow(maxima, f"query_id {kinds['query_id']}, g {kinds[group]}, m double")
        best = tops.groupBy("query_id", "g").agg(F.max("m").alias("m")).groupBy("query_id").agg(F.collect_list(F.struct("g", "m")).alias("tops"))
        asking, fields = asking.join(best, "query_id", "left"), [*fields, "tops"]
    pairs = pieces.crossJoin(blocks(asking, F.struct(*fields))).mapInArrow(found, f"query_id {kinds['query_id']}, {item} {kinds[item]}, {name} double")
    return pairs if k is None else top_k(pairs, name, item, k, key=["query_id"])


def set_search(df: DataFrame, queries: DataFrame, item: str, k: int, least: float, measure: str = "jaccard", digits: int = 6, scale: float = 1.0, members: str = "members", name: str = "similarity") -> DataFrame:
    """(query_id, item, ``name``): the ``k`` rows of ``df`` whose sets (array<string>) are most similar to each of ``queries`` (query_id, q), if ``least`` or more.

    Similarity is ``scale`` times the shared members over all of both (jaccard) or over those of the
    smaller set (overlap), rounded; ties go to the smaller item; empty and null sets are similar to nothing.
    Shared members are counted by a product of matrices over the members of a few queries,
    so a member that all have costs no more than another; the ``k`` best of a query leave a piece.
    Equal sets meet once: of rows with one set only the ``k`` least items can be among the best, and
    queries with one set have the same best, so work is that of the different sets.
    """
    if measure not in ("jaccard", "overlap"):
        raise ValueError("measure is jaccard or overlap")
    kinds = {f.name: f.dataType.simpleString() for f in (*df.schema.fields, *queries.schema.fields)}
    different = lambda c: F.array_sort(F.array_compact(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))))
    least_first = F.row_number().over(Window.partitionBy("m").orderBy(item))
    kept = cut_lineage(df.select(item, different(members).alias("m")).withColumn("_n", least_first).where(F.col("_n") <= k).drop("_n"))
    asking = queries.select("query_id", different("q").alias("m"))
    sets = cut_lineage(asking.groupBy("m").agg(F.min("query_id").alias("query_id")))
    rows, (asked, size) = kept.count(), sets.agg(F.count("*"), F.sum(F.length(F.array_join("m", ",")))).first()
    size = size or 0
    pieces = packed(kept, item, PIECE_ROWS, rows, F.struct(F.col(item).alias("id"), "m"), "_rows")
    blocks = packed(sets, "query_id", BLOCK_ROWS, asked, F.struct("query_id", "m"), "_qs")
    blocks = F.broadcast(blocks) if size <= MOST_BROADCAST else blocks

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, who = batch.column(0)[i].values, batch.column(1)[i].values
                part = part.take(pc.sort_indices(part.field("id")))
                own = part.field("m")
                sizes, words = pc.list_value_length(own).to_numpy(), own.flatten()
                at = np.repeat(np.arange(len(part)), sizes)
                for start in range(0, len(who), STRIP):
                    some = who.slice(start, STRIP)
                    wanted = some.field("m")
                    lengths = pc.list_value_length(wanted).to_numpy()
                    coded = wanted.flatten().dictionary_encode()
                    ours = np.zeros((len(some), len(coded.dictionary)), dtype=np.float32)
                    ours[np.repeat(np.arange(len(some)), lengths), coded.indices.to_numpy()] = 1
                    places = pc.index_in(words, coded.dictionary)
                    known = np.asarray(places.is_valid())
                    theirs = np.zeros((len(part), len(coded.dictionary)), dtype=np.float32)
                    theirs[at[known], places.drop_null().to_numpy()] = 1
                    shared = (ours @ theirs.T).astype(np.float64)
                    both = (lengths[:, None] + sizes) - shared if measure == "jaccard" else np.minimum(lengths[:, None], sizes)
                    score = rounded(scale * shared / np.maximum(both, 1), digits)
                    score[(score < least) | (lengths[:, None] == 0) | (sizes == 0)] = -np.inf
                    q, x = best_places(score, k)
                    yield pa.RecordBatch.from_arrays([some.field("query_id").take(pa.array(q)), part.field("id").take(pa.array(x)), pa.array(score[q, x])], ["query_id", item, name])

    pairs = pieces.crossJoin(blocks).mapInArrow(found, f"query_id {kinds['query_id']}, {item} {kinds[item]}, {name} double")
    best = top_k(pairs, name, item, k, key=["query_id"]).withColumnRenamed("query_id", "_first")
    own = asking.join(sets.withColumnRenamed("query_id", "_first"), "m").select("query_id", "_first")
    return own.join(best, "_first").select("query_id", item, name)
