"""Vector search by inverted lists and product codes, in a stored index that grows by batches."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.vector import cosine
from larkspur.operators import retrieval
from larkspur.sources.files import cut_lineage

#: Most lists of an index, and vectors of the sample for each list.
MOST_LISTS, SAMPLE_EACH = 65536, 40
#: Bound of the sample that lists and codes are fitted on.
SAMPLE_ROWS = 1 << 18
#: Values of a byte of a code.
CODES = 256
#: Elements of a matrix of scores in a worker, vectors of a piece of a list, and queries that meet it at once.
AT_ONCE, PIECE_ROWS, BLOCK_ROWS = 1 << 24, 1 << 13, 1 << 9


def list_count(rows: int) -> int:
    """The square root of the number of vectors, from 1 to 65,536."""
    return min(MOST_LISTS, max(1, math.isqrt(rows)))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of an Arrow column of lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def listed(x: np.ndarray, kind: pa.DataType = pa.float32()) -> pa.Array:
    """A matrix as an Arrow column of lists."""
    x = np.ascontiguousarray(x)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<float>) of the rows with an id and a vector of some length; null, zero and non-finite vectors have no neighbours."""
    v = F.col(vector_col).cast("array<float>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def least_hashes(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of (id, v), those of the least hashes of their ids, which any row may have."""
    return df.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(rows)


def closeness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Larger for a nearer one of ``centres``."""
    return x @ centres.T - (centres**2).sum(axis=1) / 2


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the nearest of ``centres`` for each row, in bounded memory."""
    each = max(1, AT_ONCE // len(centres))
    parts = [np.argmax(closeness(x[i : i + each], centres), axis=1) for i in range(0, len(x), each)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def lloyd(sample: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after some rounds of k-means over the unit vectors of ``sample`` (id, v).

    In a round each task adds up its own vectors by nearest centre; sums meet by centre. Only
    centres come to the driver. A centre without vectors stays where it is.
    """
    centres, dim = first, first.shape[1]
    for _ in range(rounds):
        now = centres

        def added(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(now), np.zeros(len(now), dtype=np.int64)
            for batch in batches:
                x = unit(matrix(batch.column(0), dim))
                cells = nearest(x, now)
                np.add.at(sums, cells, x)
                counts += np.bincount(cells, minlength=len(now))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), listed(sums[some], pa.float64())], ["cell", "n", "s"])

        def mean(key: tuple, parts: pa.Table) -> pa.Table:
            total = matrix(parts.column("s"), dim).sum(axis=0) / sum(parts.column("n").to_pylist())
            return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "c": listed(total[None], pa.float64())})

        moved = sample.select("v").mapInArrow(added, "cell long, n long, s array<double>").groupBy("cell").applyInArrow(mean, "cell long, c array<double>").toArrow()
        centres = now.copy()
        if moved.num_rows:
            centres[moved.column("cell").to_numpy()] = matrix(moved.column("c"), dim)
    return centres


def local_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k-means over the rows of a bounded sample, from its first different rows."""
    _, order = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(order)[:k]].copy()
    for _ in range(rounds):
        cells = nearest(x, centres)
        counts = np.bincount(cells, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cells, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def codebooks_of(sample: DataFrame, centroids: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """For each of ``parts`` slices of what is left of a vector beside its centroid, 256 typical ones; slices are fitted by tasks of their own over the bounded sample."""
    dim = centroids.shape[1]
    wide = dim // parts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(1), dim))
            rest = x - centroids[nearest(x, centroids)]
            for p in range(parts):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), p, dtype=np.int32)), listed(rest[:, p * wide : (p + 1) * wide], pa.float64())], ["id", "part", "x"])

    def fitted(key: tuple, rows: pa.Table) -> pa.Table:
        x = matrix(rows.sort_by("id").column("x"), wide)
        found = local_means(x, CODES, rounds)
        full = np.concatenate([found, np.repeat(found[:1], CODES - len(found), axis=0)])
        return pa.table({"part": pa.array([key[0].as_py()] * CODES, pa.int32()), "code": pa.array(range(CODES), pa.int32()), "c": listed(full, pa.float64())})

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.select("id", "v").mapInArrow(cut, f"id {kind}, part int, x array<double>").groupBy("part").applyInArrow(fitted, "part int, code int, c array<double>").toArrow().sort_by([("part", "ascending"), ("code", "ascending")])
    return matrix(got.column("c"), wide).reshape(parts, CODES, wide)


@dataclass(frozen=True)
class Index:
    """A stored index: what it was fitted to, which is bounded, and where its lists lie."""

    path: str
    centroids: np.ndarray
    codebooks: np.ndarray
    probes: int
    batches: tuple[str, ...]

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def lists(self, spark: SparkSession) -> DataFrame:
        """(cell, id, v, code) of all batches."""
        return spark.read.parquet(*(f"{self.path}/lists/{b}" for b in self.batches))


def placed(df: DataFrame, centroids: np.ndarray, codebooks: np.ndarray) -> DataFrame:
    """(cell, id, v, code) of (id, v): the nearest list and a byte for each slice of the rest."""
    dim, parts = centroids.shape[1], len(codebooks)
    wide = dim // parts

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(1), dim))
            cells = nearest(x, centroids)
            rest = x - centroids[cells]
            codes = np.stack([nearest(rest[:, p * wide : (p + 1) * wide], codebooks[p]) for p in range(parts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "id", "v", "code"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "v").mapInArrow(encode, f"cell int, id {kind}, v array<float>, code binary")


def _write_batch(df: DataFrame, index: Index) -> Index:
    """``index`` with the vectors of ``df`` (id, v) as one more batch; it counts once the manifest of the batch is there."""
    name = uuid.uuid4().hex
    rows = placed(df, index.centroids, index.codebooks)
    rows.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.parquet(f"{index.path}/lists/{name}")
    spark = df.sparkSession
    n = spark.read.parquet(f"{index.path}/lists/{name}").count()
    spark.createDataFrame([(name, n)], "batch string, rows long").coalesce(1).write.json(f"{index.path}/manifest/{name}")
    return replace(index, batches=(*index.batches, name))


def build(df: DataFrame, id_col: str, vector_col: str, path: str, lists: int | None = None, parts: int = 16, recall: float = 0.97, k: int = 10, rounds: int = 6) -> Index:
    """Fit an index to ``df``, store it at ``path`` with all rows and return it.

    Lists and codes are fitted to a sample of 40 vectors a list, 262,144 at most; every
    vector is then put into a list. Vectors have one length, a multiple of ``parts``; null, zero and
    non-finite ones are left out. ``probes``, the lists a search looks at, is the least number that
    holds a share of ``recall`` of the ``k`` nearest of 64 vectors, found exactly over all rows.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    n = rows.count()
    if not n:
        raise ValueError("an index needs a vector")
    dim = rows.select(F.size("v")).first()[0]
    if dim % parts:
        raise ValueError(f"{parts} parts don't divide {dim} components")
    lists = lists or list_count(n)
    sample = cut_lineage(least_hashes(rows, min(SAMPLE_ROWS, SAMPLE_EACH * lists)))
    first = unit(matrix(least_hashes(sample, lists).toArrow().column("v"), dim))
    centroids = lloyd(sample, first, rounds)
    codebooks = codebooks_of(sample, centroids, parts, rounds)
    index = _write_batch(rows, Index(path, centroids, codebooks, 0, ()))
    index = replace(index, probes=probes_needed(spark, index, least_hashes(sample, 64), k, recall))
    _write_fit(spark, index)
    return index


def probes_needed(spark: SparkSession, index: Index, queries: DataFrame, k: int, recall: float) -> int:
    """How many lists hold a share of ``recall`` of the true neighbours of ``queries`` (id, v)."""
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near = retrieval.top_k(retrieval.scored(index.lists(spark), asked, "v", "s").select("query_id", "cell", "id", "s"), "s", "id", k, key=["query_id"])
    found = near.join(asked, "query_id").select("q", "cell").toArrow()
    if not found.num_rows:
        return 1
    scores = closeness(unit(matrix(found.column("q"), index.dim)), index.centroids)
    own = np.take_along_axis(scores, found.column("cell").to_numpy()[:, None], axis=1)
    ranks = np.sort((scores > own).sum(axis=1) + 1)
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)])


def _write_fit(spark: SparkSession, index: Index) -> None:
    cells = pa.table({"cell": pa.array(range(len(index.centroids)), pa.int32()), "c": listed(index.centroids, pa.float64())})
    parts, codes, _ = index.codebooks.shape
    books = pa.table({"part": pa.array(np.repeat(np.arange(parts), codes), pa.int32()), "code": pa.array(np.tile(np.arange(codes), parts), pa.int32()), "c": listed(index.codebooks.reshape(parts * codes, -1), pa.float64())})
    for name, held in (("centroids", cells), ("codebooks", books)):
        spark.createDataFrame(held).coalesce(1).write.parquet(f"{index.path}/{name}")
    said = json.dumps({"probes": index.probes, "dim": index.dim, "lists": len(index.centroids), "parts": parts})
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{index.path}/about")


def load(spark: SparkSession, path: str) -> Index:
    """The index stored at ``path``; lists without a manifest, left by a write that failed, don't count."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    cells = spark.read.parquet(f"{path}/centroids").toArrow().sort_by("cell")
    books = spark.read.parquet(f"{path}/codebooks").toArrow().sort_by([("part", "ascending"), ("code", "ascending")])
    batches = [r.batch for r in spark.read.json(f"{path}/manifest/*", schema="batch string, rows long").orderBy("batch").collect()]
    codebooks = matrix(books.column("c"), about["dim"] // about["parts"]).reshape(about["parts"], CODES, -1)
    return Index(path, matrix(cells.column("c"), about["dim"]), codebooks, about["probes"], tuple(batches))


def add(index: Index, df: DataFrame, id_col: str, vector_col: str) -> Index:
    """``index`` with more rows, by the lists and codes it has; what is stored isn't touched."""
    return _write_batch(usable(df, id_col, vector_col), index)


def stored_vectors(spark: SparkSession, index: Index, ids: DataFrame) -> DataFrame:
    """(query_id, q): vectors of the index as queries, by id."""
    return index.lists(spark).join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def met(index: Index, queries: DataFrame, probes: int, columns: tuple[str, ...], score: Callable[[np.ndarray, pa.Table, int], np.ndarray], k: int) -> DataFrame:
    """(query_id, cell, id, s): the ``k`` best of each query by ``score`` over the lists it probes.

    Lists are cut into pieces and the queries of a list into blocks, by counts, so neither a
    full list nor one that all queries probe lands in one task. ``score`` gets unit queries, the rows of
    a piece and the number of its list; the best of a query leave a piece, then meet.
    """
    spark, dim, centroids = queries.sparkSession, index.dim, index.centroids
    asked = usable(queries, "query_id", "q")
    kind = asked.schema["id"].dataType.simpleString()
    lists = index.lists(spark)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = max(1, AT_ONCE // len(centroids))
        for batch in batches:
            for i in range(0, batch.num_rows, each):
                part = batch.slice(i, each)
                scores = closeness(unit(matrix(part.column(1), dim)), centroids)
                cells = np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)
                at = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(cells.ravel())], ["query_id", "q", "cell"])

    probed = cut_lineage(asked.mapInArrow(probing, f"query_id {kind}, q array<float>, cell int"))
    pieces = lists.groupBy("cell").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces"))
    blocks = probed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    bounds = cut_lineage(pieces.join(blocks, "cell"))  # a row for each list, MOST_LISTS at most
    spread = lists.select("cell", "id", *columns).join(F.broadcast(bounds), "cell")
    left = spread.withColumn("piece", F.pmod(F.xxhash64("id"), "pieces")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).drop("pieces", "blocks")  # keys of one type on both sides, as others hash apart
    asking = probed.join(F.broadcast(bounds), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1))).drop("pieces", "blocks")

    def best(key: tuple, rows: pa.Table, who: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")  # of equal scores the smaller ids are taken
        found = score(unit(matrix(who.column("q"), dim)), rows, key[0].as_py()) if rows.num_rows and who.num_rows else np.zeros((who.num_rows, 0))
        take = np.argsort(-found, axis=1, kind="stable")[:, :k]
        q = np.repeat(np.arange(len(take)), take.shape[1])
        cells = np.full(len(q), key[0].as_py(), dtype=np.int32)
        return pa.table({"query_id": who.column("query_id").take(pa.array(q)), "cell": pa.array(cells), "id": rows.column("id").take(pa.array(take.ravel())), "s": pa.array(found[q, take.ravel()])})

    key = ["cell", "piece", "block"]
    own = lists.schema["id"].dataType.simpleString()
    scored = left.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(best, f"query_id {kind}, cell int, id {own}, s double")
    return retrieval.top_k(scored, "s", "id", k, key=["query_id"])


def cosines(dim: int) -> Callable[[np.ndarray, pa.Table, int], np.ndarray]:
    return lambda q, rows, cell: q @ unit(matrix(rows.column("v"), dim)).T


def by_tables(index: Index) -> Callable[[np.ndarray, pa.Table, int], np.ndarray]:
    """Approximate cosines from codes: a table of products of each query with all typical slices, looked up byte by byte."""
    centroids, codebooks = index.centroids, index.codebooks
    parts, _, wide = codebooks.shape

    def score(q: np.ndarray, rows: pa.Table, cell: int) -> np.ndarray:
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.uint8).reshape(-1, parts)
        out = np.repeat((q @ centroids[cell])[:, None], len(codes), axis=1)
        for p in range(parts):
            out += (q[:, p * wide : (p + 1) * wide] @ codebooks[p].T)[:, codes[:, p]]
        return out

    return score


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest by cosine of each of ``queries`` (query_id, q) within the lists that it probes.

    ``probes`` is the index's own number, or any other; all lists make the search exact. Ties go to
    the smaller id. Queries without a direction (null, zero or non-finite) find nothing.
    """
    probes = min(probes or index.probes, len(index.centroids))
    return ordered(met(index, queries, probes, ("v",), cosines(index.dim), k).select("query_id", "id", F.col("s").alias("similarity")), k)


def search_codes(index: Index, queries: DataFrame, k: int, probes: int | None = None, shortlist: int = 10) -> DataFrame:
    """Like ``search``, but lists are scanned by their codes alone; the ``shortlist`` times ``k`` best of a query are then ranked by their vectors."""
    probes = min(probes or index.probes, len(index.centroids))
    spark = queries.sparkSession
    short = met(index, queries, probes, ("code",), by_tables(index), shortlist * k).select("query_id", "id")
    vectors = index.lists(spark).select("id", "v")
    both = short.join(vectors, "id").join(usable(queries, "query_id", "q").select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return ordered(both.select("query_id", "id", cosine(F.col("v"), F.col("q")).alias("similarity")), k)


def ordered(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query with their ranks."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
