"""Queries of approximate vector search over whole tables; a query set is every hundredth row against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import neighbour_graph as graphs
from larkspur.operators import vector_index as vi
from larkspur.plans.registry import query, table
from larkspur.plans.stores import new_folder


def every_hundredth(e: DataFrame) -> DataFrame:
    return e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("int").alias("rank"))


@query()
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest by inverted lists, as many probed as the recall asks for."""
    e = table(spark, sf_dir, "embeddings")
    index = vi.build(e, "vec_id", "embedding", new_folder(spark))
    return shown(vi.search(index, every_hundredth(e), 10))


@query()
def ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest by codes of 16 bytes within the lists, ranked by the vectors of a shortlist."""
    e = table(spark, sf_dir, "embeddings")
    index = vi.build(e, "vec_id", "embedding", new_folder(spark), recall=0.98)
    return shown(vi.search_codes(index, every_hundredth(e), 10, shortlist=12))


_EXACT = """
    SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id)::INTEGER AS rank
    FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10"""


@query(_EXACT)
def index_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of two thirds of the vectors, to which the rest is added; loaded again and searched by id in all lists, it finds what a search of all rows finds."""
    e = table(spark, sf_dir, "embeddings")
    path = new_folder(spark)
    index = vi.build(e.where(F.col("vec_id") % 3 != 0), "vec_id", "embedding", path)
    vi.add(index, e.where(F.col("vec_id") % 3 == 0), "vec_id", "embedding")
    index = vi.load(spark, path)
    queries = vi.stored_vectors(spark, index, e.select("vec_id").where("vec_id % 100 = 0"))
    return shown(vi.search(index, queries, 10, probes=len(index.centroids)))


@query()
def neighbour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours of every vector, by refining lists through neighbours of neighbours."""
    graph = graphs.neighbour_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=10)
    return graphs.neighbour_ids(graph).withColumnRenamed("id", "vec_id")


@query()
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest by a walk along the neighbour graph."""
    e = table(spark, sf_dir, "embeddings")
    graph = graphs.neighbour_graph(e, "vec_id", "embedding", k=16)
    return shown(graphs.graph_search(graphs.to_nodes(e, "vec_id", "embedding"), graph, every_hundredth(e), 10, beam=100))
