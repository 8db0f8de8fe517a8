"""Queries of links; sources stand for documents, texts for chunks, benchmark items and vectors for images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import linking as ops
from larkspur.plans.registry import query, table


def page_of() -> Column:
    """A page holds a hundred vectors of all documents, so what is on one is bounded, however many there are."""
    return F.floor(F.col("vec_id") / 100)


@query("""
    WITH c AS (SELECT doc_id AS chunk, source AS document, 'figure ' || (doc_id // 100) AS key FROM documents), i AS (SELECT vec_id AS image, 'src' || (vec_id % 20) AS document, 'figure ' || (vec_id // 100) AS key FROM embeddings)
    SELECT DISTINCT document, chunk, image FROM c JOIN i USING (document, key)""")
def link_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and the figures that they name; a figure's number is told by a hundred ids, so links grow with the tables and not with their product."""
    number = F.expr("doc_id div 100")
    refs = F.array(F.concat(F.lit("Fig. 3."), number), F.concat(F.lit("FIGURE  "), number))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), F.col("source").alias("document"), refs.alias("refs"))
    figure = F.concat(F.lit("fig "), F.expr("vec_id div 100"))
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.concat(F.lit("src"), F.col("vec_id") % 20).alias("document"), figure.alias("figure"))
    return ops.link_by_reference(chunks, images)


@query("""
    WITH c AS (SELECT vec_id AS chunk, label AS document, embedding::DOUBLE[] AS v, ['c' || vec_id % 3, 'd' || vec_id % 4] AS cuis, vec_id // 100 AS p FROM embeddings WHERE vec_id % 2 = 0),
    i AS (SELECT vec_id AS image, label AS document, embedding::DOUBLE[] AS w, ['c' || vec_id % 3, 'd' || vec_id % 4] AS cuis2, vec_id // 100 AS page FROM embeddings WHERE vec_id % 2 = 1),
    j AS (SELECT document, chunk, image, chunk % 10 = 0 AND image % 10 = 1 AS det, greatest(0, list_cosine_similarity(v, w)) AS s, len(list_intersect(cuis, cuis2))::DOUBLE / len(list_distinct(list_concat(cuis, cuis2))) AS jac
      FROM c JOIN i USING (document) WHERE abs(page - p) <= 1 OR abs(page - (p + 2)) <= 1),
    f AS (SELECT *, 0.55::DOUBLE * s + 0.45::DOUBLE * jac AS f FROM j)
    SELECT document, chunk, image, CASE WHEN det THEN 'deterministic' WHEN f >= 0.55 THEN CASE WHEN s > jac THEN 'fusion:semantic' ELSE 'fusion:cui' END ELSE 'cui_only' END AS link,
      round(CASE WHEN det THEN 1.0 WHEN f >= 0.55 THEN f ELSE 0.8::DOUBLE * jac END, 6) AS strength FROM f WHERE det OR f >= 0.55 OR jac >= 0.25""")
def link_tri_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    cuis = F.array(F.concat(F.lit("c"), F.col("vec_id") % 3), F.concat(F.lit("d"), F.col("vec_id") % 4))
    p = page_of()
    chunks = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("chunk"), F.col("label").alias("document"), F.col("embedding").alias("v"), cuis.alias("cuis"), p.alias("first_page"), (p + 2).alias("last_page"))
    images = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("image"), F.col("label").alias("document"), F.col("embedding").alias("w"), cuis.alias("cuis2"), p.alias("page"))
    pairs = ops.page_candidates(chunks, images).withColumn("deterministic", (F.col("chunk") % 10 == 0) & (F.col("image") % 10 == 1))
    return ops.tri_pass(pairs).select("document", "chunk", "image", "link", F.round("strength", 6).alias("strength"))


@query("""
    WITH c AS (SELECT vec_id AS chunk, label AS document, vec_id // 100 AS page, vec_id % 3 AS k1, vec_id % 5 AS kind FROM embeddings WHERE vec_id % 2 = 0), i AS (SELECT vec_id AS image, label AS document, vec_id // 100 - 1 AS page, vec_id % 3 AS k1, vec_id % 5 AS kind2 FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 7 <> 0),
    s AS (SELECT document, image, chunk, 3 * (c.k1 = i.k1)::INTEGER + (kind = kind2)::INTEGER AS score FROM c JOIN i USING (document, page)),
    r AS (SELECT *, row_number() OVER (PARTITION BY document, image ORDER BY CASE WHEN score >= 2 THEN score ELSE 0 END DESC, chunk) AS n FROM s) SELECT document, image, chunk, score FROM r WHERE n = 1""")
def link_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    chunks = e.where("vec_id % 2 = 0").select(v.alias("chunk"), F.col("label").alias("document"), page_of().alias("page"), F.array(v % 3).alias("cuis"), (v % 5).alias("kind"))
    images = e.where("vec_id % 2 = 1").select(v.alias("image"), F.col("label").alias("document"), (page_of() - 1).alias("page"), F.array(v % 3).alias("cuis2"), (v % 5).alias("kind2"))
    return ops.link_by_page(chunks, images, images.where("image % 7 = 0").select("document", "image"))


@query("""
    SELECT a.label AS document, a.vec_id AS chunk, b.vec_id AS image, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND abs(a.vec_id // 100 - b.vec_id // 100) <= 3
    WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2""")
def relink_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.functions.vector import cosine

    e, page = table(spark, sf_dir, "embeddings"), page_of()
    chunks = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("chunk"), F.col("label").alias("document"), F.col("embedding").alias("v"), page.alias("first_page"), page.alias("last_page"))
    images = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("image"), F.col("label").alias("document"), F.col("embedding").alias("w"), page.alias("page"))
    scored = ops.page_candidates(chunks, images, 3).withColumn("s", cosine(F.col("v"), F.col("w"))).where("s >= 0.2")
    return scored.select("document", "chunk", "image", F.round("s", 6).alias("score"))
