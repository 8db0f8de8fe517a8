"""Links between chunks and images: by reference, by nearness of pages, by vectors and concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import jaccard
from larkspur.functions.vector import cosine

#: Fixed values of the score.
SEMANTIC, CONCEPTS, ACCEPT, CONCEPT_ONLY, CONCEPT_SHARE = 0.55, 0.45, 0.55, 0.25, 0.8


def figure_key(name: Column) -> Column:
    """Lower case, one spelling of figure, single spaces, and of a number by chapter only its last part."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"^fig(ure)?[._]?\s*", "figure ")
    low = F.regexp_replace(F.trim(F.regexp_replace(low, r"\s+", " ")), r"figure _", "figure ")
    return F.regexp_replace(low, r"^figure \d+\.(\d+[a-z]?)$", "figure $1")


def link_by_reference(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """(document, chunk, image) where a chunk (column refs, an array) names an image's figure (column figure)."""
    refs = chunks.select("document", "chunk", F.explode("refs").alias("ref")).select("document", "chunk", figure_key(F.col("ref")).alias("key"))
    named = images.select("document", "image", figure_key(F.col("figure")).alias("key"))
    return refs.join(named, ["document", "key"]).select("document", "chunk", "image").distinct()


def page_candidates(chunks: DataFrame, images: DataFrame, buffer: int = 1) -> DataFrame:
    """Pairs of a document whose image page is within ``buffer`` of the chunk's first or last page; a join on equal pages."""
    near = F.array_distinct(F.concat(F.sequence(F.col("first_page") - buffer, F.col("first_page") + buffer), F.sequence(F.col("last_page") - buffer, F.col("last_page") + buffer)))
    return chunks.withColumn("page", F.explode(near)).join(images, ["document", "page"])


def tri_pass(pairs: DataFrame) -> DataFrame:
    """``pairs`` (deterministic, v, w, cuis, cuis2) with link and strength: a named figure is 1; else the fused score if it is enough; else concepts alone."""
    sim, share = F.greatest(F.lit(0.0), cosine(F.col("v"), F.col("w"))), jaccard(F.col("cuis"), F.col("cuis2"))
    both = pairs.withColumns({"_s": sim, "_j": share}).withColumn("_f", SEMANTIC * F.col("_s") + CONCEPTS * F.col("_j"))
    link = F.when(F.col("deterministic"), "deterministic").when(F.col("_f") >= ACCEPT, F.when(F.col("_s") > F.col("_j"), "fusion:semantic").otherwise("fusion:cui")).when(F.col("_j") >= CONCEPT_ONLY, "cui_only")
    strength = F.when(F.col("deterministic"), 1.0).when(F.col("_f") >= ACCEPT, F.col("_f")).otherwise(CONCEPT_SHARE * F.col("_j"))
    return both.withColumns({"link": link, "strength": strength}).where("link IS NOT NULL").drop("_s", "_j", "_f")


def link_by_page(chunks: DataFrame, images: DataFrame, linked: DataFrame) -> DataFrame:
    """(document, image, chunk, score): for images without a link the best chunk of their page; 3 for each shared concept, 1 for a shared kind.

    Below 2 points it is the first chunk of the page.
    """
    free = images.join(linked, ["document", "image"], "left_anti")
    pairs = chunks.join(free, ["document", "page"])
    score = 3 * F.size(F.array_intersect("cuis", "cuis2")) + F.when(F.col("kind") == F.col("kind2"), 1).otherwise(0)
    rated = pairs.withColumn("score", score).withColumn("_rate", F.when(F.col("score") >= 2, F.col("score")).otherwise(0))
    best = F.row_number().over(Window.partitionBy("document", "image").orderBy(F.desc("_rate"), "chunk"))
    return rated.withColumn("_r", best).where("_r = 1").select("document", "image", "chunk", "score")
