"""Queries of phrase dictionaries, near concepts and relations in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import phrases, relations
from larkspur.plans.registry import query, table


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each order: name, type and brand of its parts, line by line; an order has few lines."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit(" "), "p_type", F.lit(", "), "p_brand").alias("said"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey")
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "said")))
    return lines.groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda x: x["said"]), "; ").alias("text"))


_ORDER_TEXTS = "SELECT l_orderkey, string_agg(p_name || ' ' || p_type || ', ' || p_brand, '; ' ORDER BY l_linenumber, l_partkey) AS text FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"
#: Terms of one to five words, some within others.
_TERMS = """SELECT split_part(p_name, ' ', 1) AS term FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_name || ' ' || p_type FROM part WHERE p_partkey % 5 = 0
      UNION ALL SELECT split_part(p_name, ' ', 2) || ' ' || p_type || ' ' || p_brand FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT p_name || ' ' || p_type || ' ' || p_brand FROM part WHERE p_partkey % 4 = 0"""


@query(f"""
    WITH RECURSIVE d AS ({_ORDER_TEXTS}), g AS (SELECT l_orderkey, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM d),
    k AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(term), '[\\p{{L}}\\p{{N}}_]+'), ' ') AS term FROM ({_TERMS})),
    s AS (SELECT l_orderkey, w, unnest(range(1, len(w) + 1)) AS i FROM g), c AS (SELECT l_orderkey, i, n, array_to_string(w[i:i + n - 1], ' ') AS term FROM s, range(1, 6) t(n) WHERE i + n - 1 <= len(w)),
    b AS (SELECT l_orderkey, i, max(n) AS n, max_by(term, n) AS term FROM c SEMI JOIN k USING (term) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS k FROM b),
    r AS (SELECT l_orderkey, k, i, n, term, TRUE AS kept, i + n AS reach FROM o WHERE k = 1 UNION ALL SELECT o.l_orderkey, o.k, o.i, o.n, o.term, o.i >= r.reach, CASE WHEN o.i >= r.reach THEN o.i + o.n ELSE r.reach END FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.k = r.k + 1)
    SELECT l_orderkey, (i - 1)::INTEGER AS token, n::INTEGER AS tokens, term FROM r WHERE kept""")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftmost-longest terms of one to five words in the texts of all orders."""
    part = table(spark, sf_dir, "part")
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    kinds = ((7, [first]), (3, ["p_name"]), (5, ["p_name", "p_type"]), (6, [second, "p_type", "p_brand"]), (4, ["p_name", "p_type", "p_brand"]))
    terms = part.select(F.explode(F.array(*(F.when(F.col("p_partkey") % m == 0, F.concat_ws(" ", *own)) for m, own in kinds))).alias("term")).where("term is not null")
    return phrases.phrase_hits(order_texts(spark, sf_dir), "l_orderkey", "text", terms).select("l_orderkey", "token", "tokens", "term")


def _grams(name: str) -> str:
    return f"list_distinct(list_transform(range(1, length({name}) + 1), lambda i: substr(' ' || {name} || ' ', i, 3)))"


@query(f"""
    WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS name FROM benchmark), n AS (SELECT name, length(name) % 3 AS class FROM v WHERE length(name) >= 5),
    w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS x FROM documents), u AS (SELECT x, {_grams('x')} AS g FROM (SELECT DISTINCT x FROM w)), y AS (SELECT name, class, {_grams('name')} AS g FROM n),
    ux AS (SELECT x, len(g) AS n, unnest(g) AS m FROM u), yx AS (SELECT name, class, len(g) AS n, unnest(g) AS m FROM y),
    s AS (SELECT x, name, class, count(*) / (any_value(ux.n) + any_value(yx.n) - count(*))::DOUBLE AS similarity FROM ux JOIN yx ON ux.m = yx.m AND ux.n >= 0.7 * yx.n - 1e-9 AND yx.n >= 0.7 * ux.n - 1e-9 GROUP BY 1, 2, 3),
    b AS (SELECT x, name, class, similarity, similarity * CASE class WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS score FROM s WHERE similarity >= 0.7 - 1e-12 QUALIFY row_number() OVER (PARTITION BY x ORDER BY similarity DESC, name, class) = 1)
    SELECT doc_id, name AS concept, class, count(*) AS n, round(max(score), 6) AS score FROM w JOIN b USING (x) WHERE score >= 0.3::DOUBLE GROUP BY 1, 2, 3""")
def concept_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the passages as concepts, with classes and weights, in all documents, as written or nearly so."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name")
    names = table(spark, sf_dir, "benchmark").select(words).distinct().where(F.length("name") >= 5)
    vocabulary = names.select(F.col("name").alias("concept"), "name", (F.length("name") % 3).cast("long").alias("class"))
    weights = spark.createDataFrame([(0, 0.9), (1, 0.4)], "class long, weight double")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = phrases.near_concepts(docs, "doc_id", "text", vocabulary, weights, least=0.7, longest=1)
    return found.groupBy("doc_id", "concept", "class").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("score"))


#: What stands between and around entities of the invented prose.
BETWEEN = {"part_of": (r"\bof\b",), "placed_in": (r"\bin\b", r"\bon\b"), "given_to": (r"\bto\b", r"\bfor\b")}
DENIALS, LIMITS_OF_DENIAL = ("by", "not", "or by"), ("and", "but")


def passage_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the passages with five letters or more, as names of entities."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("term")
    return table(spark, sf_dir, "benchmark").select(words).distinct().where(F.length("term") >= 5)


@query()
def entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between entities that stand near each other in the documents, with negation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = phrases.phrase_hits(docs, "doc_id", "text", passage_terms(spark, sf_dir))
    spans = hits.select("doc_id", "start", "stop", F.col("term").alias("concept"), F.when(F.length("term") % 2 == 0, "even").otherwise("odd").alias("class"))
    return relations.entity_relations(docs, "doc_id", "text", spans, BETWEEN, {"part_of": (("even", "odd"),)}, 60, DENIALS, LIMITS_OF_DENIAL)
