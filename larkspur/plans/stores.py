"""Queries that write tables in the library's formats and read them back, and audits of what is stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import analytics
from larkspur.operators.learning import weak_tags
from larkspur.plans.graph import _E, edges
from larkspur.plans.registry import query, table
from larkspur.sources import files


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{files.shared_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT doc_id::VARCHAR AS id, source AS document_id, text AS content, n_chars::INTEGER AS page_number, [doc_id::FLOAT, 1::FLOAT] AS embedding, NULL::VARCHAR AS summary FROM documents")
def chunk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended as chunks under other column names, in a bounded number of folders, and read back."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), F.col("text").alias("content"), F.col("n_chars").alias("start_page"), F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("text_embedding"), F.lit("x").alias("unknown"))
    path = new_folder(spark)
    files.append_chunks(chunks, path)
    return spark.read.parquet(path).select("id", "document_id", "content", "page_number", "embedding", "summary")


@query("SELECT * FROM (SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'benchmark', count(*) FROM benchmark)")
def phase_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.export_phase({name: table(spark, sf_dir, name) for name in ("documents", "labels", "benchmark")}, new_folder(spark))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    catalog = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    files.write_catalog(catalog, path)
    return files.read_catalog(spark, path, "p_partkey long, p_name string, p_retailprice double")


@query(f"WITH {_E} SELECT s, t, rel, conf FROM e")
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e = new_folder(spark), edges(spark, sf_dir)
    files.save_graph(e.select(F.col("s").alias("node")).union(e.select("t")).distinct(), e, path)
    return files.load_graph(spark, path)[1]


@query("""
    SELECT source, count(*) AS total, count(*) FILTER (WHERE n_chars >= 200) AS valid, count(*) FILTER (WHERE n_chars < 200) AS short, count(*) FILTER (WHERE NOT regexp_matches(text, '[.!?]$')) AS cut_off,
      list_slice(list(doc_id ORDER BY n_chars, doc_id), 1, 10) AS samples FROM documents GROUP BY 1""")
def summary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each source as summaries: how many hold, what is wrong, and the ten shortest."""
    d = table(spark, sf_dir, "documents")
    samples = analytics.first_samples(d, ["source"], "doc_id", [F.col("n_chars"), F.col("doc_id")], 10).withColumnRenamed("source", "_source")
    short = F.col("n_chars") < 200
    counts = d.groupBy("source").agg(F.count("*").alias("total"), F.count_if(~short).alias("valid"), F.count_if(short).alias("short"), F.count_if(~F.col("text").rlike("[.!?]$")).alias("cut_off"))
    return counts.join(samples, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


@query("SELECT tag, round(avg(rating), 8) AS mean FROM (SELECT unnest([event_type, 'phase_' || event_id % 5]) AS tag, CASE WHEN value < 30 THEN 1 WHEN value < 60 THEN 2 WHEN value < 150 THEN 3 ELSE 4 END AS rating FROM events) GROUP BY 1 HAVING avg(rating) < 2.5")
def phase_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with a mean rating below 2.5."""
    v = F.col("value")
    rated = table(spark, sf_dir, "events").select(F.array("event_type", F.concat(F.lit("phase_"), F.col("event_id") % 5)).alias("tags"), F.when(v < 30, 1).when(v < 60, 2).when(v < 150, 3).otherwise(4).alias("rating"))
    return weak_tags(rated, "tags", "rating", 2.5).select("tag", F.round("mean", 8).alias("mean"))


@query(r"""
    WITH t AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS a, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS b FROM pages)
    SELECT page_id, list_transform(range(1, len(a) + 1), lambda i: [trim(a[i]), trim(b[i])]) AS rows FROM t WHERE len(a) > 0""")
def table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The menus of pages written as Markdown tables and parsed again."""
    from larkspur.operators import rules

    link = '<li><a href="([^"]*)">([^<]*)</a></li>'
    cells = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("a"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("b"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.transform(cells, lambda x: F.array(x["a"], x["b"])).alias("r")).where(F.size("r") > 0)
    return rows.select("page_id", rules.parse_markdown_table(rules.markdown_table(F.col("r"))).alias("rows"))


@query("""
    WITH p AS (SELECT DISTINCT page_id % 20 AS part FROM pages)
    SELECT part, CASE part % 5 WHEN 1 THEN 'touched' WHEN 2 THEN 'changed' WHEN 3 THEN 'new' ELSE 'same' END AS state, 1 AS files FROM p UNION ALL SELECT part, 'gone', 1 FROM p WHERE part % 5 = 4""")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in a file for each of twenty folders, scanned against a scan that knew some of them with other times, sizes or names, or not at all."""
    path = new_folder(spark)
    pages = table(spark, sf_dir, "pages").withColumn("part", F.col("page_id") % 20)
    pages.repartition(20, "part").write.partitionBy("part").json(path)
    nothing = spark.createDataFrame([], "path string, size long, modified timestamp, content_hash string")
    part = F.regexp_extract("path", r"part=(\d+)", 1).cast("long")
    first = files.scan_changes(spark, path, nothing, "*.json").withColumn("kind", part % 5).where("kind <> 3")
    earlier = F.when(F.col("kind").isin(1, 2), F.col("modified") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("modified"))
    known = first.select("path", (F.col("size") + F.when(F.col("kind") == 2, 1).otherwise(0)).alias("size"), earlier.alias("modified"), F.when(F.col("kind") == 2, "other").otherwise(F.col("content_hash")).alias("content_hash"), "kind")
    lost = known.where("kind = 4").withColumn("path", F.concat("path", F.lit(".old")))
    found = files.scan_changes(spark, path, files.cut_lineage(known.unionByName(lost).drop("kind")), "*.json")
    return found.groupBy(part.alias("part"), "state").agg(F.count("*").cast("int").alias("files"))
