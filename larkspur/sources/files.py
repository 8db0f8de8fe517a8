"""Reading and writing: tables, catalogs, directories of files, exports and graphs."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical schemas of the document model.
SCHEMAS = {
    "documents": "id string, source_path string, title string, total_pages int, authority_score double, specialty string, content_hash string, parent_id string, sort_order int, section_type string, deleted_at timestamp, created_at timestamp, updated_at timestamp, metadata map<string,string>",
    "chunks": "id string, document_id string, content string, content_hash string, summary string, page_number int, chunk_index int, start_char int, end_char int, chunk_type string, specialty string, embedding array<float>, summary_embedding array<float>, cuis array<string>, "
    "entities array<struct<text string, category string, normalized string, start int, `end` int, confidence double>>, readability_score double, coherence_score double, completeness_score double, type_specific_score double, is_orphan boolean, surgical_phase string, step_number int, created_at timestamp",
    "images": "id string, document_id string, file_path string, storage_path string, content_hash string, width int, height int, format string, page_number int, image_type string, is_decorative boolean, figure_id string, caption string, vlm_caption string, quality_score double, embedding array<float>, caption_embedding array<float>, cuis array<string>, created_at timestamp",
    "links": "id string, chunk_id string, image_id string, link_type string, score double, proximity_score double, semantic_score double, cui_overlap_score double, created_at timestamp",
    "entities": "id string, cui string, name string, semantic_type string, tui string, chunk_count int, image_count int",
    "entity_relations": "id string, source_entity_id string, target_entity_id string, relation_type string, confidence double, chunk_ids array<string>, context_snippet string, is_negated boolean, negation_cue string, extraction_method string",
    "review_history": "id string, user_id string, card_id string, rating int, response_time_ms int, reviewed_at timestamp, difficulty_before double, stability_before double, difficulty_after double, stability_after double, interval_before_days double, interval_after_days double, session_id string",
}
#: Names that other versions of a schema use for a column, best first.
ALIASES = {"embedding": ("text_embedding", "clip_embedding", "image_embedding"), "source_path": ("file_path",), "page_number": ("start_page", "page")}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from the session; a local one is made only where all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larkspur-"))
    return str(sc.getCheckpointDir())


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, which outlives executors, and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the canonical schema of ``table``: aliases are taken where a column is missing or null, other columns are left out."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(SCHEMAS[table]).fields
    columns = []
    for f in fields:
        known = [F.col(c).cast(f.dataType) for c in (f.name, *ALIASES.get(f.name, ())) if c in df.columns]
        columns.append((F.coalesce(*known) if known else F.lit(None).cast(f.dataType)).alias(f.name))
    return df.select(*columns)


#: Folders that stored chunks are dealt into.
CHUNK_FOLDERS = 256


def chunk_folder(document_id: Column) -> Column:
    """The folder of a document's chunks."""
    return F.pmod(F.xxhash64(document_id.cast("string")), F.lit(CHUNK_FOLDERS)).cast("int")


def append_chunks(df: DataFrame, path: str) -> None:
    """Append chunks below ``path`` in folders by a hash of their document, sorted, so that a document is read alone and a large one has many writers."""
    rows = conform(df, "chunks").withColumn("folder", chunk_folder(F.col("document_id")))
    dealt = rows.repartitionByRange("folder", "document_id", "chunk_index", "id").sortWithinPartitions("folder", "document_id", "chunk_index")
    dealt.write.mode("append").partitionBy("folder").parquet(path)


def read_chunks(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    """Stored chunks, of all documents or of one; for one, its folder alone is opened, and sorted files are skipped by their statistics."""
    rows = spark.read.parquet(path)
    if document_id is not None:
        rows = rows.where((F.col("folder") == chunk_folder(F.lit(document_id))) & (F.col("document_id") == document_id))
    return rows.drop("folder")


def write_catalog(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema) if schema else spark.read.json(path)


def scan_directory(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size, modified, content_hash) of all files below ``path``; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_hash"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of all files below ``path``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def scan_changes(spark: SparkSession, path: str, last: DataFrame, pattern: str = "*", page: int = 10_000) -> DataFrame:
    """(path, size, modified, content_hash, state): the files below ``path`` against the ``last`` scan (path, size, modified, content_hash).

    A listing tells what may have changed: a file of the same size and time is ``same`` and keeps
    its hash unread. Only the others are read and hashed, by their paths, ``page`` at a time; one whose
    content is what it was is ``touched``, else ``changed``, or ``new`` without a row in ``last``.
    ``gone`` files come with what was known of them. Paths pass through the driver as in any listing, contents don't.
    """
    now = cut_lineage(list_files(spark, path, pattern))
    known = last.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("content_hash").alias("_hash"))
    both = now.join(known, "path", "left")
    same = F.col("_size").eqNullSafe(F.col("size")) & F.col("_modified").eqNullSafe(F.col("modified"))
    fresh = [r["path"] for r in both.where(~same).select("path").toLocalIterator()]
    result = both.where(same).select("path", "size", "modified", F.col("_hash").alias("content_hash"), F.lit("same").alias("state"))
    for i in range(0, len(fresh), page):
        named = [p.replace("\\", "\\\\").translate({ord(c): f"\\{c}" for c in "{}[]*?"}) for p in fresh[i : i + page]]
        read = spark.read.format("binaryFile").load(named).select("path", F.sha2("content", 256).alias("content_hash"))
        state = F.when(F.col("_size").isNull(), "new").when(F.col("_hash").eqNullSafe(F.col("content_hash")), "touched").otherwise("changed")
        result = result.unionByName(both.join(read, "path").select("path", "size", "modified", "content_hash", state.alias("state")))
    gone = known.join(now.select("path"), "path", "left_anti").select("path", F.col("_size").alias("size"), F.col("_modified").alias("modified"), F.col("_hash").alias("content_hash"), F.lit("gone").alias("state"))
    return result.unionByName(gone)


def export_phase(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables as Parquet with a manifest (name, rows), which is returned; rows are counted while they are written."""
    from pyspark.sql import Observation

    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}")
        counts.append((name, int(seen.get["rows"])))
    manifest = spark.createDataFrame(counts, "name string, rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
