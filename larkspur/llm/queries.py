"""Registered queries of the operators in this package, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import words
from larkspur.llm import bpe_tree, dialogue, html_text, language_id, media_ogg, packing, periodic, projections, quality, repeats, secrets, sharding, simhash
from larkspur.operators.learning import folded

SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards whose row counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shuffle_to_shards(rows, SHARDS, seed=1)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in Ogg and read back."""
    return media_ogg.to_media(table(spark, sf_dir, "documents"), keep_media=False)


def held_out(doc_id: Column) -> Column:
    """Documents that no language model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs.where(~held_out(F.col("doc_id"))))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.classify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_tree.encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by SimHash over three-word shingles, two bits apart at most."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id", "kept")


def op4_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that occur elsewhere."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op10_pack_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of up to 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op7_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: base patterns, and strings of high entropy."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] != "entropy")
    counts = [secrets.count_of(k).alias(f"n_{k}") for k in secrets.KINDS]
    digest = F.sha2(secrets.joined_spans(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.joined_spans(F.col("secret_spans")).alias("spans"))


def op5_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_embedding_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings within their labels."""
    return projections.near_vectors(table(spark, sf_dir, "embeddings"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by a checksum of its id goes on in repeats of its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    damaged = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words(F.col("text"))).alias("w")).withColumn("n", F.size("w"))
    damaged = damaged.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return damaged.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_run_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every text, and the text without their repeats."""
    found = periodic.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("word_runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("word_runs", lambda r: F.struct(r["length"], (-r["start"]).alias("at"), (-r["period"]).alias("by"))))
    named = found.select("doc_id", "run_collapsed", F.size("word_runs").cast("long").alias("n_runs"), lines.alias("lines"), best.alias("best"))
    longest = named.withColumns({"start": -F.col("best.at"), "length": F.col("best.length"), "period": -F.col("best.by")})
    digest = F.sha2(F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(F.lit("")), 256)
    exponent = F.expr("1000 * length div period").alias("exponent_milli")
    return longest.select("doc_id", "n_runs", "start", "length", "period", exponent, digest.alias("runs_sha256"), F.sha2("run_collapsed", 256).alias("collapsed_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, by a checksum of conversation and turn: rows dropped, emptied, without sentence ends, repeated, or said by the user."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    h = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    changed = {
        "role": F.when(h == 4, "user").otherwise(role),
        "text": F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text),
        "copies": F.when(h == 3, 2).otherwise(1),
    }
    present = h != 0
    return rows.select("conv_id", *(F.when(present, c).alias(name) for name, c in ({"turn": F.col("turn")} | changed).items()), present.alias("present")).fillna(1, "copies")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after damage, and the cheapest repair of its structure.

    A digest of a whole conversation needs its turns in order, so pieces go by a task one after the other; it holds the audit and the digest's state.
    """
    found = dialogue.repair(damaged(table(spark, sf_dir, "conversations")))
    counted = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    parts = found.select("conv_id", "piece", *(F.col(f"stats.{c}") for c in counted), dialogue.audit(F.col("edits")).alias("audit"), dialogue.repaired_text(F.col("edits")).alias("text"))

    def add(state: tuple | None, *row: object) -> tuple:
        *stats, letters, text = row
        now, audits, digest, begun = state or (stats, [], hashlib.sha256(), False)
        audits.append(letters)
        if text is not None:
            digest.update(("\n" * begun + text).encode())
        return now, audits, digest, begun or text is not None

    fields = [*((c, "long", pa.int64()) for c in counted), ("audit", "string", pa.string()), ("repaired_sha256", "string", pa.string())]
    return folded(parts, ["conv_id"], ["piece"], [*counted, "audit", "text"], None, add, fields, lambda s: (*s[0], "".join(s[1]), s[2].hexdigest()))


def op13_quality_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned from the labels of the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    found = quality.score(docs, quality.fit(docs, labels, "quality"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.7, 1).otherwise(0).alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_shard_hypergeometric, op2_embedding_collisions, op3_media_ogg, op4_suffix_columns, op5_html_templates, op6_language_id, op7_secret_entropy, op8_simhash_ball, op9_bpe_tree, op10_pack_nnls, op11_run_convolution, op12_conversation_repair, op13_quality_additive)
    return {f.__name__: f for f in own}


#: Every pair of a label, and what is reachable over the links.
_OP2 = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    r AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON l.u = r.w),
    c AS (SELECT u, min(w) AS least FROM r GROUP BY 1), n AS (SELECT u, count(*) AS n FROM l GROUP BY 1)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.least, e.vec_id) AS kept
    FROM embeddings e LEFT JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id"""
#: Every window of 200 bytes, as hexadecimal text; then runs of covered bytes and what lies between them.
_OP4 = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
    p AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
    g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM p),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g), r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM k GROUP BY doc_id, run),
    t AS (SELECT doc_id, count(*) AS runs, sum(z - a)::BIGINT AS gone FROM r GROUP BY 1),
    b AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM r UNION ALL SELECT r.doc_id, max(z), any_value(n) FROM r JOIN d USING (doc_id) GROUP BY 1 UNION ALL SELECT doc_id, 0, n FROM d WHERE doc_id NOT IN (SELECT doc_id FROM t)),
    f AS (SELECT b.doc_id, sha256(unhex(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x))) AS kept_sha256 FROM b JOIN d ON d.doc_id = b.doc_id GROUP BY 1)
    SELECT d.doc_id, d.n AS n_bytes, coalesce(t.gone, 0) AS n_removed, coalesce(t.runs, 0) AS n_spans, f.kept_sha256 FROM d JOIN f ON f.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; tests/llm compares every one with a plain version."""
    return {"op2_embedding_collisions": _OP2, "op4_suffix_columns": _OP4}
