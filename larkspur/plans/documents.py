"""Queries of document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import documents as ops
from larkspur.operators import adaptive, relational
from larkspur.plans.registry import query, table

_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')"
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\b(Dr|Fig|No|et al|vs|Vol|pp|Ch|Sec)\\.', '\\1' || chr(2), 'g'), '([.!?])[ \\t\\n\\r\\f\\v]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(replace(x, chr(2), '.'))), lambda x: x <> '')"

#: The pronouns that leave a text dangling unless a definition follows; one white space, as more always match.
_PRONOUN = "(?i)^(This|These|That|Those|It|They)\\s"
_DANGLING = f"""(regexp_matches(text, '{_PRONOUN}\\s') OR (regexp_matches(text, '{_PRONOUN}') AND NOT regexp_matches(text, '{_PRONOUN}(is\\s+a|are\\s+the|includes?|refers?)')))::INTEGER
      + regexp_matches(text, '(?i)^(As\\s+mentioned|Continuing|Following\\s+this)')::INTEGER + regexp_matches(text, '(?i)^(The\\s+above|The\\s+following|The\\s+latter)')::INTEGER"""


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


@query(f"SELECT doc_id, len({_WORDS})::INTEGER AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query(f"SELECT doc_id, CAST(floor(len({_WORDS}) * 1.3) AS INTEGER) AS tokens, length(text) // 4 AS by_chars FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), F.floor(F.length("text") / 4).alias("by_chars"))


@query(f"SELECT doc_id, len({_SENTENCES})::INTEGER AS sentences, {_SENTENCES}[1] AS first FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", ops.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("sentences"), F.get("s", F.lit(0)).alias("first"))


@query(f"""
    WITH m AS (SELECT doc_id, len({_WORDS})::DOUBLE / greatest(len({_SENTENCES}), 1) AS mean FROM documents)
    SELECT doc_id, round(CASE WHEN mean < 15 THEN greatest(0.3::DOUBLE, mean / 15) WHEN mean > 25 THEN greatest(0.3::DOUBLE, 1 - (mean - 25) / 30) ELSE 1.0 END, 6) AS score FROM m""")
def sentence_length_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = tx.word_count(F.col("text")) / F.greatest(F.size(ops.sentences(F.col("text"))), F.lit(1))
    return docs(spark, sf_dir, "text").withColumn("m", mean).select("doc_id", F.round(ops.length_score(F.col("m")), 6).alias("score"))


@query(f"""
    WITH w AS (SELECT doc_id, text, len({_WORDS})::DOUBLE AS n FROM documents)
    SELECT doc_id, round(0.30::DOUBLE * (1.0 - 0.2::DOUBLE * ({_DANGLING})) + 0.40::DOUBLE * 0.7::DOUBLE + 0.15::DOUBLE * CASE WHEN regexp_matches(trim(text), '[.!?)"'']$') THEN 1.0 ELSE 0.7 END
      + 0.15::DOUBLE * CASE WHEN n < 20 THEN n / 20 WHEN n > 300 THEN greatest(0.8::DOUBLE, 1 - (n - 300) / 500) ELSE 1.0 END, 6) AS score
    FROM w""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", F.round(ops.completeness(F.col("text"), F.lit(0.7)), 6).alias("score"))


@query()
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four scores, the total and its verdict, for every document."""
    t = F.col("text")
    d = docs(spark, sf_dir, "text").withColumns({"_parts": ops.sentences(t), "_count": tx.word_count(t)})  # taken once for all scores
    parts, count = F.col("_parts"), F.col("_count")
    d = d.withColumns({"readability": ops.readability(t, F.lit(3), parts, count), "coherence": F.coalesce(ops.continuity(t, parts), F.lit(0.85)), "completeness": ops.completeness(t, F.lit(0.7), count), "type_specific": F.lit(0.8), "orphan": ops.is_orphan(t)})
    total = ops.quality({c: F.col(c) for c in ops.QUALITY_WEIGHTS}, F.col("orphan"))
    return d.drop("text", "_parts", "_count").withColumn("quality", total).withColumn("acceptable", F.col("quality") >= 0.5)


@query()
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents around 120 words."""
    return ops.chunk(docs(spark, sf_dir, "text"), "doc_id", "text", target=120, most=200, least=30)


#: Titles of sections, by number.
TITLES = ("Surgical technique", "Anatomy", "Tumor grade", "Management", "A case", "Differential", "CT imaging", "Outcome study", "Other")


@query()
def chunk_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, with limits by a title and by the complexity of the text."""
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % len(TITLES) + 1).cast("int"))
    return adaptive.chunk_adaptive(docs(spark, sf_dir, "text").withColumn("title", title), "doc_id", "title", "text")


@query("SELECT doc_id, list_sort(list_distinct(list_concat([doc_id % 9, doc_id % 5, doc_id % 7], range(1, doc_id % 4 + 2))))::INTEGER[] AS cited FROM documents")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    answer = F.concat(F.lit("As in ["), i % 9, F.lit("] and ["), i % 5, F.lit(", "), i % 7, F.lit("], also [1-"), i % 4 + 1, F.lit("]."))
    return docs(spark, sf_dir).select("doc_id", tx.citations(answer).alias("cited"))


@query("""
    WITH h AS (SELECT doc_id, text, substr(text, 1, 150) AS head FROM documents), p AS (SELECT *, CASE WHEN contains(head, '.') THEN length(head) - instr(reverse(head), '.') + 1 ELSE 0 END AS stop FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 150 THEN text WHEN stop - 1 > 75 THEN substr(head, 1, stop) ELSE head || '...' END AS snippet FROM p""")
def truncate_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", ops.snippet(F.col("text")).alias("snippet"))


_CUTS = [(1, "? "), (2, "! "), (3, ".' || chr(10) || '"), (4, ". ")]


@query(f"""
    WITH h AS (SELECT doc_id, text, substr(text, 1, 400) AS head, reverse(substr(text, 1, 400)) AS back FROM documents),
    p AS (SELECT *, {", ".join(f"CASE WHEN instr(back, reverse('{m}')) > 0 THEN length(head) - instr(back, reverse('{m}')) ELSE 0 END AS p{i}" for i, m in _CUTS)}, CASE WHEN instr(back, ' ') > 0 THEN length(head) - instr(back, ' ') + 1 ELSE 0 END AS space FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 400 THEN text {" ".join(f"WHEN p{i} - 1 > 280 THEN substr(head, 1, p{i})" for i, _ in reversed(_CUTS))} WHEN space > 1 THEN substr(head, 1, space - 1) || '...' ELSE head || '...' END AS cut FROM p""")
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", tx.cut_to_tokens(F.col("text"), 100).alias("cut"))


_LISTS = {"english": ("the ", "of ", "and "), "french": ("le ", "les ", "une "), "german": ("der ", "die ", "und "), "spanish": ("el ", "los ", "una ")}


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in words)


@query(f"""
    WITH h AS (SELECT doc_id, {", ".join(f"{_hits(w)} AS {k}" for k, w in _LISTS.items())} FROM documents), m AS (SELECT *, greatest(english, french, german, spanish) AS best FROM h)
    SELECT doc_id, CASE WHEN best = 0 THEN 'other' WHEN english = best THEN 'english' WHEN french = best THEN 'french' WHEN german = best THEN 'german' ELSE 'spanish' END AS kind FROM m""")
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", ops.best_of(F.col("text"), _LISTS, "other").alias("kind"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), '@') THEN 'mail' WHEN contains(lower(text), '|') THEN 'table' END AS kind FROM documents")
def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"license": ("license",), "mail": ("@",), "table": ("|",)}
    return docs(spark, sf_dir, "text").select("doc_id", ops.first_of(F.col("text"), rules, None).alias("kind"))


@query("""
    SELECT page_id, CASE WHEN contains(lower(url), 'blog.') THEN 'BLOG' WHEN contains(lower(url), 'www.') THEN 'SITE' WHEN contains(lower(url), 'm.') THEN 'MOBILE' ELSE 'GENERAL' END AS source,
      CASE WHEN contains(lower(url), 'blog.') THEN 1.0 WHEN contains(lower(url), 'www.') THEN 0.9 WHEN contains(lower(url), 'm.') THEN 0.8 ELSE 0.7 END::DOUBLE AS score FROM pages""")
def authority_from_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, score = ops.authority(F.col("url"), {"MOBILE": (0.8, ["m."]), "BLOG": (1.0, ["blog."]), "SITE": (0.9, ["www."])})
    return table(spark, sf_dir, "pages").select("page_id", name.alias("source"), score.alias("score"))


@query("SELECT page_id, list_sort(list_distinct(regexp_extract_all(url, '(page|ref)=([a-z0-9]+)', 2))) AS refs FROM pages")
def figure_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(F.array_distinct(F.regexp_extract_all("url", F.lit("(page|ref)=([a-z0-9]+)"), F.lit(2)))).alias("refs"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\n\r]+", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(text).alias("text"))


@query("""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}0-9_]+')) AS term FROM documents) SELECT doc_id, term, count(*) AS n FROM w WHERE term IN ('the', 'license', 'token', 'der', 'les') GROUP BY 1, 2""")
def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in ("the", "license", "token", "der", "les")], "term string")
    return ops.dictionary_hits(docs(spark, sf_dir, "text"), "doc_id", "text", terms)


@query("""
    SELECT md5('S' || l_suppkey || ':' || 'P' || l_partkey || ':' || l_returnflag || ':' || (l_linestatus = 'F')::VARCHAR) AS hash, max(l_discount) AS confidence FROM lineitem GROUP BY 1""")
def relation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    h = ops.relation_hash(F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey"), F.col("l_returnflag"), F.col("l_linestatus") == "F")
    return lines.groupBy(h.alias("hash")).agg(F.max("l_discount").alias("confidence"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + floor(value * 60)::BIGINT AS z, value / 100 AS confidence FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, z DESC, event_id) AS k FROM e WHERE confidence >= 0.3::DOUBLE),
    r AS (SELECT user_id, k, a, z, event_id, confidence, TRUE AS kept, z AS reach FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.a, o.z, o.event_id, o.confidence, o.a >= r.reach, CASE WHEN o.a >= r.reach THEN o.z ELSE r.reach END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT user_id, a AS start, z AS stop, event_id, confidence FROM r WHERE kept""")
def overlap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event spans of each user that don't overlap, from the left."""
    e = table(spark, sf_dir, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    spans = e.select("user_id", start.alias("start"), (start + F.floor(F.col("value") * 60)).alias("stop"), "event_id", (F.col("value") / 100).alias("confidence"))
    return ops.keep_apart(spans, ["user_id"], "start", "stop", "confidence")


@query("""
    WITH RECURSIVE h AS (SELECT vec_id, label, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END))::HUGEINT AS h FROM embeddings),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.label = b.label AND a.vec_id <> b.vec_id AND bit_count(xor(a.h, b.h)) <= 8),
    r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a, min(b) AS least FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
    SELECT vec_id, coalesce(n.n, 0) AS links, least(vec_id, coalesce(c.least, vec_id)) AS class FROM h LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""")
def average_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by the signs of all 64 components, up to eight bits apart."""
    bit = lambda i: F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    h = bit(0)
    for i in range(1, 64):
        h = h.bitwiseOR(bit(i))
    return ops.near_hashes(table(spark, sf_dir, "embeddings").select("vec_id", "label", h.alias("h")), "label", "vec_id", "h", 8)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit("Here you are:\n```json\n"), "props", F.lit("\n```\nDone."))
    return e.select("event_id", F.from_json(ops.recover_json(raw), "k int")["k"].alias("k"))


@query("""
    WITH r AS (SELECT DISTINCT p_brand AS s, p_type AS t, 'is_a' AS rel FROM part WHERE p_retailprice >= 950), c AS (SELECT 'What is ' || s || '?' AS prompt, t AS answer, 'forward' AS direction FROM r)
    SELECT * FROM c UNION ALL SELECT 'What is an example of ' || t || '?', s, 'reverse' FROM r""")
def relation_flashcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "part").select(F.col("p_brand").alias("s"), F.col("p_type").alias("t"), F.lit("is_a").alias("rel"), F.col("p_retailprice").alias("conf"))
    templates = spark.createDataFrame([("is_a", "What is {x}?", "What is an example of {x}?")], "rel string, forward string, reverse string")
    return ops.flashcards(r, templates, 950)


@query("SELECT source || ' | ' || lang || ' | ' || substr(text, 1, 40) AS prefix, doc_id FROM documents")
def contextual_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "source", "lang", "text").select(F.concat_ws(" | ", "source", "lang", F.substring("text", 1, 40)).alias("prefix"), "doc_id")


@query("""
    WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6) AS similarity FROM p""")
def summary_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("w"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.jaccard(F.col("w"), F.col("y")), 6).alias("similarity"))


@query("SELECT array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9_]+'))), ' ') AS key, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(ops.title_key(F.col("p_name")).alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query(f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents), g AS (SELECT *, row_number() OVER (PARTITION BY source, substr(text, 1, 200) ORDER BY p) AS again FROM n WHERE p <= 20),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p) AS q FROM g WHERE again = 1), t AS (SELECT *, CAST(floor(len({_WORDS}) * 1.3) AS INTEGER) AS tokens FROM k WHERE q <= 10),
    b AS (SELECT *, 3000 - coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM t)
    SELECT source, doc_id, CASE WHEN tokens <= room THEN text ELSE substr(text, 1, 4 * room::BIGINT) END AS text, tokens, tokens > room AS cut FROM b WHERE tokens <= room OR (room > 200 AND room > 0)""")
def context_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source within a budget of 3000 tokens."""
    return ops.select_context(docs(spark, sf_dir, "source", "text"), "source", "doc_id", "text", budget=3000)


@query("""
    WITH m AS (SELECT doc_id, len(list_filter(['the', 'of', 'and', 'nothere'], lambda k: contains(lower(text), k))) / 4.0::DOUBLE AS kw FROM documents), p AS (SELECT doc_id, kw, (doc_id % 10) / 10.0::DOUBLE AS emb FROM m),
    s AS (SELECT doc_id, round(CASE WHEN kw = 0 THEN 0 ELSE least(1, kw) END * 0.4::DOUBLE + 0.6::DOUBLE * emb, 6) AS relevance FROM p) SELECT doc_id, relevance FROM s WHERE relevance >= 0.3""")
def cross_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = ops.hits(F.lower("text"), ("the", "of", "and", "nothere")) / 4.0
    relevance = F.round(F.least(kw, F.lit(1.0)) * 0.4 + 0.6 * ((F.col("doc_id") % 10) / 10.0), 6)
    return docs(spark, sf_dir, "text").select("doc_id", relevance.alias("relevance")).where("relevance >= 0.3")


@query("SELECT source, doc_id, score, rank FROM (SELECT source, doc_id, n_chars / 100.0::DOUBLE AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE n_chars >= 400) WHERE rank <= 3")
def gap_fill_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir, "source", "n_chars").where("n_chars >= 400").withColumn("score", F.col("n_chars") / 100.0)
    top = relational.top_per_key(d, ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)
    return top.select("source", "doc_id", "score", F.col("rank").cast("long").alias("rank"))
