"""Queries of rules on what texts say, and of names and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import analytics, documents, entities, relational
from larkspur.operators import validity as ops
from larkspur.plans.documents import _SENTENCES, docs
from larkspur.plans.registry import query, table

_PARTS = r"string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(r"""
    WITH p AS (SELECT * FROM (VALUES ('license', 'HIGH', 1, ['license', 'licence'], '(?i)licensed under the [a-z]+', 'Name the version'), ('token', 'CRITICAL', 0, [''], '(?i)token ?[:=]', 'Keep it out'), ('mail', 'MEDIUM', 2, ['@'], '(?i)[a-z]+@[a-z]+\.com', 'Leave it out')) v(name, severity, rank, words, pattern, advice)),
    h AS (SELECT doc_id, text, name, severity, rank, advice, regexp_extract(text, pattern) AS detected, length(string_split_regex(text, pattern)[1]) AS s FROM documents, p WHERE len(list_filter(words, lambda w: contains(lower(text), w))) > 0 AND regexp_matches(text, pattern))
    SELECT doc_id, name, severity, rank, detected, substr(text, greatest(0, s - 50) + 1, s - greatest(0, s - 50) + length(detected) + 50) AS context, advice FROM h""")
def superseded_practice(spark: SparkSession, sf_dir: str) -> DataFrame:
    practices = [ops.Practice("license", "HIGH", ("license", "licence"), "licensed under the [a-z]+", "Name the version"), ops.Practice("token", "CRITICAL", (), "token ?[:=]", "Keep it out"), ops.Practice("mail", "MEDIUM", ("@",), r"[a-z]+@[a-z]+\.com", "Leave it out")]
    return ops.superseded(docs(spark, sf_dir, "text"), ["doc_id"], "text", practices)


@query("""
    SELECT o_orderkey, year(o_orderdate) AS year, (2010 - year(o_orderdate)) AS age_years, CASE WHEN contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high') THEN 'HIGH' ELSE 'MEDIUM' END AS severity
    FROM orders WHERE 2010 - year(o_orderdate) > 10""")
def citation_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("topic"))
    old = ops.old_citations(cited, "year", "topic", 2010, 10, ("urgent", "high"))
    return old.select("o_orderkey", "year", F.col("age_years").cast("long").alias("age_years"), "severity")


_FORBIDS = (("ABSOLUTE", r"\bnot\s+(.+?)(?:\.|,|;|\z)"), ("STRONG", r"\bwith\s+(.+?)(?:\.|,|;|\z)"), ("CAUTION", r"\bfor\s+(.+?)(?:\.|,|;|\z)"))
_FOUND = " UNION ALL ".join(f"SELECT doc_id, i, sentence, {n} AS n, '{s}' AS severity, unnest(regexp_extract_all(sentence, '(?i){p}', 1)) AS action, unnest(range(len(regexp_extract_all(sentence, '(?i){p}', 1)))) AS m FROM s" for n, (s, p) in enumerate(_FORBIDS))


@query(rf"""
    WITH s AS (SELECT doc_id, unnest({_PARTS}) AS sentence, unnest(range(len({_PARTS}))) AS i FROM documents), f AS ({_FOUND}),
    k AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(lower(trim(action)), '[ \t\n\r\f\v]+'), lambda w: w <> '')[1:5], ' ') AS beginning FROM f)
    SELECT doc_id, severity, trim(action) AS action, trim(sentence) AS sentence FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, beginning ORDER BY i, n, m) = 1""")
def prohibitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.prohibitions(docs(spark, sf_dir, "text"), "doc_id", "text", _FORBIDS)


@query(f"""
    WITH r AS (SELECT * FROM (VALUES ('that with the from', 'HIGH', ['that', 'with', 'from']), ('pour les dans', 'LOW', ['pour', 'dans']), ('of it', 'ANY', [])) v(action, severity, terms))
    SELECT doc_id, action, severity FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' We use it.' ELSE '' END AS text FROM documents), r WHERE regexp_matches(lower(text), '{"|".join(ops.INDICATORS)}') AND len(list_filter(terms, lambda w: NOT contains(lower(text), w))) = 0""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("that with the from", "HIGH"), ("pour les dans", "LOW"), ("of it", "ANY")], "action string, severity string")
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " We use it.").otherwise(""))
    return ops.violations(docs(spark, sf_dir, "text").withColumn("text", said), "doc_id", "text", rules)


#: ``text`` with a plain letter for every other letter or digit, as RE2 bounds words at these where texts don't end a word.
_PLAIN = r"regexp_replace({}, '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{Nd}}]', 'x', 'g')"


@query(rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_PLAIN.format("coalesce(text, '')")} AS plain FROM documents), p AS (SELECT doc_id, unnest(regexp_extract_all(plain, '\b(\d+(?:\.\d+)?)\s*(%)')) AS claim FROM d),
    m AS (SELECT doc_id, unnest(regexp_extract_all(plain, '(?i)\b(\d+(?:\.\d+)?)\s*(the|of|st|main)\b')) AS claim FROM d), s AS (SELECT doc_id, unnest({_PARTS}) AS claim FROM d)
    SELECT doc_id, 'percent' AS kind, regexp_extract(claim, '(\d+(?:\.\d+)?)', 1) AS value, '%' AS unit, FALSE AS is_temporal, claim FROM p
    UNION ALL SELECT doc_id, 'measure', regexp_extract(claim, '(\d+(?:\.\d+)?)', 1), regexp_extract(claim, '(?i)(the|of|st|main)$', 1), FALSE, claim FROM m
    UNION ALL SELECT doc_id, 'recommendation', NULL, NULL, regexp_matches(lower(claim), 'was|from'), trim(claim) FROM s WHERE regexp_matches({_PLAIN.format("lower(claim)")}, '\bhave\b|\bnot\b')""")
def fact_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.facts(docs(spark, sf_dir, "text"), ["doc_id"], "text", ("the", "of", "st", "main"), (r"\bhave\b", r"\bnot\b"), ("was", "from"))


@query(r"""
    WITH l AS (SELECT l_partkey, l_suppkey, round(max(l_discount) * 100)::INTEGER AS d FROM lineitem GROUP BY 1, 2)
    SELECT a.l_partkey || '-' || a.l_suppkey AS a, b.l_partkey || '-' || b.l_suppkey AS b, a.d::DOUBLE AS av, b.d::DOUBLE AS bv, CASE WHEN abs(a.d - b.d) < 10 THEN 'low' WHEN abs(a.d - b.d) <= 20 THEN 'medium' ELSE 'high' END AS severity
    FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey AND a.l_partkey || '-' || a.l_suppkey < b.l_partkey || '-' || b.l_suppkey WHERE abs(a.d - b.d) > 3""")
def conflict_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages that differ between sources: discounts that lines of two suppliers tell for one part."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("d"))
    said = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" discount "), F.round(F.col("d") * 100).cast("int"), F.lit("% given"))
    texts = lines.select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("id"), F.col("l_partkey").alias("topic"), F.col("l_suppkey").alias("src"), said.alias("said"))
    return ops.number_conflicts(ops.mentions(texts, ["id", "topic", "src"], "said", r"(\d+(?:\.\d+)?)\s*(%)", 30, 30))


@query("""
    WITH l AS (SELECT l_partkey, l_returnflag, max(l_quantity)::INTEGER AS q FROM lineitem GROUP BY 1, 2)
    SELECT a.l_partkey || '-' || a.l_returnflag AS a, b.l_partkey || '-' || b.l_returnflag AS b, a.q::DOUBLE AS av, b.q::DOUBLE AS bv,
      CASE WHEN 100 * abs(a.q - b.q) / greatest(a.q, b.q)::DOUBLE < 30 THEN 'low' WHEN 100 * abs(a.q - b.q) / greatest(a.q, b.q)::DOUBLE <= 50 THEN 'medium' ELSE 'high' END AS severity
    FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.l_returnflag < b.l_returnflag WHERE 100 * abs(a.q - b.q) / greatest(a.q, b.q)::DOUBLE > 20""")
def conflict_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures that differ between sources by more than a fifth: days that lines with two flags tell for one part."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_quantity").cast("int").alias("q"))
    said = F.concat(F.lit("the part "), F.col("l_partkey").cast("string"), F.lit(" is sent in "), F.col("q").cast("string"), F.lit(" days at most"))
    texts = lines.select(F.concat_ws("-", "l_partkey", "l_returnflag").alias("id"), F.col("l_partkey").alias("topic"), F.col("l_returnflag").alias("src"), said.alias("said"))
    return ops.number_conflicts(ops.mentions(texts, ["id", "topic", "src"], "said", r"(\d+(?:\.\d+)?)\s*(mm|cm|hours?|days?|weeks?)", 40, 20))


@query("""
    WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Step ' || doc_id || ': ' WHEN 1 THEN doc_id || '. ' WHEN 2 THEN 'Second ' ELSE '' END || text AS text FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id WHEN 1 THEN doc_id WHEN 2 THEN 2 WHEN 3 THEN CASE WHEN regexp_matches(text, '(?i)^Step\\s+\\d') OR regexp_matches(text, '^\\d+\\.\\s') OR regexp_matches(text, '(?i)^(first|second|third|fourth|fifth)') THEN -1 END END::INTEGER AS step FROM t""")
def step_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    head = F.when(i % 4 == 0, F.concat(F.lit("Step "), i, F.lit(": "))).when(i % 4 == 1, F.concat(i, F.lit(". "))).when(i % 4 == 2, F.lit("Second ")).otherwise("")
    return docs(spark, sf_dir, "text").select("doc_id", documents.step_number(F.concat(head, "text")).alias("step"))


_PHASE = ", ".join(f"{' + '.join(f'contains(t, {chr(39)}{w}{chr(39)})::INTEGER' for w in words)} AS {name}" for name, words in documents.PHASES.items())
_BEST = "greatest(" + ", ".join(documents.PHASES) + ")"


@query(f"""
    WITH d AS (SELECT doc_id, lower(text) || CASE doc_id % 5 WHEN 0 THEN ' incision and flap' WHEN 1 THEN ' closure of the wound' WHEN 2 THEN ' risk' ELSE '' END AS t FROM documents), h AS (SELECT doc_id, {_PHASE} FROM d)
    SELECT doc_id, CASE WHEN {_BEST} = 0 THEN 'none' {" ".join(f"WHEN {n} = {_BEST} THEN '{n}'" for n in documents.PHASES)} END AS phase FROM h""")
def surgical_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat("text", F.when(i % 5 == 0, " incision and flap").when(i % 5 == 1, " closure of the wound").when(i % 5 == 2, " risk").otherwise(""))
    return docs(spark, sf_dir, "text").select("doc_id", documents.best_of(text, documents.PHASES, "none").alias("phase"))


@query(r"""
    WITH n AS (SELECT p_partkey, regexp_replace(trim(lower('  The  ' || p_name || '  ab ' || p_type)), '^(the|a|an)\s+', '') AS t FROM part),
    w AS (SELECT p_partkey, list_transform(regexp_extract_all(t, '[\p{L}0-9_]+|[^\p{L}0-9_]+'), lambda x: CASE x WHEN 'ab' THEN 'arterial branch' WHEN 'eco' THEN 'economy' WHEN 'red' THEN 'ab red' ELSE x END) AS p FROM n)
    SELECT p_partkey, trim(regexp_replace(array_to_string(p, ''), '\s+', ' ', 'g')) AS name FROM w""")
def entity_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  The  "), "p_name", F.lit("  ab "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", entities.normalised(raw, {"AB": "arterial branch", "eco": "economy", "red": "ab red"}).alias("name"))


@query("""
    SELECT user_id, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1""")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the earlier events brought up to date with the later ones."""
    e = table(spark, sf_dir, "events").withColumn("late", F.col("event_id") % 3 == 0)
    known = e.where("NOT late").groupBy("user_id").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return analytics.updated_means(known, e.where("late"), "user_id", "value").select("user_id", F.round("mean", 6).alias("mean"), "n")


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def row_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


_CLEAN = _SENTENCES.replace("regexp_replace(text,", "regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')),")


@query(f"""
    WITH s AS (SELECT doc_id, list_filter({_CLEAN}, lambda x: length(x) >= 5 AND NOT regexp_matches(x, '^[0-9 ■.-]+$') AND NOT regexp_matches(x, '^[A-Za-z]{{1,3}}\\.$')) AS s FROM documents)
    SELECT doc_id, list_transform(s, lambda x: CASE WHEN regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END) AS sentences FROM s""")
def clean_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "text").select("doc_id", documents.clean_sentences(F.col("text")).alias("sentences"))


_WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.001}


@query(f"""
    WITH d AS (SELECT doc_id, lang, md5(doc_id || '-7') AS h FROM documents), w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {max(1, int(120 * v))})" for k, v in _WEIGHTS.items())}) v(lang, n)),
    r AS (SELECT doc_id, lang, h, coalesce(row_number() OVER (PARTITION BY d.lang ORDER BY h, doc_id) <= n, FALSE) AS own FROM d LEFT JOIN w USING (lang))
    SELECT doc_id, lang FROM r ORDER BY own DESC, h, doc_id LIMIT 120""")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir, "lang").withColumn("h", F.md5(F.concat_ws("-", "doc_id", F.lit("7"))))
    return relational.weighted_sample(d, "lang", _WEIGHTS, 120, ["h", "doc_id"]).select("doc_id", "lang")


@query(r"""
    WITH RECURSIVE s AS (SELECT conv_id, turn, role || ' ' || array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')[1:(turn % 6)], ' ') AS title, turn % 3 AS level,
        array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')[1:(conv_id + turn) % 4 * 12], ' ') AS text FROM conversations),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n, len(list_filter(string_split(title, ' '), lambda w: w <> '')) < 5 AS brief FROM s),
    f AS (SELECT conv_id, k, 0 AS place, brief AND n < 30 AS waits, CASE WHEN brief AND n < 30 THEN n ELSE 0 END AS held FROM o WHERE k = 1
      UNION ALL SELECT o.conv_id, o.k, f.place + (NOT f.waits)::INTEGER, o.brief AND f.held + o.n < 30, CASE WHEN o.brief AND f.held + o.n < 30 THEN f.held + o.n ELSE 0 END FROM f JOIN o ON o.conv_id = f.conv_id AND o.k = f.k + 1),
    l AS (SELECT conv_id, max(place) AS last, arg_max(waits, k) AS open FROM f GROUP BY 1),
    g AS (SELECT conv_id, place, min(level) AS level, CASE WHEN count(*) = 1 THEN min(title) ELSE substr(string_agg(title, ' / ' ORDER BY k), 1, 100) END AS title, coalesce(string_agg(CASE WHEN text <> '' THEN text END, chr(10) || chr(10) ORDER BY k), '') AS text FROM f JOIN o USING (conv_id, k) GROUP BY 1, 2)
    SELECT g.conv_id, g.place AS position, g.title, g.level, g.text || coalesce(chr(10) || chr(10) || t.title || chr(10) || t.text, '') AS text FROM g JOIN l USING (conv_id) LEFT JOIN g t ON t.conv_id = g.conv_id AND t.place = g.place + 1 AND l.open AND t.place = l.last
    WHERE NOT (l.open AND g.place = l.last AND l.last > 0)""")
def section_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as sections, with titles and texts of different lengths."""
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    head = lambda n: F.array_join(F.slice(words, 1, n.cast("int")), " ")
    title = F.concat_ws(" ", "role", head(F.col("turn") % 6))
    title = F.when(F.col("turn") % 6 == 0, F.concat("role", F.lit(" "))).otherwise(title)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", title.alias("title"), (F.col("turn") % 3).alias("level"), head((F.col("conv_id") + F.col("turn")) % 4 * 12).alias("text"))
    return documents.merge_sections(turns, "conv_id", "turn")


@query("""
    WITH e AS (SELECT user_id, event_id, floor(epoch(ts) / 60)::BIGINT AS a, floor(epoch(ts) / 60)::BIGINT + 1 + event_id % 90 AS z, (event_id % 11) / 10.0::DOUBLE AS conf FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, conf DESC, z DESC, event_id) AS k FROM e WHERE conf >= 0.3),
    r AS (SELECT user_id, k, a, z, event_id, TRUE AS kept, z AS reach FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.a, o.z, o.event_id, o.a >= r.reach, CASE WHEN o.a >= r.reach THEN o.z ELSE r.reach END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT user_id, a, z, event_id FROM r WHERE kept""".replace("WITH e", "WITH RECURSIVE e"))
def surest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event spans of each user that don't overlap, the surest of those that start together."""
    minute = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    spans = table(spark, sf_dir, "events").select("user_id", minute.alias("a"), (minute + 1 + F.col("event_id") % 90).alias("z"), "event_id", ((F.col("event_id") % 11) / 10.0).alias("conf"))
    return documents.keep_apart(spans.select("user_id", "a", "z", "event_id", "conf"), ["user_id"], "a", "z", "conf", surest=True).select("user_id", "a", "z", "event_id")
