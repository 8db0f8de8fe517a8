"""Rules on what a text says: superseded practice, old citations, prohibitions and their violations, facts and their conflicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators.entities import first_shared, rare_words
from larkspur.sources.files import cut_lineage

# Fixed values of the rules below.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "INFORMATIONAL")
CONTEXT = 50
INDICATORS = ("recommend", "administer", "give", "use", "initiate", "start", "consider", "prescribe")
KEY_WORDS, KEY_TERMS, LONG_WORD = 5, 3, 3
#: Percentages conflict, and are of medium and high severity, from so many points; other measures from so many hundredths of the larger.
POINTS, HUNDREDTHS = (3.0, 10.0, 20.0), (20.0, 30.0, 50.0)
#: Mentions of one topic and unit that meet each other without regard to their words.
TOGETHER = 256


@dataclass(frozen=True)
class Practice:
    """A practice that newer advice replaces: words of which one must occur (none: any text), and a pattern that shows it."""

    name: str
    severity: str
    words: tuple[str, ...]
    pattern: str
    advice: str


def sentences(text: Column) -> Column:
    """Parts of a text after . ! or ? and white space."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\u0001"), "\u0001")


def superseded(df: DataFrame, keys: Sequence[str], text_col: str, practices: Sequence[Practice]) -> DataFrame:
    """(keys, name, severity, rank, detected, context, advice): practices that a text shows, with the first place and 50 characters around it.

    One pass over the text for each practice; rank orders severities, the worst first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = []
    for p in practices:
        near = F.lit(not p.words)
        for w in p.words:
            near = near | F.lower(text).contains(w.lower())
        pattern = f"(?i){p.pattern}"
        found = F.regexp_extract(text, pattern, 0)
        start = F.length(F.get(F.split(text, pattern, 2), 0))
        first = F.greatest(F.lit(0), start - CONTEXT)
        context = F.substr(text, first + 1, start - first + F.length(found) + CONTEXT)
        fields = (F.lit(p.name).alias("name"), F.lit(p.severity).alias("severity"), F.lit(SEVERITIES.index(p.severity)).alias("rank"), found.alias("detected"), context.alias("context"), F.lit(p.advice).alias("advice"))
        hits.append(F.when(near & text.rlike(pattern), F.struct(*fields)))
    return df.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("_h")).select(*keys, "_h.*")


def old_citations(df: DataFrame, year: str, topic: str, now: int, most_years: int = 10, critical: Sequence[str] = ()) -> DataFrame:
    """Rows whose year is more than ``most_years`` before ``now``, with their age and a severity that is HIGH for critical topics; rows without a year are left out."""
    hot = F.lit(False)
    for word in critical:
        hot = hot | F.lower(F.coalesce(F.col(topic), F.lit(""))).contains(word.lower())
    aged = df.withColumn("age_years", F.lit(now) - F.col(year))
    return aged.where(F.col("age_years") > most_years).withColumn("severity", F.when(hot, "HIGH").otherwise("MEDIUM"))


def prohibitions(df: DataFrame, key: str, text_col: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, severity, action, sentence): what a text forbids, by (severity, pattern with one group), once for each first five words of an action.

    Of equal beginnings the first stays: by sentence, then pattern, then place.
    """
    each = df.select(key, F.posexplode(sentences(F.col(text_col))).alias("i", "sentence"))
    found = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(severity).alias("severity"), F.regexp_extract_all("sentence", F.lit(f"(?i){p}"), F.lit(1)).alias("actions")) for n, (severity, p) in enumerate(patterns)))
    each = each.select(key, "i", "sentence", F.explode(found).alias("f")).select(key, "i", "sentence", "f.n", "f.severity", F.posexplode("f.actions").alias("m", "action"))
    action = F.trim("action")
    begin = F.array_join(F.slice(tx.words(F.lower(action)), 1, KEY_WORDS), " ")
    first = F.min(F.struct("i", "n", "m", "severity", action.alias("action"), F.trim("sentence").alias("sentence"))).alias("f")
    return each.groupBy(key, begin.alias("_begin")).agg(first).select(key, "f.severity", "f.action", "f.sentence")


def violations(df: DataFrame, key: str, text_col: str, rules: DataFrame) -> DataFrame:
    """(key, action, severity): rules (action, severity) whose first three long words a text has, together with a word that recommends. Rules are few and broadcast."""
    listed = rules.agg(F.collect_list(F.struct("action", "severity")).alias("_rules"))
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    advised = F.lit(False)
    for word in INDICATORS:
        advised = advised | low.contains(word)

    def mentioned(rule: Column) -> Column:
        terms = F.slice(F.filter(F.split(F.lower(rule["action"]), r"\s+"), lambda w: F.length(w) > LONG_WORD), 1, KEY_TERMS)
        return F.forall(terms, lambda w: low.contains(w))

    each = df.where(advised).join(F.broadcast(listed)).select(key, F.explode(F.filter("_rules", mentioned)).alias("_r"))
    return each.select(key, "_r.action", "_r.severity")


def facts(df: DataFrame, keys: Sequence[str], text_col: str, units: Sequence[str], recommends: Sequence[str], temporal: Sequence[str]) -> DataFrame:
    """(keys, kind, value, unit, is_temporal, claim) for percentages, measurements in ``units`` and sentences that recommend."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = r"(\d+(?:\.\d+)?)"

    def numbers(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(x, pattern, 1).alias("value"), F.regexp_extract(x, pattern, 2).alias("unit"), F.lit(False).alias("is_temporal"), x.alias("claim")))

    low = lambda s: F.lower(s)
    said = F.filter(sentences(text), lambda s: low(s).rlike("|".join(recommends)))
    advice = F.transform(said, lambda s: F.struct(F.lit("recommendation").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("unit"), low(s).rlike("|".join(temporal)).alias("is_temporal"), F.trim(s).alias("claim")))
    measured = rf"(?i)\b{number}\s*({'|'.join(units)})\b"
    every = F.concat(numbers("percent", rf"\b{number}\s*(%)"), numbers("measure", measured), advice)
    return df.select(*keys, F.explode(every).alias("_f")).select(*keys, "_f.*")


def mentions(df: DataFrame, keys: Sequence[str], text_col: str, pattern: str, before: int, after: int) -> DataFrame:
    """(keys, n, value, unit, words): every match of ``pattern`` (groups: number, unit) with the distinct words from ``before`` characters ahead of it to ``after`` behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = df.select(*keys, text.alias("_t"), F.split(text, pattern, -1).alias("_b"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_f"))
    length = lambda parts, n: F.aggregate(F.slice(F.col(parts), 1, n), F.lit(0), lambda s, x: s + F.length(x))
    each = cut.select(*keys, "_t", "_b", "_f", F.posexplode("_f").alias("n", "_m"))
    each = each.withColumn("_at", length("_b", F.col("n") + 1) + length("_f", F.col("n")))
    first = F.greatest(F.lit(0), F.col("_at") - before)
    near = F.substr("_t", first + 1, F.col("_at") - first + F.length("_m") + after)
    words = F.array_distinct(F.regexp_extract_all(F.lower(near), F.lit(r"[\p{L}0-9_]+"), F.lit(0)))
    unit = F.regexp_replace(F.lower(F.regexp_extract("_m", pattern, 2)), "s+$", "")
    return each.select(*keys, "n", F.regexp_extract("_m", pattern, 1).cast("double").alias("value"), unit.alias("unit"), words.alias("words"))


def number_conflicts(mentioned: DataFrame, shared: int = 2) -> DataFrame:
    """(a, b, av, bv, severity) of mentions (id, topic, src, unit, value, words) of different sources on one topic and unit with ``shared`` words or more in common, if far enough apart.

    Mentions of a topic and unit meet where these are ``TOGETHER`` at most. In larger groups they
    meet on one of their rarest words as well, so a word that all of them have makes no pairs there. Then all words decide. Ids are unique.
    """
    each = mentioned.select("id", "topic", "src", "unit", "value", F.array_distinct("words").alias("words"))
    crowds = cut_lineage(each.groupBy("topic", "unit").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("topic", "unit"))

    def side(d: DataFrame, i: str, *more: str | Column) -> DataFrame:
        return d.select("topic", "unit", F.col("id").alias(i), F.col("src").alias(f"s{i}"), F.col("value").alias(f"{i}v"), F.col("words").alias(f"w{i}"), *more)

    some = not crowds.isEmpty()
    columns = ["a", "b", "sa", "sb", "av", "bv", "unit", "wa", "wb"]
    apart = each.join(crowds, ["topic", "unit"], "left_anti") if some else each
    met = side(apart, "a").join(side(apart, "b"), ["topic", "unit"]).select(*columns)
    if some:
        crowded = each.join(crowds, ["topic", "unit"], "left_semi")
        counts = crowded.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        rare = rare_words(crowded, counts, shared)
        a, b = (side(rare, i, "w", F.col("rare").alias(f"r{i}")) for i in ("a", "b"))
        met = met.unionByName(a.join(b, ["topic", "unit", "w"]).where(F.col("w") == first_shared("ra", "rb")).select(*columns))
    met = met.where((F.col("a") < F.col("b")) & (F.col("sa") != F.col("sb")))
    percent, gap = F.col("unit") == "%", F.abs(F.col("av") - F.col("bv"))
    far = F.when(percent, gap).otherwise(100 * F.try_divide(gap, F.greatest("av", "bv")))
    bounds = [F.when(percent, x).otherwise(y) for x, y in zip(POINTS, HUNDREDTHS, strict=True)]
    met = met.where((far > bounds[0]) & (F.size(F.array_intersect("wa", "wb")) >= shared))
    severity = F.when(far < bounds[1], "low").when(far <= bounds[2], "medium").otherwise("high")
    return met.select("a", "b", "av", "bv", severity.alias("severity"))
