"""Rule tables applied to text: expansion, extraction, gaps, interactions, formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as tx

# Fixed values of the tracked memory model.
TRACKED = (0.4072, 1.1829, 3.1262, 15.4722, 7.2102, 0.5316, 1.0651, 0.0046, 1.5352, 0.1192, 1.0507, 0.0028, 2.4028, 0.1131, 0.2909, 2.2271, 0.0272)
TRACKS = {"procedural": (0.90, 365), "factual": (0.92, 180), "csp": (0.95, 90)}
GRADES = ((0.85, "A"), (0.70, "B"), (0.55, "C"))


def expand(text: Column, abbreviations: Mapping[str, str], synonyms: Mapping[str, Sequence[str]], most: int = 2) -> Column:
    """``text`` with the long form after each abbreviation, then up to ``most`` new synonyms of each term in it."""
    for short, long in abbreviations.items():
        text = F.regexp_replace(text, rf"(?i)\b({short})\b", f"$1 {long}")
    low = F.lower(text)
    added = [F.when(low.contains(term.lower()) & ~low.contains(s.lower()), s) for term, listed in synonyms.items() for s in listed[:most]]
    return F.concat_ws(" ", text, *added)


def concepts(text: Column, ids: Mapping[str, str]) -> Column:
    """Sorted ids of the concepts whose name occurs."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(name.lower()), i) for name, i in ids.items())))))


def extract(df: DataFrame, keys: Sequence[str], text_col: str, patterns: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(keys, kind, found): group of every match of each (kind, pattern, group), one pass over the text for each pattern."""
    found = F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(g)).alias("found")) for kind, p, g in patterns))
    each = df.select(*keys, F.explode(found).alias("_x")).select(*keys, "_x.kind", F.explode("_x.found").alias("found"))
    return each.withColumn("found", F.trim("found"))


def relations(df: DataFrame, keys: Sequence[str], text_col: str, patterns: Sequence[tuple[str, str]], entities: DataFrame) -> DataFrame:
    """(keys, s, rel, t, conf): both groups of each (relation, pattern), where both name an entity (columns name, conf); the lesser confidence counts."""
    mentions = F.array(*(F.struct(F.lit(rel).alias("rel"), F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(1)).alias("s"), F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(2)).alias("t")) for rel, p in patterns))
    pairs = df.select(*keys, F.explode(mentions).alias("_m")).select(*keys, "_m.rel", F.explode(F.arrays_zip(F.col("_m.s").alias("s"), F.col("_m.t").alias("t"))).alias("_p"))
    pairs = pairs.select(*keys, "rel", F.lower("_p.s").alias("s"), F.lower("_p.t").alias("t"))
    known = entities.select(F.lower("name").alias("name"), "conf")
    joined = pairs.join(known.select(F.col("name").alias("s"), F.col("conf").alias("_c")), "s").join(known.select(F.col("name").alias("t"), F.col("conf").alias("_d")), "t")
    return joined.groupBy(*keys, "s", "rel", "t").agg(F.max(F.least("_c", "_d")).alias("conf"))


def coverage_gaps(df: DataFrame, keys: Sequence[str], text_col: str, rules: DataFrame) -> DataFrame:
    """(keys, zone, priority): rules (zone, frequency) of which a text has no word of more than three letters. Rules are few and broadcast."""
    listed = rules.agg(F.collect_list(F.struct("zone", "frequency")).alias("_rules"))
    low = F.lower(text_col)

    def missing(r: Column) -> Column:
        terms = F.filter(F.split(F.lower(r["zone"]), " "), lambda w: F.length(w) > 3)
        return ~F.exists(terms, lambda w: low.contains(w)) & ~low.contains(F.lower(r["zone"]))

    each = df.join(F.broadcast(listed)).select(*keys, F.explode(F.filter("_rules", missing)).alias("_r"))
    return each.select(*keys, "_r.zone", F.when(F.col("_r.frequency") == "common", "CRITICAL").otherwise("HIGH").alias("priority"))


def inappropriate(df: DataFrame, keys: Sequence[str], text_col: str, stage: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(keys, term): rules (stage, term, pattern) of the row's stage where the first three long words of the term occur and the pattern stands before one."""
    low = F.lower(text_col)
    hits = []
    for when, term, pattern in rules:
        words = [w for w in term.lower().split() if len(w) > 3][:3]
        hit = F.col(stage) == when
        for w in words:
            hit = hit & low.contains(w)
        hits.append(F.when(hit & low.rlike(f"(?s){pattern}.*{words[0] if words else term.lower()}"), F.lit(term)))
    return df.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("term"))


def interactions(items: DataFrame, key: str, item: str, table: DataFrame) -> DataFrame:
    """(key, a, b, severity): pairs of a key's items that the interaction table (a, b, severity) lists, in either order; joins go through the table."""
    mine = items.select(key, item).distinct()
    either = table.select("a", "b", "severity").unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b"), "severity")).where("a < b").distinct()
    first = mine.join(either, F.col(item) == F.col("a")).select(key, "a", "b", "severity")
    return first.join(mine.select(key, F.col(item).alias("b")), [key, "b"]).select(key, "a", "b", "severity")


def triggered(cases: DataFrame, key: str, words: str, rules: DataFrame) -> DataFrame:
    """(key, rule, severity): rules with a trigger among a case's words and none of their exceptions; an escalating state raises the severity.

    Triggers are exploded, so candidates come from a join on equality.
    """
    each = cases.select(key, words, "state", F.explode(words).alias("w"))
    triggers = rules.select("rule", "severity", "exceptions", "escalates", F.explode("triggers").alias("w"))
    met = each.join(triggers, "w").where(F.size(F.array_intersect(words, "exceptions")) == 0)
    severity = F.when(F.col("state") == F.col("escalates"), "CRITICAL").otherwise(F.col("severity"))
    return met.select(key, "rule", severity.alias("severity")).distinct()


def synthesis_score(sections: Column, expected: Column, words: Column, least: int, most: int, authority: Column, requested: Column, resolved: Column, figures: Column, conflicts: Column, gaps: Column) -> tuple[Column, Column]:
    """(score, grade) from coverage 0.40, authority 0.25, figures 0.15 and coherence 0.20."""
    covered = F.least(F.lit(1.0), sections / F.greatest(expected, F.lit(1)))
    long = F.least(F.lit(1.0), words / least)
    content = (covered * 0.5 + long * 0.5 - F.when(words > most * 1.2, 0.1).otherwise(0.0)) * 0.40
    rate = F.when(requested > 0, resolved / requested).otherwise(0.5)
    visual = rate * 0.10 + F.when(figures > 0, 0.05).otherwise(0.0)
    coherence = F.greatest(F.lit(0.0), 0.20 - F.least(F.lit(0.15), conflicts * 0.03) - F.least(F.lit(0.10), gaps * 0.05))
    score = content + authority * 0.25 + visual + coherence
    grade = F.lit("D")
    for bound, name in reversed(GRADES):
        grade = F.when(score >= bound, name).otherwise(grade)
    return score, grade


def markdown_table(rows: Column) -> Column:
    """An array of arrays of strings, the first being the head, as a Markdown table."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def parse_markdown_table(text: Column) -> Column:
    """The rows of a Markdown table as arrays of cells, without the rule."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s).startswith("|") & ~s.rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    return F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def format_context(rows: DataFrame, group: str, order: str, text_col: str, title_col: str, style: str = "numbered") -> DataFrame:
    """(group, context): a group's chunks in order as one text, numbered, XML or Markdown; a group is one query's bounded context."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    shapes = {"numbered": ("[", "] ", "\n"), "xml": ('<source id="', '">', "</source>"), "markdown": ("### ", ". ", "\n")}
    a, b, c = shapes[style]
    piece = F.concat(F.lit(a), n.cast("string"), F.lit(b), F.col(title_col), F.lit("\n"), F.col(text_col), F.lit(c))
    pieces = rows.select(group, n.alias("n"), piece.alias("p")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("n", "p"))).alias("ps"))
    return pieces.select(group, F.array_join(F.transform("ps", lambda x: x["p"]), "\n").alias("context"))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: shared words over those of the smaller set."""
    x, y = tx.tokens(a), tx.tokens(b)
    small = F.least(F.size(x), F.size(y))
    return F.when(small > 0, 100.0 * F.size(F.array_intersect(x, y)) / small).otherwise(0.0)


def search_catalog(df: DataFrame, text_cols: Sequence[str], asked: str | None = None, equal: Mapping[str, object] | None = None, at_least: Mapping[str, float] | None = None, at_most: Mapping[str, float] | None = None) -> DataFrame:
    """Rows that meet every condition given: a substring of any text column in any case, equalities and bounds."""
    if asked:
        hit = F.lit(False)
        for c in text_cols:
            hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(asked.lower())
        df = df.where(hit)
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    for c, v in (at_least or {}).items():
        df = df.where(F.col(c) >= v)
    for c, v in (at_most or {}).items():
        df = df.where(F.col(c) <= v)
    return df


def tracked_interval(stability: Column, track: str) -> Column:
    """Days until recall falls to the track's retention, within its cap."""
    import math

    retention, cap = TRACKS[track]
    return F.greatest(F.lit(1.0), F.least(F.lit(float(cap)), stability * (math.log(retention) / math.log(0.9))))


def tracked_difficulty(difficulty: Column, rating: Column) -> Column:
    w = TRACKED
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), difficulty + (rating - 3) * w[14] + w[14] * (w[15] - difficulty)))


def tracked_stability(stability: Column, difficulty: Column, recall: Column, rating: Column, lapses: Column) -> Column:
    """Stability after a review with the new difficulty; a lapse (rating 1) starts low again."""
    w = TRACKED
    bonus = F.when(rating == 2, w[7]).when(rating == 4, w[8]).otherwise(1.0)
    grown = stability * (1 + F.exp(F.lit(w[6])) * (11 - difficulty) * F.pow(stability, F.lit(-w[5])) * F.exp(w[9] * (1 - recall)) * bonus * F.exp(-w[16] * lapses))
    lost = F.greatest(F.lit(0.1), stability * F.exp(F.lit(w[10])) * F.pow(difficulty, F.lit(-w[11])) * (F.pow(stability + 1, F.lit(w[12])) - 1) * F.exp(w[13] * (1 - recall)))
    return F.when(rating == 1, lost).otherwise(grown)


def preview(cards: DataFrame) -> DataFrame:
    """A row of each card for each of the four ratings."""
    return cards.withColumn("rating", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
