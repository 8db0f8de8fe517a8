"""Relations between entities of a text: pairs by distance, kinds by the words between, negation by scopes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.documents import relation_hash
from larkspur.operators.phrases import _mapped, longest_matches, tokens, trie_of
from larkspur.sources.files import cut_lineage

# Words that negate, patterns of the words between two entities by relation (the first that matches), and what they are worth.
NEGATION_CUES = (
    "no evidence", "not", "without", "absence of", "negative for", "unlikely", "failed to", "failed to demonstrate", "rules out", "ruled out", "excluded", "no", "never", "neither", "cannot",
    "couldn't", "won't", "wouldn't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't",
)
PATTERNS = {
    "supplies": (r"suppl\w*", r"perfus\w*", r"vasculariz\w*", r"blood\s+to", r"feeds?", r"nourish\w*"),
    "drains_to": (r"drain\w*", r"empties?\s+into", r"flows?\s+to", r"returns?\s+to"),
    "branches_from": (r"branch\w*\s+(?:from|of)", r"originat\w*", r"aris\w*\s+from", r"derives?\s+from", r"comes?\s+from"),
    "innervates": (r"innervat\w*", r"nerve\s+(?:to|supply)", r"motor\s+to", r"sensory\s+(?:to|from)"),
    "traverses": (r"travers\w*", r"pass\w*\s+through", r"cross\w*", r"runs?\s+through", r"courses?\s+through"),
    "adjacent_to": (r"adjacent\s+to", r"next\s+to", r"beside", r"lateral\s+to", r"medial\s+to", r"near"),
    "contained_in": (r"(?:with)?in", r"inside", r"contains?", r"houses?", r"located\s+in"),
    "causes": (r"caus\w*", r"results?\s+in", r"leads?\s+to", r"produc\w*", r"induces?"),
    "treats": (r"treats?", r"therap\w*", r"manag\w*", r"indicated\s+for"),
}
EXPECTED = {
    "supplies": (("T023", "T023"), ("T023", "T029")),
    "innervates": (("T023", "T023"),),
    "causes": (("T047", "T047"), ("T047", "T184")),
    "treats": (("T121", "T047"), ("T061", "T047")),
}
BASE, DIRECT, TYPED, DIRECT_CHARS = 0.65, 0.10, 0.15, 50
#: Words after which a negation no longer holds.
TERMINATORS = ("but", "however", "although", "though", "except", "yet", "nevertheless", "whereas")
#: A sentence ends after a mark before a capital letter, but for usual abbreviations.
_END = regex.compile(r"(?<!\b(?:Dr|Fig|No|al|vs|Vol|pp|Ch|Sec))[.!?](?=\s+\p{Lu})")


def scopes(text: str, trie: dict, opens: Mapping[str, str | None]) -> list[tuple[int, str | None]]:
    """(start, cue): where the cue that holds becomes another one, or null, in ``text``."""
    marks = [(start, opens[term]) for start, _, _, _, term in longest_matches(text, trie)]
    out, holds = [], None
    for start, cue in sorted([*marks, *((m.start(), None) for m in _END.finditer(text))] if marks else [], key=lambda m: m[0]):
        if cue != holds:
            out.append((start, cue))
            holds = cue
    return out


def negated(spans: DataFrame, df: DataFrame, id_col: str, text_col: str, cues: Sequence[str] = NEGATION_CUES, terminators: Sequence[str] = TERMINATORS) -> DataFrame:
    """``spans`` (id_col, start, stop, ...) with the cue that negates each, null where none does.

    Cues open a scope, terminators and ends of sentences close it: a sweep over the places where
    these change what holds and the spans of a text in order, where a span takes the last one before it. Longer
    cues come before shorter ones within them.
    """
    opens: dict[str, str | None] = {}
    for mark, cue in [*((c, c) for c in cues), *((t, None) for t in terminators)]:
        opens.setdefault(" ".join(tokens(mark)), cue)
    kind = df.schema[id_col].dataType.simpleString()
    events = _mapped(df, [id_col, text_col], f"{id_col} {kind}, start int, cue string", lambda trie, i, text: [(i, *s) for s in scopes(text or "", trie, opens)], lambda: trie_of([k.split() for k in opens if k]))
    both = events.select(id_col, "start", F.struct("cue").alias("mark"), F.lit(0).alias("_what")).unionByName(spans.withColumn("_what", F.lit(1)), allowMissingColumns=True)
    sweep = Window.partitionBy(id_col).orderBy("start", "_what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("cue", F.last("mark", ignorenulls=True).over(sweep)["cue"]).where("_what = 1").select(*spans.columns, "cue")


def kind_between(context: Column, source_class: Column, target_class: Column, patterns: Mapping[str, Sequence[str]] = PATTERNS, expected: Mapping[str, Sequence[tuple[str, str]]] = EXPECTED) -> Column:
    """(relation, confidence) of the surest pattern in the words between two entities, the first of equals; null if none is there."""
    low, found = F.lower(context), []
    for place, (relation, listed) in enumerate(patterns.items()):
        typed = F.lit(False)
        for a, b in expected.get(relation, ()):
            typed = typed | ((source_class == a) & (target_class == b)) | ((source_class == b) & (target_class == a))
        worth = F.least(F.lit(1.0), BASE + F.when(F.length(context) < DIRECT_CHARS, DIRECT).otherwise(0.0) + F.when(typed, TYPED).otherwise(0.0))
        found.append(F.when(low.rlike("|".join(listed)), F.struct(worth.alias("confidence"), F.lit(-place).alias("order"), F.lit(relation).alias("relation"))))
    return F.array_max(F.array(*found))


def entity_relations(df: DataFrame, id_col: str, text_col: str, spans: DataFrame, patterns: Mapping[str, Sequence[str]] = PATTERNS, expected: Mapping[str, Sequence[tuple[str, str]]] = EXPECTED, apart: int = 200, cues: Sequence[str] = NEGATION_CUES, terminators: Sequence[str] = TERMINATORS) -> DataFrame:
    """(hash, source, target, relation, is_negated, cue, confidence, mentions): relations of entities in all texts, once each.

    ``spans`` has (id_col, start, stop, concept, class). An entity is paired with those that begin up to
    ``apart`` characters after its end, so pairs grow with the text and not with its square. The
    words between tell the relation. A pair is negated if either entity is, or a cue stands between them.
    The same relation, negated or not, comes once with its greatest confidence and the number of its mentions. Ids are unique.
    """
    spans = cut_lineage(spans)  # looked at twice
    marked = negated(spans.select(id_col, "start", "stop", "concept", "class"), df, id_col, text_col, cues, terminators)
    longest = spans.agg(F.max(F.col("stop") - F.col("start"))).first()[0] or 0
    ahead = Window.partitionBy(id_col).orderBy("start").rangeBetween(0, apart + longest)
    this = F.struct("start", "stop", "concept", "class", "cue")
    paired = marked.withColumn("_next", F.collect_list(this).over(ahead)).withColumn("_t", F.explode("_next"))
    gap = F.col("_t.start") - F.col("stop")
    paired = paired.where((gap >= 0) & (gap <= apart) & (F.col("_t.start") > F.col("start"))).select(id_col, F.struct("stop", F.col("_t.start").alias("to"), "concept", "class", F.coalesce("cue", "_t.cue").alias("cue"), F.col("_t.concept").alias("other"), F.col("_t.class").alias("other_class")).alias("p"))
    grouped = paired.groupBy(id_col).agg(F.collect_list("p").alias("_pairs"))
    texts = df.select(id_col, F.col(text_col).alias("_text")).join(grouped, id_col)
    fields = ("concept", "class", "cue", "other", "other_class")
    kinds = dict(marked.select("concept", "class", "cue", F.col("concept").alias("other"), F.col("class").alias("other_class")).dtypes)
    # a worker cuts the words between out of the text, as Spark's substring counts from the start of the text each time
    each = _mapped(texts, ["_text", "_pairs"], ", ".join(f"{c} {kinds[c]}" for c in fields) + ", context string", lambda text, pairs: [(*(p[c] for c in fields), text[p["stop"] : p["to"]]) for p in pairs])
    found = each.withColumn("k", kind_between(F.col("context"), F.col("class"), F.col("other_class"), patterns, expected)).where("k is not null")
    rows = found.select(F.col("concept").alias("source"), F.col("other").alias("target"), "k.relation", F.col("cue").isNotNull().alias("is_negated"), "cue", "k.confidence")
    hashed = rows.withColumn("hash", relation_hash(F.col("source"), F.col("target"), F.col("relation"), F.col("is_negated")))
    return hashed.groupBy("hash", "source", "target", "relation", "is_negated").agg(F.min("cue").alias("cue"), F.max("confidence").alias("confidence"), F.count("*").alias("mentions"))
