"""Writing entities and links: id maps, missing entities, population from chunks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.relational import latest

#: A word in more facts than this is frequent.
FREQUENT = 100_000


def synthetic_id(text: Column) -> Column:
    """Id of an entity that no dictionary knows: a mark and eight digits of a digest of its text."""
    return F.concat(F.lit("REGEX_"), F.substring(F.md5(F.lower(text)), 1, 8))


def normalised(text: Column, abbreviations: Mapping[str, str]) -> Column:
    """An entity's name in lower case without a leading article, with words that are abbreviations written out, and with single spaces."""
    bare = F.regexp_replace(F.trim(F.lower(text)), r"^(the|a|an)\s+", "")
    if abbreviations:
        known = F.create_map(*(F.lit(x.lower() if k % 2 == 0 else x) for k, x in enumerate(y for pair in abbreviations.items() for y in pair)))
        parts = F.regexp_extract_all(bare, F.lit(r"[\p{L}0-9_]+|[^\p{L}0-9_]+"), F.lit(0))
        bare = F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(known, w), w)), "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def map_ids(links: DataFrame, chunk_ids: DataFrame, image_ids: DataFrame) -> DataFrame:
    """``links`` (chunk, image, ...) with the stored ids of both maps (outer, id); links without either are dropped."""
    c = chunk_ids.select(F.col("outer").alias("chunk"), F.col("id").alias("chunk_id"))
    i = image_ids.select(F.col("outer").alias("image"), F.col("id").alias("image_id"))
    return links.join(c, "chunk").join(i, "image").drop("chunk", "image")


def upsert_links(old: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """One link for each pair of ids, the last of both tables by ``order``."""
    return latest(old.unionByName(new), ["chunk_id", "image_id"], [F.col(c) for c in order])


def missing_entities(entities: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(id, name) for each mentioned name that no entity has in any case; ids are digests, so a retry gives the same ones."""
    known = entities.select(F.lower("name").alias("key"))
    new = mentioned.select(F.lower(F.trim("name")).alias("key")).distinct().join(known, "key", "left_anti")
    return new.select(F.md5("key").alias("id"), F.col("key").alias("name"))


def populate(chunks: DataFrame, id_col: str) -> DataFrame:
    """(cui, chunks): chunks of each concept (column cuis, once for each mention) and of each text (column texts) as a synthetic concept, once for each distinct text of a chunk."""
    known = chunks.select(id_col, F.explode("cuis").alias("cui"))
    unknown = chunks.select(id_col, F.explode(F.array_distinct(F.transform("texts", lambda t: F.lower(F.trim(t))))).alias("t")).select(id_col, synthetic_id(F.col("t")).alias("cui"))
    return known.union(unknown).groupBy("cui").agg(F.count("*").alias("chunks"))


def mention_counts(chunks: DataFrame, document: str, cuis: str, entities: DataFrame) -> DataFrame:
    """(document, cui, n): mentions of known entities in each document."""
    each = chunks.select(document, F.explode(cuis).alias("cui"))
    return each.join(entities.select("cui").distinct(), "cui", "left_semi").groupBy(document, "cui").agg(F.count("*").alias("n"))


def members_left(rows: DataFrame, key: str, lists: DataFrame, member: str, kept: Sequence[str]) -> DataFrame:
    """``rows`` with the rows of ``lists`` whose array ``member`` holds their key, all kept: a left join on the exploded array."""
    each = lists.select(F.explode(member).alias(key), *kept)
    return rows.join(each, key, "left")


def clean_path(storage: Column, file: Column) -> Column:
    """Where an image lies: the storage path if there is one, without the folder that exports put before it."""
    return F.regexp_replace(F.coalesce(F.nullif(storage, F.lit("")), file), "^output/images/", "")


def rare_words(facts: DataFrame, counts: DataFrame, shared: int) -> DataFrame:
    """``facts`` once for each of its rarest words w, all but ``shared - 1``, with all of these as the array rare; sets that share ``shared`` words share one of these.

    ``counts`` has (w, n) for all words; ties sort by word, so both sides rank words alike. Only
    ids and words go through the ranking, and words in more than FREQUENT facts, which are few, are
    sent to the facts, so that a word that all have lands in no single task. Ids are unique.
    """
    each = facts.select("id", F.explode("words").alias("w"))
    frequent = F.broadcast(counts.where(F.col("n") > FREQUENT))
    counted = each.join(frequent, "w").unionByName(each.join(frequent, "w", "left_anti").join(counts.where(F.col("n") <= FREQUENT), "w"))
    ranked = counted.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("_o"))
    rare = F.slice("_o", 1, F.greatest(F.lit(0), F.size("words") - shared + 1))
    return facts.join(ranked, "id").withColumn("rare", rare).drop("_o").withColumn("w", F.explode("rare"))


def first_shared(a: str, b: str) -> Column:
    """The first rare word that two sides share: a pair that meets under several counts under this one."""
    return F.get(F.array_intersect(a, b), 0)


def fact_conflicts(inside: DataFrame, outside: DataFrame, shared: int = 3, apart: float = 0.15) -> DataFrame:
    """(a, b): facts (id, unit, value, words) of two sides with one unit, ``shared`` words or more in common and values more than ``apart`` of the larger one different.

    Ids are unique. Facts meet on unit and one of their rarest words only, so words that are
    everywhere make no pairs; pairs are then verified on all words.
    """
    sides = [d.select("id", "unit", "value", F.array_distinct("words").alias("words")) for d in (inside, outside)]
    counts = sides[0].unionByName(sides[1]).select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    a, b = (rare_words(d, counts, shared) for d in sides)
    a = a.select("w", "unit", F.col("id").alias("a"), F.col("value").alias("x"), F.col("words").alias("words_a"), F.col("rare").alias("rare_a"))
    b = b.select("w", "unit", F.col("id").alias("b"), F.col("value").alias("y"), F.col("words").alias("words_b"), F.col("rare").alias("rare_b"))
    met = a.join(b, ["unit", "w"]).where(F.abs(F.col("x") - F.col("y")) > apart * F.greatest(F.abs("x"), F.abs("y")))
    once = met.where(F.col("w") == first_shared("rare_a", "rare_b"))
    return once.where(F.size(F.array_intersect("words_a", "words_b")) >= shared).select("a", "b")
