"""Vector search, score adjustments, fusion, reranking and diversity."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import jaccard
from larkspur.functions.vector import cosine, dot

#: Fixed values of the score chain.
RRF_K = 60
#: Queries in a block of a search for many.
QUERY_BLOCK = 256
TYPE_BOOST = 1.15
CUI_BOOST = 1.2
AUTHORITY_BASE, AUTHORITY_RATE = 0.7, 0.15
FRONT_MATTER = 0.1
IMAGE_SHARE = 0.9
LINK_SCORE, LINKS_EACH = 0.5, 3
QUALITY_WEIGHTS = {"authority": 0.30, "readability": 0.20, "coherence": 0.20, "completeness": 0.20, "kind": 0.10}
#: Words that tell what a query asks for; the first list with a hit wins.
INTENTS = {
    "procedure": ("approach", "technique", "procedure", "craniotomy", "resection", "dissection", "how to", "step", "surgical", "incision", "exposure", "retraction", "clipping", "coiling", "decompression"),
    "anatomy": ("anatomy", "structure", "nerve", "artery", "vein", "cistern", "fissure", "sulcus", "gyrus", "nucleus", "foramen", "sinus", "where is", "location of", "relationship"),
    "pathology": ("tumor", "meningioma", "schwannoma", "glioma", "aneurysm", "malformation", "disease", "pathology", "lesion", "diagnosis"),
}


def gathered(queries: DataFrame, member: Column) -> DataFrame:
    """Blocks of about QUERY_BLOCK of ``queries`` (query_id ...), each an array _qs of ``member``. A row then meets blocks and not single queries."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    return queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_b")).agg(F.collect_list(member).alias("_qs")).select("_qs")


def scored(df: DataFrame, queries: DataFrame, vector: str = "embedding", name: str = "similarity") -> DataFrame:
    """``df`` once for each of ``queries`` (query_id, q), with query_id and the cosine of its vector to ``q``.

    Queries are gathered in blocks of about QUERY_BLOCK, so a row of ``df`` meets blocks and
    not single queries; Spark sends the blocks to all executors only if their size allows.
    A vector's own length is computed once, not once for each pair.
    """
    member = F.struct("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"), dot(F.col("q"), F.col("q")).alias("qq"))

    def score(x: Column) -> Column:
        size = F.sqrt(F.col("_vv") * x["qq"])
        return F.struct(x["query_id"].alias("query_id"), F.when(size > 0, dot(F.col(vector), x["q"]) / size).otherwise(0.0).alias("s"))

    met = df.withColumn("_vv", dot(F.col(vector), F.col(vector))).crossJoin(gathered(queries, member))
    return met.withColumn("_x", F.explode(F.transform("_qs", score))).select("_x.query_id", *df.columns, F.col("_x.s").alias(name))


def top_k(df: DataFrame, score: str, tie: str, k: int, least: float | None = None, stage: str = "before", key: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best rows of each ``key``, or of all; a least score applies before the limit, or after it, which may leave fewer. None means no least score; 0.0 is one."""
    if stage not in ("before", "after"):
        raise ValueError("stage is before or after")
    keep = F.lit(True) if least is None else F.col(score) >= least
    if stage == "before":
        df = df.where(keep)
    if key:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), tie))
        best = df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    else:
        best = df.orderBy(F.desc(score), tie).limit(k)
    return best if stage == "before" else best.where(keep)


def over_fetch(k: int, filtered: bool, hybrid: bool = False) -> int:
    """How many candidates a search for ``k`` results takes: ten times as many with filters that come later, else three times for hybrid and twice for plain ones."""
    return k * (10 if filtered else 3 if hybrid else 2)


def step_boost(concepts: Column, asked: Column, boost: float = CUI_BOOST) -> Column:
    """``boost`` if any asked concept is there, else 1."""
    return F.when(F.size(F.array_intersect(concepts, asked)) > 0, boost).otherwise(1.0)


def linear_boost(concepts: Column, asked: Column, boost: float = CUI_BOOST) -> Column:
    """From 1 to ``boost`` with the share of the asked concepts that is there."""
    share = F.size(F.array_intersect(concepts, asked)) / F.greatest(F.size(asked), F.lit(1))
    return 1 + (boost - 1) * F.least(share, F.lit(1.0))


def type_boost(kind: Column, wanted: str, boost: float = TYPE_BOOST) -> Column:
    return F.when(kind == wanted, boost).otherwise(1.0)


def authority_boost(authority: Column, kind: Column, front: str = "front_matter") -> Column:
    """Around 1 with the authority, 0.7 where it is missing or 0; a tenth for front matter."""
    known = F.when(F.coalesce(authority, F.lit(0.0)) == 0, AUTHORITY_BASE).otherwise(authority)
    return F.when(kind == front, FRONT_MATTER).otherwise(1 + (known - AUTHORITY_BASE) * AUTHORITY_RATE)


def detect_intent(text: Column) -> Column:
    """The first intent one of whose words occurs; null if none does."""
    low = F.lower(text)
    found = F.lit(None).cast("string")
    for intent, listed in reversed(INTENTS.items()):
        hit = F.lit(False)
        for w in listed:
            hit = hit | low.contains(w)
        found = F.when(hit, intent).otherwise(found)
    return found


def reciprocal_rank_fusion(lists: Sequence[tuple[DataFrame, float]], query: str, item: str, score: str, each: int, k: int) -> DataFrame:
    """(query, item, score): of each query the ``k`` best by summed weight / (60 + rank + 1) over the first ``each`` of its ranked lists; ranks start at 0."""
    parts = []
    for df, weight in lists:
        rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item))
        parts.append(df.withColumn("_r", rank).where(F.col("_r") <= each).select(query, item, (F.lit(weight) / (RRF_K + F.col("_r"))).alias("part")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top_k(both.groupBy(query, item).agg(F.sum("part").alias("score")), "score", item, k, key=[query])


def ensemble(scores: Mapping[str, float]) -> Column:
    """Weighted mean of score columns."""
    total = sum(scores.values())
    return sum((F.col(c) * (w / total) for c, w in scores.items()), F.lit(0.0))


def quality_score(columns: Mapping[str, Column]) -> Column:
    """Weighted sum of authority, readability, coherence, completeness and kind, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((columns[c] * w for c, w in QUALITY_WEIGHTS.items()), F.lit(0.0))))


def relative_to_best(df: DataFrame, score: str, group: Sequence[str]) -> DataFrame:
    """``df`` with its scores over the best of their group, unchanged where that isn't positive. The best comes from a grouped maximum, so a large group is no window."""
    best = df.groupBy(*group).agg(F.max(score).alias("_best"))
    return df.join(best, list(group)).withColumn(score, F.when(F.col("_best") > 0, F.col(score) / F.col("_best")).otherwise(F.col(score))).drop("_best")


def route_to_prototypes(df: DataFrame, prototypes: DataFrame, vector: str, threshold: float) -> DataFrame:
    """``df`` with the prototype (columns name, p) of the largest cosine, that cosine, and whether it reaches the threshold. Prototypes are few."""
    every = prototypes.agg(F.collect_list(F.struct("name", "p")).alias("_ps"))
    scores = F.transform("_ps", lambda p: F.struct(cosine(F.col(vector), p["p"]).alias("s"), p["name"].alias("n")))
    best = F.reduce(scores, F.struct(F.lit(-2.0).alias("s"), F.lit(None).cast(prototypes.schema["name"].dataType).alias("n")), lambda a, b: F.when((b["s"] > a["s"]) | ((b["s"] == a["s"]) & (b["n"] < a["n"])), b).otherwise(a))
    return df.join(F.broadcast(every)).withColumn("_best", best).select(*df.columns, F.col("_best.n").alias("route"), F.col("_best.s").alias("route_score"), (F.col("_best.s") >= threshold).alias("confident"))


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, mean): the component-wise mean of each group's vectors, summed before the exchange."""
    each = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def fused(own: Column, other: Column, share: float = 0.3) -> Column:
    """Unit vector along (1 - share) own + share other."""
    mixed = F.zip_with(own, other, lambda a, b: a * (1 - share) + b * share)
    size = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(mixed, lambda x: x / size)).otherwise(mixed)


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; those without a length stay."""
    x = np.asarray(x, dtype=np.float64)
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def marginal_picks(relevance: np.ndarray, units: np.ndarray, k: int, lam: float) -> list[int]:
    """Places of up to ``k`` vectors, each with the best of lam x relevance - (1 - lam) x similarity to those before it; the earliest wins ties."""
    worst, chosen, left = np.zeros(len(units)), [], np.ones(len(units), dtype=bool)
    for n in range(min(k, len(units))):
        best = int(np.where(left, lam * relevance - (1 - lam) * worst, -np.inf).argmax())
        chosen.append(best)
        left[best] = False
        near = units @ units[best]
        worst = near if n == 0 else np.maximum(worst, near)
    return chosen


def maximal_marginal_relevance(query: np.ndarray, vectors: np.ndarray, k: int, lam: float = 0.7) -> list[int]:
    """``marginal_picks`` by the cosine to a query. Up to ``k`` vectors come back in their own order."""
    if len(vectors) <= k:
        return list(range(len(vectors)))
    return marginal_picks(unit(vectors) @ unit(query), unit(vectors), k, lam)


def diversify(candidates: DataFrame, group: str, order: str, vector: str, query_vector: str, k: int, lam: float = 0.7) -> DataFrame:
    """(group, order, rank, score) of the MMR picks of each query. A query's candidates are a bounded list; queries are spread over tasks."""
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        places = maximal_marginal_relevance(np.array(rows[query_vector][0]), np.array(rows[vector].tolist()), k, lam)
        return pd.DataFrame({group: rows[group][places].to_numpy(), order: rows[order][places].to_numpy(), "rank": range(len(places)), "score": [1 - r / len(rows) for r in range(len(places))]})

    return candidates.select(group, order, vector, query_vector).groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, {order} {kinds[order]}, rank int, score double")


def diverse_edges(edges: DataFrame, group: str, order: str, score: str, vector: str, most: int, diversity: float = 0.3) -> DataFrame:
    """(group, order, rank): each query's edges in the order of (1 - diversity) x score - diversity x similarity to those before, ``most`` at most. A query's edges are a bounded list."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, order], ascending=[False, True]).reset_index(drop=True)
        places = marginal_picks(rows[score].to_numpy(), unit(np.array(rows[vector].tolist())), most, 1 - diversity)
        return pd.DataFrame({group: rows[group][places].to_numpy(), order: rows[order][places].to_numpy(), "rank": range(len(places))})

    return edges.select(group, order, score, vector).groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, {order} {kinds[order]}, rank int")


def synthesis_search(pairs: DataFrame, key: str, item: str, score: str, vector: str, query_vector: str, tier: str, k: int, most_tier: int = 3, lam: float = 0.7) -> DataFrame:
    """(key, item, rank) for synthesis: of twice ``k`` candidates MMR picks ``k`` x 2 diverse ones, those of a tier up to ``most_tier`` stay, the first ``k`` of them.

    ``pairs`` has each query's scored candidates with both vectors; 3 is the widest tier and filters nothing.
    """
    fetched = top_k(pairs, score, item, over_fetch(2 * k, False), key=[key])
    fetched = fetched.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), item)))
    picked = diversify(fetched, key, "_place", vector, query_vector, 2 * k, lam).select(key, "_place", F.col("rank").alias("_picked"))
    kept = fetched.join(picked, [key, "_place"])
    if most_tier < 3:
        kept = kept.where(F.col(tier) <= most_tier)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_picked"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select(key, item, "rank")


def exclusive_assignment(scores: DataFrame, group: str, request: str, item: str, score: str, least: float, each: int = 1) -> DataFrame:
    """(group, request, item, score): requests in order take their best items that no earlier request took. Groups are bounded and independent; a fold over a group's sorted offers settles it."""
    offer = F.struct(F.col(request).alias("r"), (-F.col(score)).alias("d"), F.col(item).alias("i"), F.col(score).alias("s"))
    grouped = scores.where(F.col(score) >= least).groupBy(group).agg(F.array_sort(F.collect_list(offer)).alias("_o"))
    kinds = {f.name: f.dataType.simpleString() for f in scores.schema.fields}
    won = f"array<struct<r:{kinds[request]},i:{kinds[item]},s:{kinds[score]}>>"

    def settle(out: Column, o: Column) -> Column:
        same = F.size(F.filter(out, lambda x: x["r"].eqNullSafe(o["r"])))
        taken = F.exists(out, lambda x: x["i"].eqNullSafe(o["i"]))
        return F.when(taken | (same >= each), out).otherwise(F.concat(out, F.array(F.struct(o["r"].alias("r"), o["i"].alias("i"), o["s"].alias("s"))).cast(won)))

    picked = grouped.select(group, F.explode(F.aggregate("_o", F.array().cast(won), settle)).alias("_x"))
    return picked.select(group, F.col("_x.r").alias(request), F.col("_x.i").alias(item), F.col("_x.s").alias(score))


def keyword_score(tokens: Column, asked: Sequence[str]) -> Column:
    """Share of the asked words that occur."""
    words = F.array(*map(F.lit, asked))
    return F.size(F.array_intersect(tokens, words)) / len(asked)


def field_score(fields: Mapping[str, float], asked: Sequence[str]) -> Column:
    """Weighted count of asked words over fields of tokens."""
    words = F.array(*map(F.lit, asked))
    return sum((F.size(F.array_intersect(F.col(c), words)) * w for c, w in fields.items()), F.lit(0.0))


def has_all(tokens: Column, asked: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, asked)), tokens)) == 0


def attach_images(results: DataFrame, links: DataFrame, chunk: str, image: str, score: str) -> DataFrame:
    """``results`` with images: up to three linked ones with a score of 0.5 or more, best first."""
    good = links.where(F.col(score) >= LINK_SCORE)
    rank = F.row_number().over(Window.partitionBy(chunk).orderBy(F.desc(score), image))
    best = good.withColumn("_r", rank).where(F.col("_r") <= LINKS_EACH).groupBy(chunk)
    images = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", image))), lambda s: s[image]).alias("images"))
    return results.join(images, chunk, "left").withColumn("images", F.coalesce("images", F.array().cast(images.schema["images"].dataType)))


def figure_score(similarity: Column, words: Column, other: Column, tier: Column) -> Column:
    """0.60 of the cosine, 0.25 of the shared words and 0.15 of the tier."""
    return 0.60 * similarity + 0.25 * jaccard(words, other) + 0.15 * tier


def score_in_batches(df: DataFrame, scorer, columns: Sequence[str], name: str = "score") -> DataFrame:
    """``df`` with the scores of ``scorer``, a function from a pandas frame of ``columns`` to a series: the place for a model."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} double"

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(**{name: scorer(rows[list(columns)])})

    return df.mapInPandas(convert, schema)


def cache_key(parts: Sequence[Column]) -> Column:
    """Key of a search in a result cache: a digest of query, mode, size and filters."""
    return F.sha2(F.concat_ws("|", *parts), 256)
