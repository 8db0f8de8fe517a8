"""Lookups, filters, merges and deletes over DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_columns(df: DataFrame, order_by: str, default: str, tie: str) -> list[Column]:
    """Sort columns of a text such as "price DESC": an unknown column gives ``default``, an unknown direction ASC; ``tie`` makes the order total."""
    words = (order_by or default).split()
    if not words or words[0] not in df.columns:
        words = default.split()
    down = len(words) > 1 and words[1].upper() == "DESC"
    column = F.col(words[0])
    return [column.desc_nulls_first() if down else column.asc_nulls_last(), F.col(tie)]


def paged(df: DataFrame, order_by: str, default: str, tie: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a total order, which Spark takes as a top-k without a full sort."""
    return df.orderBy(*order_columns(df, order_by, default, tie)).offset(offset).limit(limit)


def find_by(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Rows that meet all conditions; a list means any of its values. Unknown columns are an error, so a filter never silently widens."""
    if unknown := set(conditions) - set(df.columns):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    terms = [F.col(c).isin(*v) if isinstance(v, list | tuple | set) else F.col(c).isNull() if v is None else F.col(c) == v for c, v in conditions.items()]
    return df.where(reduce(lambda a, b: a & b, terms, F.lit(True)))


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids``; an id that repeats doesn't repeat its row."""
    return df.join(ids.select(key), key, "left_semi")


def without(df: DataFrame, gone: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key isn't in ``gone``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(gone.select(*keys), keys, "left_anti")


def cascade_delete(parents: DataFrame, gone: DataFrame, key: str, children: Iterable[tuple[DataFrame, str]]) -> list[DataFrame]:
    """Parents without those in ``gone`` (column ``key``), then each child table without rows that point to them."""
    left = [without(parents, gone, key)]
    return left + [without(child, gone.select(F.col(key).alias(link)), link) for child, link in children]


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in a total order, as a grouped maximum that is combined before the exchange."""
    others = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*key, *(F.col(f"_row.{c}").alias(c) for c in others)).select(*df.columns)


def first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    others = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return best.select(*key, *(F.col(f"_row.{c}").alias(c) for c in others)).select(*df.columns)


#: How an upsert merges a column: from old and new value.
RULES = {
    "sum": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
    "greatest": lambda old, new: F.greatest(old, new),
    "new_or_old": lambda old, new: F.coalesce(new, old),
    "named_or_old": lambda old, new: F.coalesce(F.when(new != "", new), old),
    "old_or_new": lambda old, new: F.coalesce(old, new),
    "concat": lambda old, new: F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array())),
}


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], rules: Mapping[str, str]) -> DataFrame:
    """Rows of either side by key, each column of ``rules`` merged by its rule; both sides have a key once."""
    o, n = old.select(*key, *(F.col(c).alias(f"_o_{c}") for c in rules)), new.select(*key, *(F.col(c).alias(f"_n_{c}") for c in rules))
    both = o.join(n, list(key), "full_outer")
    return both.select(*key, *(RULES[r](F.col(f"_o_{c}"), F.col(f"_n_{c}")).alias(c) for c, r in rules.items()))


def append_to_list(items: DataFrame, new: DataFrame, list_col: str, item_col: str, order: Sequence[Column]) -> DataFrame:
    """Items with positions after appending ``new``: known pairs are left alone, others go to the end of their list in order."""
    fresh = new.dropDuplicates([list_col, item_col]).join(items, [list_col, item_col], "left_anti")
    ends = items.groupBy(list_col).agg(F.max("position").alias("_end"))
    rank = F.row_number().over(Window.partitionBy(list_col).orderBy(*order))
    placed = fresh.withColumn("_n", rank).join(ends, list_col, "left").select(list_col, item_col, (F.coalesce("_end", F.lit(0)) + F.col("_n")).alias("position"))
    return items.select(list_col, item_col, "position").unionByName(placed)


def carry_previous(now: DataFrame, before: DataFrame, hash_col: str, path_col: str, carried: Sequence[str]) -> DataFrame:
    """``now`` with the columns ``carried`` of the same file before, matched by hash, else by path; is_new where neither matches."""
    by_hash = before.groupBy(hash_col).agg(F.lit(True).alias("_h"), *(F.min(c).alias(f"_h_{c}") for c in carried))
    by_path = before.groupBy(path_col).agg(F.lit(True).alias("_p"), *(F.min(c).alias(f"_p_{c}") for c in carried))
    both = now.join(by_hash, hash_col, "left").join(by_path, path_col, "left")
    known = [F.when(F.col("_h"), F.col(f"_h_{c}")).otherwise(F.col(f"_p_{c}")).alias(c) for c in carried]
    return both.select(*now.columns, *known, (F.col("_h").isNull() & F.col("_p").isNull()).alias("is_new"))


def enrich(df: DataFrame, other: DataFrame, on: str | Column | list[str], columns: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with ``columns`` of ``other``."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*keys, *columns), keys, how)


def with_counts(df: DataFrame, counted: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the number of rows of ``counted`` per key, 0 where there is none; counted before the join."""
    return df.join(counted.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their rank; Spark limits groups before the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= n)


def prefixes(path: Column, separator: str = "/") -> Column:
    """All ancestors of a materialised path, itself included, so that a prefix join is a join on equality."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def band_join(left: DataFrame, right: DataFrame, key: str, a: str, b: str, width: float) -> DataFrame:
    """Pairs of one key with ``|a - b| <= width``; buckets as wide as the band turn it into a join on equality.

    Rows of ``right`` go to their bucket and its two neighbours, so each pair meets once.
    """
    spread = right.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col(b) / width) + d for d in (-1, 0, 1)))))
    return left.withColumn("_bucket", F.floor(F.col(a) / width)).join(spread, [key, "_bucket"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_bucket")


def weighted_sample(df: DataFrame, category: str, weights: Mapping[object, float], n: int, order: Sequence[str]) -> DataFrame:
    """``n`` rows: of each category the whole part of ``n`` times its weight, one at least, then others, first by ``order``.

    ``order`` stands for chance, such as a hash, and ends in a unique column. Only the first
    ``n`` of a category are looked at beyond their share.
    """
    share = F.lit(0)
    for value, weight in weights.items():
        share = F.when(F.col(category) == value, max(1, int(n * weight))).otherwise(share)
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("_n") <= n)
    return ranked.orderBy(F.desc(F.col("_n") <= share), *order).limit(n).drop("_n")
