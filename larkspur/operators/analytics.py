"""Grouped statistics, distributions and windows over ordered rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """(bucket, n) over [0, 1] in equal parts; 1.0 has a bucket of its own."""
    low = F.floor(F.col(value) * buckets) / buckets
    return df.groupBy(low.alias("bucket")).agg(F.count("*").alias("n"))


def cumulative_histogram(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """(bound, n): values up to each bound and, with a null bound, all of them; one pass with a conditional count for each bound."""
    counts = [F.count_if(F.col(value) <= b).alias(f"c{i}") for i, b in enumerate(bounds)]
    one = df.agg(*counts, F.count(value).alias("c_all"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("bound"), F.col(f"c{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("bound"), F.col("c_all").alias("n")))
    return one.select(F.inline(rows))


def zero_filled(df: DataFrame, key: str, values: Sequence[object]) -> DataFrame:
    """(key, n) for each of ``values``, 0 for those that don't occur; others are left out."""
    spine = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} {df.schema[key].dataType.simpleString()}")
    counts = df.where(F.col(key).isin(*values)).groupBy(key).agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def equals(value: object) -> Callable[[Column], Column]:
    """A test for members of an array."""
    return lambda x: x == value


def first_samples(df: DataFrame, key: Sequence[str], value: str, order: Sequence[Column], n: int) -> DataFrame:
    """(key, samples): the values of the first ``n`` rows of each key in ``order``; ranked first, so that no more than these come together."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    few = df.select(*key, F.col(value).alias("_v"), rank.alias("_r")).where(F.col("_r") <= n)
    return few.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias("samples"))


def streaks(df: DataFrame, key: str, day: str, as_of: Column) -> DataFrame:
    """(key, streak): consecutive days with a row that end on ``as_of``; 0 for keys without a row that day."""
    days = df.select(key, F.col(day).alias("d")).where(F.col("d") <= as_of).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("d")))
    return days.withColumn("back", F.datediff(as_of, "d")).withColumn("r", rank).groupBy(key).agg(F.count_if(F.col("back") == F.col("r") - 1).alias("streak"))


def rolling_ratio(daily: DataFrame, key: Sequence[str], order: str, part: str, whole: str, rows: int) -> Column:
    """Sum of ``part`` over sum of ``whole`` for a row and the ``rows - 1`` before it."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-(rows - 1), 0)
    return F.try_divide(F.sum(part).over(w), F.sum(whole).over(w))


def updated_means(known: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, n): running means (columns mean, n) after further values, (mean x n + sum) / (n + count); keys of either side."""
    added = new.groupBy(key).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    both = known.select(key, "mean", "n").join(added, key, "full")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("_c", F.lit(0))
    total = F.coalesce(F.col("mean") * F.col("n"), F.lit(0.0)) + F.coalesce("_s", F.lit(0.0))
    return both.select(key, F.try_divide(total, n).alias("mean"), n.alias("n"))


def within_budget(df: DataFrame, key: Sequence[str], order: Sequence[Column], cost: str, budget: int, piece: Column | None = None) -> DataFrame:
    """Rows of each key, in order, with ``spent``, as long as the running cost stays within ``budget``; costs aren't negative.

    A key may be large: with ``piece``, a number that grows with the order and has a bounded
    count of rows, costs are summed by piece first, and only pieces that begin within the
    budget are sorted.
    """
    if piece is None:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)
    cut = df.withColumn("_piece", piece)
    ahead = Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*key, "_piece").agg(F.sum(cost).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    near = cut.join(starts.where(F.col("_start") <= budget).drop("_sum"), [*key, "_piece"])
    w = Window.partitionBy(*key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("spent", F.col("_start") + F.sum(cost).over(w)).where(F.col("spent") <= budget).drop("_piece", "_start")


def round_robin(df: DataFrame, kind: str, order: str, piece: Column) -> DataFrame:
    """``df`` with ``turn`` and ``kind_first``: the first row of every kind, then the second, kinds in the order of their first row.

    Kinds are few and may be large, so each is numbered in pieces: ``piece`` is a number that
    grows with ``order`` and has a bounded count of rows. Pieces are counted, their starts
    come from a running sum over the counts, and rows are numbered inside a piece only.
    """
    cut = df.withColumn("_piece", piece)
    counts = cut.groupBy(kind, "_piece").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    ahead = Window.partitionBy(kind).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(kind, "_piece", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"), F.min("_first").over(Window.partitionBy(kind)).alias("kind_first"))
    n = F.row_number().over(Window.partitionBy(kind, "_piece").orderBy(order))
    return cut.withColumn("_in", n).join(starts, [kind, "_piece"]).withColumn("turn", F.col("_start") + F.col("_in")).drop("_piece", "_in", "_start")


def due_by_day(df: DataFrame, due: str, days: DataFrame) -> DataFrame:
    """(day, due): rows due on or before each of ``days``, from counts by day."""
    counts = df.groupBy(F.to_date(due).alias("d")).agg(F.count("*").alias("n"))
    met = days.join(counts, counts.d <= days.day, "left")
    return met.groupBy("day").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("due"))
