"""Text expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """White-space separated words; an empty array for empty and null texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    """Whole part of 1.3 tokens a word."""
    return F.floor(word_count(text) * 1.3).cast("int")


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members of two arrays; 0 if one is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each with two spaces before and one after."""
    padded = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def tier(name: Column, asked: str) -> Column:
    """1.0 for the same name, 0.8 for a prefix, 0.5 for a part of it, in any case; else 0."""
    low, q = F.lower(name), asked.lower()
    return F.when(low == q, 1.0).when(low.startswith(q), 0.8).when(low.contains(q), 0.5).otherwise(0.0)


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    """The first ``most`` characters, with ``mark`` if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def last_place(text: Column, part: str) -> Column:
    """Where ``part`` stands last, from 1; 0 if nowhere."""
    back = F.instr(F.reverse(text), part[::-1])
    return F.when(back > 0, F.length(text) - back - len(part) + 2).otherwise(0)


def cut_to_tokens(text: Column, tokens_left: int) -> Column:
    """At most four characters a token: up to the last sentence end past 70 %, else the last space and dots."""
    most = 4 * tokens_left
    head = F.substring(text, 1, most)
    cut = F.lit(None).cast("string")
    for mark in ("? ", "! ", ".\n", ". "):
        at = last_place(head, mark)
        cut = F.when(at - 1 > 0.7 * most, F.substr(head, F.lit(1), at)).otherwise(cut)
    space = last_place(head, " ")
    rest = F.concat(F.when(space > 1, F.substr(head, F.lit(1), space - 1)).otherwise(head), F.lit("..."))
    return F.when(F.length(text) <= most, text).otherwise(F.coalesce(cut, rest))


def citations(text: Column) -> Column:
    """Distinct numbers in [1], [1, 2] and [1-3], ascending."""
    inner = F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,9}(?:[ ]*[,-][ ]*[0-9]{1,9})*)\]"), F.lit(1))
    parts = F.flatten(F.transform(inner, lambda s: F.split(s, r"[ ]*,[ ]*")))

    def numbers(part: Column) -> Column:
        ends = F.transform(F.split(part, r"[ ]*-[ ]*"), lambda x: x.cast("int"))
        low, high = F.get(ends, F.lit(0)), F.element_at(ends, -1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))
