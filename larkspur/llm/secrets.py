"""Secret scans with DataFrame functions alone: patterns, and Shannon entropy in a sliding window."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Least length of what follows an assignment.
ASSIGNED = 6

#: Candidates of the entropy scan: all long runs of these characters, each as a whole.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Candidates that are never secrets: digits alone, dates and times, UUIDs, and names of
#: digests before their value.
ALLOWED = (
    r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(sha1|sha224|sha256|sha384|sha512|md5|crc32|etag|integrity)[=_-]",
)
#: Neither are words or numbers joined by separators, if all between the separators are like this.
SEPARATORS, JOINED = r"[/_=+-]+", r"^([A-Za-z]{1,15}[0-9]{0,4}|[0-9]{1,8})?$"
#: The least code of a candidate's characters, the bits that hold a count, and how many counts one number holds.
FIRST_CODE, CODES, COUNT_BITS, COUNTS = 43, 80, 6, 10
#: Code points of the parts that a text is cut into to be redacted.
PART = 1024


@dataclass(frozen=True)
class CharacterClass:
    """Candidates made of such characters only are secret if a window has so many bits a character."""

    name: str
    pattern: str
    window: int
    bits: float


#: The first class that fits a candidate counts. Long words have no digit, so letters alone need more.
CLASSES = (
    CharacterClass("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 20, 3.0),
    CharacterClass("letters and digits", r"^(?=.*[0-9])[A-Za-z0-9]+$", 20, 3.7),
    CharacterClass("base 64", r"^(?=.*[0-9])[A-Za-z0-9+/_=-]+$", 20, 3.8),
    CharacterClass("letters", r"^[A-Za-z+/_=-]+$", 32, 4.4),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(numbers: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of numbers, all before it combined, from 0.

    An array that grows in a fold is copied in each step, so the numbers are combined in
    blocks of about the root of their count: first each block, then the blocks before each,
    then within each.
    """

    def scan(values: Column, start: Column) -> Column:
        step = lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine))
        return let(scan(totals, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda b, k: scan(b, F.get(starts, k)))))

    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(numbers))).cast("int"))
    blocks = let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / n).cast("int")), lambda k: F.slice(numbers, k * n + 1, n)))
    return F.when(F.size(numbers) > 0, let(blocks, of_blocks)).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, number, stop, found, kind) for the leftmost matches of ``pattern``, in code points.

    The text between matches comes from splitting at them, so a match starts where the
    lengths of all before it add up to. Texts without a match are told by a plain search.
    """
    number = KINDS.index(kind)
    none = F.array().cast("array<struct<start:int,number:int,stop:int,found:string,kind:string>>")

    def spans_of(cut: Column) -> Column:
        lengths = F.transform(cut["found"], lambda w, i: F.length(F.get(cut["between"], i)) + F.length(w))

        def placed(n: Column, before: Column) -> Column:
            def span(w: Column, i: Column) -> Column:
                stop = F.get(before, i) + F.get(n, i)
                return F.struct((stop - F.length(w)).alias("start"), F.lit(number).alias("number"), stop.alias("stop"), w.alias("found"), F.lit(kind).alias("kind"))

            return F.transform(cut["found"], span)

        return let(lengths, lambda n: let(running(n, lambda a, b: a + b), lambda before: placed(n, before)))

    cut = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    spans = F.when(text.rlike(pattern), let(cut, spans_of)).otherwise(none)
    return spans if keep is None else F.filter(spans, keep)


def window_entropy(word: Column, window: int) -> Column:
    """Most bits a character in any ``window`` neighbouring characters of ``word``; 0 for shorter words.

    Counts of the characters in the window, ten to a number, change by one on either side
    from step to step, and so does the sum of count x log2(count), which gives the entropy.
    """
    weigh = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    gains = F.array(*(F.lit(b - a) for a, b in zip(weigh, weigh[1:], strict=False)))
    shift = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), code % COUNTS * COUNT_BITS)
    held = lambda code: F.floor(code / COUNTS).cast("int")

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, held(code)), code % COUNTS * COUNT_BITS).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long")).cast("int")

    def step(state: Column, x: Column) -> Column:
        enters, leaves, counts = x["enters"], x["leaves"], state["counts"]
        change = F.get(gains, count(counts, enters)) - F.when(leaves >= 0, F.get(gains, count(counts, leaves) - 1)).otherwise(0.0)
        moved = F.transform(counts, lambda n, k: n + F.when(k == held(enters), shift(enters)).otherwise(0) - F.when((leaves >= 0) & (k == held(leaves)), shift(leaves)).otherwise(0))
        same = enters == leaves
        total = state["total"] + F.when(same, 0.0).otherwise(change)
        bits = F.when(x["full"], math.log2(window) - total / window).otherwise(0.0)
        return F.struct(F.when(same, counts).otherwise(moved).alias("counts"), total.alias("total"), F.greatest(state["best"], bits).alias("best"))

    def best_of(codes: Column) -> Column:
        moves = F.transform(codes, lambda c, i: F.struct(c.alias("enters"), F.coalesce(F.get(codes, i - window), F.lit(-1)).alias("leaves"), (i >= window - 1).alias("full")))
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), CODES // COUNTS).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(moves, start, step, lambda s: s["best"])

    return let(F.transform(F.split(word, ""), lambda c: F.ascii(c) - FIRST_CODE), best_of)


def is_secret(span: Column) -> Column:
    """Whether a candidate has enough entropy for its class and is on no allow-list."""
    word = span["found"]
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    allowed = allowed | F.forall(F.split(word, SEPARATORS), lambda part: part.rlike(JOINED))
    enough = F.lit(False)
    for c in reversed(CLASSES):
        enough = F.when(word.rlike(c.pattern), window_entropy(word, c.window) >= c.bits - 1e-9).otherwise(enough)
    return F.when(allowed, F.lit(False)).otherwise(enough)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with secret_spans, an array of (start, number, stop, found, kind) in the order of start and kind.

    Positions are code points, the stop exclusive. Kinds assign, access and hex are the
    leftmost matches of their patterns, each on its own, so kinds may overlap; entropy adds
    candidate strings with a window of high entropy that no allow-list knows, whole. One
    pass without a shuffle and without Python. Time grows with the text, whatever the number
    and length of matches, but for a root of their number that is small beside the patterns'.
    Null and empty texts have no spans; repeated rows get equal results; an input column
    called secret_spans is replaced, others pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assigned = lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= ASSIGNED
    spans = F.concat(located(text, ASSIGN, "assign", assigned), located(text, ACCESS, "access"), located(text, HEX, "hex"), located(text, CANDIDATE, "entropy", is_secret))
    return df.withColumn("secret_spans", F.array_sort(spans))


def count_of(kind: str) -> Column:
    """How many spans of ``scan`` are of a kind."""
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")


def joined_spans(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``scan`` replaced by ``mark``, overlapping spans by one mark; null texts stay null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.struct(F.col("secret_spans").alias("spans"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)).alias("parts"))

    def clean(x: Column) -> Column:
        def between(a: Column, z: Column) -> Column:
            first = F.floor(a / PART).cast("int")
            near = F.slice(x["parts"], first + 1, F.floor((z - 1) / PART).cast("int") - first + 1)
            return F.when(z > a, F.substr(F.array_join(near, ""), a % PART + 1, z - a)).otherwise("")

        def marked(reach: Column) -> Column:
            heads = F.filter(F.transform(x["spans"], lambda s, i: F.struct(F.get(reach, i).alias("a"), s["start"].alias("z"))), lambda h: h["z"] >= h["a"])
            last = F.greatest(F.element_at(reach, -1), F.element_at(x["spans"], -1)["stop"])
            return F.concat(F.array_join(F.transform(heads, lambda h: F.concat(between(h["a"], h["z"]), F.lit(mark))), ""), between(last, F.length(text)))

        return let(running(F.transform(x["spans"], lambda s: s["stop"]), lambda a, b: F.greatest(a, b)), marked)

    scanned = scan(df, text_col)
    return scanned.withColumn(text_col, F.when(F.size("secret_spans") > 0, let(whole, clean)).otherwise(F.col(text_col))).drop("secret_spans")
