"""Spaced repetition and item response: closed forms as columns, histories as folds over sorted rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the memory model, the schedule and the ability update.
W = (0.4, 0.6, 2.4, 5.8, 4.93, 0.94, 0.86, 0.01, 1.49, 0.14, 0.94, 2.18, 0.05, 0.34, 1.26, 0.29, 2.61)
RETENTION, LONGEST = 0.9, 365
STEPS_MINUTES, RELEARN_MINUTES = (1, 10), (10,)
SESSION_DAYS = (1, 3, 7, 14, 30, 60, 120)
SESSION_LIMITS = {3: 0.90, 4: 0.85, 5: 0.80, 6: 0.75, 7: 0.70}
LEARNING_RATE, SHRINK, ABILITY_BOUND = 0.3, 0.1, 3.0
RESCALE = {1: 0.5, 2: 0.75, 3: 1.0, 4: 1.25}


def retrievability(days: Column, stability: Column) -> Column:
    """Chance of recall after ``days``; 1 before that."""
    return F.when(days <= 0, 1.0).otherwise(F.pow(1 + days / (9 * stability), F.lit(-1.0)))


def interval(stability: Column, retention: float = RETENTION, longest: int = LONGEST) -> Column:
    """Whole days until recall falls to ``retention``, halves to even, from 1 to ``longest``."""
    days = F.bround(9 * stability * (1 / retention - 1), 0)
    return F.greatest(F.lit(1), F.least(F.lit(longest), days.cast("int")))


def first_difficulty(rating: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), W[4] - (rating - 3) * W[5]))


def first_stability(rating: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in W[:4])), rating.cast("int"))


def next_difficulty(difficulty: Column, rating: Column) -> Column:
    moved = W[7] * W[4] + (1 - W[7]) * (difficulty - W[6] * (rating - 3))
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), moved))


def stability_after_success(stability: Column, difficulty: Column, recall: Column, rating: Column) -> Column:
    grown = F.exp(F.lit(W[8])) * (11 - difficulty) * F.pow(stability, F.lit(-W[9])) * (F.exp((1 - recall) * W[10]) - 1)
    grown = grown * F.when(rating == 2, W[15]).otherwise(1.0) * F.when(rating == 4, W[16]).otherwise(1.0)
    return F.greatest(F.lit(0.1), stability * (1 + grown))


def stability_after_lapse(stability: Column, difficulty: Column, recall: Column) -> Column:
    return F.greatest(F.lit(0.1), W[11] * F.pow(difficulty, F.lit(-W[12])) * (F.pow(stability + 1, F.lit(W[13])) - 1) * F.exp((1 - recall) * W[14]))


def _clamp(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


def review(state: dict, rating: int, day: float) -> dict:
    """The memory after one review on ``day``: states new, learning, review, relearning with their steps."""
    s, kind = dict(state), state["state"]
    elapsed = 0 if s["day"] is None else max(0, int(day - s["day"]))
    s["reps"], s["day"] = s["reps"] + 1, day

    def grown(stability: float, difficulty: float, recall: float) -> float:
        bonus = (W[15] if rating == 2 else 1) * (W[16] if rating == 4 else 1)
        return max(0.1, stability * (1 + math.exp(W[8]) * (11 - difficulty) * stability ** -W[9] * (math.exp((1 - recall) * W[10]) - 1) * bonus))

    def wait(days: float, state: str, step: int = 0) -> dict:
        return s | {"state": state, "step": step, "wait_days": days}

    def days() -> int:
        return int(_clamp(round(9 * s["stability"] * (1 / RETENTION - 1)), 1, LONGEST))

    if kind == "new":
        s |= {"difficulty": _clamp(W[4] - (rating - 3) * W[5], 1, 10), "stability": W[rating - 1]}
        if rating == 1:
            s["lapses"] += 1
        if rating <= 2:
            return wait(STEPS_MINUTES[0] / 1440, "learning")
        return wait(STEPS_MINUTES[-1] / 1440, "learning", len(STEPS_MINUTES) - 1) if rating == 3 else wait(days(), "review")
    if kind in ("learning", "relearning"):
        steps = STEPS_MINUTES if kind == "learning" else RELEARN_MINUTES
        if rating == 1:
            s["lapses"] += 1
            return wait(steps[0] / 1440, kind)
        if rating == 2:
            return wait(steps[min(s["step"], len(steps) - 1)] / 1440, kind, s["step"])
        if rating == 3 and s["step"] + 1 < len(steps):
            return wait(steps[s["step"] + 1] / 1440, kind, s["step"] + 1)
        s["stability"] = grown(s["stability"], s["difficulty"], 1.0)
        return wait(days(), "review")
    recall = 1.0 if elapsed <= 0 else 1 / (1 + elapsed / (9 * s["stability"]))
    old = s["difficulty"]
    s["difficulty"] = _clamp(W[7] * W[4] + (1 - W[7]) * (old - W[6] * (rating - 3)), 1, 10)
    if rating == 1:
        s["lapses"] += 1
        s["stability"] = max(0.1, W[11] * old ** -W[12] * ((s["stability"] + 1) ** W[13] - 1) * math.exp((1 - recall) * W[14]))
        return wait(RELEARN_MINUTES[0] / 1440, "relearning")
    s["stability"] = grown(s["stability"], old, recall)
    return wait(days(), "review")


NEW = {"state": "new", "step": 0, "reps": 0, "lapses": 0, "difficulty": 0.0, "stability": 0.0, "day": None, "wait_days": 0.0}


def folded(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], start: Any, step: Callable[..., Any], fields: Sequence[tuple[str, str, pa.DataType]], finish: Callable[[Any], tuple]) -> DataFrame:
    """(key, fields): ``step(state, *values)`` over the rows of each key in order, from ``start``.

    Rows are dealt out by key and sorted by Spark, which spills what doesn't fit; a worker
    reads them as they come and holds one state, so a key's history may be of any length.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in key), *(f"{name} {kind}" for name, kind, _ in fields)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, start
        types = None

        def emit(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*key, *(name for name, _, _ in fields)])

        for batch in batches:
            types = types or [*batch.schema.types[: len(key)], *(t for _, _, t in fields)]
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[: len(key)] != now:
                    if now is not None:
                        done.append((*now, *finish(state)))
                    now, state = row[: len(key)], start
                state = step(state, *row[len(key) :])
            if done:
                yield emit(done)
        if now is not None:
            yield emit([(*now, *finish(state))])

    dealt = rows.repartition(*key).sortWithinPartitions(*key, *order)
    return dealt.select(*key, *values).mapInArrow(walk, schema)


def memory(history: DataFrame, key: list[str], order: list[str], rating: str, day: str) -> DataFrame:
    """(key, state, reps, lapses, difficulty, stability, wait_days): each card's memory after all of its reviews, in order."""
    whole, real = ("int", pa.int32()), ("double", pa.float64())
    fields = [("state", "string", pa.string()), ("reps", *whole), ("lapses", *whole), ("difficulty", *real), ("stability", *real), ("wait_days", *real)]
    step = lambda state, r, d: review(state, int(r), float(d))
    return folded(history, key, order, [rating, day], NEW, step, fields, lambda s: tuple(s[name] for name, _, _ in fields))


def probability(ability: Column, a: Column, b: Column, c: Column) -> Column:
    """Chance of a right answer in the three-parameter model."""
    return c + (1 - c) / (1 + F.exp(-a * (ability - b)))


def information(p: Column, a: Column, c: Column) -> Column:
    """Fisher information; 0 where the chance isn't between guessing and certainty."""
    value = a * a * F.pow(p - c, F.lit(2.0)) * (1 - p) / (F.pow(1 - c, F.lit(2.0)) * p)
    return F.when((p > c) & (p < 1), value).otherwise(0.0)


def standard_error(total: Column) -> Column:
    return F.when(total > 0, 1 / F.sqrt(total)).otherwise(1.0)


def answered(theta: float, a: float, b: float, c: float, correct: bool) -> float:
    """The ability after an answer: the rate times the gradient goes on, a share of the ability comes off, within bounds."""
    p = c + (1 - c) / (1 + math.exp(-a * (theta - b)))
    gradient = a * (1 - p) * (p - c) / (p * (1 - c)) if correct else -a * (p - c) / ((1 - p) * (1 - c))
    return _clamp(theta + LEARNING_RATE * gradient - SHRINK * theta, -ABILITY_BOUND, ABILITY_BOUND)


def abilities(answers: DataFrame, key: str, order: str) -> DataFrame:
    """(key, ability, answers) after each user's answers (columns a, b, c, correct) in order."""
    step = lambda state, *answer: (answered(state[0], *answer), state[1] + 1)
    return folded(answers, [key], [order], ["a", "b", "c", "correct"], (0.0, 0), step, [("ability", "double", pa.float64()), ("answers", "int", pa.int32())], lambda s: s)


def schedule(starts: DataFrame, start: str, target_days: Column | None = None) -> DataFrame:
    """A row for each of the seven sessions after ``start``, their days scaled to a target of 180."""
    sessions = F.array(*(F.struct(F.lit(i + 1).alias("session"), F.lit(d).alias("days")) for i, d in enumerate(SESSION_DAYS)))
    spread = starts.withColumn("_s", F.explode(sessions)).select(*starts.columns, "_s.session", "_s.days")
    days = F.col("days") if target_days is None else F.greatest(F.lit(1), F.floor(F.col("days") * target_days / 180).cast("int"))
    return spread.withColumn("due", F.date_add(start, days)).drop("days")


def session_cards(cards: DataFrame, session: int, days: Column, stability: Column) -> DataFrame:
    """Cards for a session: all in the first two, later those below the session's recall or without a memory."""
    if session <= 2:
        return cards
    return cards.where(stability.isNull() | (retrievability(days, stability) < SESSION_LIMITS[min(7, session)]))


def weak_tags(cards: DataFrame, tags: str, recall: str, below: float = 0.8) -> DataFrame:
    """(tag, mean): tags whose mean recall is below ``below``."""
    each = cards.select(F.explode(tags).alias("tag"), recall).groupBy("tag").agg(F.avg(recall).alias("mean"))
    return each.where(F.col("mean") < below).orderBy("mean", "tag")


def normal_percentile(z: Column) -> Column:
    """Per cent of a normal population below ``z``, by a fifth-degree polynomial in 1 / (1 + 0.2316419 |z|)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = 0.3989422804014327 * F.exp(-z * z / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 100 * F.when(z >= 0, 1 - tail).otherwise(tail)


def rescaled(days: Column, score: Column) -> Column:
    """Days left, shortened or lengthened by a self score from 1 to 4, without fraction."""
    factor = F.lit(1.0)
    for s, f in RESCALE.items():
        factor = F.when(score == s, f).otherwise(factor)
    return F.floor(days * factor).cast("int")


def predicted_retention(sessions: Column, score: Column) -> Column:
    return F.least(F.lit(0.95), 0.5 + F.least(F.lit(0.3), 0.05 * sessions) + 0.1 * (score - 2))


def moves(loads: Sequence[tuple[Any, int]], slack: float) -> list[tuple[Any, int, int, Any]]:
    """(day, first, last, to): which of a day's cards, by number from 1, move to which day, from (day, cards) in order.

    No day has more than the mean load x ``slack`` where a later day has room; the first
    later day with room takes them.
    """
    days, load = [d for d, _ in loads], [n for _, n in loads]
    cap = max(1, math.ceil(sum(load) / len(load) * slack))
    out, room = [], 1
    for k, (day, own) in enumerate(loads):
        given, room = 0, max(room, k + 1)
        while given < own and load[k] > cap:
            while room < len(load) and load[room] >= cap:
                room += 1
            if room == len(load):
                break
            n = min(own - given, load[k] - cap, cap - load[room])
            out.append((day, given + 1, given + n, days[room]))
            given, load[k], load[room] = given + n, load[k] - n, load[room] + n
    return out


def balanced(due: DataFrame, user: str, card: str, day: str, stability: str, slack: float = 1.2) -> DataFrame:
    """(user, card, day) with no day above the mean load x ``slack`` where a later day has room: of the excess the least stable cards move on.

    What moves is decided on counts by day, which are few for any user; cards are then
    numbered within their day by Spark and take their new day by number.
    """
    kinds = {f.name: f.dataType.simpleString() for f in due.schema.fields}
    loads = due.groupBy(user, day).agg(F.count("*").cast("long").alias("n"))
    loads = loads.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), "n"))).alias("loads"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, *m) for u, own in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in moves([(x["d"], x["n"]) for x in own], slack)]
            columns = list(zip(*found, strict=True)) or [()] * 5
            types = [batch.schema.types[0], batch.schema.types[1].value_type.field("d").type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, types[1]], strict=True)], [user, day, "_first", "_last", "_to"])

    planned = loads.mapInArrow(plan, f"{user} {kinds[user]}, {day} {kinds[day]}, _first long, _last long, _to {kinds[day]}")
    spans = planned.groupBy(user, day).agg(F.collect_list(F.struct("_first", "_last", "_to")).alias("_moves"))
    number = F.row_number().over(Window.partitionBy(user, day).orderBy(stability, card))
    placed = due.select(user, card, day, stability).withColumn("_n", number).join(spans, [user, day], "left")
    to = F.get(F.filter("_moves", lambda m: F.col("_n").between(m["_first"], m["_last"])), 0)["_to"]
    return placed.select(user, card, F.coalesce(to, F.col(day)).alias(day))
