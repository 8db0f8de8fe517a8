"""Repair of conversation structure by Hirschberg's divide and conquer over four states."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.llm.common import slices, stored

#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The turn that each state asks for, and the state after it.
ASKS = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What the edits cost.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
#: Cost and letters of the turns to add at the end, by state.
CLOSING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
#: White space of a text, as in the pattern ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\f\r"
#: Rows and bytes of a piece of a conversation.
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 22
NEVER = 1 << 40

#: A row as repair sees it: 0 must go; else 1 + 2 * (place of its role's initial in INITIALS) + (1 if truncated).
INITIALS = "sua?"
Costs = tuple[int, ...]
Ranked = tuple[tuple[int, int], ...]


def kind_of(role: str, must_go: bool, truncated: bool) -> int:
    place = INITIALS.index(role[0]) if role[:1] in ("s", "u", "a") else INITIALS.index("?")
    return 0 if must_go else 1 + 2 * place + truncated


@lru_cache(maxsize=None)
def moves(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest letters, of these the ASCII-least, that take a row from one state to another: inserted turns, then what happens to the row."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    initial, truncated = INITIALS[(kind - 1) // 2], (kind - 1) % 2
    for start in STATES:
        state = start
        for inserts in range(3):
            ends = [(DELETE, "D", state)]
            if kind:
                ends.append((REROLE + LEFT_TRUNCATED * truncated, "R", NEXT[state]))
                if initial == ASKS[state][0] or (initial == "s" and state == START):
                    ends.append((LEFT_TRUNCATED * truncated, "K", SYSTEM if initial == "s" else NEXT[state]))
            for cost, letter, end in ends:
                found = (cost + INSERT * inserts, "I" * inserts + letter)
                best[start, end] = min(best.get((start, end), (NEVER, "")), found)
            state = NEXT[state]
    return best


def ranked(candidates: dict[int, list[tuple]]) -> Ranked:
    """For each state its least (cost, order ...): the cost, and the place of the order among all states. Costs count from the least one."""
    best = {s: min(c) for s, c in candidates.items() if c}
    order = {key: i for i, key in enumerate(sorted(b[1:] for b in best.values()))}
    return tuple((best[s][0], order[best[s][1:]]) if s in best else (NEVER, 0) for s in STATES)


def lowered(vector: Ranked) -> tuple[Ranked, int]:
    least = min(c for c, _ in vector)
    return tuple((c - least if c < NEVER else NEVER, r) for c, r in vector), least


@lru_cache(maxsize=1 << 16)
def _ahead(vector: Ranked, kind: int) -> tuple[Ranked, int]:
    into: dict[int, list[tuple]] = {s: [] for s in STATES}
    for (s, t), (cost, letters) in moves(kind).items():
        if vector[s][0] < NEVER:
            into[t].append((vector[s][0] + cost, vector[s][1], letters))
    return lowered(ranked(into))


@lru_cache(maxsize=1 << 16)
def _behind(vector: Costs, kind: int) -> tuple[Costs, int]:
    costs = [min(cost + vector[t] for (s, t), (cost, _) in moves(kind).items() if s == start) for start in STATES]
    least = min(costs)
    return tuple(c - least if c < NEVER else NEVER for c in costs), least


def only(state: int) -> Ranked:
    return tuple((0 if s == state else NEVER, 0) for s in STATES)


def ahead(kinds: Sequence[int], vector: Ranked) -> Ranked:
    """Forward vector: for each state the least cost of reaching it over all rows, and the rank of its least audit among those of the states."""
    total = 0
    for kind in kinds:
        vector, least = _ahead(vector, kind)
        total += least
    return tuple((c + total if c < NEVER else NEVER, r) for c, r in vector)


def behind(kinds: Sequence[int], vector: Costs) -> Costs:
    """Backward vector: for each state the least cost from there over all rows to the end that ``vector`` has the costs of."""
    total = 0
    for kind in reversed(kinds):
        vector, least = _behind(vector, kind)
        total += least
    return tuple(c + total if c < NEVER else NEVER for c in vector)


def crossing(forward: Ranked, backward: Costs) -> int:
    """The state in the middle of the cheapest way, of several that of the ASCII-least audit.

    Audits of one number of rows end in a row's letter and none begins another, so the
    least audit up to here belongs to the least audit of all.
    """
    return min(STATES, key=lambda s: (forward[s][0] + backward[s], forward[s][1]))


def reconstruct(kinds: Sequence[int], entry: int, ends: Costs) -> list[tuple[str, int]]:
    """(letters, state after it) of each row, by Hirschberg's recursion: in memory linear in the rows, in time n log n."""
    if not kinds:
        return []
    if len(kinds) == 1:
        (_, letters), state = min((((cost + ends[t]), letters), t) for (s, t), (cost, letters) in moves(kinds[0]).items() if s == entry)
        return [(letters, state)]
    half = len(kinds) // 2
    middle = crossing(ahead(kinds[:half], only(entry)), behind(kinds[half:], ends))
    return reconstruct(kinds[:half], entry, tuple(c for c, _ in only(middle))) + reconstruct(kinds[half:], middle, ends)


def closing_costs() -> Costs:
    return tuple(CLOSING[s][0] for s in STATES)


_ROWS = "array<struct<role:string,text:string,kind:int>>"
_PIECE = f"conv_id {{kind}}, piece long, n_rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, least_turn long, last_turn long, turns long, costs array<long>, ranks array<long>, turn_rows {_ROWS}"


class _Piece:
    """Rows of one conversation that follow each other, with what is counted on them."""

    def __init__(self, conv: object) -> None:
        self.conv, self.rows, self.size = conv, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, repeated: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.rows and self.rows[-1]["role"][:1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        must_go = blank or repeated
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + (repeated and not blank), self.truncated + (truncated and not must_go)
        self.rows.append({"role": role, "text": "" if must_go else text, "kind": kind_of(role, must_go, truncated)})
        self.size += len(text)

    def row(self, number: int) -> dict:
        kinds = [r["kind"] for r in self.rows]
        forward = [ahead(kinds, only(s)) for s in STATES]
        ends = [r["role"][:1] for r in (self.rows[:1] + self.rows[-1:])] or [None, None]
        return {
            "conv_id": self.conv, "piece": number, "n_rows": len(self.rows), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "first_initial": ends[0], "last_initial": ends[1],
            "least_turn": self.least, "last_turn": self.last, "turns": self.turns, "costs": [c for v in forward for c, _ in v], "ranks": [r for v in forward for _, r in v], "turn_rows": self.rows,
        }


def pieces(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies, present) as pieces of conversations in order, stored.

    Equal rows are counted first. Rows are dealt out by ranges of (conversation, turn, role,
    text), so a conversation of any length lies in as many partitions as it needs. The first
    turn at which a role says a text comes along as a mark before it, found by grouped minima; no join.
    """
    equal = rows.groupBy("conv_id", "turn", "role", "text", "present").agg(F.sum("copies").alias("copies"))
    digest = F.sha2("text", 256).alias("digest")
    turn_order = F.struct(F.col("turn").isNotNull(), "turn")
    marks = rows.where("present").groupBy("conv_id", "role", digest).agg(F.min(turn_order).alias("first"))
    marks = marks.select("conv_id", F.col("first.turn").alias("turn"), "role", "digest", F.lit(0).alias("what"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    all_rows = equal.select("conv_id", "turn", "role", digest, F.when(F.col("present"), 1).otherwise(2).alias("what"), "text", "copies").unionByName(marks)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]  # a mark and its row have one place
    bare = F.rtrim("text", F.lit(BLANKS))
    ends_well = F.substring(bare, -1, 1).isin(".", "!", "?")
    known = all_rows.repartitionByRange(*order).sortWithinPartitions(*order, "what").select("conv_id", "turn", "role", "what", "text", "copies", (bare == "").alias("blank"), (~ends_well).alias("truncated"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, now, marked = TaskContext.get().partitionId() << 40, 0, None, False
        done: list[dict] = []
        size = 0
        for batch in slices(batches):
            for conv, turn, role, what, text, copies, blank, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and (now.conv != conv or len(now.rows) >= PIECE_ROWS or now.size >= PIECE_BYTES):
                    done.append(now.row(base + number))
                    number, size, now = number + 1, size + now.size, None
                now = now or _Piece(conv)
                if what == 0:
                    marked = True
                    continue
                for copy in range(copies if what == 1 else 0):
                    if len(now.rows) >= PIECE_ROWS:
                        yield pa.RecordBatch.from_pylist([*done, now.row(base + number)], arrow)
                        done, size, number, now = [], 0, number + 1, _Piece(conv)
                    now.add(turn, role, text, blank, copy > 0 or not marked, truncated)
                marked = False
            if len(done) >= 1000 or size >= PIECE_BYTES:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done, size = [], 0
        if now is not None:
            done.append(now.row(base + number))
        yield pa.RecordBatch.from_pylist(done, arrow)

    schema = _PIECE.format(kind=kind)
    arrow = _arrow(schema)
    return stored(known.mapInArrow(cut, schema))


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


_COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal")
_STATS = "struct<n_rows:bigint,gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint>"
_CROSSED = f"piece long, entry int, exit int, stats {_STATS}"


def met(own: Sequence[dict]) -> Iterator[dict]:
    """Where each piece of one conversation begins and ends, from the pieces' cost vectors; the first one gets what is counted on the conversation.

    Forward vectors with ranks over the pieces meet backward ones at each border.
    """
    vector, forward = only(START), []
    for p in own:
        into: dict[int, list[tuple]] = {s: [] for s in STATES}
        for s in STATES:
            for t in STATES:
                cost = p["costs"][4 * s + t]
                if vector[s][0] < NEVER and cost < NEVER:
                    into[t].append((vector[s][0] + cost, vector[s][1], p["ranks"][4 * s + t]))
        vector = ranked(into)
        forward.append(vector)
    backward, exits = closing_costs(), []
    for p, f in zip(reversed(own), reversed(forward), strict=True):
        exits.append(crossing(f, backward))
        backward = tuple(min(p["costs"][4 * s + t] + backward[t] for t in STATES) for s in STATES)
    exits.reverse()
    stats = {c: sum(p[c] for p in own) for c in _COUNTS} | {"cost": backward[START]}
    filled = [p for p in own if p["n_rows"]]
    stats["illegal"] += sum(a["last_initial"] + b["first_initial"] not in ("su", "ua", "au") for a, b in zip(filled, filled[1:], strict=False))
    timed = [p for p in own if p["turns"]]
    turns = sum(p["turns"] for p in timed) - sum(a["last_turn"] == b["least_turn"] for a, b in zip(timed, timed[1:], strict=False))
    stats["gaps"] = timed[-1]["last_turn"] - timed[0]["least_turn"] + 1 - turns if timed else 0
    for i, p in enumerate(own):
        yield {"piece": p["piece"], "entry": exits[i - 1] if i else START, "exit": exits[i] if i + 1 < len(own) else None, "stats": None if i else stats}


def crossed(cut: DataFrame) -> DataFrame:
    """(piece, entry, exit, stats) of all pieces; a task reads conversations one after the other and holds 32 small numbers for each 4,096 rows of one."""
    summary = cut.drop("turn_rows").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    arrow = _arrow(_CROSSED)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in slices(batches) for r in batch.to_pylist())
        done: list[dict] = []
        for _, own in groupby(rows, key=lambda r: (r["conv_id"] is None, r["conv_id"])):
            done += met(list(own))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        yield pa.RecordBatch.from_pylist(done, arrow)

    return summary.mapInArrow(walk, _CROSSED)


def edited(rows: Sequence[dict], entry: int, exit_state: int | None) -> list[dict]:
    """The edits of a piece in order: (edit, role, text), deleted rows with nulls."""
    ends = closing_costs() if exit_state is None else tuple(c for c, _ in only(exit_state))
    state, out = entry, []

    def added() -> None:
        nonlocal state
        out.append({"edit": "I", "role": ASKS[state], "text": ""})
        state = NEXT[state]

    for row, (letters, after) in zip(rows, reconstruct([r["kind"] for r in rows], entry, ends), strict=True):
        for _ in letters[:-1]:
            added()
        edit = letters[-1]
        out.append({"edit": edit, "role": None if edit == "D" else ASKS[state] if edit == "R" else row["role"], "text": None if edit == "D" else row["text"]})
        state = after
    for _ in CLOSING[state][1] if exit_state is None else "":
        added()
    return out


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, stats, edits): the cheapest edits that give each conversation the roles ``(s?(ua)+)?``, system, then user and assistant in turns.

    ``rows`` has (conv_id, turn, role, text, copies, present); a row with a copies of n stands for n
    equal ones, and one that isn't present only makes its conversation appear. Further columns are left out.
    Rows are taken by turn, nulls first, then role and digest of the text. Null roles and
    texts count as one space, and a null conv_id is a conversation of its own.

    A blank row (white space alone) or a duplicate (role and text seen earlier in the conversation) must
    go; a truncated one (its last character but white space isn't one of . ! ?) costs more if it
    stays. Edits are K keep, R rerole, D delete and I insert; of several cheapest ways the ASCII-least is taken.
    A role's initial is its first character; a row with an empty role is rewritten or deleted.

    A row of the result holds a piece of a conversation, 4,096 rows at most; pieces ascend.
    ``stats`` counts the whole conversation and stands in the row of its first piece. A conversation
    without rows has no edits, and an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(" "))
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.col("copies").cast("long").alias("copies"), "present")
    cut = pieces(own)
    both = cut.select("conv_id", "piece", "turn_rows").join(crossed(cut), "piece").select("conv_id", "piece", "entry", "exit", "stats", "turn_rows")
    kind = own.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, piece long, stats {_STATS}, edits array<struct<edit:string,role:string,text:string>>"
    arrow = _arrow(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            done = [{"conv_id": r["conv_id"], "piece": r["piece"], "stats": r["stats"], "edits": edited(r["turn_rows"], r["entry"], r["exit"])} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(done, arrow)

    return both.mapInArrow(solve, schema)


def audit(edits: Column) -> Column:
    return F.array_join(F.transform(edits, lambda e: e["edit"]), "")


def repaired_text(edits: Column) -> Column:
    """``role:text`` of the turns that are left, a line each; null where none is."""
    left = F.filter(edits, lambda e: e["edit"] != "D")
    return F.when(F.size(left) > 0, F.array_join(F.transform(left, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n"))
