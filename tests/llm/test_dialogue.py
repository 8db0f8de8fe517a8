import hashlib
import random
import re
from functools import cache
from itertools import product
from zlib import crc32

import pytest

from larkspur.llm import dialogue


def faults(rows):
    """First fault of each row of (turn, role, text), in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(roles, found):
    """Cost and audit by a table of what is left, from every row and state; letters are then taken greedily."""
    asks = {"": "u", "s": "u", "u": "a", "a": "u"}

    def options(i, state, inserts):
        if inserts < 2:
            yield "I", i, asks[state], 3, inserts + 1
        if i < len(roles):
            yield "D", i + 1, state, 4, 0
            if found[i] not in ("blank", "duplicate"):
                more = 3 * (found[i] == "truncated")
                if roles[i][:1] == asks[state] or (roles[i][:1] == "s" and state == ""):
                    yield "K", i + 1, roles[i][:1], more, 0
                yield "R", i + 1, asks[state], 3 + more, 0

    @cache
    def left(i, state, inserts=0):
        ends = [0] if i == len(roles) and state in ("", "a") else []
        return min(ends + [c + left(j, s, k) for _, j, s, c, k in options(i, state, inserts)], default=10**9)

    i, state, inserts, said = 0, "", 0, ""
    while not (i == len(roles) and left(i, state, inserts) == 0):
        rest = left(i, state, inserts)
        letter, i, state, _, inserts = min(o for o in options(i, state, inserts) if o[3] + left(o[1], o[2], o[4]) == rest)
        said += letter
    return left(0, ""), said


def plain(rows):
    """All that the query returns of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = cheapest(tuple(r[1] for r in rows), tuple(found))
    out, i, state = [], 0, ""
    for letter in audit:
        want = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        if letter != "D":
            role, text = (want, "") if letter == "I" else (want if letter == "R" else rows[i][1], rows[i][2])
            out.append(f"{role}:{text}")
            state = role[:1]
        i += letter != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out))
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_moves_match_all_letters():
    """A row between two states: every string of inserts and an edit."""
    for kind in range(9):
        for s, t in product(range(4), repeat=2):
            ways = []
            for k in range(5):
                state = s
                for _ in range(k):
                    state = dialogue.NEXT[state]
                more = 3 * k
                ways += [(more + 4, "I" * k + "D")] if state == t else []
                if kind:
                    initial, cut = "sua?"[(kind - 1) // 2], 3 * ((kind - 1) % 2)
                    ways += [(more + 3 + cut, "I" * k + "R")] if dialogue.NEXT[state] == t else []
                    ways += [(more + cut, "I" * k + "K")] if initial == dialogue.ASKS[state][0] and dialogue.NEXT[state] == t else []
                    ways += [(more + cut, "I" * k + "K")] if initial == "s" and state == 0 and t == 1 else []
            assert dialogue.moves(kind).get((s, t)) == min(ways, default=None)


def solved(roles, found, cuts):
    kinds = [dialogue.kind_of(r, f in ("blank", "duplicate"), f == "truncated") for r, f in zip(roles, found, strict=True)]
    edges = [0, *sorted(cuts), len(kinds)]
    own = []
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        vectors = [dialogue.ahead(kinds[a:b], dialogue.only(s)) for s in range(4)]
        own.append({"piece": n, "costs": [c for v in vectors for c, _ in v], "ranks": [r for v in vectors for _, r in v], "turns": 0, "n_rows": b - a, "last_initial": "", "first_initial": ""} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    states = list(dialogue.met(own))
    letters = ""
    for (a, b), s in zip(zip(edges, edges[1:], strict=False), states, strict=True):
        rows = [{"role": r, "text": "", "kind": k} for r, k in zip(roles[a:b], kinds[a:b], strict=True)]
        letters += "".join(e["edit"] for e in dialogue.edited(rows, s["entry"], s["exit"]))
    return states[0]["stats"]["cost"], letters


def test_against_the_full_table():
    rng = random.Random(2)
    for _ in range(1500):
        n = rng.randint(0, 14)
        roles = tuple(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]) for _ in range(n))
        found = tuple(rng.choice([None, None, None, "truncated", "blank", "duplicate"]) for _ in range(n))
        cuts = [rng.randint(0, n) for _ in range(rng.randint(0, 3))]
        assert solved(roles, found, cuts) == cheapest(roles, found), (roles, found, cuts)


def test_long_conversation():
    rng = random.Random(3)
    roles = [rng.choice(["user", "assistant", "assistant"]) for _ in range(60_000)]
    cost, letters = solved(roles, [None] * len(roles), range(4096, 60_000, 4096))
    state = spent = 0
    left = iter(roles)
    for e in letters:
        spent += {"K": 0, "R": 3, "D": 4, "I": 3}[e]
        role = next(left) if e != "I" else None
        assert e != "K" or role == dialogue.ASKS[state]
        state = state if e == "D" else dialogue.NEXT[state]
    assert spent == cost and state == dialogue.ASSISTANT and next(left, None) is None


def answers(spark, rows, monkeypatch=None):
    from larkspur.llm import queries

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return sorted((tuple(r[c] for c in NAMES) for r in queries.op12_conversation_repair(spark, "").collect()), key=str)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def expected(rows):
    """Damage and repair, conversation by conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        h = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return sorted(((c, *plain(own)) for c, own in convs.items()), key=str)


@pytest.mark.parametrize("most", [4096, 2])
def test_edges(spark, monkeypatch, most):
    monkeypatch.setattr(dialogue, "PIECE_ROWS", most)
    rng = random.Random(4)
    texts = ["Yes.", "No", " ", "", None, "What?", "é.\n", "Yes. \x0b", "\xa0", "x" * 5000 + "!", "cut"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "", "tool", "Sys"]), rng.choice(texts), "p") for c in (*range(40), None) for t in (None, None, *range(rng.randint(-3, 0), rng.randint(1, 12), rng.choice([1, 1, 2])))]
    rows += rng.choices(rows, k=100) + [(100, 3, "user", "Yes.", None)] * 50
    assert answers(spark, rows, monkeypatch) == expected([r[:4] for r in rows])
    assert answers(spark, [], monkeypatch) == []


def test_whole_table(spark, sf):
    from larkspur.llm.queries import op12_conversation_repair

    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = op12_conversation_repair(spark, sf).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=str) == expected(map(tuple, rows))
