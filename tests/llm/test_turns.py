"""Conversation repair against a plain search over whole conversations, and odd rows."""

import hashlib
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

from tanik.llm import turns
from tests.conftest import SMALL

SPACE = " \t\n\v\f\r"


def cheapest(rows):
    """(cost, letters) by recursion over the rest of a conversation; rows are (initial, fault)."""
    keeps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    then = {0: 2, 1: 2, 2: 3, 3: 2}

    @cache
    def rest(n, state, inserts):
        found = []
        if inserts < 3:
            cost, letters = rest(n, then[state], inserts + 1)
            found.append((cost + 3, "I" + letters))
        if n == len(rows):
            if state in (0, 3):
                found.append((0, ""))
            return min(found, default=(10**9, ""))
        initial, fault = rows[n]
        cost, letters = rest(n + 1, state, 0)
        found.append((cost + 4, "D" + letters))
        if fault not in ("blank", "duplicate"):
            cut = 3 if fault == "truncated" else 0
            if (state, initial) in keeps:
                cost, letters = rest(n + 1, keeps[state, initial], 0)
                found.append((cost + cut, "K" + letters))
            cost, letters = rest(n + 1, then[state], 0)
            found.append((cost + 3 + cut, "R" + letters))
        return min(found)

    for n in range(len(rows), 0, -40):  # the rest of a long conversation first: recursion stays shallow
        for state in range(4):
            rest(n, state, 0)
    return rest(0, 0, 0)


def expected(rows):
    """What the query returns, for [(conv_id, turn, role, text)], by conversation."""
    kept = {}
    for conv, turn, role, text in rows:
        out = kept.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    result = {}
    for conv, out in kept.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in out:
            faults.append("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, letters = cheapest(tuple((r[1][:1], f) for r, f in zip(out, faults)))
        said, state, n = [], 0, 0
        for letter in letters:
            new = {2: ("assistant", 3)}.get(state, ("user", 2))
            if letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[out[n][1][:1]]
                said.append(f"{out[n][1]}:{out[n][2]}")
            elif letter != "D":
                state = new[1]
                said.append(f"{new[0]}:{out[n][2] if letter == 'R' else ''}")
            n += letter != "I"
        known = [r[0] for r in out if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
        result[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return result


def repaired(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_given_conversations(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert repaired(turns.digest(rows)) == expected([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_random_conversations(spark):
    draw = random.Random(4)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None]
    rows = [(conv, turn, draw.choice(roles), draw.choice(["A b.", "c", "d!", "e", " ", "f?", f"{turn}."])) for conv in range(400) for turn in range(draw.randrange(1, 14))]
    rows += [(500, turn, "user" if draw.random() < 0.9 else "system", "same.") for turn in range(300)]  # nearly all are duplicates
    rows += [(501, turn, ("user", "assistant")[turn // 3 % 2], f"x{turn}" + "." * (turn % 4 > 0)) for turn in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert repaired(turns.digest(table.repartition(7))) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "hi."), (None, None, "assistant", "yo."), (1, None, None, None), (1, 5, "user", ""), (2, 3, "user", "é" * 9000), (3, 7, "user", "a."), (3, 7, "user", "a."), (3, 7, "assistant", "b?\r\n"), (4, 2, "", "no role."), (5, 2**40, "system", "s."), (5, -(2**40), "user", "\x1c")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = table.withColumn("copy", F.lit("x")).withColumn("fault", F.lit(1)).withColumn("edit", F.lit("q"))
    want = expected(rows)
    assert repaired(turns.digest(clashing)) == want and set(want) == {None, 1, 2, 3, 4, 5}
    assert turns.digest(table.limit(0)).count() == 0
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    only = spark.createDataFrame([(lost, 0, "user", "x.")], table.schema)
    assert repaired(turns.digest(only)) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_edited_rows(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "user", "why?"), (1, 2, "tool", "so.")]
    found = turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("edit IS NOT NULL").collect()
    assert [(r.edit, r.new_role, r.new_text) for r in found] == [("I", "user", ""), ("K", "assistant", "hello."), ("K", "user", "why?"), ("R", "assistant", "so.")]


def test_little_stays_pending():
    draw, machine, most, letters = random.Random(8), turns.Repair(), 0, []
    rows = [(draw.choice("suaut"), draw.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(20000)]
    for row in rows:
        letters += [edit for edit, _, _ in machine.push(row, *row)]
        most = max(most, machine.pending)
    letters += [edit for edit, _, _ in machine.finish()]
    assert most < 200 and len([x for x in letters if x != "I"]) == len(rows)
    assert "".join(letters[:300]) == cheapest(tuple(rows[:600]))[1][:300]
