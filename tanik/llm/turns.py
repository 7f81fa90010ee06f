"""Conversation structure repair by a Viterbi search whose edits come out as soon as they are certain.

A repaired conversation's role initials read ``(s?(ua)+)?``. Its four states are: nothing yet, after the
system row, after a user row, after an assistant row. Each state keeps one survivor, the cheapest path
of edits into it. Survivors are leaves of a backpointer tree whose nodes count their references; where
the root has one child left, all survivors share it, so its edit is certain, is emitted, and the child
becomes the root. Memory holds the unresolved end of a conversation only.

From each state every edit letter leads to one next state, and no two paths of equal cost into one state
are such that one begins the other (what it adds would cost nothing). So of tied paths the lesser is
known from the letters at which they part, and the comparison runs over all that is still unresolved. A
survivor goes once another can do whatever it may still do for less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tanik.llm.common import small_batches

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a row whose role has this initial.
_KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The one role that may be inserted in a state, and the state after it.
_NEXT = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
INSERT, REROLE, DELETE, CUT = 3, 3, 4, 3
#: What a conversation's rest costs more, at most, from the second state than from the first: the second
#: may have to delete a system row that the first keeps, to insert, or both.
_LAG = {
    (NOTHING, SYSTEM): 6, (NOTHING, USER): 7, (NOTHING, ASSISTANT): 4, (SYSTEM, NOTHING): 0, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 0,
    (USER, NOTHING): 3, (USER, SYSTEM): 3, (USER, ASSISTANT): 3, (ASSISTANT, NOTHING): 0, (ASSISTANT, SYSTEM): 6, (ASSISTANT, USER): 3,
}
#: Unresolved edits between two looks for certain ones, at least.
_LOOK = 16
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


class _Node:
    """One edit of a path; ``refs`` counts the paths and survivors that go on from it."""

    __slots__ = ("parent", "edit", "row", "role", "depth", "refs")

    def __init__(self, parent: _Node | None, edit: str, row: tuple | None, role: str | None):
        self.parent, self.edit, self.row, self.role, self.refs = parent, edit, row, role, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def _less(a: _Node, b: _Node) -> bool:
    """Whether the path to ``a`` has the lesser letters; compares back to where the two part."""
    while a.depth > b.depth:
        a = a.parent
    while b.depth > a.depth:
        b = b.parent
    while a.parent is not b.parent:
        a, b = a.parent, b.parent
    return a.edit < b.edit


class Repair:
    """Takes one conversation's rows in order and yields (edit, row, role) as they become certain."""

    def __init__(self):
        self.root = _Node(None, "", None, None)
        self.root.refs = 1
        self.alive: dict[int, tuple[int, _Node]] = {NOTHING: (0, self.root)}
        self.look = self.root.depth + _LOOK

    def _offer(self, into: dict, state: int, cost: int, parent: _Node, edit: str, row: tuple | None, role: str | None) -> None:
        held = into.get(state)
        if held and held[0] < cost:
            return
        node = _Node(parent, edit, row, role)
        node.refs = 1
        if held:
            if held[0] == cost and not _less(node, held[1]):
                self._drop(node)
                return
            self._drop(held[1])
        into[state] = (cost, node)

    def _drop(self, node: _Node | None) -> None:
        while node:
            node.refs -= 1
            if node.refs:
                return
            node = node.parent

    def _inserts(self) -> None:
        """Paths that insert here; two inserts in a row suffice, and none is worth taking twice."""
        for source in (NOTHING, SYSTEM, ASSISTANT, USER):
            if source in self.alive:
                cost, node = self.alive[source]
                role, state = _NEXT[source]
                self._offer(self.alive, state, cost + INSERT, node, "I", None, role)

    def push(self, row: tuple, initial: str, fault: str | None) -> Iterator[tuple[str, tuple | None, str | None]]:
        """One more row; ``row`` is given back with its edit."""
        self._inserts()
        found: dict[int, tuple[int, _Node]] = {}
        more = CUT if fault == TRUNCATED else 0
        for state, (cost, node) in self.alive.items():
            self._offer(found, state, cost + DELETE, node, "D", row, None)
            if fault not in (BLANK, DUPLICATE):
                if (state, initial) in _KEPT:
                    self._offer(found, _KEPT[state, initial], cost + more, node, "K", row, None)
                role, then = _NEXT[state]
                self._offer(found, then, cost + REROLE + more, node, "R", row, role)
        for _, node in self.alive.values():
            self._drop(node)
        self.alive = found
        for state in [s for s, (cost, _) in found.items() if any(found[t][0] + _LAG[s, t] < cost for t in found if t != s)]:
            self._drop(found.pop(state)[1])
        if max(node.depth for _, node in found.values()) >= self.look:
            yield from self._certain()

    def _certain(self) -> Iterator[tuple[str, tuple | None, str | None]]:
        node, path = next(iter(self.alive.values()))[1], []
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path and self.root.refs == 1:
            self.root = path.pop()
            self.root.parent = None
            yield self.root.edit, self.root.row, self.root.role
            self.root.row = None
        self.look = self.root.depth + max(_LOOK, 2 * len(path))

    @property
    def pending(self) -> int:
        """Edits of the longest survivor that are not certain yet."""
        return max(node.depth for _, node in self.alive.values()) - self.root.depth

    def finish(self) -> Iterator[tuple[str, tuple | None, str | None]]:
        """The edits that are left, of the cheapest complete path."""
        self._inserts()
        ends = {s: self.alive[s] for s in (NOTHING, ASSISTANT) if s in self.alive}
        cheapest = min(cost for cost, _ in ends.values())
        best = None
        for cost, node in ends.values():
            if cost == cheapest and (best is None or _less(node, best)):
                best = node
        path = []
        while best is not self.root:
            path.append(best)
            best = best.parent
        for node in reversed(path):
            yield node.edit, node.row, node.role


_ROW = "turn long, role string, fault string, edit string, new_role string, new_text string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema: pa.Schema | None = None
    out: list[tuple] = []
    weight = 0

    def flushed() -> pa.RecordBatch:
        nonlocal out, weight
        columns = list(zip(*out)) or [()] * 7
        found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        out, weight = [], 0
        return found

    def add(conv, edits) -> None:
        nonlocal weight
        for edit, row, role in edits:
            turn, old, text, fault = row or (None, None, "", None)
            kept = None if edit == "D" else text
            out.append((conv, turn, old, fault, edit, role or (old if edit == "K" else None), kept))
            weight += 50 + len(kept or "")

    conv, machine = None, None
    for batch in batches:
        if schema is None:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("turn", pa.int64()), *[(n, pa.string()) for n in ("role", "fault", "edit", "new_role", "new_text")]])
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for one, *row, copy in zip(*(part.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault", "copy"))):
                if machine is None or one != conv:
                    if machine is not None:
                        add(conv, machine.finish())
                    conv, machine = one, Repair()
                    out.append((conv, *[None] * 6))  # each conversation begins with a row without an edit
                if copy:
                    add(conv, machine.push(tuple(row), row[1][:1], row[3]))
                if weight > 4_000_000:
                    yield flushed()
        if out:
            yield flushed()
    if machine is not None:
        add(conv, machine.finish())
        yield flushed()


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    done: list[tuple] = []
    kind: pa.DataType | None = None
    conv, open_ = None, False

    def closed() -> tuple:
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        return (conv, gaps, *(counts[n] for n in names[1:]), audit.decode(), sha.hexdigest())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *names, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            for one, turn, role, fault, edit, new_role, text in zip(*(c.to_pylist() for c in part.columns)):
                if edit is None:
                    if open_:
                        done.append(closed())
                    conv, open_, counts, audit, sha = one, True, dict.fromkeys(names, 0), bytearray(), hashlib.sha256()
                    turns, before, begun = [0, 0, 0], None, False  # least, last and different turns
                    continue
                audit += edit.encode()
                counts["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                if edit != "I":
                    if turn is not None and not (turns[2] and turn == turns[1]):
                        turns = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
                    if fault:
                        counts[fault] += 1
                        counts["cost"] += CUT * (fault == TRUNCATED and edit != "D")
                    if before is not None:
                        counts["illegal"] += before + role[:1] not in ("su", "ua", "au")
                    before = role[:1]
                if edit != "D":
                    sha.update((("\n" if begun else "") + f"{new_role}:{text}").encode("utf-8", "surrogatepass"))
                    begun = True
            if len(done) >= 1024:
                yield batch_of(done)
                done = []
    if open_:
        done.append(closed())
    if done:
        yield batch_of(done)


def repair(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """The cheapest edits of every conversation in order: conv_id, turn, role, fault, edit, new_role, new_text.

    ``edit``: K keeps a row, R gives it new_role, D deletes it (new_text is null), I inserts an empty row
    (turn, role and fault are null). Each conversation begins with a row without an edit, also where it has
    no rows; conversations follow each other whole and in order within a partition. ``copies``: how often
    a row of the input stands (0: not at all, but its conversation is known).

    Rows go by turn, a null turn first, then role and text, so that equal rows are adjacent. A null role or text
    is one space: such a text is blank, such a role is never kept. A null conv_id is one conversation. An
    empty table gives an empty one; other columns are left out. The conversation's key is hashed once, and
    each task reads its rows as a sorted stream (Spark sorts on disk if it must): even a conversation with
    a large share of all rows takes constant memory. Its rows stay in one task, as its repaired text is one
    running hash.
    """
    times = F.lit(1) if copies is None else copies
    plain = rows.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), times.cast("int").alias("times"))
    gone = F.col("times") == 0
    plain = plain.withColumn("copy", F.explode(F.when(gone, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("times")))))
    plain = plain.withColumn("role", F.when(~gone, F.col("role"))).withColumn("text", F.when(~gone, F.col("text"))).repartition("conv_id")
    by_turn = F.col("turn").asc_nulls_first()
    plain = plain.withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(by_turn)))
    fault = F.when(gone, None).when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
    marked = plain.withColumn("fault", fault).sortWithinPartitions("conv_id", by_turn, "role", "text", "nth").select("conv_id", "turn", "role", "text", "fault", "copy")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return small_batches(marked).mapInArrow(_repaired, f"conv_id {kind}, {_ROW}")


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with planted faults, and how often each row stands: dropped, emptied, stripped of end marks, repeated, or said by the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(part("role"))
    out = rows.select("conv_id", "turn", "role", "text").withColumn("kind", kind).withColumn("text", text).withColumn("role", role)
    return out, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)


def digest(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, the edits' cost and letters, the hash of the repaired text.

    Derived from the rows of ``repair`` in their order, in the same task.
    """
    damaged, copies = damage(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return repair(damaged, copies).mapInArrow(_summarised, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
