"""Conversations made well formed by the cheapest edits.

A well-formed conversation is empty, or an optional system turn and then user and assistant in turn, the assistant
last.  Turns are kept (0), given the role user or assistant (1), deleted (2) or inserted without text (5).  A turn
without text, or with a role and text seen before, must be deleted; one that does not end in ``.``, ``!`` or ``?`` costs
5 unless it is deleted.

Rows are dealt out by conversation once.  Within a partition each conversation is read twice in the order of its turns:
first as a class a row (fault and initial of the role, one byte), over which costs to go are worked out from the end for
each state of the grammar; then with the texts, walking forward and taking the ASCII-least of the edits whose cost is
tight.  So a task holds two bytes a turn of one conversation (its audit, a single value, is as long), never its texts.
Costs to go, less their least, take few values, so the steps are looked up.

Edge cases: turns are ordered by number, nulls first, then role and text.  A null id is a conversation of its own.
Null roles and texts are one blank; a role that does not begin with s, u or a can only be changed or deleted.
Equal rows are kept apart; all but the first are duplicates.  Very long texts stay on Spark's side until they are
hashed one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("fine", "blank", "duplicate", "truncated")
INITIALS = "sua"
GONE = -1
# States of the grammar: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
AFTER_ADDED = (2, 2, 3, 2)
ADDED_ROLE = ("user", "user", "assistant", "user")
AFTER_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED = 5


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, there`` with one row in four damaged, by the CRC-32 of id and turn; a row that is dropped stays with ``there`` false."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    role, text = F.when(kind == 4, "user").otherwise(blank("role")), blank("text")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("there"), F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)).alias("copies"))
    return out.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def _fault(text: Column, seen: Column) -> Column:
    end = F.rtrim(text, F.lit(BLANKS))
    return F.when(end == "", 1).when(seen, 2).when(~F.right(end, F.lit(1)).isin(*".!?"), 3).otherwise(0)


def _passes(rows: DataFrame) -> DataFrame:
    """Each conversation's rows twice, in order: ``phase`` 0 with the class, 1 with role and text.  Dropped rows only name their conversation."""
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), there.alias("there"))
    dealt = dealt.select("conv_id", "turn", "there", *(F.when(F.col("there"), F.col(c)).alias(c) for c in ("role", "text"))).repartition("conv_id")
    again = Window.partitionBy("conv_id", "there", "role", "text").orderBy("turn")
    order = Window.partitionBy("conv_id", "there").orderBy("turn", "role", "text")  # nulls come first
    initial = F.locate(INITIALS[0], F.left("role", F.lit(1))) + F.locate(INITIALS[1], F.left("role", F.lit(1))) * 2 + F.locate(INITIALS[2], F.left("role", F.lit(1))) * 3
    found = dealt.withColumn("seen", F.row_number().over(again) > 1).withColumn("at", F.row_number().over(order).cast("long"))
    kind = F.when(~F.col("there"), GONE).otherwise(_fault(F.col("text"), F.col("seen")) * 4 + initial).cast("int")
    found = found.withColumn("kind", kind)
    none = F.lit(None).cast("string")
    first = F.struct(F.lit(0).alias("phase"), "kind", none.alias("role"), none.alias("text"))
    second = F.struct(F.lit(1).alias("phase"), "kind", "role", "text")
    both = F.when(F.col("there"), F.array(first, second)).otherwise(F.array(first))
    return found.select("conv_id", "turn", "at", F.inline(both)).sortWithinPartitions("conv_id", "phase", "at")


class Steps:
    """Costs to go by state, less their least; each is known by a number, and so is what is done on the way.

    ``back[number, kind]`` is the number one row earlier, by how much the least cost grows, and the row's plan: for each
    state the edits up to and with this row and the state after it.
    """

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.back: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.plans: list[tuple[tuple[str, int], ...]] = []
        self.plan_number: dict[tuple, int] = {}
        self.end, self.end_cost, self.last_plan = self._step((None,) * 4, None)

    def _known(self, vector: tuple[int, ...]) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    def _moves(self, after: tuple, kind: int | None, state: int) -> dict[str, tuple[int, int]]:
        """Edits of a row in a state: their cost with all that follows, and the state after them."""
        if kind is None:  # past the last row: nothing is left in a state that may end
            return {"": (0, state)} if state in (0, 3) else {}
        fault, initial = FAULTS[kind >> 2], INITIALS[(kind & 3) - 1 : kind & 3]
        moves = {DELETE: (COSTS[DELETE] + after[state], state)}
        if fault in ("fine", "truncated"):
            more = TRUNCATED if fault == "truncated" else 0
            to = AFTER_KEPT[initial][state] if initial else None
            if to is not None:
                moves[KEEP] = (COSTS[KEEP] + more + after[to], to)
            to = AFTER_ADDED[state]
            moves[REROLE] = (COSTS[REROLE] + more + after[to], to)
        return moves

    def _step(self, after: tuple, kind: int | None) -> tuple[int, int, int]:
        moves = [self._moves(after, kind, q) for q in range(4)]
        far = 1 << 20
        cost = [min((c for c, _ in m.values()), default=far) for m in moves]
        for _ in range(4):  # turns may be inserted first, any number of them
            cost = [min(c, COSTS[INSERT] + cost[AFTER_ADDED[q]]) for q, c in enumerate(cost)]
        plan = []
        for q in range(4):
            edits = ""
            while True:
                tight = [e for e, (c, _) in moves[q].items() if c == cost[q]]
                if cost[q] == COSTS[INSERT] + cost[AFTER_ADDED[q]]:
                    tight.append(INSERT)
                edit = min(tight)
                edits += edit
                if edit != INSERT:
                    plan.append((edits, moves[q][edit][1]))
                    break
                q = AFTER_ADDED[q]
        least = min(cost)
        if tuple(plan) not in self.plan_number:
            self.plan_number[tuple(plan)] = len(self.plans)
            self.plans.append(tuple(plan))
        return self._known(tuple(c - least for c in cost)), least, self.plan_number[tuple(plan)]

    def plan(self, kinds: bytearray) -> tuple[int, list[int] | bytearray]:
        """Backwards over the classes of a conversation: its cost, and the plan of each row in order."""
        at, total, plans = self.end, self.end_cost, []
        for kind in reversed(kinds):
            found = self.back.get((at, kind))
            if found is None:
                found = self.back[at, kind] = self._step(self.vectors[at], kind)
            at, more, plan = found
            total += more
            plans.append(plan)
        plans = bytearray(plans) if len(self.plans) < 256 else plans
        plans.reverse()
        return total + self.vectors[at][0], plans


class Repair:
    """The machine of one task: rows in the order of ``_passes`` in, a row per conversation (or per repaired turn) out."""

    def __init__(self, schema: pa.Schema, turns: bool):
        self.schema, self.turns, self.steps = schema, turns, Steps()
        self.out: list[dict] = []

    def begin(self, conv_id) -> None:
        self.conv_id, self.kinds, self.plans, self.at = conv_id, bytearray(), None, 0
        self.low = self.high = self.last_turn = None
        self.n_turns, self.cost, self.state, self.audit, self.n_out = 0, 0, 0, bytearray(), 0
        self.hash = hashlib.sha256()

    def write(self, edit: str, role: str, text: str) -> None:
        if self.n_out:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        if self.turns:
            self.out.append({"conv_id": self.conv_id, "position": self.n_out, "edit": edit, "role": role, "text": text})
        self.n_out += 1

    def follow(self, plan: int, role: str | None = None, text: str = "") -> None:
        """Carry out a row's edits: insertions, then what happens to the row itself."""
        edits, to = self.steps.plans[plan][self.state]
        for edit in edits:
            self.audit += edit.encode()
            if edit == INSERT or edit == REROLE:
                self.write(edit, ADDED_ROLE[self.state], "" if edit == INSERT else text)
                self.state = AFTER_ADDED[self.state]
            elif edit == KEEP:
                self.write(edit, role, text)
        self.state = to

    def row(self, turn, phase: int, kind: int, role, text) -> None:
        if kind == GONE:
            return
        if phase == 0:
            self.kinds.append(kind)
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.n_turns += turn != self.last_turn
                self.last_turn = turn
            return
        if self.plans is None:
            self.cost, self.plans = self.steps.plan(self.kinds)
        self.follow(self.plans[self.at], role, text)
        self.at += 1

    def finish(self) -> None:
        if self.kinds:
            self.follow(self.steps.last_plan)
        if self.turns:
            return
        legal = {(1, 2), (2, 3), (3, 2)}
        count = lambda fault: sum(self.kinds.count(fault * 4 + initial) for initial in range(4))
        self.out.append(
            {
                "conv_id": self.conv_id,
                "gaps": 0 if self.low is None else self.high - self.low + 1 - self.n_turns,
                **{name: count(k) for k, name in enumerate(FAULTS) if k},
                "illegal": sum((a & 3, b & 3) not in legal for a, b in zip(self.kinds, islice(self.kinds, 1, None))),
                "cost": self.cost,
                "audit": self.audit.decode(),
                "repaired_sha256": self.hash.hexdigest(),
            }
        )

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            for conv_id, turn, phase, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "phase", "kind", "role", "text"))):
                if not begun or conv_id != self.conv_id:
                    if begun:
                        self.finish()
                    self.begin(conv_id)
                    begun = True
                self.row(turn, phase, kind, role, text)
            yield self.flush()
        if begun:
            self.finish()
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_pylist(out, schema=self.schema)


def _run(rows: DataFrame, fields: list[tuple[str, T.DataType]], turns: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(rows.sparkSession)
    passes = _passes(rows)
    schema = T.StructType([passes.schema["conv_id"], *(T.StructField(n, t) for n, t in fields)])
    arrow = to_arrow_schema(schema)
    return passes.mapInArrow(lambda batches: Repair(arrow, turns).read(batches), schema)


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of ``conv_id, turn, role, text`` rows.

    ``gaps`` are turn numbers missing between the first and the last; ``illegal`` are neighbours that the grammar does not
    allow; ``audit`` has the initial of each edit, of all cheapest ones the ASCII-least; the digest is of the
    repaired ``role:text`` rows, joined by line ends.  With a boolean column ``there``, rows where it is false count as
    dropped: their conversation is returned even if nothing else is left of it.
    """
    long, text = T.LongType(), T.StringType()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return _run(rows, [*((n, long) for n in names), ("audit", text), ("repaired_sha256", text)], turns=False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text``: the turns of the repaired conversations (edit ``K``, ``R`` or ``I``)."""
    text = T.StringType()
    return _run(rows, [("position", T.LongType()), ("edit", text), ("role", text), ("text", text)], turns=True)
