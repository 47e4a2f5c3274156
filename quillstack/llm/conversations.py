"""Conversation structure repair by a dynamic programme over the turns that stay.

A repaired conversation has the role initials ``(s?(ua)+)?``. Each turn is kept, reroled to user or assistant, or deleted;
empty turns may be inserted anywhere. The programme runs over retained turns from the last to the first: a turn retained
under a role costs its edit and the cheapest way on from there, and a way on from a role is the next retained turn (or
the end), the deletions of the turns between, a difference of prefix sums, and the insertions that the two roles ask for.
One running minimum per state (start, system, user, assistant) holds the best way on, so a turn is constant work.

Of equally cheap repairs the one whose audit (initials of the edits in order) is least in ASCII wins. D is the least
letter, so of equal ways on the one with more deletions in front, found earlier by this order, stays; of ways to the same
next turn the one with the least insertions-and-edit letters is taken. Both are decided on the spot.

A conversation's turns come sorted twice through one shuffle: first as slim rows without texts, from which the plan is
made, then with their texts, which pass through and are never gathered. A task so holds some bytes a turn, not the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Turns of one batch that a task hands on.
ROWS = 4096

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Insertions before a role, by the state before it; a missing pair can't be mended by insertions. A system turn stands
#: first or nowhere.
BETWEEN = {
    START: {SYSTEM: 0, USER: 0, ASSISTANT: 1},
    SYSTEM: {USER: 0, ASSISTANT: 1},
    USER: {ASSISTANT: 0, USER: 1},
    ASSISTANT: {USER: 0, ASSISTANT: 1},
}
#: Insertions after the last retained turn.
AFTER = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Neighbours that are in order.
LEGAL = {"su", "ua", "au"}
WHITE = r"\x20\x09-\x0D"


def repair_plan(initials: list[str], gone: list[bool], cut: list[bool]) -> tuple[int, list[tuple[list[str], str, str | None]], list[str]]:
    """(cost, what happens at each turn, roles inserted at the end). What happens: roles inserted before it, its edit's
    initial, its new role where it is reroled. ``gone``: must be deleted; ``cut``: costs more where it isn't."""
    n = len(initials)
    deleted = [DELETE * i for i in range(n + 1)]
    #: Per state: (cost counted from the first turn's deletion on, next turn, insertions, edit, its state).
    best = [(deleted[n] + INSERT * AFTER[r], n, AFTER[r], "", r) for r in range(4)]
    onward: list = [None] * n
    for k in range(n - 1, -1, -1):
        if gone[k]:
            continue
        own = INITIAL.get(initials[k])
        costs = {r: (REROLE, "R") for r in (USER, ASSISTANT)}
        if own is not None:
            costs[own] = (0, "K")
        onward[k] = tuple(best)
        values = {r: (price + TRUNCATED * cut[k] + best[r][0] - deleted[k + 1], edit) for r, (price, edit) in costs.items()}
        for before, roles in BETWEEN.items():
            options = [(deleted[k] + INSERT * n_in + values[r][0], "I" * n_in + values[r][1], n_in, r) for r, n_in in roles.items() if r in values]
            price, _, n_in, r = min(options)
            if price < best[before][0]:
                best[before] = (price, k, n_in, values[r][1], r)
    plan: list = [([], "D", None)] * n
    way, state = best[START], START
    while way[1] < n:
        _, k, n_in, edit, r = way
        plan[k] = (inserted(state, n_in), edit, ROLES.get(r) if edit == "R" else None)
        way, state = onward[k][r], r
    return best[START][0], plan, inserted(state, way[2])


def inserted(state: int, n: int) -> list[str]:
    """Roles of ``n`` turns inserted after a state: user and assistant by turns."""
    first = ASSISTANT if state == USER else USER
    return [ROLES[first] if i % 2 == 0 else ROLES[USER + ASSISTANT - first] for i in range(n)]


class _Conversation:
    """One conversation as it streams by: slim turns first, then texts."""

    def __init__(self, key):
        self.key, self.turns, self.initials, self.faults, self.seen = key, [], [], [], set()
        self.at, self.place, self.plan, self.tail = -1, 0, None, []

    def slim(self, turn, role: str, digest: bytes, blank: bool, cut: bool) -> None:
        fault = "blank" if blank else "duplicate" if (role, digest) in self.seen else "truncated" if cut else ""
        self.seen.add((role, digest))
        self.turns.append(turn)
        self.initials.append(role[:1])
        self.faults.append(fault)

    def head(self) -> dict:
        """The conversation's own row; makes the plan."""
        cost, self.plan, self.tail = repair_plan(self.initials, [f in ("blank", "duplicate") for f in self.faults], [f == "truncated" for f in self.faults])
        known = [t for t in self.turns if t is not None]
        out = {name: self.faults.count(name) for name in ("blank", "duplicate", "truncated")}
        out["gaps"] = known[-1] - known[0] + 1 - len(set(known)) if known else 0
        out["illegal"] = sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:]))
        self.seen, self.turns = set(), []
        return out | {"place": 0, "cost": cost}

    def edits(self, role: str, text: str) -> Iterator[dict]:
        self.at += 1
        before, edit, new = self.plan[self.at]
        yield from self.new(before)
        self.place += 1
        yield {"place": self.place, "edit": edit, "role": role if new is None else new, "text": None if edit == "D" else text}

    def new(self, roles: list[str]) -> Iterator[dict]:
        for role in roles:
            self.place += 1
            yield {"place": self.place, "edit": "I", "role": role, "text": ""}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, held, now = [], 0, None

    def put(row: dict, key) -> None:
        nonlocal held
        rows.append(row | {"conv": key})
        held += len(row.get("text") or "")

    def done() -> None:
        if now.plan is None:
            put(now.head(), now.key)
        for row in now.new(now.tail):
            put(row, now.key)

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or r["conv"] != now.key:
                if now is not None:
                    done()
                now = _Conversation(r["conv"])
            if r["phase"] == 0:
                if not r["lost"]:
                    now.slim(r["turn"], r["role"], r["digest"], r["blank"], r["cut"])
                continue
            if now.plan is None:
                put(now.head(), now.key)
            for row in now.edits(r["role"], r["text"]):
                put(row, now.key)
            if len(rows) >= ROWS or held > 1 << 22:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    if now is not None:
        done()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: Column | None = None) -> DataFrame:
    """The repaired conversations, those of a partition one after another and each in order: (conv, place, edit, role,
    text, and the counts). A conversation's first row, place 0, holds its counts and cost (longs) and no edit; a row for
    each edit follows: kept, reroled, deleted (its old role, null text) or inserted (empty text).

    Turns are taken by ``turn``, nulls first; ties by role, then by the SHA-256 of the text. Null roles and texts are one
    blank, so such a turn is blank. A null conversation key is a conversation. Turns that are ``lost`` are absent, but
    their conversation is returned even if none is left. Other columns are ignored; an empty table gives an empty one.
    A conversation is one task's (its repaired text is one sequence); its texts stream through, whatever their size.
    """
    blank_if_null = lambda c: F.coalesce(F.col(c), F.lit(" "))
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank_if_null(role).alias("role"), blank_if_null(text).alias("text"), (F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))).alias("lost"))
    digest = F.unhex(F.sha2("text", 256))
    phases = F.array(F.lit(0), *([F.lit(1)])) if lost is None else F.when(F.col("lost"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    t = t.select("*", digest.alias("digest"), (~F.col("text").rlike(f"[^{WHITE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{WHITE}]*\z")).alias("cut"), F.explode(phases).alias("phase"))
    t = t.withColumn("text", F.when(F.col("phase") == 1, F.col("text")))
    ordered = t.repartition("conv").sortWithinPartitions("conv", "phase", F.asc_nulls_first("turn"), "role", "digest")
    kind = turns.schema[conv].dataType.simpleString()
    ddl = f"conv {kind}, place long, edit string, role string, text string, " + ", ".join(f"{c} long" for c in COUNTS)
    schema = _arrow(turns.sparkSession, ddl)
    return ordered.mapInArrow(lambda batches: _repaired(batches, schema), ddl)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, the counts, audit, repaired_sha256) of what ``repair`` returned, in the order it came: the hash is that of
    the repaired ``role:text``, parted by newlines. One row a conversation; runs on the same partitions, without a shuffle."""
    kind = repaired.schema["conv"].dataType.simpleString()
    ddl = f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    schema = _arrow(repaired.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, audit, sha, first = [], None, [], None, True
        for batch in batches:
            for r in batch.to_pylist():
                if r["place"] == 0:
                    if now is not None:
                        rows.append(now | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                    now, audit, sha, first = {"conv": r["conv"], **{c: r[c] for c in COUNTS}}, [], hashlib.sha256(), True
                    continue
                audit.append(r["edit"])
                if r["edit"] != "D":
                    sha.update(("" if first else "\n").encode() + f"{r['role']}:{r['text']}".encode())
                    first = False
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if now is not None:
            rows.append(now | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return repaired.mapInArrow(run, ddl)


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults by the crc32 of ``conv_id:turn``, nulls being one blank: of 20
    remainders 0 marks the row as ``lost``, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), (F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fault == 0).alias("lost"), copies.alias("copy")).drop("copy")
