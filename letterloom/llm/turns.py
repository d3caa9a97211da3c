"""Repair of the turn structure of conversations by branch and bound.

A sound conversation has no blank or repeated turns, and its roles are an optional system
turn followed by pairs of user and assistant. Edits keep, re-role, delete or insert
turns; the cheapest are searched, of equal ones those whose letters come first. Only
short codes of turns are searched; a conversation of any length is cut into blocks, each
solved between all states of the grammar, and blocks are put together like matrices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from letterloom.llm.common import stored

BLANK = " \t\n\x0b\x0c\r"
# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
REACHED = [(0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3)]
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
DELETE, CHANGE, INSERT, UNFINISHED = 3, 2, 2, 1
BLOCK = 48         # turns solved at once; longer conversations have more blocks
SOLVED = 1 << 16   # blocks that a Python worker remembers

Plan = tuple[int, str]                  # cost and letters of the edits
Table = dict[tuple[int, int], Plan]     # cheapest plan between two states


def _bounds(steps: list[tuple[str, int]], goals: tuple[int, ...]) -> list[tuple[int, int]]:
    """A lower bound of the cost from every turn on, where a user or where an assistant is
    due. System turns may stay anywhere here, which can only lower the cost."""
    due = [0 if {0, 1, 3} & set(goals) else INSERT, 0 if 2 in goals else INSERT]
    out = [(min(due[0], INSERT + due[1]), min(due[1], INSERT + due[0]))]
    for code, times in reversed(steps):
        if code == "x":
            out.append((out[-1][0] + DELETE * times, out[-1][1] + DELETE * times))
            continue
        mark = UNFINISHED * code.isupper()
        cost = []
        for p, role in enumerate("ua"):
            turn = min(DELETE + out[-1][p], CHANGE + mark + out[-1][1 - p])
            if code.lower() == role:
                turn = min(turn, mark + out[-1][1 - p])
            elif code.lower() == "s":
                turn = min(turn, mark + out[-1][p])
            cost.append(turn)
        out.append((min(cost[0], INSERT + cost[1]), min(cost[1], INSERT + cost[0])))
    return out[::-1]


def search(steps: list[tuple[str, int]], start: int, goals: tuple[int, ...]) -> Plan | None:
    """The cheapest edits of ``steps`` from state ``start`` to one of ``goals``, of equal
    cost the letters that come first; None if there are none.

    Depth first with a stack of its own. A branch is given up when its cost and the bound
    of what is left exceed the best plan known, or equal it with later letters, or when
    its node was reached by a plan that is no worse. Plans of one node have taken the same
    turns, so none of equal cost is the beginning of another and the order of two plans
    stays whatever follows.
    """
    bounds = _bounds(steps, goals)
    best: Plan | None = None
    seen: dict[tuple[int, int], Plan] = {}
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, letters = stack.pop()
        if best is not None:
            least = cost + bounds[at][state == 2]
            if least > best[0] or least == best[0] and letters > best[1][:len(letters)]:
                continue
        known = seen.get((at, state))
        if known is not None and known <= (cost, letters):
            continue
        seen[at, state] = (cost, letters)
        if at == len(steps) and state in goals and (best is None or (cost, letters) < best):
            best = (cost, letters)
        after = []
        if at < len(steps):
            code, times = steps[at]
            if code == "x":
                after.append((at + 1, state, cost + DELETE * times, letters + "D" * times))
            else:
                after.append((at + 1, state, cost + DELETE, letters + "D"))
                mark = UNFINISHED * code.isupper()
                if code.lower() in STEP[state]:
                    after.append((at + 1, STEP[state][code.lower()], cost + mark, letters + "K"))
                after += [(at + 1, to, cost + CHANGE + mark, letters + "R")
                          for role, to in STEP[state].items() if role in NAMES]
        after += [(at, to, cost + INSERT, letters + "I")
                  for role, to in STEP[state].items() if role in NAMES]
        stack += sorted(after, key=lambda n: (n[2] + bounds[n[0]][n[1] == 2], n[3]), reverse=True)
    return best


def steps_of(codes: str) -> list[tuple[str, int]]:
    """One step for every turn; neighbouring turns that have to go are one step, as nothing
    is inserted between them: the insertion may as well follow, with earlier letters."""
    out: list[tuple[str, int]] = []
    for code in codes:
        if code == "x" and out and out[-1][0] == "x":
            out[-1] = ("x", out[-1][1] + 1)
        else:
            out.append((code, 1))
    return out


@lru_cache(SOLVED)
def block_table(codes: str) -> Table:
    """The cheapest plan for a block between any two states."""
    steps = steps_of(codes)
    found = {(a, b): search(steps, a, (b,)) for a in range(4) for b in REACHED[a]}
    return {k: v for k, v in found.items() if v is not None}


@lru_cache(SOLVED)
def whole_plan(codes: str) -> Plan:
    """The cheapest plan for a whole conversation of one block."""
    return search(steps_of(codes), 0, ENDS)


def together(a: Table, b: Table) -> Table:
    out: Table = {}
    for (start, mid), (cost, letters) in a.items():
        for end in REACHED[mid]:
            if (mid, end) in b:
                more, rest = b[mid, end]
                plan = (cost + more, letters + rest)
                out[start, end] = min(out.get((start, end), plan), plan)
    return out


def joined(tables: Iterable[Table]) -> Table:
    """Tables of blocks in order put together, neighbours first, so that letters are
    copied only as often as the logarithm of their number asks for."""
    stack: list[tuple[int, Table]] = []
    for table in tables:
        rank = 0
        while stack and stack[-1][0] == rank:
            table = together(stack.pop()[1], table)
            rank += 1
        stack.append((rank, table))
    out = stack.pop()[1]
    while stack:
        out = together(stack.pop()[1], out)
    return out


class Segment:
    """Consecutive turns of one conversation: counts, ends, and codes cut into blocks."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self, conv) -> None:
        self.conv, self.codes, self.size, self.tables = conv, [], 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, initial: str, copies: int, blank: bool, truncated: bool, new: bool) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.illegal += copies - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.first = initial if self.first is None else self.first
        self.last = initial
        if blank:
            self.blank += copies
            code = "x" * copies
        else:
            self.duplicate += copies - new
            self.truncated += new and truncated
            code = initial if initial in ("s", "u", "a") else "o"
            code = (code.upper() if truncated else code) * new + "x" * (copies - new)
        if self.size == BLOCK:
            self.tables.append("".join(self.codes))
            self.codes, self.size = [], 0
        self.codes.append(code)
        self.size += 1

    def row(self, alone: bool) -> dict:
        """``alone``: no other segment of this conversation exists."""
        codes = "".join(self.codes)
        if alone and not self.tables:
            plans = [(0, 3, *whole_plan(codes))]
        else:
            table = joined(block_table(c) for c in [*self.tables, codes])
            plans = [(a, b, *plan) for (a, b), plan in table.items()]
        return {"conv": self.conv, "plans": [dict(zip(("start", "end", "cost", "letters"), p)) for p in plans],
                **{f: getattr(self, f) for f in self.FIELDS}}


COUNTS = pa.struct([(k, pa.int64()) for k in Segment.FIELDS[:7]]
                   + [("first", pa.string()), ("last", pa.string())])
PLANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()),
                            ("letters", pa.string())]))
SEGMENT = ("struct<blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, turns: bigint, "
           "low: bigint, high: bigint, first: string, last: string>")
PLAN = "array<struct<start: int, end: int, cost: bigint, letters: string>>"
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def turn_rows(convs: DataFrame, copies: str | None) -> DataFrame:
    """The columns that count, nulls in role and text as one space: (conv, turn, role,
    text, copies, mark), ``mark`` the same for the same role and text."""
    role = F.coalesce(F.col("role"), F.lit(" "))
    text = F.coalesce(F.col("text"), F.lit(" "))
    return convs.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"),
        (F.coalesce(F.col(copies).cast("long"), F.lit(0)) if copies else F.lit(1).cast("long")).alias("copies"),
        F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)).alias("mark"))


def _ordered(turn: Column) -> Column:
    return F.struct(turn.isNotNull(), turn)


def audits(convs: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per ``conv_id``: ``gaps`` in the turn numbers, turns that are ``blank``,
    else ``duplicate`` (role and text seen before), else ``truncated`` (the last character
    that is no white space is none of ``.!?``), ``illegal`` neighbours, ``cost`` and
    ``audit`` of the cheapest repair (D, I, K, R for delete, insert, keep, re-role).

    Turns are taken by number, nulls first, then role, then a hash of the text. ``copies``
    names a column that says how often a turn stands there; with 0 (or null) it only
    makes its conversation appear. A null ``conv_id`` is a conversation like any other, a
    null role or text is one space, repeated rows are duplicates, other columns are not
    looked at, and an empty table gives an empty one.

    Equal turns become one row first, and only codes and hashes move, no texts. Turns are
    dealt by range of (conversation, turn, ...), so a conversation of any length spreads
    over tasks; each task sends on one row per conversation.
    """
    rows = turn_rows(convs, copies)
    bare = F.rtrim("text", F.lit(BLANK))
    narrow = rows.select(
        "conv", "turn", F.substring("role", 1, 1).alias("initial"), "role", "mark", "copies",
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    same = narrow.groupBy("conv", "turn", "role", "mark").agg(
        F.sum("copies").alias("copies"), *[F.min(c).alias(c) for c in ("initial", "blank", "truncated")])
    first = narrow.where("copies > 0").groupBy(F.col("conv").alias("c"), F.col("mark").alias("m")).agg(
        F.min(_ordered(F.col("turn"))).alias("first"))
    marked = stored(same.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")),
                              "left")
                    .withColumn("new", F.coalesce(F.col("first") == _ordered(F.col("turn")), F.lit(False)))
                    .drop("c", "m", "first"), "turns")
    order = ["conv", "turn", "role", "mark"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "conv", "turn", "initial", "copies", "blank", "truncated", "new")
    kind = convs.schema["conv_id"].dataType.simpleString()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at_edge, ready, schema, part = None, True, [], None, None

        def flush() -> pa.RecordBatch:
            keys = ("conv", "plans", *Segment.FIELDS)
            got = {k: [r[k] for r in ready] for k in keys}
            counts = pa.array([{f: r[f] for f in Segment.FIELDS} for r in ready], COUNTS)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ready), pa.int32()), pa.array(got["conv"], schema.field("conv").type),
                 counts, pa.array(got["plans"], PLANS)], ["part", "conv", "counts", "plans"])

        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for part, conv, turn, initial, copies, blank, truncated, new in zip(*columns):
                if now is None or conv != now.conv:
                    if now is not None:
                        # The first and the last conversation of a task may go on in another.
                        ready.append(now.row(alone=not at_edge))
                        at_edge = False
                    now = Segment(conv)
                if copies > 0:
                    now.add(turn, initial, copies, blank, truncated, new)
            if len(ready) > 2_000:
                yield flush()
                ready.clear()
        if now is not None:
            ready.append(now.row(alone=False))
            yield flush()

    segments = dealt.mapInArrow(collect, f"part int, conv {kind}, counts {SEGMENT}, plans {PLAN}")
    whole = segments.groupBy("conv").agg(F.array_sort(F.collect_list(
        F.struct("part", "counts", "plans"))).alias("segments"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_report(s) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[k] for r in out], pa.int64()) for k in REPORT],
                 pa.array([r["audit"] for r in out], pa.string())], ["conv_id", *REPORT, "audit"])

    return whole.mapInArrow(finish, f"conv_id {kind}, " + "".join(f"{k} bigint, " for k in REPORT)
                            + "audit string")


def _report(segments: list[dict]) -> dict:
    """Segments of one conversation, in order, as one row. Their number is that of the
    tasks that the conversation was dealt to."""
    tables = [{(p["start"], p["end"]): (p["cost"], p["letters"]) for p in s["plans"]} for s in segments]
    cost, audit = min(p for (a, b), p in joined(tables).items() if a == 0 and b in ENDS)
    out = {"cost": cost, "audit": audit}
    counts = [s["counts"] for s in segments]
    for k in ("blank", "duplicate", "truncated", "illegal"):
        out[k] = sum(c[k] for c in counts)
    turns, high, low, last = 0, None, None, None
    for c in counts:
        if c["first"] is not None:
            out["illegal"] += last is not None and last + c["first"] not in ("su", "ua", "au")
            last = c["last"]
        if c["low"] is not None:
            turns += c["turns"] - (c["low"] == high)
            low, high = c["low"] if low is None else low, c["high"]
    out["gaps"] = 0 if low is None else high - low + 1 - turns
    return out


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object, str | None, str | None]]:
    """Follows the audit of every conversation along its turns: ``("conv", id, None, None)``
    and then ``("turn", id, role, text)`` for every turn that the repair has."""
    audit, at, due = "", 0, "u"

    def insertions(conv):
        nonlocal at, due
        while at < len(audit) and audit[at] == "I":
            yield "turn", conv, NAMES[due], ""
            at, due = at + 1, "a" if due == "u" else "u"

    conv = None
    for batch in batches:
        for conv_next, letters, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
            if letters is not None:
                yield from insertions(conv)
                conv, audit, at, due = conv_next, letters, 0, "u"
                yield "conv", conv, None, None
                continue
            for _ in range(copies):
                yield from insertions(conv)
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                yield "turn", conv, role if letter == "K" else NAMES[due], text
                if not (letter == "K" and role[:1] == "s"):
                    due = "a" if due == "u" else "u"
    yield from insertions(conv)


def _audited_turns(convs: DataFrame, audited: DataFrame, copies: str | None) -> DataFrame:
    """The audit of every conversation and then its turns, in the order of ``audits``."""
    rows = turn_rows(convs, copies).where("copies > 0").select(
        "conv", F.lit(None).cast("string").alias("letters"), "role", "text", "copies", "turn", "mark")
    heads = audited.select(F.col("conv_id").alias("conv"), F.col("audit").alias("letters"),
                           *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[2:]])
    # Two keys order the rows: whether it is the head, then the turn.
    return heads.union(rows).repartition("conv").sortWithinPartitions(
        "conv", F.col("letters").isNull(), "turn", "role", "mark").select(
        "conv", "letters", "role", "text", "copies")


def edited_turns(convs: DataFrame, audited: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired conversations: ``(conv_id, at, role, text)``, ``at`` counted from 0.

    ``audited`` is what ``audits`` gave for the same table. A task reads the turns of its
    conversations as a sorted stream and keeps none of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], 0
        for what, conv, role, text in _edits(batches):
            if what == "conv":
                at = 0
                continue
            rows.append((conv, at, role, text))
            at += 1
            if len(rows) == 1_000:
                yield _batch(rows, kind)
                rows = []
        if rows:
            yield _batch(rows, kind)

    kind = convs.schema["conv_id"].dataType
    return _audited_turns(convs, audited, copies).mapInArrow(
        run, f"conv_id {kind.simpleString()}, at bigint, role string, text string")


def _batch(rows: list[tuple], kind) -> pa.RecordBatch:
    conv, at, role, text = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, to_arrow_type(kind)), pa.array(at, pa.int64()), pa.array(role, pa.string()),
         pa.array(text, pa.string())], ["conv_id", "at", "role", "text"])


def repaired_digests(convs: DataFrame, audited: DataFrame, copies: str | None = None) -> DataFrame:
    """``audited`` with ``repaired_sha256``: SHA-256 of the repaired ``role:text`` joined by
    newlines. A hash of a text has to be computed in order, so a conversation is one task's
    here; it is fed turn by turn."""
    names = audited.columns
    kind = convs.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums, state, empty = [], [], None, True

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, to_arrow_type(kind)), pa.array(sums, pa.string())],
                ["conv_id", "repaired_sha256"])

        for what, conv, role, text in _edits(batches):
            if what == "conv":
                if state is not None:
                    sums.append(state.hexdigest())
                if len(sums) >= 1_000:
                    yield ready()
                    ids, sums = [], []
                ids.append(conv)
                state, empty = hashlib.sha256(), True
            else:
                state.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        if state is not None:
            sums.append(state.hexdigest())
            yield ready()

    sums = _audited_turns(convs, audited, copies).mapInArrow(
        run, f"conv_id {kind.simpleString()}, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    return audited.join(sums, F.col("conv_id").eqNullSafe(F.col("c"))).select(*names, "repaired_sha256")
