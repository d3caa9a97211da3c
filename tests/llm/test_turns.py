"""Repair of conversations against a plain search of all edits."""

import binascii
import hashlib
import heapq

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from letterloom.llm import queries, turns

DATA = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """rows: (initial, has to go, truncated). Best first over (cost, letters) is exact:
    of equal cost the queue has the smaller letters first, and plans of one node have
    taken the same turns."""
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, letters, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, letters
        moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
        if at < len(rows):
            initial, goes, truncated = rows[at]
            heapq.heappush(queue, (cost + 3, letters + "D", at + 1, state))
            if not goes:
                for role, to in moves.items():
                    if role == initial:
                        heapq.heappush(queue, (cost + truncated, letters + "K", at + 1, to))
                    if role in "ua":
                        heapq.heappush(queue, (cost + 2 + truncated, letters + "R", at + 1, to))
        for role, to in moves.items():
            if role in "ua":
                heapq.heappush(queue, (cost + 2, letters + "I", at, to))


def plain(rows):
    """rows of one conversation: (turn, role, text), in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                      else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = [t for t, _, _ in rows if t is not None]
    cost, audit = cheapest([(r[:1], f in ("blank", "duplicate"), f == "truncated")
                            for (_, r, _), f in zip(rows, faults)])
    out, at, due = [], 0, 0
    for letter in audit:
        role, text = ("", "")
        if letter != "I":
            _, role, text = rows[at]
            at += 1
        if letter == "D":
            continue
        role = role if letter == "K" else ("user", "assistant")[due]
        due = due if letter == "K" and role[:1] == "s" else 1 - due
        out.append((role, text))
    return ((max(numbers) - min(numbers) + 1 - len(set(numbers))) if numbers else 0,
            faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            cost, audit), out


def damaged(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    key = ":".join(" " if x is None else str(x) for x in (conv, turn))
    fault = binascii.crc32(key.encode()) % 20
    if fault == 1:
        text = ""
    if fault == 2:
        text = "".join(c for c in text if c not in ".!?")
    if fault == 4:
        role = "user"
    return [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)


def in_order(rows):
    mark = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], mark(r)))


def expected(convs):
    groups = {}
    for r in convs:
        groups.setdefault(r.conv_id, []).extend(damaged(r.conv_id, r.turn, r.role, r.text))
    out = {}
    for conv, rows in groups.items():
        report, repaired = plain(in_order(rows))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (*report, hashlib.sha256(text.encode()).hexdigest())
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("suaoSUAOx", max_size=14))
def test_search_equals_best_first(codes):
    rows = [("" if c == "x" else c.lower(), c == "x", c.isupper()) for c in codes]
    assert turns.whole_plan(codes) == cheapest(rows)


@settings(max_examples=60, deadline=None)
@given(st.text("suaoSUAOx", max_size=40), st.integers(1, 7))
def test_blocks_put_together_equal_the_whole(codes, size):
    blocks = [codes[i:i + size] for i in range(0, len(codes), size)] or [""]
    found = turns.joined(map(turns.block_table, blocks))
    assert min(p for (a, b), p in found.items() if a == 0 and b in turns.ENDS) == turns.whole_plan(codes)


def rows_of(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_query_equals_brute_force(spark):
    convs = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    found = rows_of(queries.op12_turn_repair(spark, DATA))
    assert found == expected(convs)
    assert len({r[6] for r in found.values()}) > 10


def test_nulls_ties_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(c, t, role, text, "x", 9) for c in (None, 1, 2, 3) for t in (None, 1, 1, 3, 7)
            for role, text in (("user", "a."), ("assistant", "b"), (None, None), ("user", "a."),
                               ("", " \t"), ("system", "é. "), ("tool", "y!"))]
    rows += [(4, t, "user", "same.", "x", 9) for t in range(40)] + [(5, None, None, None, None, None)]
    convs = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, conv string, copies int")
    convs.write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(queries.op12_turn_repair(spark, str(tmp_path))) == expected(convs.collect())


def test_a_long_conversation_spreads_over_tasks(spark):
    n = 6_000
    rows = spark.range(n).select(
        F.when(F.col("id") < n // 3 * 2, 1).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
        F.element_at(F.array(*map(F.lit, ("user", "assistant", "user", "system", "tool"))),
                     (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int")).alias("role"),
        F.when(F.col("id") % 7 == 0, "again.").when(F.col("id") % 11 == 0, "")
        .otherwise(F.concat("id", F.lit("."))).alias("text")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = turns.audits(rows)
        done = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit)
                for r in found.collect()}
        edits = turns.edited_turns(rows, found).where("conv_id = 1").orderBy("at").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert done == {c: plain(in_order(g))[0] for c, g in groups.items()}
    assert [(e.role, e.text) for e in edits] == plain(in_order(groups[1]))[1]
    assert [e.at for e in edits] == list(range(len(edits)))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repaired_digests(empty, turns.audits(empty)).collect() == []
    assert turns.edited_turns(empty, turns.audits(empty)).collect() == []
