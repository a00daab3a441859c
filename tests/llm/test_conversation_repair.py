"""Repairs against a search of all edits, short and in ranges."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import pytest

from lodestone.llm import conversation_repair as cr
from lodestone.llm.op13_query import damaged, op13_conversation_repair
from tests.llm.conftest import with_extras

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}
#: What may follow what, by initials; "" is the beginning.
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def model_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def model(rows):
    """The audit of one conversation, by the shortest way over (turns used, last role), whole strings compared."""
    rows = sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, used, last, lines = heapq.heappop(heap)
        if used == len(rows) and last in ("", "a"):
            break
        if (used, last) in done:
            continue
        done.add((used, last))
        for x in "ua":
            if (last, x) in NEXT:
                heapq.heappush(heap, (cost + 5, audit + "I", used, x, (*lines, f"{NAMES[x]}:")))
        if used < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", used + 1, last, lines))
            if faults[used] not in (1, 2):
                _, _, role, text = rows[used]
                extra = 5 * (faults[used] == 3)
                if (last, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + extra, audit + "K", used + 1, role[:1], (*lines, f"{role}:{text}")))
                for x in "ua":
                    if (last, x) in NEXT:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", used + 1, x, (*lines, f"{NAMES[x]}:{text}")))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest


def random_rows(seed, convs, longest):
    random.seed(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "s", "User"]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why?  ", "é.", "a:b\nc."]
    rows = []
    for c in range(convs):
        for t in range(random.randint(1, longest)):
            turn = random.choice([t, t, t, t, t, t - 1, t + 3, None])
            role = random.choices(roles, (9, 9, 2, 1, 1, 1, 1, 1))[0] if random.random() < 0.7 else ("user", "assistant")[t % 2]
            rows.append((c if c else None, turn, role, random.choice(texts) if random.random() < 0.4 else f"Text {random.randint(0, 12)}."))
    return rows


def compare(frame, rows, **more):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    got = {r.conv_id: tuple(r)[1:] for r in cr.audit(frame, **more).collect()}
    assert got == {c: model(g) for c, g in groups.items()}


@pytest.mark.parametrize("long_rows", [cr.LONG_ROWS, 3])
def test_random_conversations(spark, long_rows):
    """With ranges, conversations of over three turns go over the borders of tasks."""
    rows = random_rows(21, 120, 12)
    compare(spark.createDataFrame(rows, SCHEMA).repartition(3), rows, long_rows=long_rows)


def test_one_conversation_of_most_rows(spark):
    rows = [(7, *r[1:]) for r in random_rows(22, 60, 12)] + random_rows(23, 5, 6)
    compare(spark.createDataFrame(rows, SCHEMA), rows, long_rows=50)
    long = [(1, t, "user", "Again.") for t in range(400)] + [(2, None, "assistant", "The same.")] * 300
    compare(spark.createDataFrame(long, SCHEMA), long, long_rows=100)
    compare(spark.createDataFrame(long, SCHEMA), long)


def test_the_table_knows_the_grammar():
    for text, good in (("", True), ("ua", True), ("suaua", True), ("s", False), ("u", False), ("uas", False), ("au", False), ("sua", True), ("ssua", False)):
        stacks = [cr.START]
        for x in text:
            stacks = [new for s in stacks for new in cr.read(s, x)]
        assert any(cr.read(s, cr.END) for s in stacks) == good, text
    assert len(cr.tops()) == 6


def test_ranges_put_together_equal_the_whole():
    """What stands before a range doesn't change its ways; many turns are put aside on the way."""
    random.seed(24)
    for n in (1, 5, 40, 700):
        pattern = "".join(random.choices("suaoSUAOx", (1, 6, 6, 1, 1, 2, 2, 1, 2), k=n))
        cost, edits = cr.best_edits(pattern)
        assert sum(e != "I" for e in edits) == n
        for cut in {0, n // 3, n - 1}:
            front = {0: (0, "")}
            for part in (pattern[:cut], pattern[cut:]):
                ways, after = cr.ways(part), {}
                for top, to, c, e in ways:
                    if top in front:
                        after[to] = min(after.get(to, (1 << 60, "")), (front[top][0] + c, front[top][1] + e))
                front = after
            ends = []
            for top, (c, e) in front.items():
                more, tail = cr.parsed("", cr.tops()[top]).best()
                ends.append((c + more, e + tail))
            assert min(ends) == (cost, edits)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hi!"), (1, 3, "user", "cut"), (2, 5, "user", "Alone."), (3, 0, "user", "")]
    got = [tuple(r) for r in cr.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "part", "row", "step").select("conv_id", "turn", "role", "text", "edit").collect()]
    assert got == [(1, 0, "system", "Be kind.", "K"), (1, 1, "user", "Hello.", "R"), (1, 2, "assistant", "Hi!", "K")]
    good = [(4, 0, "user", "One."), (4, 1, "user", "Two."), (4, 2, "assistant", "Three."), (4, 3, "user", "Four."), (4, 4, "assistant", "Five.")]
    got = [tuple(r) for r in cr.repair(spark.createDataFrame(good, SCHEMA)).orderBy("row", "step").select("role", "text", "edit").collect()]
    assert got == [("user", "Two.", "K"), ("assistant", "Three.", "K"), ("user", "Four.", "K"), ("assistant", "Five.", "K")]


def test_empty_tables_and_other_columns(spark):
    rows = random_rows(25, 10, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert cr.audit(frame.filter("false")).count() == 0 and cr.repair(frame.filter("false")).count() == 0
    compare(with_extras(frame, "fault", "edits", "PART", "key", "row", "audit", "first", "known", "time"), rows)


def test_long_texts_make_a_conversation_long(spark):
    rows = [(99, t, ("user", "assistant")[t % 2], f"{'x' * 20_000} {t}.") for t in range(20)] + random_rows(26, 4, 6)[6:]
    groups = {c: [r for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    short, *long = cr.marked(spark.createDataFrame(rows, SCHEMA), long_bytes=100_000)
    assert len(long) == 1 and long[0].count() == 20 and short.count() == len(rows) - 20
    assert sorted(r.edits for r in long[0].collect()) == ["K"] * 20 and model(groups[99])[6] == "K" * 20


def test_the_query_and_its_damage(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    hurt = model_damage(rows)
    assert sorted(map(tuple, damaged(table).collect())) == sorted(hurt)
    got = {r.conv_id: tuple(r)[1:] for r in op13_conversation_repair(spark, data).collect()}
    assert got == {c: model([r for r in hurt if r[0] == c]) for c in {r[0] for r in rows}}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert all(got[c] == nothing for c in {r[0] for r in rows} - {r[0] for r in hurt})


def test_damage_of_nulls(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in [None, *range(25)] for r, x in ((None, None), ("user", "A. b! c?"))]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(repr, map(tuple, damaged(frame).collect()))) == sorted(map(repr, model_damage(rows)))
