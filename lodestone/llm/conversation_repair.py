"""Conversation structure repair by a generalised LR parse with edits (operator 13).

The roles of a conversation must read `(s?(ua)+)?`: at most one system turn, then users and assistants in turn. The
grammar's table is that of an SLR parser; the parser follows all edits at once over stacks that share what they have in
common (a stack is its top state and the stack below). A turn may be kept, deleted or given another role, and a turn
without text may be inserted before or after any other; of stacks with equal tops the one with the least cost stays, and
of those the one whose edits come first in ASCII. What can follow depends on the top alone in this grammar, so nothing is
lost by that; and two edit strings of equal cost that have used up the same turns are never the beginning of one another,
so the lesser stays the lesser whatever follows.

A turn's fault is the first that holds: blank (no character but white space), duplicate (role and text of an earlier
turn), truncated (doesn't end in `.`, `!` or `?`). Blank and duplicate turns must go; truncated ones cost more to keep.

Conversations of up to LONG_ROWS turns and LONG_BYTES of text are sorted into one task each and streamed. Longer ones are
dealt out in ranges of turns: each range is parsed from every top that may stand before it, and the ranges are then put
together by their tops, so that no task has more than a range of turns at once.

Null roles and texts count as one space; a null conv_id is a conversation of its own. Turns go by number, null first, then
by role and text; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import hot_join, hot_keys
from lodestone.llm.shared import partitions, written

DELETE, REROLE, INSERT, TRUNCATED_KEPT = 2, 1, 5, 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LONG_ROWS, LONG_BYTES = 10_000, 32 << 20
#: Long conversations that get ranges, the longest first; the others have less than this share of all turns each.
MOST_LONG = 10_000
#: Turns after which the edits so far are put aside and only their order is kept.
ASIDE = 256
#: Conversations of up to so many turns are remembered by their pattern.
SHORT, REMEMBERED = 32, 1 << 16
ROLES = {"u": "user", "a": "assistant"}

#: The grammar, as head and body: terminals are the roles' initials, END follows the last.
END = "$"
RULES = (("S", ""), ("S", "T"), ("S", "sT"), ("T", "ua"), ("T", "Tua"))


def slr_table() -> tuple[dict, dict]:
    """Actions by state and terminal (lists: several may hold), and the states after a reduced head. State 0 is the first."""
    rules = [("start", "S"), *RULES]
    heads = {h for h, _ in rules}

    def closure(items: Iterable[tuple[int, int]]) -> frozenset:
        found, todo = set(), list(items)
        while todo:
            rule, dot = item = todo.pop()
            if item not in found:
                found.add(item)
                todo += [(k, 0) for k, (h, _) in enumerate(rules) if dot < len(rules[rule][1]) and h == rules[rule][1][dot]]
        return frozenset(found)

    empty = {h for h, b in rules if not b}
    first = {h: set() for h in heads}
    follow = {h: set() for h in heads} | {"start": {END}}
    for _ in range(2 * len(rules) * len(heads)):  # far more often than either needs to settle
        for head, body in rules:
            for k, x in enumerate(body):
                starts = first[x] if x in heads else {x}
                if not body[:k] or set(body[:k]) <= empty:
                    first[head] |= starts
                if x in heads:
                    rest = body[k + 1 :]
                    follow[x] |= (first[rest[0]] if rest[0] in heads else {rest[0]}) if rest else follow[head]
    states, table, goto = [closure([(0, 0)])], {}, {}
    for at, items in enumerate(states):  # grows as it goes
        after: dict[str, list] = {}
        for rule, dot in sorted(items):
            head, body = rules[rule]
            if dot < len(body):
                after.setdefault(body[dot], []).append((rule, dot + 1))
            else:
                for x in follow[head]:
                    table.setdefault((at, x), []).append(("accept", 0) if rule == 0 else ("reduce", (head, len(body))))
        for x, moved in after.items():
            new = closure(moved)
            if new not in states:
                states.append(new)
            if x in heads:
                goto[at, x] = states.index(new)
            else:
                table.setdefault((at, x), []).append(("shift", states.index(new)))
    return table, goto


TABLE, GOTO = slr_table()
#: A stack is (top state, stack below).
START = (0, None)


@lru_cache(maxsize=1 << 12)
def read(stack: tuple, symbol: str) -> tuple[tuple, ...]:
    """The stacks after reading a symbol, or, for END, those that are accepted."""
    found, todo = [], [stack]
    while todo:
        top = todo.pop()
        for kind, value in TABLE.get((top[0], symbol), ()):
            if kind == "shift":
                found.append((value, top))
            elif kind == "accept":
                found.append(top)
            else:
                head, size = value
                below = top
                for _ in range(size):
                    below = below[1]
                todo.append((GOTO[below[0], head], below))
    return tuple(found)


@lru_cache(maxsize=1)
def tops() -> dict[int, tuple]:
    """A stack for each top that can stand between two turns."""
    found, todo = {}, [START]
    while todo:
        stack = todo.pop(0)
        if stack[0] not in found:
            found[stack[0]] = stack
            todo += [s for x in "sua" for s in read(stack, x)]
    return found


class Front:
    """The stacks after some turns. Each has (cost, rank, tail): `tail` holds its latest edits, and `rank` is the place that
    what came before them has among that of all stacks here."""

    def __init__(self, stack: tuple = START) -> None:
        self.stacks = {stack[0]: (0, 0, "", stack)}
        self.before: list[tuple] = [None]  # by rank: earlier edits, as (those before, text)
        self.turns = 0

    @staticmethod
    def offer(to: dict, stack: tuple, cost: int, rank: int, tail: str) -> bool:
        was = to.get(stack[0])
        if was is None or (cost, rank, tail) < was[:3]:
            to[stack[0]] = (cost, rank, tail, stack)
            return True
        return False

    def widened(self) -> dict:
        """The stacks with any number of turns inserted."""
        wide, todo = dict(self.stacks), list(self.stacks.values())
        while todo:
            cost, rank, tail, stack = todo.pop()
            for role in "ua":
                for after in read(stack, role):
                    if self.offer(wide, after, cost + INSERT, rank, tail + "I"):
                        todo.append(wide[after[0]])
        return wide

    def turn(self, symbol: str) -> None:
        """A turn: s, u, a or o (another role), in upper case if truncated; x if it must go."""
        role, extra = symbol.lower(), TRUNCATED_KEPT * symbol.isupper()
        after: dict = {}
        for cost, rank, tail, stack in self.widened().values():
            self.offer(after, stack, cost + DELETE, rank, tail + "D")
            if role != "x":
                for new in read(stack, role):
                    self.offer(after, new, cost + extra, rank, tail + "K")
                for other in "ua":
                    for new in read(stack, other):
                        self.offer(after, new, cost + REROLE + extra, rank, tail + "R")
        self.stacks = after
        self.turns += 1
        if self.turns % ASIDE == 0:
            self.put_aside()

    def put_aside(self) -> None:
        order = sorted({x[1:3] for x in self.stacks.values()})
        place = {x: k for k, x in enumerate(order)}
        self.stacks = {top: (cost, place[rank, tail], "", stack) for top, (cost, rank, tail, stack) in self.stacks.items()}
        self.before = [(self.before[rank], tail) for rank, tail in order]

    def edits(self, rank: int, tail: str) -> str:
        parts, at = [tail], self.before[rank]
        while at:
            parts.append(at[1])
            at = at[0]
        return "".join(reversed(parts))

    def best(self) -> tuple[int, str]:
        """(cost, edits) of the best whole repair."""
        cost, rank, tail = min(x[:3] for x in self.widened().values() if read(x[3], END))
        return cost, self.edits(rank, tail)


def parsed(pattern: str, stack: tuple = START) -> Front:
    front = Front(stack)
    for symbol in pattern:
        front.turn(symbol)
    return front


def best_edits(pattern: str) -> tuple[int, str]:
    return _remembered(pattern) if len(pattern) <= SHORT else parsed(pattern).best()


@lru_cache(maxsize=REMEMBERED)
def _remembered(pattern: str) -> tuple[int, str]:
    return parsed(pattern).best()


def symbol(role: str, fault: int) -> str:
    if fault in (BLANK, DUPLICATE):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if fault == TRUNCATED else initial


def codes(edits: str, pattern: str, last: str = "") -> list[str]:
    """The edits of each turn, one letter each: u or a, a turn with that role is inserted; K, kept; D, deleted; U or A, given
    that role. Turns inserted at the very end go with the last turn. last: the initial of the role before the first turn."""
    out, held = [], ""
    for edit in edits:
        at = len(out)
        if edit == "D":
            out.append(held + "D")
        elif edit == "K":
            out.append(held + "K")
            last = pattern[at].lower()
        else:
            last = "a" if last == "u" else "u"
            if edit == "I":
                held += last
                continue
            out.append(held + last.upper())
        held = ""
    if held:
        out[-1] += held
    return out


MARKED = "conv_id {id}, part int, row long, turn long, role string, text string, fault int, edits string"


def mark_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, whole conversations: adds `part`, `row` and `edits`, and finds turns that repeat the one before."""
    held: list[pa.RecordBatch] = []
    faults: list[int] = []
    done: list[str] = []
    rows: list[int] = []
    pattern, before = [], ()

    def ended() -> None:
        if pattern:
            done.extend(codes(best_edits("".join(pattern))[1], pattern))
            rows.extend(range(len(pattern)))
            pattern.clear()

    def ready(all_: bool) -> Iterator[pa.RecordBatch]:
        while held and (all_ or held[0].num_rows <= len(done)):
            n = held[0].num_rows
            yield marked_batch(held.pop(0), pa.array([0] * n, pa.int32()), pa.array(rows[:n], pa.int64()), pa.array(faults[:n], pa.int32()), pa.array(done[:n], pa.string()))
            del rows[:n], faults[:n], done[:n]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        for at, (now, fault) in enumerate(turns_of(batch, before)):
            if pattern and now[0] != before[0]:
                ended()
            pattern.append(symbol(now[2], fault))
            faults.append(fault)
            before = now
        before = (*before[:3], batch["text"][at].as_py())
        yield from ready(False)
    ended()
    yield from ready(True)


def turns_of(batch: pa.RecordBatch, before: tuple) -> Iterator[tuple[tuple, int]]:
    """(conv_id, turn, role, None) and fault of each row; a row that repeats the one before it is a duplicate."""
    text, was, at_text = batch["text"], before, before[3] if before else None
    columns = (batch[c].to_pylist() for c in ("conv_id", "turn", "role", "fault"))
    for at, (conv, turn, role, fault) in enumerate(zip(*columns, strict=True)):
        if fault != BLANK and was and was[:3] == (conv, turn, role):
            if (text[at - 1].as_py() if at else at_text) == text[at].as_py():
                fault = DUPLICATE
        was = (conv, turn, role, None)
        yield was, fault


def marked_batch(batch: pa.RecordBatch, part: pa.Array, row: pa.Array, fault: pa.Array, edits: pa.Array) -> pa.RecordBatch:
    columns = [batch["conv_id"], part, row, batch["turn"], batch["role"], batch["text"], fault, edits]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "row", "turn", "role", "text", "fault", "edits"])


def place_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, a range of them: as mark_short, with the turn's symbol in place of its edits."""
    from pyspark import TaskContext

    part, row, before = TaskContext.get().partitionId(), 0, ()
    for batch in batches:
        if not batch.num_rows:
            continue
        n, symbols, faults, rows = batch.num_rows, [], [], []
        for now, fault in turns_of(batch, before):
            row = row + 1 if before and now[0] == before[0] else 0
            symbols.append(symbol(now[2], fault))
            faults.append(fault)
            rows.append(row)
            before = now
        before = (*before[:3], batch["text"][n - 1].as_py())
        yield marked_batch(batch, pa.array([part] * n, pa.int32()), pa.array(rows, pa.int64()), pa.array(faults, pa.int32()), pa.array(symbols))


def ways(pattern: str) -> list[tuple[int, int, int, str]]:
    """(top before, top after, cost, edits) for a range of turns."""
    out = []
    for top, stack in tops().items():
        front = parsed(pattern, stack)
        out += [(top, after, cost, front.edits(rank, tail)) for after, (cost, rank, tail, _) in front.stacks.items()]
    return out


def range_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: all its ways, with the place of the edits among them instead of the edits."""
    for batch in batches:
        out: dict[str, list] = {"conv_id": [], "part": [], "top": [], "after": [], "cost": [], "place": []}
        for at, pattern in enumerate(batch["pattern"].to_pylist()):
            found = ways(pattern)
            place = {x: k for k, x in enumerate(sorted({x[3] for x in found}))}
            for top, after, cost, edits in found:
                for name, value in zip(("top", "after", "cost", "place"), (top, after, cost, place[edits]), strict=True):
                    out[name].append(value)
            out["conv_id"] += [batch["conv_id"][at]] * len(found)
            out["part"] += [batch["part"][at]] * len(found)
        kinds = (batch.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([x.as_py() if isinstance(x, pa.Scalar) else x for x in v], k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def joined_ways(table: pa.Table) -> pa.Table:
    """One conversation's ranges: the way taken through each (part, top, after), and the turns inserted at the very end."""
    by_part: dict[int, list] = {}
    for row in table.select(["part", "top", "after", "cost", "place"]).to_pylist():
        by_part.setdefault(row["part"], []).append(row)
    front, taken = {START[0]: (0, 0)}, []
    for part in sorted(by_part):
        reached: dict[int, tuple] = {}
        for way in by_part[part]:
            if way["top"] in front:
                cost, rank = front[way["top"]]
                reached[way["after"]] = min(reached.get(way["after"], (1 << 62,)), (cost + way["cost"], rank, way["place"], way["top"]))
        order = {x: k for k, x in enumerate(sorted({x[1:3] for x in reached.values()}))}
        taken.append((part, {top: x[3] for top, x in reached.items()}))
        front = {top: (x[0], order[x[1:3]]) for top, x in reached.items()}
    ends = []
    for top, (cost, rank) in front.items():
        more, edits = parsed("", tops()[top]).best()
        ends.append((cost + more, rank, edits, top))
    _, _, tail, top = min(ends)
    rows = []
    for part, back in reversed(taken):
        rows.append((part, back[top], top, tail))
        top, tail = back[top], ""
    conv = pa.array([table["conv_id"][0].as_py()] * len(rows), table.schema.field("conv_id").type)
    part, before, after, tails = zip(*rows, strict=True)
    return pa.table({"conv_id": conv, "part": pa.array(part, pa.int32()), "top": pa.array(before, pa.int32()), "after": pa.array(after, pa.int32()), "tail": pa.array(tails, pa.string())})


def last_role(top: int) -> str:
    """The initial of the role that a stack with this top has read last."""
    return next((x for stack in tops().values() for x in "sua" for s in read(stack, x) if s[0] == top), "")


def range_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each turn of each range, by the way taken."""
    for batch in batches:
        for at, (pattern, top, after, tail) in enumerate(zip(*(batch[c].to_pylist() for c in ("pattern", "top", "after", "tail")), strict=True)):
            front = parsed(pattern, tops()[top])
            found = codes(front.edits(*front.stacks[after][1:3]) + tail, pattern, last_role(top))
            n = len(found)
            conv = pa.array([batch["conv_id"][at].as_py()] * n, batch.schema.field("conv_id").type)
            yield pa.RecordBatch.from_arrays([conv, pa.array([batch["part"][at].as_py()] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(found, pa.string())], names=["conv_id", "part", "row", "edits"])


def same(left: DataFrame, right: DataFrame, *columns: str):
    found = F.lit(True)
    for c in columns:
        found = found & left[c].eqNullSafe(right[c])
    return found


def faulted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and fault. Turns that repeat one with the same number are found where they stand in order."""
    filled = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    conv = F.col("conv_id").cast("string")
    size = F.concat_ws("/", F.coalesce(F.char_length(conv), F.lit(-1)).cast("string"), F.char_length("role").cast("string"), F.lit(""))
    keyed = filled.withColumn("key", F.md5(F.concat(size, F.coalesce(conv, F.lit("")), F.col("role"), F.col("text")).cast("binary")))
    # of turns that occur once, nothing is sent on
    firsts = keyed.groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"), F.max(F.struct("turn")).alias("last"))
    firsts = written(firsts.filter((F.col("n") > 1) & ~F.col("first.turn").eqNullSafe(F.col("last.turn"))).select("key", F.col("first.turn").alias("first")), "repeated-turns")
    visible, ended = F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    fault = F.when(~visible, BLANK).when(F.col("again"), DUPLICATE).when(~ended, TRUNCATED).otherwise(0).alias("fault")
    if firsts.isEmpty():
        return keyed.withColumn("again", F.lit(False)).select("conv_id", "turn", "role", "text", fault)
    met = hot_join(keyed, firsts.withColumn("known", F.lit(True)), "key", "left", hot_keys(keyed, "key"))
    again = F.col("known").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    return met.withColumn("again", again).select("conv_id", "turn", "role", "text", fault)


def marked(turns: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> list[DataFrame]:
    """The turns with fault and edits (MARKED), as one table of short conversations, whose turns stand together in order, and
    one of long ones, if there are any, in no order."""
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = MARKED.format(id=kind)
    found = faulted(turns)
    sizes = found.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).orderBy(F.desc("bytes"), F.desc("n")).limit(MOST_LONG).select("conv_id"), "long-conversations")
    order = ("conv_id", "turn", "role", "text")
    if long.isEmpty():
        return [found.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(mark_short, schema)]
    known = F.broadcast(long.select(F.col("conv_id").alias("long_id")))
    match = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = found.join(known, match, "left_anti").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(mark_short, schema)
    ranges = found.join(known, match, "left_semi").repartitionByRange(4 * partitions(spark), "conv_id", "turn", "role", F.substring("text", 1, 32))
    placed = written(ranges.sortWithinPartitions(*order).mapInArrow(place_long, schema), "long-turns")
    ordered = F.array_sort(F.collect_list(F.struct("row", "edits")))
    patterns = written(placed.groupBy("conv_id", "part").agg(F.array_join(F.transform(ordered, lambda x: x["edits"]), "").alias("pattern")), "patterns")
    each = patterns.mapInArrow(range_ways, f"conv_id {kind}, part int, top int, after int, cost long, place int")
    taken = each.groupBy("conv_id").applyInArrow(joined_ways, f"conv_id {kind}, part int, top int, after int, tail string")
    edits = patterns.join(taken, same(patterns, taken, "conv_id", "part")).select(patterns["conv_id"], patterns["part"], "pattern", "top", "after", "tail")
    edits = edits.mapInArrow(range_edits, f"conv_id {kind}, part int, row long, edits string")
    rows = placed.drop("edits")
    return [short, rows.join(edits, same(rows, edits, "conv_id", "part", "row")).select(rows["conv_id"], rows["part"], rows["row"], "turn", "role", "text", "fault", "edits")]


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (part, row, step), turn (null if inserted), role, text, and the edit by which
    each turn is there (K kept, R another role, I inserted)."""
    tables = marked(turns)
    rows = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    each = rows.select("*", F.posexplode(F.split("edits", "(?<=.)(?=.)")).alias("step", "edit")).filter("edit <> 'D'")
    inserted, role = F.col("edit").isin("u", "a"), F.lower("edit")
    return each.select(
        "conv_id", "part", "row", "step", F.when(~inserted, F.col("turn")).alias("turn"),
        F.when(F.col("edit") == "K", F.col("role")).when(role == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"),
        F.when(inserted, "").otherwise(F.col("text")).alias("text"),
        F.when(inserted, "I").when(F.col("edit") == "K", "K").otherwise("R").alias("edit"),
    )


class Audit:
    """What is told of one conversation, turn by turn."""

    NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

    def __init__(self) -> None:
        self.first = self.last = self.role = None
        self.distinct = self.illegal = self.cost = 0
        self.faults = [0, 0, 0, 0]
        self.parts: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def turn(self, turn: int | None, role: str, text: str, fault: int, edits: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        self.faults[fault] += 1
        if self.role is not None:
            self.illegal += self.role + role[:1] not in ("su", "ua", "au")
        self.role = role[:1]
        kept = TRUNCATED_KEPT * (fault == TRUNCATED)
        for edit in edits:
            self.cost += {"D": DELETE, "K": kept, "U": REROLE + kept, "A": REROLE + kept}.get(edit, INSERT)
            if edit in "KUA":
                self.line(role if edit == "K" else ROLES[edit.lower()], text)
            elif edit in "ua":
                self.line(ROLES[edit], "")
        self.parts.append(edits.translate(str.maketrans("uaUA", "IIRR")))

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.parts), self.hash.hexdigest()


def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of marked turns in order."""
    now, told = None, None
    for batch in batches:
        convs, rows = [], []
        columns = (batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "edits"))
        for conv, *turn in zip(*columns, strict=True):
            if told is None or conv != now:
                if told is not None:
                    convs.append(now)
                    rows.append(told.row())
                now, told = conv, Audit()
            told.turn(*turn)
        kind = batch.schema.field("conv_id").type
        yield audit_batch(convs, rows, kind)
    if told is not None:
        yield audit_batch([now], [told.row()], kind)


def audit_batch(convs: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(Audit.NAMES)
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=["conv_id", *Audit.NAMES])


def audit(turns: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """One row for each conversation: its faults (gaps in the numbers, blank, duplicate, truncated, illegal neighbours), the
    cost of the repair, its edits in order, and the SHA-256 of the repaired turns as `role:text` lines. The edits of a
    conversation are one string, so it may have 2^31 turns at most; the hash needs all its turns in order, so one task
    streams through those of a long one."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    short, *long = marked(turns, long_rows)
    out = short.mapInArrow(audits, schema)
    for rows in long:
        out = out.unionByName(rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "row").mapInArrow(audits, schema))
    return out
