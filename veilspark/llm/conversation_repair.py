"""Cheapest repairs of conversations, by a weighted automaton made deterministic as it goes.

The rows of a conversation are taken by turn (nulls first; with ties by role, then by a hash
of the text).  A row's first fault counts: *blank* (nothing but white space), *duplicate* (role
and text seen earlier in the conversation), *truncated* (its last visible character is none of
``.!?``).  Edits: keep a row (0), give it the role user or assistant (1), delete it (2, the only
edit of blank and duplicate rows), insert an empty row of user or assistant anywhere (5);
truncated rows that aren't deleted add 5.  The repaired roles' initials match ``(s?(ua)+)?``.

That language has four states.  What it costs at least to be in each of them after a row is
a vector; less its least entry, such vectors are the states of a deterministic automaton.
There are few, as entries that can't be on a cheapest way are left out; they and their
transitions are worked out when they first occur, and kept in a table.  A scan by the table
gives costs.  Backwards, arcs are kept that are tight and lead to a cheapest end; the audit
is the ASCII-least walk along them (``D``, ``I``, ``K``, ``R``).  An audit fixes all roles.

Rows are sorted over all tasks, so a conversation may lie in many.  One that lies within a
task and a block is repaired there.  Others are written as blocks: each block's least costs
from state to state are found on their own, one pass over those small tables gives costs
at a block's beginning and the cheapest states at its end, and a last pass goes through a
conversation's blocks in order.  It holds one block at a time; SHA-256 needs that order.

Null roles and texts are one space; null turns are no turns but rows; a null identifier is a
conversation.  Rows that are repeated are duplicates.  A conversation without present
rows has zeros, an empty audit and the hash of the empty string; an empty table gives no rows.  Very
long texts are compared by 128-bit hashes.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: A block of a conversation ends after so many rows or characters.
BLOCK_ROWS, BLOCK_CHARS = 4096, 2_000_000
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a; what a role's initial leads to from each.
NONE, S, U, A = range(4)
BY_ROLE = {"s": {NONE: S}, "u": {NONE: U, S: U, A: U}, "a": {U: A}}
NEW_ROLE = {NONE: "u", S: "u", A: "u", U: "a"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Symbols: twice the place in this text, and one more for truncated rows; rows that must be deleted have one of their own.
INITIALS, DELETED = "sua-", 8
FAR = 1 << 40

Vector = tuple[int, int, int, int]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def arcs(symbol: int) -> list[tuple[str, int, int, int]]:
    """The edits of a row as (letter, state before, state after, cost)."""
    out = [("D", p, p, DELETE) for p in range(4)]
    if symbol != DELETED:
        initial, more = INITIALS[symbol // 2], BROKEN * (symbol % 2)
        out += [("K", p, q, KEEP + more) for p, q in BY_ROLE.get(initial, {}).items()]
        out += [("R", p, BY_ROLE[r][p], REROLE + more) for p, r in NEW_ROLE.items()]
    return out


ARCS = [arcs(s) for s in range(DELETED + 1)]
INSERTED = {p: BY_ROLE[r][p] for p, r in NEW_ROLE.items()}


def settled(v: list[int]) -> Vector:
    """With rows inserted, and without entries that can't be on a cheapest way.

    What follows an "a" may follow the beginning too, but for a kept system row, which costs 2
    to delete; and whatever may follow "s" may follow "a".
    """
    for _ in range(2):
        for p, q in INSERTED.items():
            v[q] = min(v[q], v[p] + INSERT)
    if v[NONE] > v[A] + DELETE:
        v[NONE] = FAR
    if v[S] > v[A]:
        v[S] = FAR
    return tuple(min(x, FAR) for x in v)


class Repairs:
    """The automaton: vectors by number, and what was worked out of its transition tables so far."""

    def __init__(self) -> None:
        self.number: dict[Vector, int] = {}
        self.vectors: list[Vector] = []
        self.table: list[list[tuple[int, int] | None]] = []
        self.tight: dict[tuple[int, int, int], int] = {}

    def state(self, v: Vector) -> tuple[int, int]:
        """The number of a vector less its least entry, and that entry."""
        least = min(v)
        v = tuple(x - least if x < FAR else FAR for x in v)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
            self.table.append([None] * (DELETED + 1))
        return self.number[v], least

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and its cost, from the table if it is there."""
        if self.table[state][symbol] is None:
            new, v = [FAR] * 4, self.vectors[state]
            for _, p, q, cost in ARCS[symbol]:
                new[q] = min(new[q], v[p] + cost)
            self.table[state][symbol] = self.state(settled(new))
        return self.table[state][symbol]

    def scan(self, v: Vector, symbols: bytes) -> tuple[list[int], list[int]]:
        """The states before each symbol and after the last, and what each step (first: the vector itself) adds."""
        state, least = self.state(v)
        states, added, table = [state], [least], self.table
        for s in symbols:
            state, cost = table[state][s] or self.step(state, s)
            states.append(state)
            added.append(cost)
        return states, added

    def closed(self, state: int, good: int) -> int:
        """``good`` (bits of states) with those that a tight insertion leads from."""
        v = self.vectors[state]
        for _ in range(2):
            for p, q in INSERTED.items():
                if good >> q & 1 and v[p] < FAR and v[p] + INSERT == v[q]:
                    good |= 1 << p
        return good

    def before(self, state: int, symbol: int, good: int) -> int:
        """The states before a row from which tight arcs lead to ``good`` ones after it."""
        key = (state, symbol, good)
        if key not in self.tight:
            v, (after, cost) = self.vectors[state], self.step(state, symbol)
            w, found = self.vectors[after], 0
            for _, p, q, c in ARCS[symbol]:
                if good >> q & 1 and v[p] < FAR and v[p] + c == w[q] + cost:
                    found |= 1 << p
            self.tight[key] = self.closed(state, found)
        return self.tight[key]

    def ends(self, state: int) -> int:
        """The cheapest states that a conversation may end in."""
        v = self.vectors[state]
        least = min(v[NONE], v[A])
        return self.closed(state, sum(1 << q for q in (NONE, A) if v[q] == least))

    def walk(self, states: list[int], added: list[int], symbols: bytes, good: int, q: int, last: bool) -> tuple[str, int]:
        """The ASCII-least letters from state ``q`` to ``good`` at the end, and the state there."""
        marks, out = [good], []
        for i in range(len(symbols) - 1, -1, -1):
            marks.append(self.before(states[i], symbols[i], marks[-1]))
        marks.reverse()
        i, n = 0, len(symbols)
        while True:
            v = self.vectors[states[i]]
            if i == n and (not last or q in (NONE, A) and v[q] == min(v[NONE], v[A])):
                return "".join(out), q
            choices = []
            to = INSERTED[q]
            if marks[i] >> to & 1 and v[q] + INSERT == v[to]:
                choices.append(("I", i, to))
            if i < n:
                w = self.vectors[states[i + 1]]
                choices += [(x, i + 1, r) for x, p, r, c in ARCS[symbols[i]] if p == q and marks[i + 1] >> r & 1 and v[q] + c == w[r] + added[i + 1]]
            letter, i, q = min(choices)
            out.append(letter)

    def across(self, symbols: bytes) -> list[int]:
        """The least costs from each state before a block to each after it (16 values)."""
        out: list[int] = []
        for p in range(4):
            states, added = self.scan(settled([0 if q == p else FAR for q in range(4)]), symbols)
            out += [x + sum(added) if x < FAR else FAR for x in self.vectors[states[-1]]]
        return out


def classes(roles: list[str], texts: list[str], seen: set[bytes]) -> tuple[bytes, list[int], list[bytes]]:
    """Symbols of rows, their numbers of blank, duplicate and truncated ones, and digests; ``seen`` takes up the rows'."""
    symbols, faults, digests = bytearray(), [0, 0, 0], []
    for role, text in zip(roles, texts):
        key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "replace"))
        digests.append(key)
        visible = text.rstrip(WHITE)
        place = INITIALS.find(role[:1]) if role[:1] else -1
        symbol = 2 * (place if 0 <= place < 3 else 3)
        if not visible:
            faults[0] += 1
            symbol = DELETED
        elif key in seen:
            faults[1] += 1
            symbol = DELETED
        elif visible[-1] not in ".!?":
            faults[2] += 1
            symbol += 1
        seen.add(key)
        symbols.append(symbol)
    return bytes(symbols), faults, digests


def illegal(roles: list[str]) -> int:
    return sum((a[:1], b[:1]) not in LEGAL for a, b in pairwise(roles))


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def repaired(audit: str, q: int, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The rows that the letters give, as ``role:text``."""
    rows = zip(roles, texts)
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = ROLES[NEW_ROLE[q]]
        q = BY_ROLE[role[:1]][q]
        yield f"{role}:{text}"


START = settled([0, FAR, FAR, FAR])


def whole(machine: Repairs, turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The results of a conversation that is all there."""
    symbols, faults, _ = classes(roles, texts, set())
    states, added = machine.scan(START, symbols)
    v = machine.vectors[states[-1]]
    audit, _ = machine.walk(states, added, symbols, machine.ends(states[-1]), NONE, True)
    text = "\n".join(repaired(audit, NONE, roles, texts))
    return gaps(turns), *faults, illegal(roles), sum(added) + min(v[NONE], v[A]), audit, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def _fields(kind: str) -> str:
    return f"conv_id {kind}, done boolean, {RESULT}, part int, block int, turns array<long>, roles array<string>, texts array<string>, late array<binary>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(kind: pa.DataType) -> pa.Schema:
    longs, text = pa.int64(), pa.string()
    result = [(n, longs) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", text), ("repaired_sha256", text)]
    block = [("part", pa.int32()), ("block", pa.int32()), ("turns", pa.list_(longs)), ("roles", pa.list_(text)), ("texts", pa.list_(text)), ("late", pa.list_(pa.binary()))]
    return pa.schema([("conv_id", kind), ("done", pa.bool_()), *result, *block])


def in_blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Sorted rows as results of conversations that lie here whole, and as blocks of others."""
    part, machine = TaskContext.get().partitionId(), Repairs()
    out: list[tuple] = []
    number = size = place = begun = 0
    conv, turns, roles, texts = None, [], [], []
    any_yet = False

    def block() -> None:
        nonlocal number, begun, size, turns, roles, texts
        digests = list(dict.fromkeys(classes(roles, texts, set())[2]))
        out.append((conv, False, *[None] * 8, part, number, turns, roles, texts, digests))
        number, begun, size, turns, roles, texts = number + 1, begun + 1, 0, [], [], []

    schema = None
    for batch in batches:
        schema = schema or _arrow(batch.schema.field("conv_id").type)
        for c, t, r, x, present in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "present")]):
            if any_yet and c != conv:
                # the first conversation here may have begun before
                if place and not begun:
                    out.append((conv, True, *whole(machine, turns, roles, texts), part, None, None, None, None, None))
                else:
                    block()
                place, begun, size, turns, roles, texts = place + 1, 0, 0, [], [], []
            conv, any_yet = c, True
            if present:
                if len(roles) >= most or size >= BLOCK_CHARS:
                    block()
                turns.append(t)
                roles.append(r)
                texts.append(x)
                size += len(x)
        if len(out) >= 512:
            yield _batch(out, schema)
            out = []
    if any_yet:
        block()
        yield _batch(out, schema)


def with_late(blocks: DataFrame) -> DataFrame:
    """The blocks with ``late``: digests of their rows that an earlier block of the conversation has."""
    at = F.struct("part", "block")
    keys = blocks.select("conv_id", at.alias("at"), F.explode("late").alias("key"))
    first = keys.groupBy("conv_id", "key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    k, f = keys.alias("k"), first.alias("f")
    late = k.join(f, F.col("k.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("k.key") == F.col("f.key"))).where("at > first")
    late = late.groupBy("k.at").agg(F.collect_list("k.key").alias("late")).select("at.part", "at.block", "late")
    return blocks.drop("late").join(late, ["part", "block"], "left").withColumn("late", F.coalesce("late", F.array().cast("array<binary>")))


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = Repairs()
    for b in batches:
        late, roles, texts = (b.column(n).to_pylist() for n in ("late", "roles", "texts"))
        costs = [machine.across(classes(r, t, set(x))[0]) for r, t, x in zip(roles, texts, late)]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), b.column("block"), pa.array(costs, pa.list_(pa.int64()))], names=["conv_id", "part", "block", "costs"])


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows of sorted batches, with True where a conversation begins."""
    last, begun = None, False
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in columns]):
            yield not begun or row[0] != last, row
            last, begun = row[0], True


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the costs at its beginning and the bits of the cheapest states at its end."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("entry", pa.list_(pa.int64())), ("good", pa.int32()), ("last", pa.bool_())])
    rows: list[tuple] = []

    def resolved() -> pa.RecordBatch:
        machine, entries = Repairs(), [START]
        for _, _, _, m in rows:
            v = entries[-1]
            new = [min(v[p] + m[4 * p + q] for p in range(4)) for q in range(4)]
            least = min(new)
            entries.append(tuple(min(x - least, FAR) if x < FAR else FAR for x in new))
        good = machine.ends(machine.state(entries[-1])[0])
        out = []
        for i in range(len(rows) - 1, -1, -1):
            _, part, block, m = rows[i]
            out.append((part, block, list(entries[i]), good, i == len(rows) - 1))
            v, w = entries[i], [min(entries[i][p] + m[4 * p + q] for p in range(4)) for q in range(4)]
            good = sum(1 << p for p in range(4) if v[p] < FAR and any(good >> q & 1 and v[p] + m[4 * p + q] == w[q] for q in range(4)))
            good = machine.closed(machine.state(v)[0], good)
        return _batch(out, schema)

    for first, row in runs(batches, ["conv_id", "part", "block", "costs"]):
        if first and rows:
            yield resolved()
            rows = []
        rows.append(row)
    if rows:
        yield resolved()


def gone_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of conversations from their blocks in order, one block at a time."""
    machine, out, now, schema = Repairs(), [], None, None
    columns = ["conv_id", "turns", "roles", "texts", "late", "entry", "good", "last"]

    def ended() -> tuple:
        span = now["high"] - now["low"] + 1 - now["distinct"] if now["distinct"] else 0
        return now["conv"], span, *now["faults"], now["illegal"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal schema
        for b in batches:
            schema = schema or pa.schema([("conv_id", b.schema.field("conv_id").type), *list(_arrow(pa.int64()))[2:10]])
            yield b

    for first, (conv, turns, roles, texts, late, entry, good, last) in runs(named(batches), columns):
        if first:
            if now:
                out.append(ended())
            now = {"conv": conv, "faults": [0, 0, 0], "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "rows": 0, "q": NONE, "role": None, "distinct": 0, "low": None, "high": None, "turn": None}
        symbols, faults, _ = classes(roles, texts, set(late))
        states, added = machine.scan(tuple(entry), symbols)
        audit, q = machine.walk(states, added, symbols, good, now["q"], last)
        for piece in repaired(audit, now["q"], roles, texts):
            now["hash"].update((("\n" if now["rows"] else "") + piece).encode("utf-8", "replace"))
            now["rows"] += 1
        now["q"] = q
        now["audit"].append(audit)
        now["faults"] = [x + y for x, y in zip(now["faults"], faults)]
        now["illegal"] += illegal(([now["role"]] if now["role"] is not None else []) + roles)
        now["role"] = roles[-1] if roles else now["role"]
        # turns ascend, so a turn that goes on from the last block is the last one there
        for t in turns:
            if t is not None and t != now["turn"]:
                now["distinct"], now["turn"], now["high"] = now["distinct"] + 1, t, t
                now["low"] = t if now["low"] is None else now["low"]
        now["cost"] += sum(added[1:])
        if last:
            v = machine.vectors[states[-1]]
            now["cost"] += min(v[NONE], v[A])
        if len(out) >= 512:
            yield _batch(out, schema)
            out = []
    if now:
        yield _batch([*out, ended()], schema)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, most: int = BLOCK_ROWS) -> DataFrame:
    """A row for each conversation: ``conv_id``, counts of gaps and faults, ``cost``, ``audit``, ``repaired_sha256``.

    Rows for which ``present`` is false only name their conversation.
    """
    spark = rows.sparkSession
    small_batches(spark)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    kind = slim.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "h"]
    each = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(each.drop("h").mapInArrow(lambda b: in_blocks(b, most), _fields(kind)), "conversations")
    results = ["conv_id", *[f.split()[0] for f in RESULT.split(", ")]]
    blocks = with_late(found.where("not done").select("conv_id", "part", "block", "turns", "roles", "texts", "late"))
    blocks = materialize(blocks, "blocks")
    costs = blocks.mapInArrow(summaries, f"conv_id {kind}, part int, block int, costs array<long>")
    places = costs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(placed, "part int, block int, entry array<long>, good int, last boolean")
    ordered = blocks.join(places, ["part", "block"]).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    rest = ordered.mapInArrow(gone_through, f"conv_id {kind}, {RESULT}")
    return found.where("done").select(results).unionByName(rest.select(results))
