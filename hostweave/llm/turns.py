"""Conversations put right at the least cost, long ones in chunks that are solved side by side.

Rows become a byte each (class of role, fault). The cheapest edits follow from costs to go over
four states: nothing yet, after the system row, after a user row, after an assistant row. A chunk
of a conversation starts its backward pass from a guess of the costs at its end. Passes then put
its neighbour's costs in place of the guess and run until they differ from those of the pass before
by a constant only, from where on nothing changes; passes end when no chunk's end has changed but
by a constant. With these costs each chunk traces its edits, least letters first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm.tables import only, written

#: Rows of a chunk.
CHUNK = 4096
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Classes of a role by its first letter; faults.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NONE, BLANK, DUPLICATE, CUT = range(4)
#: States: nothing yet, and after a row of each class. Where a row of a class leads from each, or -1.
FOLLOWS = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: The class that can follow each state by a new label or a new row, and the state after it.
NEXT_CLASS, NEXT_STATE = (USER, USER, ASSISTANT, USER), (2, 2, 3, 2)
LABELS = {USER: "user", ASSISTANT: "assistant"}
#: Costs to go where no row is left: a conversation ends empty or after an assistant row.
END = (0, 6, 3, 0)

Costs = tuple[int, int, int, int]


def step_back(code: int, to_go: Costs) -> Costs:
    """Costs to go before a row, from those after it; new rows before it are counted."""
    kind, fault = code & 3, code >> 2
    base = [DELETE + c for c in to_go]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        for state in range(4):
            if (kept := FOLLOWS[state][kind]) >= 0:
                base[state] = min(base[state], extra + to_go[kept])
            base[state] = min(base[state], extra + RELABEL + to_go[NEXT_STATE[state]])
    user, assistant = min(base[2], INSERT + base[3]), min(base[3], INSERT + base[2])
    return min(base[0], INSERT + user), min(base[1], INSERT + user), user, assistant


def apart(one: Costs, other: Costs) -> bool:
    """Whether two cost vectors differ by more than a constant."""
    return len({a - b for a, b in zip(one, other, strict=True)}) > 1


def backward(codes: bytes, right: Costs) -> Costs:
    for code in reversed(codes):
        right = step_back(code, right)
    return right


def fixed_up(codes: bytes, old_right: Costs, old_left: Costs, right: Costs) -> Costs:
    """Costs before the chunk for other costs after it: run on until both differ by a constant."""
    for code in reversed(codes):
        if not apart(right, old_right):
            shift = right[0] - old_right[0]
            return tuple(c + shift for c in old_left)
        right, old_right = step_back(code, right), step_back(code, old_right)
    return right


def traced(codes: bytes, right: Costs, state: int) -> tuple[list[tuple[str, int, int]], int]:
    """Edits (letter, row or -1, class of the row after it or -1) of the cheapest way, of these the
    least letters; and the state after it. Codes have no row left out."""
    to_go = [right]
    for code in reversed(codes):
        to_go.append(step_back(code, to_go[-1]))
    to_go.reverse()
    edits, at = [], 0
    while at < len(codes):
        kind, fault = codes[at] & 3, codes[at] >> 2
        cost, after = to_go[at][state], to_go[at + 1]
        free = fault not in (BLANK, DUPLICATE)
        extra = TRUNCATED if fault == CUT else 0
        kept, new = FOLLOWS[state][kind], NEXT_STATE[state]
        if cost == DELETE + after[state]:
            edits.append(("D", at, -1))
            at += 1
        elif cost == INSERT + to_go[at][new]:
            edits.append(("I", -1, NEXT_CLASS[state]))
            state = new
        elif free and kept >= 0 and cost == extra + after[kept]:
            edits.append(("K", at, kind))
            state, at = kept, at + 1
        else:
            edits.append(("R", at, NEXT_CLASS[state]))
            state, at = new, at + 1
    return edits, state


def ending(state: int) -> list[tuple[str, int, int]]:
    """New rows that end a conversation."""
    edits = []
    while state in (1, 2):
        edits.append(("I", -1, NEXT_CLASS[state]))
        state = NEXT_STATE[state]
    return edits


def cost_of(edits: list[tuple[str, int, int]], codes: bytes) -> int:
    price = {"D": DELETE, "I": INSERT, "K": 0, "R": RELABEL}
    return sum(price[e] + TRUNCATED * (e in "KR" and codes[at] >> 2 == CUT) for e, at, _ in edits)


def _key(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def _judged(rows: DataFrame) -> DataFrame:
    """_conv, turn, role, text, copies (equal rows are one) and code of the first of them."""
    space = F.lit(" ")
    filled = only(rows, "conv_id", "turn", "role", "text").select(
        _key(F.col("conv_id")).alias("_conv"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    )
    once = filled.groupBy("_conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("_sha", F.sha2(F.col("text").cast("binary"), 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    once = written(once.withColumn("_at", when), "turns")
    # Only texts that a role has in more than one turn can repeat an earlier one.
    first = once.groupBy("_conv", "role", "_sha").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    found = once.join(first, ["_conv", "role", "_sha"], "left")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("_first").isNotNull() & (F.col("_at") > F.col("_first")), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT)
        .otherwise(NONE)
    )
    return found.select("_conv", "turn", "role", "text", "copies", (kind + 4 * fault).cast("int").alias("code"))


CHUNKS = "_conv string, _chunk long, codes binary, free boolean, at array<int>, roles array<string>, texts array<string>"


def _chunks(judged: DataFrame) -> DataFrame:
    """Rows of conversations in order, cut into chunks; at, roles and texts are of rows that may stay."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        done, conv, codes, free = [], None, bytearray(), []

        def close() -> None:
            nonlocal number, codes, free
            if codes:
                done.append((conv, number, bytes(codes), bool(free), *([f[i] for f in free] for i in range(3))))
                number += 1
                codes, free = bytearray(), []

        def out() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done.clear()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("_conv", "code", "copies", "role", "text"))
            for own, code, copies, role, text in zip(*columns, strict=True):
                if own != conv or len(codes) >= CHUNK:
                    close()
                    conv = own
                if code >> 2 not in (BLANK, DUPLICATE):
                    free.append((len(codes), role, text))
                codes.append(code)
                again = code if code >> 2 == BLANK else (code & 3) | DUPLICATE << 2
                while copies > 1:
                    if len(codes) >= CHUNK:
                        close()
                        yield from out()
                    more = min(copies - 1, CHUNK - len(codes))
                    codes += bytes([again]) * more
                    copies -= more
            yield from out()
        close()
        yield from out()

    order = ["_conv", "turn", "role", "text"]
    return judged.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, CHUNKS)


PASS = "_conv string, _chunk long, rights array<long>, lefts array<long>"


def _passes(chunks: DataFrame) -> DataFrame:
    """_chunk and the costs after it (rights), for chunks with rows that may stay; others change no cost but by a constant."""

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [list(backward(c, END)) for c in batch.column("codes").to_pylist()]
            right = [list(END)] * len(left)
            yield pa.RecordBatch.from_arrays([batch.column("_conv"), batch.column("_chunk"), pa.array(right, pa.list_(pa.int64())), pa.array(left, pa.list_(pa.int64()))],
                                             ["_conv", "_chunk", "rights", "lefts"])

    def fix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("codes", "rights", "lefts", "_wanted"))
            left = [list(fixed_up(c, tuple(r), tuple(x), tuple(w))) for c, r, x, w in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_conv"), batch.column("_chunk"), batch.column("_wanted"), pa.array(left, pa.list_(pa.int64()))],
                                             ["_conv", "_chunk", "rights", "lefts"])

    solved = written(chunks.where("free").select("_conv", "_chunk", "codes").mapInArrow(first, PASS), "turn-costs")
    relative = "transform({0}, c -> c - {0}[0])"
    following = F.lead("lefts").over(Window.partitionBy("_conv").orderBy("_chunk"))
    while True:
        wanted = solved.withColumn("_wanted", F.coalesce(following, F.array(*[F.lit(c).cast("long") for c in END])))
        wrong = f"{relative.format('rights')} <> {relative.format('_wanted')}"
        again = written(wanted.where(wrong), "turn-costs-wrong")
        if again.isEmpty():
            return solved.select("_chunk", "rights")
        redone = again.join(chunks.select("_chunk", "codes"), "_chunk").select("_conv", "_chunk", "codes", "rights", "lefts", "_wanted").mapInArrow(fix, PASS)
        solved = written(solved.join(again.select("_chunk"), "_chunk", "left_anti").unionByName(redone), "turn-costs")


class _Conversation:
    """What the chunks of one conversation, in order, come to."""

    def __init__(self):
        self.faults, self.illegal, self.cost, self.state, self.last = np.zeros(4, np.int64), 0, 0, 0, -1
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, codes: bytes, right: Costs | None, at: list[int], roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
        """Takes the next chunk; its repaired rows (edit, role, text)."""
        code = np.frombuffer(codes, np.uint8)
        self.faults += np.bincount(code >> 2, minlength=4)
        kinds = np.concatenate(([self.last], code & 3)) if self.last >= 0 else code & 3
        before, after = kinds[:-1], kinds[1:]
        legal = ((after == USER) & ((before == SYSTEM) | (before == ASSISTANT))) | ((before == USER) & (after == ASSISTANT))
        self.illegal += len(before) - int(legal.sum())
        self.last = int(kinds[-1])
        if right is None:
            edits = [("D", i, -1) for i in range(len(codes))]
        else:
            edits, self.state = traced(codes, right, self.state)
        self.cost += cost_of(edits, codes)
        return self._keep(edits, dict(zip(at, zip(roles, texts, strict=True), strict=True)))

    def end(self) -> list[tuple[str, str, str]]:
        edits = ending(self.state)
        self.cost += cost_of(edits, b"")
        return self._keep(edits, {})

    def _keep(self, edits: list[tuple[str, int, int]], free: dict[int, tuple[str, str]]) -> list[tuple[str, str, str]]:
        rows = []
        for letter, at, kind in edits:
            if letter != "D":
                role, text = free.get(at, ("", ""))
                rows.append((letter, role if letter == "K" else LABELS[kind], text))
        self.audit.append("".join(e[0] for e in edits))
        for _, role, text in rows:
            self.digest.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
            self.lines += 1
        return rows


FOUND = ["_conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _in_order(rows: DataFrame) -> DataFrame:
    chunks = written(_chunks(_judged(rows)), "turn-chunks")
    found = chunks.join(_passes(chunks), "_chunk", "left")
    return found.select("_conv", "_chunk", "codes", "at", "roles", "texts", "rights").repartition("_conv").sortWithinPartitions("_conv", "_chunk")


def _walk(batches: Iterable[pa.RecordBatch], ended, rows=None):
    """Each conversation's chunks one after the other; gives what ``ended`` and ``rows`` make of it."""
    conv, own = None, None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("_conv", "codes", "rights", "at", "roles", "texts"))
        for name, codes, right, at, roles, texts in zip(*columns, strict=True):
            if name != conv:
                if own is not None:
                    yield from ended(conv, own)
                conv, own = name, _Conversation()
            made = own.add(codes, tuple(right) if right else None, at, roles, texts)
            if rows:
                yield from rows(conv, own, made)
    if own is not None:
        yield from ended(conv, own)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text): what is wrong with it and the cheapest repair.

    conv_id, gaps (turns missing between the first and the last), blank, duplicate, truncated (rows
    by their first fault), illegal (neighbours whose roles may not follow one another), cost, audit
    (the edits' letters: Delete, Insert, Keep, Rerole; the least of the cheapest) and repaired_sha256 (of the
    repaired ``role:text`` lines). Rows are in order of turn, null turns first, equal turns by role
    and text; rows equal in all stand side by side. Null ids, roles and texts count as one space;
    texts are taken whole; a repaired conversation may be empty. Other columns are not read,
    whatever their names, and an empty table gives no row. A conversation's hash is taken in order, so one
    task reads its rows, a chunk at a time.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(conv: str, own: _Conversation):
            own.end()
            yield (conv, *own.faults[1:].tolist(), own.illegal, own.cost, "".join(own.audit), own.digest.hexdigest())

        held = []
        for row in _walk(batches, ended):
            held.append(row)
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], FOUND)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], FOUND)

    schema = "_conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    found = _in_order(rows).mapInArrow(work, schema)
    turns = only(rows, "conv_id", "turn").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("_n"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps")).withColumn("_conv", _key(F.col("conv_id")))
    return gaps.join(found, "_conv").select("conv_id", "gaps", *FOUND[1:])


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations' rows: conv_id (text; a space for null), place, edit, role and text. Cases as in ``repair_conversations``."""
    names = ["conv_id", "place", "edit", "role", "text"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(conv: str, own: _Conversation, rows: list[tuple[str, str, str]]):
            for i, row in enumerate(rows):
                yield (conv, own.lines - len(rows) + i, *row)

        def ended(conv: str, own: _Conversation):
            yield from made(conv, own, own.end())

        held = []
        for row in _walk(batches, ended, made):
            held.append(row)
            if len(held) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)

    return _in_order(rows).mapInArrow(work, "conv_id string, place long, edit string, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows, a twentieth of them each dropped, emptied, without sentence ends, twice, or the user's, by the CRC of ``conv_id:turn``."""
    space = F.lit(" ")
    rows = only(conversations, "conv_id", "turn", "role", "text").withColumn("text", F.coalesce("text", space)).withColumn("role", F.coalesce("role", space))
    name = F.concat(_key(F.col("conv_id")), F.lit(":"), _key(F.col("turn")))
    marked = rows.withColumn("_d", F.crc32(name.cast("binary")) % 20).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("_d") == 3, 2).otherwise(1)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_c")).drop("_c")


def repaired_after_damage(conversations: DataFrame) -> DataFrame:
    """``repair_conversations`` of ``damaged`` rows, with a row for every original conv_id."""
    every = only(conversations, "conv_id").distinct()
    found = repair_conversations(damaged(conversations))
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    both = every.withColumnRenamed("conv_id", "_id").join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return both.select(F.col("_id").alias("conv_id"), *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"), nothing)
