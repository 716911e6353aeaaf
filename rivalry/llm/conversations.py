"""Repair of conversation structure by iterative-deepening A*.

The turns of a conversation are edited into roles ``(s?(ua)+)?`` at the least cost: a row is
deleted (D), kept (K) or gets another role (R), and empty turns are inserted (I). The search
goes depth first, in ASCII order of the edits, under a cost bound that rises until a path is
accepted; so the first accepting path is the cheapest, and of those the ASCII-least. A state
is (row, last role). What a failed state would have needed at least is kept in a table, which
stops later visits and gives the next bound.

Rows are ordered in ranges, so that a conversation of any length is spread over tasks: what
lies in a range is cut into blocks of ``BLOCK`` rows. A block's cost from each entry to each
exit state is a 4 x 4 table; multiplied from the end these give what every exit of a block
costs until the end of the conversation, with which blocks are searched independently, for
each entry state. An insertion belongs to the row after it, so the parts of the ASCII-least
path are ASCII-least themselves. The final digest is sequential by its nature: texts pass
one task per conversation as a sorted stream, of which only the edits are held.

Defined cases: null roles and texts are one space; null conversation ids are one
conversation; null turns come first; rows of one turn are ordered by role and the text's
digest; a repeated row is a duplicate like any other, a text of blanks is blank; an empty
table gives no rows; a conversation without rows has an empty audit; other columns are
ignored; texts of any length are hashed as they stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.session import persist_table

#: Rows of one block, and rows of one range of the order.
BLOCK, RANGE_ROWS = 256, 100_000
#: Costs of the edits, and of a row that stays although it is truncated.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Last role: none yet, system, user, assistant. What a further turn makes of it, and what an end there costs.
AFTER, FINAL = (2, 2, 3, 2), (0, 2 * INSERT, INSERT, 0)
ROLES = ("", "", "user", "assistant")
#: Last role after keeping a row whose role begins with s, u, a or something else; -1: not possible.
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
MUCH = 1 << 60


def _least(code: int, count: int) -> int:
    """What a row costs at least: code 0 must go, others are 1 + 2 x role + truncated."""
    return DELETE * count if not code else DELETE if code % 2 == 0 else REROLE if code // 2 == 3 else 0


def search(codes: list[int], counts: list[int], entry: int, exits: tuple, last: bool) -> tuple[int, int, str]:
    """(cost, exit state, edits) of the ASCII-least cheapest edits; ``exits``: cost from each last role on."""
    n = len(codes)
    floor = [0 if last else min(exits)] * (n + 1)
    for i in range(n - 1, -1, -1):
        floor[i] = floor[i + 1] + _least(codes[i], counts[i])
    known = [f for f in floor[:n] for _ in range(4)] + list(exits)  # cost to go of each state, at least

    def moves(state: int) -> list[tuple[str, int, int]]:
        i, role = divmod(state, 4)
        insert = ("I", INSERT, 4 * i + AFTER[role])
        if i == n:
            return [insert] if last and FINAL[role] else []
        code, out = codes[i], [("D", DELETE * counts[i], state + 4), insert]
        if code:
            more = TRUNCATED if code % 2 == 0 else 0
            if (to := KEPT[(code - 1) // 2][role]) >= 0:
                out.append(("K", more, 4 * i + 4 + to))
            out.append(("R", REROLE + more, 4 * i + 4 + AFTER[role]))
        return out

    while True:
        bound = known[entry]
        stack, path = [[entry, 0, moves(entry), 0, MUCH, 0]], []  # state, cost so far, moves, next one, least cost beyond, cost of the move to it
        while stack:
            top = stack[-1]
            state, spent, ways, k, beyond, step = top
            if not k and state >= 4 * n and not (last and FINAL[state % 4]):
                return bound, state % 4, "".join(path)
            if k < len(ways):
                top[3] += 1
                edit, cost, to = ways[k]
                if spent + cost + known[to] > bound:
                    top[4] = min(beyond, cost + known[to])
                else:
                    stack.append([to, spent + cost, moves(to), 0, MUCH, cost])
                    path.append(edit * counts[state // 4] if edit == "D" else edit)
            else:
                known[state] = max(known[state], beyond)
                stack.pop()
                if stack:
                    path.pop()
                    stack[-1][4] = min(stack[-1][4], step + known[state])


def block_costs(codes: list[int], counts: list[int]) -> list[int]:
    """Least cost from each entry state to each exit state, the last row's edit being the last."""
    out = []
    for entry in range(4):
        at = [MUCH] * 4
        at[entry] = 0
        for code, count in zip(codes, counts):
            for _ in range(3):
                for role in range(4):
                    at[AFTER[role]] = min(at[AFTER[role]], at[role] + INSERT)
            then = [c + DELETE * count for c in at]
            if code:
                more = TRUNCATED if code % 2 == 0 else 0
                for role in range(4):
                    if (to := KEPT[(code - 1) // 2][role]) >= 0:
                        then[to] = min(then[to], at[role] + more)
                    then[AFTER[role]] = min(then[AFTER[role]], at[role] + REROLE + more)
            at = then
        out += at
    return out


BLOCKS = "conv_id long, part int, block int, codes binary, counts array<long>, costs array<long>, blank long, duplicate long, truncated long"
SOLVED = "conv_id long, part int, block int, blank long, duplicate long, truncated long, ways array<struct<cost: long, exit: int, edits: string>>"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _table(fields: str) -> pa.Schema:
    """The Arrow form of a list of columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
             "array<struct<cost: long, exit: int, edits: string>>": pa.list_(pa.struct([("cost", pa.int64()), ("exit", pa.int32()), ("edits", pa.string())]))}
    pairs = [p.split(" ", 1) for p in fields.replace("cost: long, exit: int, edits: string", "*").split(", ")]
    return pa.schema([(name, kinds[kind.replace("*", "cost: long, exit: int, edits: string")]) for name, kind in pairs])


def _rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # slices, so that long texts never exist twice
            yield from zip(*[c.slice(at, 256).to_pylist() for c in batch.columns])


def _cut(batches):
    """Ordered rows to blocks; a block that holds its whole conversation needs no cost table."""
    from pyspark import TaskContext

    part, schema = TaskContext.get().partitionId(), _table(BLOCKS)
    here: list = []  # conversation, number of the block, codes, counts, blank, duplicate, truncated
    first, out = True, []

    def close(ended: bool, whole: bool):
        nonlocal first
        conv, block, codes, counts, *faults = here
        costs = None if whole and not block and not first else block_costs(codes, counts)
        out.append((conv, part, block, bytes(codes), counts, costs, *faults))
        here[1:] = [block + 1, [], [], 0, 0, 0]
        first = first and not ended

    for conv, copies, role, is_blank, is_first, is_open in _rows(batches):
        if here and here[0] != conv:
            close(True, True)
            here = []
            if len(out) >= 512:
                yield _batch(out, schema)
                out.clear()
        here = here or [conv, 0, [], [], 0, 0, 0]
        if not copies:
            continue
        if len(here[2]) >= BLOCK:
            close(False, False)
        live = not is_blank and is_first
        if live:
            here[2].append(1 + 2 * role + is_open)
            here[3].append(1)
            here[6] += is_open
        if copies > live:
            here[2].append(0)
            here[3].append(copies - live)
            here[4 if is_blank else 5] += copies - live
    if here:
        close(True, False)
    yield _batch(out, schema)


def _exits(batches):
    """Blocks from the last to the first of each conversation: adds what each exit costs, and whether a block is first and last."""
    schema = _table(f"{BLOCKS}, exits array<long>, opens int, ends int")
    held, out = None, []
    for row in _rows(batches):
        follows = held is not None and held[0] == row[0]
        if held is not None:
            out.append((*held, 0 if follows else 1, held_ends))
            if len(out) >= 512:
                yield _batch(out, schema)
                out = []
        if follows:
            table, after = held[5], held[9]
            exits = [min(table[4 * a + b] + after[b] for b in range(4)) for a in range(4)]
        else:
            exits = list(FINAL)
        held, held_ends = (*row, exits), 0 if follows else 1
    if held is not None:
        out.append((*held, 1, held_ends))
    yield _batch(out, schema)


def _solve(batches):
    schema = _table(SOLVED)
    for batch in batches:
        out = []
        for conv, part, block, codes, counts, _, *faults, exits, opens, ends in _rows([batch]):
            ways = [search(list(codes), counts, entry, tuple(exits), bool(ends)) for entry in range(1 if opens else 4)]
            out.append((conv, part, block, *faults, [{"cost": c, "exit": e, "edits": s} for c, e, s in ways]))
        yield _batch(out, schema)


class _Conversation:
    """Edits of one conversation, then its rows in order."""

    def __init__(self, conv) -> None:
        self.conv, self.cost, self.state, self.faults = conv, None, 0, np.zeros(3, dtype=np.int64)
        self.edits, self.at, self.role = bytearray(), 0, 0
        self.digest, self.lines = hashlib.sha256(), 0
        self.turns, self.least, self.last_turn, self.illegal, self.initial = 0, None, None, 0, None

    def block(self, faults: tuple, ways: list[dict]) -> None:
        way = ways[self.state]
        self.cost = way["cost"] if self.cost is None else self.cost
        self.state = way["exit"]
        self.edits += way["edits"].encode()
        self.faults += faults

    def write(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:".encode() + text.encode())
        self.lines += 1

    def insertions(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == 73:
            self.role = AFTER[self.role]
            self.write(ROLES[self.role], "")
            self.at += 1

    def row(self, turn, role: str, text: str, copies: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn
        for _ in range(copies):
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
            self.insertions()
            edit = self.edits[self.at]
            self.at += 1
            if edit == 75:
                self.role = KEPT["sua".index(role[0])][self.role]
                self.write(role, text)
            elif edit == 82:
                self.role = AFTER[self.role]
                self.write(ROLES[self.role], text)

    def result(self) -> tuple:
        self.insertions()
        gaps = self.last_turn - self.least + 1 - self.turns if self.turns else 0
        blank, duplicate, truncated = self.faults.tolist()
        return (self.conv, gaps, blank, duplicate, truncated, self.illegal, self.cost or 0, self.edits.decode(), self.digest.hexdigest())


def _apply(batches):
    schema, here, out = _table(REPAIRED), None, []
    for conv, turn, role, text, copies, blank, duplicate, truncated, ways in _rows(batches):
        if here is None or here.conv != conv:
            if here is not None:
                out.append(here.result())
                if len(out) >= 512:
                    yield _batch(out, schema)
                    out = []
            here = _Conversation(conv)
        if ways is not None:
            here.block((blank, duplicate, truncated), ways)
        elif copies:
            here.row(turn, role, text, copies)
    if here is not None:
        out.append(here.result())
    yield _batch(out, schema)


def damage(rows: DataFrame) -> DataFrame:
    """Adds ``copies`` (0, 1 or 2) and spoils rows by a checksum of ``conv_id:turn``."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.when(kind == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults, the cheapest edits and the digest of what they leave.

    ``rows`` has conv_id, turn, role, text, and if wanted ``copies``: how often a row stands there.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = rows.select("conv_id", "turn", text_of("role"), text_of("text"),
                        *([F.col("copies")] if "copies" in rows.columns else [F.lit(1).cast("long").alias("copies")]))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    tail = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = turns.select("conv_id", "turn", "role", digest, "copies", (tail == "").alias("blank"), (~tail.rlike("[.!?]")).alias("open"))
    items = persist_table(narrow.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), F.any_value("blank").alias("blank"), F.any_value("open").alias("open")))
    # stored, so that a join with a frequent text can be split
    earliest = persist_table(items.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("earliest")))
    i, e = items.alias("i"), earliest.alias("e")
    same = F.col("i.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("i.role") == F.col("e.role")) & (F.col("i.digest") == F.col("e.digest"))
    begin = F.when(F.col("i.role").startswith("s"), 0).when(F.col("i.role").startswith("u"), 1).when(F.col("i.role").startswith("a"), 2).otherwise(3)
    judged = i.join(e, same, "left").select("i.conv_id", "i.turn", "i.role", "i.digest", "i.copies", begin.alias("begin"), "i.blank",
                                            F.col("i.turn").eqNullSafe(F.col("e.earliest.turn")).alias("is_first"), F.col("i.open").cast("int").alias("open"))
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    ranges = max(parallel, -(-items.count() // RANGE_ROWS))
    conv, turn = F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()
    ordered = judged.repartitionByRange(ranges, conv, turn, "role", "digest").sortWithinPartitions(conv, turn, "role", "digest")
    blocks = persist_table(ordered.select("conv_id", "copies", "begin", "blank", "is_first", "open").mapInArrow(_cut, BLOCKS))
    backward = blocks.repartition("conv_id").sortWithinPartitions(conv, F.col("part").desc(), F.col("block").desc())
    bounded = backward.mapInArrow(_exits, f"{BLOCKS}, exits array<long>, opens int, ends int").repartition(ranges, "conv_id", "part", "block")
    solved = bounded.mapInArrow(_solve, SOLVED)
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    edits = solved.select("conv_id", F.lit(0).alias("kind"), "part", "block", no("long", "turn"), no("string", "role"), no("binary", "digest"),
                          no("string", "text"), no("long", "copies"), "blank", "duplicate", "truncated", "ways")
    lines = turns.select("conv_id", F.lit(1).alias("kind"), no("int", "part"), no("int", "block"), "turn", "role", digest, "text", "copies",
                         no("long", "blank"), no("long", "duplicate"), no("long", "truncated"), no(edits.schema["ways"].dataType, "ways"))
    stream = edits.unionByName(lines).repartition("conv_id").sortWithinPartitions(conv, "kind", "part", "block", turn, "role", "digest")
    return stream.select("conv_id", "turn", "role", "text", "copies", "blank", "duplicate", "truncated", "ways").mapInArrow(_apply, REPAIRED)
