"""Repair of the structure of conversations by Hirschberg's divide and conquer.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Reading its rows in order, an edit script is in one of four states: nothing
written yet, after the system row, after a user row, after an assistant row.  Every row is kept, reroled or deleted, and rows
may be inserted before it and at the end.  From a state each edit letter leads to one state only, so the letters alone (the audit) tell the repair.

The cheapest script with the ASCII-least audit is found in linear space: the vector of costs from the front, for the first half of the rows,
meets the vector of costs from the back, for the second half; among the states where they meet with least sum the one whose front audit is least
is the crossing, and both halves are solved alone.  Audits of the same rows that end in different states are never prefixes of each
other (each ends with the letter of the last row), so their order is settled at the crossing; the front vector carries it as four ranks.

On Spark rows are range-partitioned by conversation and turn, so no conversation, however long, has to be one task's work.  A task
finishes the conversations that lie whole in its range.  Longer ones, and those at the ends of a range, leave it as blocks of at most
``Plan.rows`` rows; each block is summed up by its 4 x 4 costs and ranks, the crossings between blocks follow from these
small matrices, and then each block is reconstructed alone.  Only the digest of the repaired text, sequential by nature, reads
the blocks of a conversation in one stream, one block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scoreloom.llm.common import SPACES, stored

NEW, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
#: What the end costs in each state, and its inserts.
END, END_EDITS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: States more than this above the least are never on a cheapest path: any state follows the edits of any other with two inserts and one deletion more.
REACH = 12
CLEAN, BLANK, DUPLICATE, CUT_OFF = range(4)


@dataclass(frozen=True)
class Plan:
    """Most rows and most characters of text that a block holds."""

    rows: int = 1024
    chars: int = 1 << 21


def following(state: int) -> int:
    """The one state that an inserted or reroled row leads to."""
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=None)
def moves(code: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the edits of a row with this code: letters (inserts before the row, then its own), next state, cost."""
    initial, fault = "suax"[code >> 2], code & 3
    out = []
    for state in range(4):
        found, at = [], state
        for inserts in range(3 if state in (NEW, SYSTEM) else 2):
            before, paid = "I" * inserts, INSERT * inserts
            found.append((before + "D", at, paid + DELETE))
            if fault in (CLEAN, CUT_OFF):
                paid += TRUNCATED if fault == CUT_OFF else 0
                found.append((before + "R", following(at), paid + REROLE))
                if initial == "s" and at == NEW:
                    found.append((before + "K", SYSTEM, paid + KEEP))
                elif initial == "ua"[following(at) - USER]:
                    found.append((before + "K", following(at), paid + KEEP))
            at = following(at)
        out.append(tuple(sorted(found)))
    return tuple(out)


Costs = tuple[int | None, ...]


@lru_cache(maxsize=1 << 16)
def onward(costs: Costs, ranks: Costs, code: int) -> tuple[Costs, Costs, int]:
    """Costs above their least and ranks of audits after one more row, and by how much the least grew."""
    best: list = [None] * 4
    for state, ways in enumerate(moves(code)):
        if costs[state] is not None:
            for letters, to, cost in ways:
                way = (costs[state] + cost, ranks[state], letters)
                if best[to] is None or way < best[to]:
                    best[to] = way
    least = min(b[0] for b in best if b is not None)
    best = [b if b is not None and b[0] <= least + REACH else None for b in best]
    order = {b[1:]: i for i, b in enumerate(sorted((b for b in best if b is not None), key=lambda b: b[1:]))}
    return tuple(b and b[0] - least for b in best), tuple(b and order[b[1:]] for b in best), least


@lru_cache(maxsize=1 << 16)
def back(costs: Costs, code: int) -> tuple[Costs, int]:
    """Costs to go, above their least, from before a row, given those from behind it, and by how much the least grew."""
    out = [min((cost + costs[to] for _, to, cost in ways if costs[to] is not None), default=None) for ways in moves(code)]
    least = min(c for c in out if c is not None)
    return tuple(None if c is None else c - least for c in out), least


def only(state: int) -> Costs:
    return tuple(0 if s == state else None for s in range(4))


def front(codes: bytes, state: int) -> tuple[Costs, Costs]:
    """Costs from a state over all rows to each state, and the ranks of their least audits."""
    costs, ranks, paid = only(state), only(state), 0
    for code in codes:
        costs, ranks, more = onward(costs, ranks, code)
        paid += more
    return tuple(None if c is None else c + paid for c in costs), ranks


def rear(codes: bytes, costs: Costs) -> Costs:
    """Costs to go from each state before all rows, given those behind them; a common amount is left out."""
    for code in reversed(codes):
        costs, _ = back(costs, code)
    return costs


def crossing(costs: Costs, ranks: Costs, to_go: Costs) -> int:
    """The state with the least sum of both vectors, of equal ones that with the least audit."""
    return min((costs[s] + to_go[s], ranks[s], s) for s in range(4) if costs[s] is not None and to_go[s] is not None)[2]


def audit_between(codes: bytes, start: int, end: int) -> str:
    """The least audit of the cheapest scripts over the rows from one state to another."""
    if len(codes) < 2:
        return "".join(min((cost, letters) for letters, to, cost in moves(code)[start] if to == end)[1] for code in codes)
    half = len(codes) // 2
    middle = crossing(*front(codes[:half], start), rear(codes[half:], only(end)))
    return audit_between(codes[:half], start, middle) + audit_between(codes[half:], middle, end)


def whole_audit(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation."""
    costs, ranks = front(codes, NEW)
    end = crossing(costs, ranks, END)
    return costs[end] + END[end], audit_between(codes, NEW, end) + END_EDITS[end]


def repaired_lines(audit: str, state: int, rows: Iterable[tuple[str, str]]) -> list[str]:
    """``role:text`` of the rows that an audit leaves, from a state on."""
    out, rows = [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        state = SYSTEM if letter == "K" and state == NEW and role[:1] == "s" else following(state)
        out.append(f"{role if letter == 'K' else ('user' if state == USER else 'assistant')}:{text}")
    return out


def code_of(role: str, text: str, seen: bool) -> int:
    """A row's initial and first fault as one number."""
    written = text.rstrip(SPACES)
    fault = BLANK if not written else DUPLICATE if seen else CLEAN if written[-1] in ".!?" else CUT_OFF
    return ("sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3) << 2 | fault


def row_key(role: str, text: str) -> bytes:
    """16 bytes that tell rows of different role or text apart."""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


class Facts:
    """Counts over rows in order that can be put together block by block."""

    def __init__(self) -> None:
        self.least = self.most = self.initial = None
        self.kinds, self.illegal, self.faults = 0, 0, [0, 0, 0, 0]

    def add(self, least, most, kinds: int, first: str, last: str, illegal: int, faults: Iterable[int]) -> None:
        if kinds:
            self.kinds += kinds - (self.most == least)
            self.least, self.most = least if self.least is None else self.least, most
        self.illegal += illegal + (self.initial is not None and self.initial + first not in ("su", "ua", "au"))
        self.initial = last
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]

    def columns(self) -> dict[str, int]:
        gaps = self.most - self.least + 1 - self.kinds if self.kinds else 0
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT_OFF], "illegal": self.illegal}


def block_facts(turns: list, roles: list[str], codes: bytes) -> tuple:
    known, initials = [t for t in turns if t is not None], [r[:1] for r in roles]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    faults = [sum(c & 3 == f for c in codes) for f in range(4)]
    return (known[0] if known else None, known[-1] if known else None, len(set(known)), initials[0], initials[-1], illegal, faults)


def finished(turns: list, roles: list[str], texts: list[str], keys: list[bytes]) -> dict:
    """Result columns of a conversation whose rows are all here, in order."""
    seen: set[bytes] = set()
    codes = bytearray()
    for role, text, key in zip(roles, texts, keys, strict=True):
        codes.append(code_of(role, text, key in seen))
        seen.add(key)
    facts = Facts()
    facts.add(*block_facts(turns, roles, bytes(codes)))
    cost, audit = whole_audit(bytes(codes))
    lines = repaired_lines(audit, NEW, zip(roles, texts, strict=True))
    return facts.columns() | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()}


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
BLOCK = "part int, ord int, turns array<bigint>, roles array<string>, texts array<string>, keys array<binary>"


def batched(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, each of so many characters of text at most beside its last row."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 400 + sum(len(v) if isinstance(v, (str, bytes)) else sum(len(x or "") for x in v) if k == "texts" and v else 0 for k, v in row.items())
        if chars >= size or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def damaged(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies`` after the damage that the checksum of conversation and turn chooses: 0 copies where the row is dropped.

    Null roles, texts and null parts of the checksum's text count as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(space(conversation), F.lit(":"), space(turn)).cast("binary")) % 20
    return rows.select(
        F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(act == 4, "user").otherwise(space(role)).alias("role"),
        F.when(act == 1, "").when(act == 2, F.translate(space(text), ".!?", "")).otherwise(space(text)).alias("text"),
        F.when(act == 0, 0).when(act == 3, 2).otherwise(1).alias("copies"))


def repair(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Conversation, faults, cheapest repair and its digest, one row for each ``conv`` of ``conv, turn, role, text, copies``.

    Rows stand in order of turn (nulls first), rows of one turn in order of role and text; equal rows are adjacent.  A null conversation
    is one conversation.  Roles with another initial than s, u, a are reroled or deleted.  A conversation without rows left has
    zeros, an empty audit and the digest of an empty text.  An empty table gives no rows; other columns are not read.
    """
    conv = rows.schema["conv"].dataType.simpleString()
    # the last key has no meaning: it lets a range boundary fall between equal rows
    ranged = (rows.where("copies > 0").withColumn("turn_row", F.monotonically_increasing_id()).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
              .select("conv", "turn", "role", "text", "turn_row").repartitionByRange("conv", "turn", "role", "text", "turn_row").sortWithinPartitions("conv", "turn", "role", "text"))
    schema = to_arrow_schema(StructType.fromDDL(f"conv {conv}, done boolean, {BLOCK}, {RESULT}"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def blocks() -> Iterator[dict]:
            held: tuple[list, ...] = ([], [], [], [])
            now, ordinal, chars, opened = None, 0, 0, True  # the first conversation of a range may have begun in the one before it

            def block() -> dict:
                return {"conv": now[0], "done": False, "part": part, "ord": ordinal, "turns": held[0], "roles": held[1], "texts": held[2], "keys": held[3]}

            for batch in batches:
                for own, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text")], strict=True):
                    if now is None or own != now[0]:
                        if now is not None:
                            yield block() if opened else {"conv": now[0], "done": True, **finished(*held)}
                            ordinal, opened = ordinal + 1, False
                        now, held, chars = (own,), ([], [], [], []), 0
                    elif len(held[0]) >= plan.rows or chars >= plan.chars:
                        yield block()
                        ordinal, opened, held, chars = ordinal + 1, True, ([], [], [], []), 0
                    for column, value in zip(held, (turn, role, text, row_key(role, text)), strict=True):
                        column.append(value)
                    chars += len(text)
            if now is not None:  # the last one may go on in the next range
                yield block()

        yield from batched(blocks(), schema, plan.chars)

    parts = stored(ranged.select("conv", "turn", "role", "text").mapInArrow(segments, f"conv {conv}, done boolean, {BLOCK}, {RESULT}"), "conversation-parts")
    names = ["conv", *[f.name for f in StructType.fromDDL(RESULT)]]
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    emptied = rows.groupBy("conv").agg(F.max("copies").alias("copies")).where("copies = 0").select(
        "conv", *[F.lit(nothing.get(f.name, 0)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(RESULT)])
    return parts.where("done").select(*names).unionByName(across_blocks(parts.where("not done"), conv, plan).select(*names)).unionByName(emptied)


SUMMARY = "part int, ord int, codes binary, costs array<bigint>, ranks array<int>, least bigint, most bigint, kinds bigint, first string, last string, illegal bigint, faults array<bigint>"
CROSSED = f"part int, ord int, start int, stop int, final boolean, {RESULT.replace(', audit string, repaired_sha256 string', '')}"


def across_blocks(blocks: DataFrame, conv: str, plan: Plan) -> DataFrame:
    """The same for conversations given as blocks, each numbered by ``part`` and ``ord`` in order."""
    rows = blocks.select("conv", "part", "ord", F.posexplode("keys").alias("at", "key"))
    firsts = (rows.groupBy("conv", "key").agg(F.min(F.struct("part", "ord", "at")).alias("x")).groupBy(F.col("x.part").alias("part"), F.col("x.ord").alias("ord"))
              .agg(F.collect_list("x.at").alias("firsts")))  # at most the rows of a block
    schema = to_arrow_schema(StructType.fromDDL(f"conv {conv}, {SUMMARY}"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summaries() -> Iterator[dict]:
            for batch in batches:
                for at in range(batch.num_rows):
                    b = batch.slice(at, 1).to_pylist()[0]
                    new = set(b["firsts"] or ())
                    codes = bytes(code_of(r, t, i not in new) for i, (r, t) in enumerate(zip(b["roles"], b["texts"], strict=True)))
                    matrix = [front(codes, s) for s in range(4)]
                    facts = dict(zip(("least", "most", "kinds", "first", "last", "illegal", "faults"), block_facts(b["turns"], b["roles"], codes), strict=True))
                    yield {"conv": b["conv"], "part": b["part"], "ord": b["ord"], "codes": codes, "costs": [c for row in matrix for c in row[0]],
                           "ranks": [r for row in matrix for r in row[1]], **facts}

        yield from batched(summaries(), schema, plan.chars)

    slim = blocks.select("conv", "part", "ord", "turns", "roles", "texts").join(firsts, ["part", "ord"], "left")
    summaries = stored(slim.mapInArrow(summed, f"conv {conv}, {SUMMARY}"), "conversation-blocks")

    def cross(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "ord"])
        facts, states, to_go = Facts(), [NEW], [END]
        matrices = [[([None if pd.isna(c) else int(c) for c in costs[4 * s:4 * s + 4]], [None if pd.isna(r) else int(r) for r in ranks[4 * s:4 * s + 4]]) for s in range(4)]
                    for costs, ranks in zip(group["costs"], group["ranks"], strict=True)]
        for matrix in reversed(matrices):
            ahead = to_go[-1]
            to_go.append(tuple(min((c + a for c, a in zip(costs, ahead, strict=True) if c is not None and a is not None), default=None) for costs, _ in matrix))
        cost, to_go = to_go[-1][NEW], to_go[::-1]
        for matrix, ahead in zip(matrices, to_go[1:], strict=True):
            states.append(crossing(*matrix[states[-1]], ahead))
        for b in group.itertuples():
            turn = lambda x: None if pd.isna(x) else int(x)
            facts.add(turn(b.least), turn(b.most), int(b.kinds), b.first, b.last, int(b.illegal), [int(f) for f in b.faults])
        return pd.DataFrame({"part": group["part"], "ord": group["ord"], "start": states[:-1], "stop": states[1:],
                             "final": [False] * (len(group) - 1) + [True], **facts.columns(), "cost": cost})

    crossed = summaries.select("conv", "part", "ord", "costs", "ranks", "least", "most", "kinds", "first", "last", "illegal", "faults").groupBy("conv").applyInPandas(cross, CROSSED)
    solved = f"conv {conv}, {CROSSED}, audit string, body binary"
    solved_schema = to_arrow_schema(StructType.fromDDL(solved))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for at in range(batch.num_rows):
                    b = batch.slice(at, 1).to_pylist()[0]
                    audit = audit_between(b["codes"], b["start"], b["stop"]) + (END_EDITS[b["stop"]] if b["final"] else "")
                    lines = repaired_lines(audit, b["start"], zip(b.pop("roles"), b.pop("texts"), strict=True))
                    yield {k: b.get(k) for k in solved_schema.names} | {"audit": audit, "body": "\n".join(lines).encode("utf-8", "surrogatepass")}

        yield from batched(rows(), solved_schema, plan.chars)

    pieces = (blocks.select("conv", "part", "ord", "roles", "texts").join(summaries.select("part", "ord", "codes"), ["part", "ord"]).join(crossed, ["part", "ord"])
              .mapInArrow(solve, solved).repartition("conv").sortWithinPartitions("conv", "part", "ord"))
    whole = to_arrow_schema(StructType.fromDDL(f"conv {conv}, {RESULT}"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            sha, audits, begun = hashlib.sha256(), [], False
            for batch in batches:
                for at in range(batch.num_rows):
                    b = batch.slice(at, 1).to_pylist()[0]
                    if b["body"]:
                        sha.update((b"\n" if begun else b"") + b["body"])
                        begun = True
                    audits.append(b["audit"])
                    if b["final"]:
                        yield {k: b.get(k) for k in whole.names} | {"audit": "".join(audits), "repaired_sha256": sha.hexdigest()}
                        sha, audits, begun = hashlib.sha256(), [], False

        yield from batched(rows(), whole, plan.chars)

    return pieces.mapInArrow(digest, f"conv {conv}, {RESULT}")


def repaired_conversations(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation after its damage."""
    return repair(damaged(rows), plan).withColumnRenamed("conv", "conv_id")
