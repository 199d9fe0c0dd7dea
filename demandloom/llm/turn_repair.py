"""Cheapest repairs of conversations by an auction algorithm for shortest paths.

The rows of a conversation and four states of the role pattern `(s?(ua)+)?` span a lattice; edits are
its arcs, with whole-number costs. An auction finds the shortest path: it extends a path along the
cheapest arc, or raises the price of the path's last node and contracts. When the path is complete,
prices are dual: an arc is tight if its cost is the difference of the prices, the shortest paths are
the tight ones, and the first of them in the order of the letters is traced.

Rows are dealt by ranges of (conversation, place), so a long conversation spreads over tasks. One that
fits is repaired where it lies. Of others every task writes parts with the costs between the states at
both ends; these are folded from the end, and the parts are then traced in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import fresh, sized, staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a lattice that one auction works on, and rows and characters of a part.
BLOCK_ROWS = 16
PART_ROWS = 1024
PART_CHARS = 4 << 20
_KNOWN = 1 << 14
_SHORT = 256
INF = 1 << 60

#: White space of the contract.
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after `s`, after `u`, after `a`. What may follow, by role initial.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Cost of completing the pattern after the last row, by state, and the inserts it takes.
TAIL = (0, 2 * INSERT, INSERT, 0)
TAIL_AUDIT = ("", "II", "I", "")
#: A row's code is the place of its initial here (last: any other) and four times its fault.
INITIALS = "sua"
FAULTS = SOUND, BLANK, REPEATED, CUT = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLES = {2: "user", 3: "assistant"}


def _arcs(code: int, state: int) -> list[tuple[int, int, int, str]]:
    """Edits at a row in the order of their letters: (cost, rows passed, next state, letter)."""
    fault, initial = code >> 2, code & 3
    extra = TRUNCATED if fault == CUT else 0
    given = 2 if state in NEXT["u"] else 3
    out = [(DELETE, 1, state, "D"), (INSERT, 0, given, "I")]
    if fault not in (BLANK, REPEATED):
        if initial < 3 and state in NEXT[INITIALS[initial]]:
            out.append((KEEP + extra, 1, NEXT[INITIALS[initial]][state], "K"))
        out.append((REROLE + extra, 1, given, "R"))
    return out


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(16)]


def lattice(codes: bytes, exits: tuple) -> list[list[tuple[int, int, str]]]:
    """Arcs (cost, node, letter) of every node 4 * row + state; the sink comes last."""
    n = len(codes)
    # States that cannot come to an end with a finite price are left out; no pattern goes back.
    live = range(4) if min(exits[2:]) < INF else range(2 if exits[1] < INF else 1)
    nodes: list[list[tuple[int, int, str]]] = []
    for row, code in enumerate(codes):
        for state in range(4):
            arcs = ARCS[code][state] if state in live else ()
            nodes.append([(c, 4 * (row + step) + to, x) for c, step, to, x in arcs if to in live])
    nodes += [[(exits[state], 4 * n + 4, "")] if exits[state] < INF else [] for state in range(4)]
    return nodes


def auction(nodes: list[list[tuple[int, int, str]]], prices: list[int], origin: int) -> None:
    """Raise prices until a path of tight arcs leads from `origin` to the last node.

    Prices must not exceed an arc's cost plus the price at its end, at the start; they never do
    later. An origin from which nothing leads to the last node gets the price INF.
    """
    sink = len(nodes)
    path = [origin]
    while (at := path[-1]) != sink:
        best, to = INF, -1
        for cost, node, _ in nodes[at]:
            if cost + prices[node] < best:
                best, to = cost + prices[node], node
        if prices[at] < best:
            prices[at] = best
            if len(path) > 1:
                path.pop()
            elif best >= INF:
                return
        elif to < 0:
            if len(path) == 1:
                return
            path.pop()
        else:
            path.append(to)


def sweep(codes: bytes, exits: tuple, origins: tuple = (0, 1, 2, 3)) -> tuple[list, tuple]:
    """Lattices and converged prices of all blocks, solved from the last to the first.

    `exits` prices the states after the last row. Returns also those before the first, of the wanted
    `origins`.
    """
    solved = []
    starts = range(0, len(codes), BLOCK_ROWS)
    for start in reversed(starts):
        low = min(exits)
        nodes = lattice(codes[start : start + BLOCK_ROWS], tuple(x - low if x < INF else INF for x in exits))
        prices = [0] * (len(nodes) + 1)
        wanted = origins if start == 0 else (0, 1, 2, 3)
        for state in wanted:
            auction(nodes, prices, state)
        solved.append((nodes, prices))
        exits = tuple(prices[s] + low if s in wanted and prices[s] < INF else INF for s in range(4))
    return solved[::-1], exits


def trace(solved: list, state: int) -> tuple[str, int]:
    """Letters of the first tight path from `state` before the first row, and its state at the end."""
    letters: list[str] = []
    for nodes, prices in solved:
        sink, path, tries, own, dead = len(nodes), [state], [0], [], set()
        while path[-1] != sink:
            at = path[-1]
            for k in range(tries[-1], len(nodes[at])):
                cost, node, letter = nodes[at][k]
                if prices[at] == cost + prices[node] and node not in dead:
                    tries[-1] = k + 1
                    path.append(node)
                    tries.append(0)
                    own.append(letter)
                    break
            else:
                dead.add(path.pop())
                tries.pop()
                own.pop()
        letters += own
        state = path[-2] & 3
    return "".join(letters), state


def solve(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    solved, exits = sweep(codes, TAIL, (0,))
    audit, state = trace(solved, 0)
    return exits[0] if codes else 0, audit + TAIL_AUDIT[state]


class Digest:
    """SHA-256 of the repaired rows, fed a part at a time."""

    def __init__(self) -> None:
        self.state, self.first, self.sha = 0, True, hashlib.sha256()

    def feed(self, audit: str, codes: bytes, rows: list[tuple[str, str]]) -> None:
        """`rows` has the role and text of every row of `codes` that need not be deleted."""
        given = iter(rows)
        faults = (code >> 2 for code in codes)
        for letter in audit:
            role = text = ""
            if letter != "I" and next(faults) not in (BLANK, REPEATED):
                role, text = next(given)
            if letter == "D":
                continue
            if letter == "K":
                self.state = NEXT[role[0]][self.state]
            else:
                self.state = 2 if self.state in NEXT["u"] else 3
                role = ROLES[self.state]
            self.sha.update((role + ":" + text if self.first else "\n" + role + ":" + text).encode())
            self.first = False


def _least(matrix: list[list[int]], exits: tuple) -> tuple:
    return tuple(min(INF, *(row[k] + exits[k] for k in range(4))) for row in matrix)


class _Part:
    """Rows of one conversation that lie side by side in a task."""

    def __init__(self, name: str, conv) -> None:
        self.name, self.conv = name, conv
        self.codes, self.rows, self.chars = bytearray(), [], 0
        self.low = self.high = None
        self.turns = 0

    def turn(self, turn: int | None) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1

    def add(self, code: int, role: str, text: str) -> None:
        self.codes.append(code)
        if code >> 2 not in (BLANK, REPEATED):
            self.rows.append((role, text))
            self.chars += len(text)

    def counts(self) -> list[int]:
        faults = [code >> 2 for code in self.codes]
        kinds = [code & 3 for code in self.codes]
        illegal = sum(pair not in LEGAL for pair in zip(kinds, kinds[1:], strict=False))
        return [faults.count(BLANK), faults.count(REPEATED), faults.count(CUT), illegal]


_LONGS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = [*((c, T.LongType()) for c in _LONGS), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
_PART = [
    ("part", T.LongType()), ("low", T.LongType()), ("high", T.LongType()), ("turns", T.LongType()),
    ("codes", T.BinaryType()), ("costs", T.ArrayType(T.LongType())),
    ("roles", T.ArrayType(T.StringType())), ("texts", T.ArrayType(T.StringType())),
]


def _schema(kind: T.DataType, *fields: tuple) -> tuple[T.StructType, pa.Schema]:
    found = T.StructType([T.StructField("name", T.StringType()), T.StructField("conv", kind), *(T.StructField(*f) for f in fields)])
    return found, pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in found.fields])


def _gaps(low, high, turns) -> int:
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


def _scan(schema: pa.Schema, part_rows: int, part_chars: int):
    """A row for every conversation that lies within a task, parts of the others."""

    def whole(part: _Part, known: dict) -> dict:
        codes = bytes(part.codes)
        if codes not in known:
            if len(known) >= _KNOWN:
                known.clear()
            known[codes] = solve(codes)
        cost, audit = known[codes]
        digest = Digest()
        digest.feed(audit, codes, part.rows)
        found = dict(zip(_LONGS, [_gaps(part.low, part.high, part.turns), *part.counts(), cost], strict=True))
        return found | {"name": part.name, "conv": part.conv, "audit": audit, "repaired_sha256": digest.sha.hexdigest()}

    def piece(part: _Part, number: int) -> dict:
        codes = bytes(part.codes)
        ends = [sweep(codes, tuple(0 if k == e else INF for k in range(4)))[1] for e in range(4)]
        found = dict(zip(["blank", "duplicate", "truncated", "illegal"], part.counts(), strict=True))
        return found | {
            "name": part.name, "conv": part.conv, "part": number, "low": part.low, "high": part.high,
            "turns": part.turns, "codes": codes, "costs": [ends[e][s] for s in range(4) for e in range(4)],
            "roles": [r for r, _ in part.rows], "texts": [t for _, t in part.rows],
        }

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        known: dict[bytes, tuple[int, str]] = {}
        out: list[dict] = []
        part, opened, chars, before = None, True, 0, None

        def close(ends: bool) -> None:
            nonlocal number, opened, chars
            if part is not None:
                if ends and not opened:
                    out.append(whole(part, known))
                else:
                    out.append(piece(part, base + number))
                    number += 1
                opened, chars = not ends, chars + part.chars

        for batch in batches:
            for name, conv, turn, role, text, copies, initial, fault, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None or part.name != name:
                    # The first conversation of a task may have begun in another one.
                    close(True)
                    part = _Part(name, conv)
                if copies:
                    part.turn(turn)
                for k in range(copies):
                    if len(part.codes) >= part_rows or part.chars >= part_chars:
                        close(False)
                        part = _Part(name, conv)
                        part.turn(turn)
                    code = fault if fault == BLANK else REPEATED if k or again else fault
                    part.add(4 * code + initial, role, text)
                if len(out) >= 1024 or chars >= part_chars:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, chars = [], 0
        close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return scan


def _fold(table: pa.Table) -> pa.Table:
    """Prices after each part of one conversation, from its last part back."""
    table = table.sort_by([("part", "descending")])
    exits, out = TAIL, []
    for costs in table["costs"].to_pylist():
        out.append(list(exits))
        exits = _least([costs[4 * s : 4 * s + 4] for s in range(4)], exits)
    return pa.table({"name": table["name"], "part": table["part"], "exits": pa.array(out, pa.list_(pa.int64()))})


def _join_parts(schema: pa.Schema):
    """Whole conversations from their parts in order; a task holds one part at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, digest, audits, last, low, high, turns, state = None, Digest(), [], None, None, None, 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            if found is not None:
                found["audit"] = "".join(audits) + TAIL_AUDIT[state]
                digest.feed(TAIL_AUDIT[state], b"", [])
                done = {"gaps": _gaps(low, high, turns), "repaired_sha256": digest.sha.hexdigest()}
                yield pa.RecordBatch.from_pylist([found | done], schema)

        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                codes, kinds = row["codes"], [x & 3 for x in row["codes"]]
                if found is None or found["name"] != row["name"]:
                    yield from close()
                    found = {"name": row["name"], "conv": row["conv"]} | dict.fromkeys(_LONGS, 0)
                    digest, audits, last, low, high, turns, state = Digest(), [], None, None, None, 0, 0
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    found[c] += row[c]
                if codes:
                    found["illegal"] += last is not None and (last, kinds[0]) not in LEGAL
                    last = kinds[-1]
                if row["low"] is not None:
                    turns += row["turns"] - (row["low"] == high)
                    low, high = row["low"] if low is None else low, row["high"]
                exits = tuple(row["exits"])
                solved, entry = sweep(codes, exits)
                found["cost"] += (entry[state] if codes else exits[state])
                audit, after = trace(solved, state)
                digest.feed(audit, codes, list(zip(row["roles"], row["texts"], strict=True)))
                found["cost"] -= exits[after]
                state = after
                audits.append(audit)
                if row["final"]:
                    found["cost"] += TAIL[state]
        yield from close()

    return scan


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, turn, role, text, copies) after the damage that the contract deals by checksum.

    `copies` is 0 for a dropped row and 2 for a repeated one.
    """

    def filled(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    deal = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    body = filled(text)
    return df.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.when(deal == 4, F.lit("user")).otherwise(filled(role)).alias("role"),
        F.when(deal == 1, F.lit("")).when(deal == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"),
        F.when(deal == 0, 0).when(deal == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(rows: DataFrame, part_rows: int = PART_ROWS, part_chars: int = PART_CHARS) -> DataFrame:
    """`(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)` of every conversation.

    `rows` has the columns of `damaged`, without nulls in role, text and copies; others are not read.
    Rows of a conversation are taken by turn, nulls first, then by role and text. Rows without a
    conversation are one of their own, whose `conv` is null. A role that is empty or of another initial
    than s, u and a cannot be kept. An empty table gives an empty one.

    Equal rows are counted before they move, and what repeats across turns is found by its digest. A
    conversation of any length is dealt to many tasks, whose parts hold `part_rows` rows or about
    `part_chars` characters. Its audit is one string and its checksum one pass, so a single task reads
    its parts in order at the end, one at a time, and holds the audit.
    """
    name = F.when(F.col("conv").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv").cast("string")))
    same = F.unhex(F.sha2(F.concat_ws(":", F.length("name"), "name", F.length("role"), "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(F.col("copies") == 0, SOUND).when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    )
    base = rows.select(name.alias("name"), "conv", "turn", "role", "text", "copies")
    first, again = fresh("first"), fresh("same")
    repeats = staged(
        base.where("copies > 0")
        .select(same.alias(again), place.alias("place"))
        .groupBy(again)
        .agg(F.min("place").alias(first), F.max("place").alias("last"))
        .where(F.col(first) != F.col("last"))
        .select(again, first),
        "repeats",
    )
    # Dropped rows only keep their conversation alive; they need no text of their own.
    kept = F.col("copies") > 0
    once = base.select(
        "name", "conv", F.when(kept, F.col("turn")).alias("turn"),
        F.when(kept, F.col("role")).otherwise("").alias("role"), F.when(kept, F.col("text")).otherwise("").alias("text"), "copies",
    ).groupBy("name", "conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    keyed = once.withColumn(again, same).join(sized(repeats, 96), again, "left")
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)) - 1
    ready = keyed.select(
        "name", "conv", "turn", "role", "text", "copies",
        F.when(F.col("role") == "", 3).otherwise(initial).cast("int").alias("initial"), fault.cast("int").alias("fault"),
        F.coalesce(place > F.col(first), F.lit(False)).alias("again"),
    )
    order = [F.col("name"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    kind = rows.schema["conv"].dataType
    schema, arrow = _schema(kind, *_RESULT, *_PART)
    # The cut points that Spark samples hold no long texts.
    short = F.length("role") <= _SHORT
    ranges = [*order[:2], F.left("role", F.lit(_SHORT)), F.when(short, F.left("text", F.lit(_SHORT))).otherwise("")]
    dealt = ready.repartitionByRange(*ranges).sortWithinPartitions(*order)
    found = staged(dealt.mapInArrow(_scan(arrow, part_rows, part_chars), schema), "repaired")
    names = [c for c, _ in _RESULT]
    parts = found.where("part is not null")
    ends = parts.groupBy("name").agg(F.max("part").alias("end"))
    exits = parts.select("name", "part", "costs").groupBy("name").applyInArrow(
        _fold, "name string, part long, exits array<long>"
    )
    wanted, wanted_arrow = _schema(kind, *_RESULT)
    placed = (
        parts.drop("gaps", "cost", "audit", "repaired_sha256", "costs")
        .join(exits, ["name", "part"])
        .join(ends, "name")
        .withColumn("final", F.col("part") == F.col("end"))
        .drop("end")
        .repartition("name")
        .sortWithinPartitions("name", "part")
    )
    joined = placed.mapInArrow(_join_parts(wanted_arrow), wanted)
    return found.where("part is null").select("conv", *names).unionByName(joined.select("conv", *names))


def repair_damaged(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **kw
) -> DataFrame:
    """`repair` of the rows of `df` after their damage, a row for every conversation it ever held."""
    return repair(damaged(df, conv, turn, role, text), **kw).withColumnRenamed("conv", conv)
