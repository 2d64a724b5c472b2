"""Conversation structure repair over a suffix-shared automaton.

A conversation is a string of signatures, one letter a row: its role initial and whether
it may stay (`x` must go: blank or a duplicate; a capital letter is a truncated row).
Read from the end, equal suffixes of all conversations are one node of the minimised
automaton, as a suffix has one continuation. Signatures are sorted by their reversed
letters, so a task meets every node once: it holds the nodes of the current path and
keeps those that the next string shares. A node holds, for each state of the grammar
`(s?(ua)+)?`, its cost-to-go and the cheapest audit from there, as a letter and a link to
the audit of its successor. Edits of one state begin with different letters, so the
ASCII-least of equally cheap audits is decided by the first letter.

Long conversations are cut into pieces of `PIECE` letters. A piece becomes a 4 x 4 table
of costs; the tables, chained from the last piece, give the costs that each piece ends
in, which take the place of the end of the string. No task holds a conversation's rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebin.llm.shared import settle

#: Letters of a conversation that one piece holds.
PIECE = 4096
#: Leading characters by which rows of one turn and role are ordered, before a hash of the text.
HEAD = 64
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STATES = range(4)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after the user or assistant row that an edit makes; the grammar leaves one choice.
MADE = (2, 2, 3, 2)
NEVER = 1 << 60
END = (0, NEVER, NEVER, 0)
LEGAL = ["su", "ua", "au"]
ORDER = ["turn", "role", "head", "digest"]


class Repair(NamedTuple):
    #: `conv`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`, `audit` of every conversation with rows.
    summary: DataFrame
    #: `conv`, `place`, `edit`, `turn`, `role`, `text`: rows after repair, in order within a partition.
    rows: DataFrame


def damage(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Reproducible damage by a checksum of conversation and turn; nulls in text count as one space.

    Of twenty classes, 0 drops a row, 1 empties its text, 2 removes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes it a user's.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in (conv_id, ":", turn)])
    hit = F.crc32(key.cast("binary")) % 20
    words = F.coalesce(text, F.lit(" "))
    words = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words)
    who = F.when(hit == 4, "user").otherwise(F.coalesce(role, F.lit(" ")))
    times = F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))
    return df.filter(hit != 0).select(F.col(conv_id), F.col(turn), who.alias(role), words.alias(text), F.explode(times).alias("__time")).drop("__time")


def _solved(cost: list[int], letter: list[str], to: list) -> tuple[list, list, list]:
    """Inserts before a row: cheaper, or as cheap and with a smaller letter."""
    changed = True
    while changed:
        changed = False
        for q in STATES:
            way = INSERT + cost[MADE[q]]
            if way < NEVER and (way, "I") < (cost[q], letter[q]):
                cost[q], letter[q], to[q], changed = way, "I", None, True
    return cost, letter, to


def _node(symbol: str, after: list[int]) -> tuple[list, list, list]:
    """Costs, letters and successor states of one node, from the costs of the next."""
    cost, letter, to = [NEVER] * 4, [""] * 4, [None] * 4
    for q in STATES:
        ways = [(DELETE + after[q], "D", q)]
        if symbol != "x":
            more = CUT_OFF if symbol.isupper() else 0
            if (q, symbol.lower()) in KEPT:
                ways.append((more + after[KEPT[q, symbol.lower()]], "K", KEPT[q, symbol.lower()]))
            ways.append((REROLE + more + after[MADE[q]], "R", MADE[q]))
        cost[q], letter[q], to[q] = min(ways)
    return _solved(cost, letter, to)


def _audits(cost: list, letter: list, to: list, after: list) -> list:
    """Cells (letter, rest) of the cheapest audit for each state; `after` are those of the next node."""
    out: list = [None] * 4

    def cell(q: int):
        if out[q] is None:
            out[q] = (letter[q], cell(MADE[q]) if to[q] is None else after[to[q]])
        return out[q]

    return [cell(q) if cost[q] < NEVER else None for q in STATES]


class Automaton:
    """Nodes along one path from the end; sorted strings share them."""

    def __init__(self, ends: tuple[int, ...]):
        """`ends`: the cost of stopping in each state; inserts at the end belong to `END` only."""
        cost, cells = list(ends), [("", q) for q in STATES]
        if ends == END:
            cost = [0, 2 * INSERT, INSERT, 0]
            cells[2] = ("I", cells[3])
            cells[1] = ("I", cells[2])
        self.symbols: list[str] = []
        self.nodes = [(cost, cells)]
        self.made = 0

    def read(self, backwards: str) -> tuple[list[int], list]:
        """Costs and audits of the string with these letters from its end."""
        same = 0
        for a, b in zip(self.symbols, backwards):
            if a != b:
                break
            same += 1
        del self.symbols[same:], self.nodes[same + 1 :]
        for symbol in backwards[same:]:
            after, cells = self.nodes[-1]
            cost, letter, to = _node(symbol, after)
            self.nodes.append((cost, _audits(cost, letter, to, cells)))
            self.symbols.append(symbol)
            self.made += 1
        return self.nodes[-1]


def unrolled(cell) -> tuple[str, int]:
    """Letters of an audit and the state it stops in."""
    letters = []
    while cell[0]:
        letters.append(cell[0])
        cell = cell[1]
    return "".join(letters), cell[1]


def transfer(signature: str) -> list[int]:
    """16 costs from state to state over a piece; inserts after it belong to the next."""
    out = []
    for stop in STATES:
        ends = tuple(0 if q == stop else NEVER for q in STATES)
        cost = list(ends)
        for symbol in reversed(signature):
            cost = _node(symbol, cost)[0]
        out.append([min(c, NEVER) for c in cost])
    return [out[stop][start] for start in STATES for stop in STATES]


def _light(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: order, initial, `n` of them, and the fault of the first."""
    words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    light = rows.select("conv", "turn", "role", F.substring("text", 1, HEAD).alias("head"), digest.alias("digest"), (~words).alias("blank"), cut.alias("cut"))
    light = light.groupBy("conv", *ORDER, "blank", "cut").agg(F.count("*").alias("n"))
    seen = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = light.groupBy("conv", "digest").agg(F.count("*").alias("turns"), F.min(seen).alias("first")).filter("turns > 1")
    again = again.select(F.col("conv").alias("c"), F.col("digest").alias("d"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("more"))
    both = light.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(F.col("more") & ~F.col("turn").eqNullSafe(F.col("first_turn")), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    return both.select("conv", *ORDER, "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _pieces(light: DataFrame, size: int) -> DataFrame:
    """Signatures of conversations in order, cut into pieces: `conv`, `part`, `seq`, `sig`,
    first and last initial, and the illegal neighbours within."""
    fields = {f.name: f for f in light.schema.fields}
    schema = T.StructType([fields["conv"], *[T.StructField(c, fields[c].dataType) for c in ORDER]])
    for name in ("part", "seq"):
        schema.add(name, "long")
    for name in ("sig", "initial", "final"):
        schema.add(name, "string")
    schema.add("illegal", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, done, piece = TaskContext.get().partitionId(), 0, [], None
        for batch in batches:
            for conv, *order, n, initial, fault in zip(*[c.to_pylist() for c in batch.columns]):
                symbol = initial if initial in ("s", "u", "a") else "o"
                symbol = "x" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol
                while n:
                    if piece and (piece["conv"] != conv or len(piece["sig"]) >= size):
                        done.append(piece)
                        piece = None
                    if piece is None:
                        seq += 1
                        piece = {"conv": conv, **dict(zip(ORDER, order)), "part": part, "seq": seq, "sig": "", "initial": initial, "final": None, "illegal": 0}
                    if piece["final"] is not None:
                        piece["illegal"] += piece["final"] + initial not in LEGAL
                    room = min(n, size - len(piece["sig"]))
                    if symbol != "x":
                        room = 1
                    piece["illegal"] += room - 1
                    piece["sig"] += symbol * room
                    piece["final"], symbol, n = initial, "x", n - room
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                    done = []
        done += [piece] if piece else []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    ordered = light.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    return ordered.select("conv", *ORDER, "n", "initial", "fault").mapInArrow(run, schema)


def _mapped(df: DataFrame, keep: list[str], added: str, rows_of) -> DataFrame:
    """Rows of `keep` columns and the columns that `rows_of` makes from the others."""
    schema = T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(added).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                kept = {c: row[c] for c in keep}
                out += [kept | made for made in rows_of(row)]
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _chained(row: dict) -> Iterator[dict]:
    """What each piece of a conversation ends in, from the last: costs less their smallest."""
    ends, taken = END, 0
    for piece in reversed(row["pieces"]):
        yield {"part": piece["part"], "seq": piece["seq"], "ends": list(ends), "taken": taken}
        if ends == END:
            ends = tuple(Automaton(END).nodes[0][0])
        costs = [min(piece["costs"][4 * q + r] + ends[r] for r in STATES) for q in STATES]
        costs = _solved(costs, ["K"] * 4, list(STATES))[0]
        least = min(costs)
        ends, taken = tuple(min(c - least, NEVER) for c in costs), taken + least


def _entered(row: dict) -> Iterator[dict]:
    """The state in which each piece begins."""
    state = 0
    for piece in row["pieces"]:
        yield {"part": piece["part"], "seq": piece["seq"], "entry": state}
        state = piece["stops"][state]


def _solutions(wanted: DataFrame) -> DataFrame:
    """`sig`, `ends` with `costs`, `audits` and `stops` for each state to begin in."""
    schema = T.StructType([*wanted.schema.fields, *T.StructType.fromDDL("costs array<long>, audits array<string>, stops array<int>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = None, None
        for batch in batches:
            out, held = [], 0
            for sig, ends in zip(*[c.to_pylist() for c in batch.columns]):
                if paths[0] != ends:
                    paths = ends, Automaton(tuple(ends))
                costs, cells = paths[1].read(sig[::-1])
                found = [unrolled(c) if c else (None, None) for c in cells]
                audits, stops = zip(*found)
                out.append({"sig": sig, "ends": ends, "costs": costs, "audits": audits, "stops": stops})
                held += 4 * len(sig) + 64
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    by = [F.col("ends"), F.reverse("sig")]
    return wanted.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _edits(pieces: DataFrame) -> DataFrame:
    """The pieces with `audit` and, for the first of a conversation, `cost`."""
    same = ["conv", "part", "seq"]

    def keyed(df: DataFrame, name: str) -> tuple[DataFrame, Column]:
        right = df.withColumnsRenamed({c: f"{name}_{c}" for c in same})
        return right, F.col("conv").eqNullSafe(F.col(f"{name}_conv")) & (F.col("part") == F.col(f"{name}_part")) & (F.col("seq") == F.col(f"{name}_seq"))

    def of_conversation(rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seq", *more))).alias("pieces"))

    counted = pieces.groupBy("conv").agg(F.count("*").alias("pieces")).filter("pieces > 1").select(F.col("conv").alias("long_conv"))
    long = pieces.join(counted, F.col("conv").eqNullSafe(F.col("long_conv")), "left_semi").select(*same, "sig")
    tables = _mapped(long.select("sig").distinct(), ["sig"], "costs array<long>", lambda row: [{"costs": transfer(row["sig"])}])
    chain = _mapped(of_conversation(long.join(tables, "sig"), "costs"), ["conv"], "part long, seq long, ends array<long>, taken long", _chained)
    right, on = keyed(settle(chain), "x")
    end = F.lit(list(END)).cast("array<long>")
    placed = pieces.join(right, on, "left").select(*pieces.columns, F.coalesce("ends", end).alias("ends"), F.coalesce("taken", F.lit(0)).alias("taken"), F.col("x_seq").isNotNull().alias("many"))
    solved = _solutions(placed.select("sig", "ends").distinct())
    found = settle(placed.join(solved, ["sig", "ends"]))
    entry = _mapped(of_conversation(found.filter("many"), "stops"), ["conv"], "part long, seq long, entry int", _entered)
    right, on = keyed(entry, "y")
    state = F.coalesce("entry", F.lit(0))
    cost = (F.get("costs", state) + F.col("taken")).alias("cost")
    return found.join(right, on, "left").select(*pieces.columns, cost, F.get("audits", state).alias("audit"))


def _repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows and audits in one sorted stream: a piece's audit comes just before its first row."""
    head = F.substring("text", 1, HEAD)
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    none = F.lit(None)
    texts = rows.select("conv", "turn", "role", head.alias("head"), digest.alias("digest"), F.lit(1).alias("kind"), none.cast("long").alias("part"), none.cast("long").alias("seq"), "text")
    stream = texts.unionByName(edits.select("conv", *ORDER, F.lit(0).alias("kind"), "part", "seq", F.col("audit").alias("text")))
    ordered = stream.repartition("conv").sortWithinPartitions("conv", *ORDER, "kind", "part", "seq")
    conv, turn = rows.schema["conv"], rows.schema["turn"]
    schema = T.StructType([conv, T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", turn.dataType), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: deque[str] = deque()
        audit, at, place, state, last, held, out = "", 0, 0, 0, object(), 0, []

        def put(edit: str, turn, role: str, text: str) -> None:
            nonlocal place, state, held
            place += 1
            state = KEPT[state, role[0]] if edit == "K" else MADE[state]
            made = role if edit == "K" else "user" if state == 2 else "assistant"
            out.append({"conv": last, "place": place, "edit": edit, "turn": turn, "role": made, "text": text})
            held += len(text) + 64

        def inserts() -> None:
            nonlocal audit, at
            while True:
                if at == len(audit):
                    if not pending:
                        return
                    audit, at = pending.popleft(), 0
                elif audit[at] == "I":
                    put("I", None, "", "")
                    at += 1
                else:
                    return

        for batch in batches:
            for conv, turn, role, kind, text in zip(*[c.to_pylist() for c in batch.columns]):
                if conv != last:
                    inserts()
                    audit, at, place, state, last = "", 0, 0, 0, conv
                    pending.clear()
                if kind == 0:
                    pending.append(text)
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(edit, turn, role, text)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out.clear()
                    held = 0
        inserts()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ordered.select("conv", "turn", "role", "kind", "text").mapInArrow(run, schema)


def repair(df: DataFrame, conv_id: str, turn: str, role: str, text: str, size: int = PIECE) -> Repair:
    """The cheapest edits that make each conversation's role initials match `(s?(ua)+)?`.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the first 64
    characters and a hash of the text. Null roles and texts are one space; a null id is a
    conversation of its own. The first fault of a row counts: blank, a duplicate of an
    earlier row's role and text, or cut off before a full stop, exclamation or question
    mark. Keeping is free, a new role costs 3, deleting 4, a new empty row 3, and a cut-off
    row that stays 3; blank rows and duplicates must go. Of equally cheap audits the
    ASCII-least is taken. An empty table gives empty tables; other columns play no part.
    A single conversation's repaired rows pass through one task as a sorted stream.
    """
    rows = df.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    light = settle(_light(rows))
    first = F.col("fault")
    again = F.when(first == "blank", 0).when(first == "duplicate", F.col("n")).otherwise(F.col("n") - 1)
    faults = light.groupBy("conv").agg(
        F.sum(F.when(first == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(again).alias("duplicate"),
        F.sum((first == "truncated").cast("long")).alias("truncated"),
    )
    edits = settle(_edits(settle(_pieces(light, size))))
    part = F.struct("part", "seq", "initial", "final", "cost", "audit")
    joined = edits.groupBy("conv").agg(F.sort_array(F.collect_list(part)).alias("p"), F.sum("illegal").alias("within"))
    joints = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: (~F.concat(F.get("p", i - 1)["final"], F.get("p", i)["initial"]).isin(LEGAL)).cast("long"))
    between = F.when(F.size("p") > 1, F.aggregate(joints, F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(F.lit(0))
    summary = joined.select(
        F.col("conv").alias("s"), (F.col("within") + between).alias("illegal"), F.get("p", F.lit(0))["cost"].alias("cost"), F.array_join(F.col("p.audit"), "").alias("audit")
    )
    summary = faults.join(summary, F.col("conv").eqNullSafe(F.col("s"))).drop("s")
    return Repair(summary, _repaired(rows, edits))


def turn_gaps(df: DataFrame, conv_id: str, turn: str) -> DataFrame:
    """`conv` and `gaps`: whole numbers between the smallest and largest turn that no row has."""
    turns = df.groupBy(F.col(conv_id).alias("conv"), F.col(turn).alias("turn")).count()
    wide = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv").agg(F.coalesce(wide, F.lit(0)).cast("long").alias("gaps"))


def text_hashes(rows: DataFrame) -> DataFrame:
    """`conv` and `repaired_sha256` of `role:text` lines, from the ordered stream of repaired rows."""
    schema = T.StructType([rows.schema["conv"], T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, out = None, None, []
        for batch in batches:
            for conv, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if digest is None or conv != last:
                    if digest:
                        out.append({"conv": last, "repaired_sha256": digest.hexdigest()})
                    last, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if digest:
            out.append({"conv": last, "repaired_sha256": digest.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select("conv", "role", "text").mapInArrow(run, schema)
