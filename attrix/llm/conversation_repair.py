"""Conversation structure repair by a grammar-compressed shortest-path search.

A row is a symbol of two facts: the initial of its role (s, u, a or another) and its first fault. Blank rows and rows whose
role and text came earlier must go; rows that stop without a sentence's end cost a penalty if they stay. The repaired
roles must read ``(s?(ua)+)?``, an automaton of four states, so a row is a 4 x 4 matrix over (cost, audit): what it costs
to come from one state to another by inserting turns before the row and then keeping, rerolling or deleting it, and the
letters of these edits. Matrices multiply by least cost, then least audit. That is sound: edits' letters fix their cost,
so of two equally dear audits over the same rows none begins the other, and appending the same letters keeps their order.

Sequences of symbols are compressed by Re-Pair, all distinct ones of a batch together. Each rule's matrix is made once,
bottom-up, from those of its two symbols, with audits as ropes that share their parts, and serves all conversations in
which the rule occurs.

Rows are range-partitioned by conversation and turn, so a conversation of any length is spread over tasks and read as a
stream; a partition's run of one conversation is cut into pieces of at most ``PIECE_ROWS`` rows. A piece leaves its task
as one matrix. The matrices of a conversation are multiplied in order in one task, without its texts: up to 11 letters a
row, as the audit itself is one string of a letter or more a row. The edits go back to the pieces' rows by joins.

Edge cases: a null role or text counts as one space; a null conversation id is a conversation; null turns come first and are
not counted in gaps; rows of equal turn are taken by role, then by the digest of their text, so repeated rows are neighbours
and all but the first are duplicates; an empty role is a role of another kind; a gap beyond a long is cut to the largest
long; an empty table gives empty results; other columns are ignored. Ropes are compared by 61-bit hashes of equal parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import release, shuffle_partitions, stored
from attrix.llm.re_pair import re_pair

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. A repaired conversation ends in the first or the last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads from each state.
KINDS = "sua-"
STEPS = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAULTS = BLANK, DUPLICATE, CUT = 1, 2, 3
#: Rows in a piece; symbols compressed together; bytes of text in a range partition.
PIECE_ROWS, BATCH_SYMBOLS, RANGE_BYTES = 1 << 12, 1 << 17, 32 << 20
SPACE = " \t\n\x0b\x0c\r"
_BASE, _MODULUS = 0x5DEECE66D1CE4E5B, (1 << 61) - 1


class Rope(NamedTuple):
    """A string as a leaf or as two ropes; ``power`` is the base to its length, for the hash of what follows."""

    length: int
    hash: int
    power: int
    text: str | None
    left: Rope | None = None
    right: Rope | None = None


def leaf(text: str) -> Rope:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c)) % _MODULUS
    return Rope(len(text), h, pow(_BASE, len(text), _MODULUS), text)


def joined(x: Rope, y: Rope) -> Rope:
    if not x.length or not y.length:
        return x if x.length else y
    return Rope(x.length + y.length, (x.hash * y.power + y.hash) % _MODULUS, x.power * y.power % _MODULUS, None, x, y)


def flat(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if x.text is None:
            todo += [x.right, x.left]
        else:
            out.append(x.text)
    return "".join(out)


def less(x: Rope, y: Rope) -> bool:
    """Whether x comes before y in ASCII order; equal parts are passed over by their hashes."""
    one, two = [x], [y]
    while one and two:
        a, b = one.pop(), two.pop()
        if a is b or a.length == b.length and a.hash == b.hash:
            continue
        if a.text is not None and b.text is not None:
            n = min(a.length, b.length)
            if a.text[:n] != b.text[:n]:
                return a.text[:n] < b.text[:n]
            if a.length > n:
                one.append(leaf(a.text[n:]))
            if b.length > n:
                two.append(leaf(b.text[n:]))
        elif b.text is not None or a.text is None and a.length >= b.length:
            one += [a.right, a.left]
            two.append(b)
        else:
            two += [b.right, b.left]
            one.append(a)
    return bool(two)


#: (from, to): (cost, audit); ways that do not exist are left out.
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def better(x: tuple[int, Rope], y: tuple[int, Rope] | None) -> bool:
    return y is None or x[0] < y[0] or x[0] == y[0] and less(x[1], y[1])


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, audit) in x.items():
        for j in range(4):
            if (k, j) in y:
                way = cost + y[k, j][0], joined(audit, y[k, j][1])
                if better(way, out.get((i, j))):
                    out[i, j] = way
    return out


def insertions() -> Matrix:
    """Inserting turns between two rows; going round costs and leads nowhere, so a state is passed once at most."""
    out: Matrix = {}
    for start in range(4):
        state, cost, audit = start, 0, ""
        while (start, state) not in out:
            out[start, state] = cost, leaf(audit)
            state, cost, audit = USER if state != USER else ASSISTANT, cost + INSERT, audit + "I"
    return out


def initial(role: str) -> str:
    """The role's initial if the automaton knows it, else ``-``."""
    return role[0] if role[:1] in STEPS else "-"


def symbol(kind: str, fault: int) -> int:
    """0: must go; else 1 to 8 for the role's initial and whether the text is cut off."""
    return 0 if fault in (BLANK, DUPLICATE) else 1 + 2 * KINDS.index(kind) + (fault == CUT)


def symbol_matrix(number: int) -> Matrix:
    """Turns inserted before a row, then what is done with the row."""
    out: Matrix = {(i, i): (DELETE, leaf("D")) for i in range(4)}
    if number:
        kind, cut = divmod(number - 1, 2)
        for letter, cost, initials in (("R", REROLE, "ua"), ("K", KEEP, KINDS[kind])):
            for initial in initials:
                for i, j in STEPS.get(initial, {}).items():
                    way = cost + cut * TRUNCATED, leaf(letter)
                    if better(way, out.get((i, j))):
                        out[i, j] = way
    return product(insertions(), out)


SYMBOLS = 9


def sequence_matrices(sequences: list[tuple[int, ...]]) -> list[Matrix]:
    """The matrix of every sequence of symbols, through one grammar for all of them."""
    rules, short = re_pair(sequences, SYMBOLS)
    known = [symbol_matrix(k) for k in range(SYMBOLS)]
    for a, b in rules:
        known.append(product(known[a], known[b]))
    out = []
    for s in short:
        matrix = known[s[0]]
        for k in s[1:]:
            matrix = product(matrix, known[k])
        out.append(matrix)
    return out


def edits(audit: str, state: int, kinds: str) -> list[tuple[str, int | None, str | None]]:
    """(letter, row, new role) of an audit over rows of these initials that starts in a state.

    Insertions have no row; only insertions and rerolled rows have a new role.
    """
    out, row = [], 0
    for letter in audit:
        at = None if letter == "I" else row
        if letter in "IR":
            state = USER if state != USER else ASSISTANT
        elif letter == "K":
            state = STEPS[kinds[row]][state]
        out.append((letter, at, ROLE[state] if letter in "IR" else None))
        row += letter != "I"
    return out


_PIECE = ("piece struct<kinds: string, blank: long, duplicate: long, truncated: long, illegal: long, first: string, last: string, "
          "low: long, high: long, turns: long, ways: array<struct<i: int, j: int, cost: long, audit: string>>>")


class _Piece:
    """What a run of rows of one conversation adds up to."""

    def __init__(self, conv, chunk: int):
        self.conv, self.chunk = conv, chunk
        self.kinds, self.symbols, self.faults = [], [], [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        kind = initial(role)
        if self.kinds:
            self.illegal += illegal(self.last, role[:1])
        else:
            self.first = role[:1]
        self.last = role[:1]
        self.kinds.append(kind)
        self.symbols.append(symbol(kind, fault))
        self.faults[fault] += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def value(self, matrix: Matrix) -> dict:
        ways = [{"i": i, "j": j, "cost": cost, "audit": flat(audit)} for (i, j), (cost, audit) in matrix.items()]
        return {"kinds": "".join(self.kinds), "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT],
                "illegal": self.illegal, "first": self.first, "last": self.last, "low": self.low, "high": self.high, "turns": self.turns, "ways": ways}


def illegal(one: str, two: str) -> bool:
    return one + two not in ("su", "ua", "au")


def _rows_and_pieces(schema: pa.Schema):
    """Over the sorted rows of a range partition: the rows with their place and fault, and the pieces."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece, chunk, marked, waiting, held = None, -1, None, [], 0

        def done() -> pa.RecordBatch:
            distinct = list(dict.fromkeys(tuple(p.symbols) for p in waiting))
            matrix = dict(zip(distinct, sequence_matrices(distinct)))
            out = [{"conv_id": p.conv, "part": part, "chunk": p.chunk, "piece": p.value(matrix[tuple(p.symbols)])} for p in waiting]
            waiting.clear()
            return pa.RecordBatch.from_pylist(out, schema)

        for batch in batches:
            take, chunks, places, faults = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "row", "marked", "blank", "truncated")]
            for at, (conv, turn, role, row, mark, blank, truncated) in enumerate(zip(*columns)):
                if mark:  # what follows is this row itself, a copy of an earlier one
                    marked = row
                    continue
                if piece is None or piece.conv != conv or len(piece.kinds) == PIECE_ROWS:
                    if piece is not None:
                        waiting.append(piece)
                        held += len(piece.kinds)
                    chunk += 1
                    piece = _Piece(conv, chunk)
                fault = BLANK if blank else DUPLICATE if marked == row else CUT if truncated else 0
                take.append(at)
                chunks.append(chunk)
                places.append(len(piece.kinds))
                faults.append(fault)
                piece.add(turn, role, fault)
            if take:
                some = batch.take(pa.array(take, pa.int32()))
                rows = {"conv_id": some.column("conv_id"), "part": pa.array([part] * len(take), pa.int32()), "chunk": pa.array(chunks, pa.int64()),
                        "place": pa.array(places, pa.int32()), "fault": pa.array(faults, pa.int32()), "turn": some.column("turn"),
                        "role": some.column("role"), "text": some.column("text"), "piece": pa.nulls(len(take), schema.field("piece").type)}
                yield pa.RecordBatch.from_arrays([rows[f.name].cast(f.type) if rows[f.name].type != f.type else rows[f.name] for f in schema], schema=schema)
            if held >= BATCH_SYMBOLS:
                yield done()
                held = 0
        if piece is not None:
            waiting.append(piece)
            yield done()

    return scan


def _combined(schema: pa.Schema):
    """Over the pieces sorted by conversation: its totals in the row of its last piece, and the edits of every piece."""

    def whole(conv, pieces: list[dict]) -> list[dict]:
        vectors: list[Matrix] = [{(EMPTY, EMPTY): (0, leaf(""))}]
        back: list[dict[int, tuple[int, str]]] = []
        for p in pieces:
            from_to, now = {}, {}
            for w in p["ways"]:
                if (EMPTY, w["i"]) in vectors[-1]:
                    cost, audit = vectors[-1][EMPTY, w["i"]]
                    way = cost + w["cost"], joined(audit, leaf(w["audit"]))
                    if better(way, now.get((EMPTY, w["j"]))):
                        now[EMPTY, w["j"]], from_to[w["j"]] = way, (w["i"], w["audit"])
            vectors.append(now)
            back.append(from_to)
        ends = {}
        for (i, j), (cost, audit) in insertions().items():
            if (EMPTY, i) in vectors[-1] and j in (EMPTY, ASSISTANT):
                way = vectors[-1][EMPTY, i][0] + cost, joined(vectors[-1][EMPTY, i][1], audit)
                if better(way, ends.get(j) and ends[j][0]):
                    ends[j] = way, i, flat(audit)
        (cost, audit), state, tail = ends.pop(EMPTY)
        for way, i, letters in ends.values():
            if better(way, (cost, audit)):
                (cost, audit), state, tail = way, i, letters
        out = []
        for p, from_to in zip(reversed(pieces), reversed(back)):
            start, letters = from_to[state]
            done = edits(letters + (tail if not out else ""), start, p["kinds"])
            out.append({"conv_id": conv, "part": p["part"], "chunk": p["chunk"],
                        "edits": [{"item": k, "edit": e, "place": at, "role": role} for k, (e, at, role) in enumerate(done) if e != "D"]})
            state = start
        total = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        for one, two in zip(pieces, pieces[1:]):
            total["illegal"] += illegal(one["last"], two["first"])
            total["turns"] -= one["high"] is not None and one["high"] == two["low"]
        low = min((p["low"] for p in pieces if p["low"] is not None), default=None)
        high = max((p["high"] for p in pieces if p["high"] is not None), default=None)
        gaps = 0 if low is None else min(high - low + 1 - total.pop("turns"), (1 << 63) - 1)
        out[0]["total"] = {k: total[k] for k in FAULT_NAMES} | {"gaps": gaps, "illegal": total["illegal"], "cost": cost, "audit": flat(audit)}
        return out

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({**r["piece"], "conv": r["conv_id"], "part": r["part"], "chunk": r["chunk"]} for b in batches for r in b.to_pylist())
        for conv, pieces in groupby(rows, key=lambda r: r["conv"]):
            yield pa.RecordBatch.from_pylist(whole(conv, list(pieces)), schema)

    return combine


FAULT_NAMES = ("blank", "duplicate", "truncated")


def ends_cut(text: Column) -> tuple[Column, Column]:
    """(blank, truncated) of a text: without other characters than white space; last such character no sentence's end."""
    bare = F.rtrim(text, F.lit(SPACE))
    return bare == "", ~F.substring(bare, -1, 1).isin(".", "!", "?")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, rows).

    conversations: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with rows.
    rows: (conv_id, part, chunk, item, edit, turn, role, text) of every repaired conversation, in the order of part, chunk, item;
    ``edit`` is K, R or I; inserted rows have no turn and an empty text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = turns.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    blank, truncated = ends_cut(text)
    # Stored with a number for every row, so that all passes below see the same rows.
    base = stored(turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                               F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"),
                               F.monotonically_increasing_id().alias("row"), F.lit(False).alias("marked"), blank.alias("blank"),
                               truncated.alias("truncated"), text.alias("text")), "turns")
    # Role and text that came earlier: only keys with several rows, without texts.
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "row")
    first = (base.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
             .agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("c", "r", "d", "first.row"))
    again = base.drop("text").join(first.withColumnRenamed("row", "first_row"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                                   & (F.col("digest") == F.col("d"))).where("row != first_row")
    marks = again.select(*[c for c in base.columns if c not in ("marked", "text")], F.lit(True).alias("marked"), F.lit(None).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "digest", "row"]
    size = base.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    schema = f"conv_id {base.schema['conv_id'].dataType.simpleString()}, part int, chunk long, place int, fault int, turn long, role string, text string, {_PIECE}"
    both = stored(base.unionByName(marks), "turns")
    release(base)
    ranged = both.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.desc("marked"))
    empty = spark.createDataFrame([], schema)
    table = stored(ranged.mapInArrow(_rows_and_pieces(to_arrow_schema(empty.schema)), schema), "pieces")
    release(both)
    pieces = table.where("piece is not null").select("conv_id", "part", "chunk", "piece")
    result = ("conv_id " + empty.schema["conv_id"].dataType.simpleString() + ", part int, chunk long, edits array<struct<item: int, edit: string, place: int, role: string>>, "
              "total struct<gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>")
    solved = stored(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(
        _combined(to_arrow_schema(spark.createDataFrame([], result).schema)), result), "edits")
    items = solved.select("conv_id", "part", "chunk", F.explode("edits").alias("e")).select("conv_id", "part", "chunk", "e.item", "e.edit", "e.place", F.col("e.role").alias("new_role"))
    kept = table.where("piece is null and fault not in (1, 2)").select("part", "chunk", "place", "turn", "role", "text")
    rows = items.join(kept, ["part", "chunk", "place"], "left").select(
        "conv_id", "part", "chunk", "item", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return solved.where("total is not null").select("conv_id", "total.*"), rows


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the hash of conversation and turn: rows dropped, emptied, without sentences' ends, doubled, or by the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = turns.select("conv_id", "turn", kind.alias("kind"), blank("role").alias("role"), blank("text").alias("text")).where("kind != 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash over ``role:text`` of all rows of a conversation in order, joined by newlines; rows pass as a stream."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, seen = None, None, False
        for batch in batches:
            ids, out = [], []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not seen or conv_id != key:
                    if seen:
                        ids.append(key)
                        out.append(sha.hexdigest())
                    key, sha, seen = conv_id, hashlib.sha256(), True
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("conv_id").type), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
            kind = batch.column("conv_id").type
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk", "item").select("conv_id", "role", "text").mapInArrow(
        scan, f"conv_id {conv}, repaired_sha256 string")


def repair_report(turns: DataFrame) -> DataFrame:
    """The report on every conversation of (conv_id, turn, role, text) after ``damaged`` rows are repaired."""
    conversations, rows = repair(damaged(turns))
    every = turns.select(F.col("conv_id").alias("c")).distinct()
    found = conversations.withColumnRenamed("conv_id", "c1")
    hashed = digests(rows).withColumnRenamed("conv_id", "c2")
    joined_up = every.join(found, F.col("c").eqNullSafe(F.col("c1")), "left").join(hashed, F.col("c").eqNullSafe(F.col("c2")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined_up.select(F.col("c").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
