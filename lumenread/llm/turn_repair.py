"""Cheapest repair of conversations to the form (s?(ua)+)?, by lazy weighted determinisation.

Keeping a row costs nothing, giving it another role 3, deleting it 4, a new empty row 3; a row cut
off in its sentence costs 3 more unless it is deleted; blank rows and repeats have to go. Which of
the four states of the form (START, SYSTEM, USER, ASSISTANT: the last role written) is cheapest
depends on what is left of the conversation, so a conversation is scanned from its last row: for
each row there is a vector of what the rest costs from each state. Less its minimum, such a vector
is a state of a deterministic automaton (no two entries differ by more than 7: two insertions or a
deletion and an insertion reach any state's continuation from any other), and a row's effect is
only its first letter and whether it may stay. So a table of (vector, row kind), filled as cases
turn up, takes the scan through a conversation with one lookup a row and gives its cost. The trace
then goes back over the rows, from the first, along tight arcs (what an edit costs and what is
left add up to the vector's entry), and takes the least letter where several are: D, I, K, R.
A letter decides the next state, so the audit is the least of all cheapest ones.

Rows are dealt by conversation once. Repeats are found by a window over the same partitioning; the
scan reads a partition's rows from the last to the first and the trace from the first to the last,
both sorted by Spark (which spills) and streamed: neither holds more than a batch of rows. A
conversation's rows pass through one task, as its result is one audit and one digest of all its
text; what is kept of them there is a state and sums.

Defined results: null role and text are one space, and a null turn comes first. Rows of equal turn
are ordered by role and text. A null conv_id is a conversation like any other. A role's first
letter decides what it is; letters other than s, u and a fit nowhere. Repeated rows repeat a turn
and count as duplicates. Empty tables have no result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

START, SYSTEM, USER, ASSISTANT = range(4)
#: What a state lets follow: first letter of a role and the state after it.
ARCS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (START, ASSISTANT)
#: Roles that edits write.
WRITTEN = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Kinds of rows: letter, cut off or not; GONE has to be deleted.
LETTERS = "sua"
GONE = 8
#: Faults by number, in the order in which they count.
FAULTS = ("", "blank", "duplicate", "truncated")
#: Costs are never so large.
NEVER = 1 << 20
WHITE = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def kind_of(role: str, fault: int) -> int:
    """The number of a row's kind."""
    if fault in (1, 2):
        return GONE
    at = LETTERS.find(role[:1]) if role else -1
    return (at if at >= 0 else 3) + 4 * (fault == 3)


class Automaton:
    """Determinised vectors of costs, their transitions and the trace's arcs, made when first asked for."""

    def __init__(self) -> None:
        self.end, offset = self.normal([0 if q in ENDS else NEVER for q in range(4)])
        assert offset == 0
        self.moves: dict[tuple[Vector, int], tuple[Vector, int]] = {}
        self.arcs: dict[tuple[Vector, int, int], tuple[tuple[tuple[str, str], ...], int]] = {}

    @staticmethod
    def normal(costs: list[int]) -> tuple[Vector, int]:
        """A vector in which insertions are used where they pay, less its minimum; and the minimum."""
        for _ in range(3):  # at most two insertions in a row pay
            costs = [min([costs[q], *(INSERT + costs[to] for letter, to in ARCS[q].items() if letter in WRITTEN)]) for q in range(4)]
        least = min(costs)
        return tuple(c - least for c in costs), least

    @staticmethod
    def edits(kind: int, q: int) -> Iterator[tuple[str, str, int, int]]:
        """The edits that read a row of a kind in state q: letter, role written, cost, next state; the least letter first."""
        yield "D", "", DELETE, q
        if kind == GONE:
            return
        more, letter = CUT_OFF * (kind >= 4), (LETTERS + "-")[kind % 4]
        if letter in ARCS[q]:
            yield "K", letter, more, ARCS[q][letter]
        for other, to in ARCS[q].items():
            if other in WRITTEN and other != letter:
                yield "R", other, more + REROLE, to

    def move(self, after: Vector, kind: int) -> tuple[Vector, int]:
        """The vector before a row by that after it, and what the minimum grows by."""
        if (known := self.moves.get((after, kind))) is None:
            known = self.moves[after, kind] = self.normal([min(cost + after[to] for _, _, cost, to in self.edits(kind, q)) for q in range(4)])
        return known

    def arc(self, after: Vector, kind: int, q: int) -> tuple[tuple[tuple[str, str], ...], int]:
        """The tight edits up to and with the one that reads the row, and the state after them."""
        if (known := self.arcs.get((after, kind, q))) is None:
            before, offset = self.move(after, kind)
            taken, at = [], q
            while True:
                left = before[at] + offset
                tight = [(letter, role, to) for letter, role, cost, to in self.edits(kind, at) if cost + after[to] == left]
                tight += [("I", letter, to) for letter, to in ARCS[at].items() if letter in WRITTEN and INSERT + before[to] == before[at]]
                letter, role, at = min(tight)
                taken.append((letter, role))
                if letter != "I":
                    break
            known = self.arcs[after, kind, q] = tuple(taken), at
        return known

    def last(self, q: int) -> str:
        """Letters of the roles inserted after the last row."""
        out = ""
        while q not in ENDS:
            letter, q = next((a, to) for a, to in ARCS[q].items() if a in WRITTEN and INSERT + self.end[to] == self.end[q])
            out += letter
        return out


def audit(rows: list[tuple[str, int]]) -> tuple[int, list[tuple[str, str]]]:
    """Cost and edits (letter, first letter of the role) of one conversation's rows (role, fault)."""
    machine = Automaton()
    after, cost = [machine.end], 0
    for role, fault in reversed(rows):
        vector, more = machine.move(after[-1], kind_of(role, fault))
        after.append(vector)
        cost += more
    cost += after[-1][START]
    found, q = [], START
    for (role, fault), vector in zip(rows, reversed(after[:-1]), strict=True):
        taken, q = machine.arc(vector, kind_of(role, fault), q)
        found += taken
    return cost, found + [("I", x) for x in machine.last(q)]


def _packed(v: Vector) -> int:
    return v[0] | v[1] << 3 | v[2] << 6 | v[3] << 9


def _unpacked(n: int) -> Vector:
    return n & 7, n >> 3 & 7, n >> 6 & 7, n >> 9 & 7


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from each conversation's last to its first, with the vector after the row, the cost from START before it and the place from the end."""
    machine = Automaton()
    of, vector, cost, nth = object(), machine.end, 0, 0
    for batch in batches:
        afters, costs, places = [], [], []
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "live", "role", "fault"))
        for conv, live, role, fault in zip(*columns, strict=True):
            if conv != of:
                of, vector, cost, nth = conv, machine.end, 0, 0
            nth += 1
            places.append(nth)
            afters.append(_packed(vector))
            if live:
                vector, more = machine.move(vector, kind_of(role, fault))
                cost += more
            costs.append(cost + vector[START])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(afters, pa.int32()), pa.array(costs, pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "after", "left", "from_end"])


EDITS = "conv_id long, place long, edit string, turn long, role string, text string, fault int, illegal boolean, left long"
_FIELDS = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32()), ("illegal", pa.bool_()), ("left", pa.int64())])


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of rows that come from each conversation's first to its last; a row without an edit stands for a conversation without rows."""
    machine = Automaton()
    none = object()
    of, q, place, before = none, START, 0, None

    def closed() -> Iterator[tuple]:
        for n, letter in enumerate(machine.last(q)):
            yield of, place + n, "I", None, WRITTEN[letter], "", 0, False, None

    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "live", "turn", "role", "text", "fault", "after", "left"))
        for conv, live, turn, role, text, fault, after, left in zip(*columns, strict=True):
            if conv != of or of is none:
                out += closed() if of is not none else ()
                of, q, place, before = conv, START, 0, None
            if not live:
                out.append((conv, None, None, None, None, None, 0, False, None))
                continue
            taken, q = machine.arc(_unpacked(after), kind_of(role, fault), q)
            for letter, to in taken:
                if letter == "I":
                    out.append((conv, place, letter, None, WRITTEN[to], "", 0, False, None))
                else:
                    illegal = before is not None and before + role[:1] not in ("su", "ua", "au")
                    out.append((conv, place, letter, turn, WRITTEN[to] if letter == "R" else role, text, fault, illegal, left if before is None else None))
                place += 1
            before = role[:1]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FIELDS, strict=True)] if out else [pa.array([], f.type) for f in _FIELDS], schema=_FIELDS)
    if of is not none and (out := list(closed())):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


def _edits(rows: DataFrame) -> DataFrame:
    """The edits of rows with conv_id, turn, role, text and live; rows that aren't live only name their conversation."""
    common.bound_batches(rows.sparkSession)
    closing = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    # a hash partitioning by conversation serves the window and both sorts
    dealt = rows.repartition("conv_id").withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first())))
    fault = (
        F.when(~F.col("live"), 0).when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(F.col("seen") > 1, 2).when(~closing.isin(".", "!", "?"), 3).otherwise(0))
    dealt = dealt.select("conv_id", "live", "turn", "role", "text", fault.cast("int").alias("fault"))
    again = F.col("fault") == 2  # of equal rows the first isn't a repeat
    schema = "conv_id long, live boolean, turn long, role string, text string, fault int, after int, left long, from_end long"
    scanned = dealt.sortWithinPartitions(F.col("conv_id").desc(), F.col("live").desc(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), again.desc()).mapInArrow(_scan, schema)
    return scanned.sortWithinPartitions(F.col("conv_id").asc(), F.col("from_end").desc()).mapInArrow(_trace, EDITS)


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(" "))


def repair(conversations: DataFrame) -> DataFrame:
    """Every edit of every conversation: conv_id, place (of the edit), edit (K, R, D or I), turn (null: inserted), role and text as they are now (of deleted rows: as they were), fault."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), _spaced("role").alias("role"), _spaced("text").alias("text"), F.lit(True).alias("live"))
    names = F.array(*map(F.lit, FAULTS))
    return _edits(rows).select("conv_id", "place", "edit", "turn", "role", "text", names[F.col("fault")].alias("fault"))


def repaired(conversations: DataFrame) -> DataFrame:
    """The conversations after their repair: conv_id, turn (counted anew from 0), role, text."""
    kept = repair(conversations).filter("edit <> 'D'")
    return kept.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("place")).cast("long") - 1).select("conv_id", "turn", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and live of rows damaged by a hash of conversation and turn; dropped rows stay as rows that aren't live."""
    key = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), _spaced("role").alias("role"), _spaced("text").alias("text"), key.alias("damage"))
    text = F.when(F.col("damage") == 0, "").when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", F.when(F.col("damage") > 0, F.col("turn")).alias("turn"), F.when(F.col("damage") == 4, "user").when(F.col("damage") == 0, "").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("damage") > 0).alias("live"), F.explode(copies).alias("copy")).drop("copy")


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COSTS = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


class _Sums:
    """What is kept of a conversation while its edits pass."""

    def __init__(self, conv: int | None):
        self.conv, self.low, self.high, self.turns = conv, None, None, 0
        self.faults, self.illegal, self.cost, self.scanned = [0] * 4, 0, 0, 0
        self.audit, self.digest, self.empty = [], hashlib.sha256(), True

    def add(self, edit: str, turn: int | None, role: str, text: str, fault: int, illegal: bool, left: int | None) -> None:
        self.audit.append(edit)
        self.cost += _COSTS[edit] + CUT_OFF * (fault == 3 and edit != "D")
        self.faults[fault] += 1
        self.illegal += illegal
        self.scanned = self.scanned if left is None else left
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if edit != "D":
            self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False

    def row(self) -> tuple:
        if self.cost != self.scanned:
            raise ValueError(f"conversation {self.conv}: the trace costs {self.cost}, the scan {self.scanned}")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation whose edits come in order."""
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [part.split(" ")[0] for part in SCHEMA.split(", ")]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    sums: _Sums | None = None
    for batch in batches:
        done = []
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "edit", "turn", "role", "text", "fault", "illegal", "left"))
        for conv, edit, *row in zip(*columns, strict=True):
            if sums is None or sums.conv != conv:
                if sums is not None:
                    done.append(sums.row())
                sums = _Sums(conv)
            if edit is not None:
                sums.add(edit, *row)
        if done:
            yield made(done)
    if sums is not None:
        yield made([sums.row()])


def summaries(edits: DataFrame) -> DataFrame:
    """Gaps, faults, cost, audit and the digest of the repaired rows of each conversation, from edits in order."""
    return edits.mapInArrow(_summed, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(_edits(damaged(common.read(spark, sf_dir, "conversations"))))
