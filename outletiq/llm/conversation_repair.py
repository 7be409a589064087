"""Repair of conversation structure as a secondary-sorted stream with carried DP state.

A repaired conversation has the roles ``(system? (user assistant)+)?`` by their
initials. Rows may be kept (cost 0), given another role (3) or deleted (4, which
blank and repeated rows must be), empty rows may be inserted (3), and a kept row
whose text breaks off costs 3 more. The cheapest edits win, ties go to the
edit string that is least in ASCII.

Rows are hash-partitioned by conversation and sorted by turn within partitions;
``mapInArrow`` carries one small state across Arrow batches, so memory does not
grow with a conversation:

1. faults: the first place of each (conversation, role, text digest) is a partial
   aggregate, joined back on the full row key, so no group meets in one task;
2. backward: short rows without texts, last turn first; the four costs-to-go are
   carried, and each row's choices for the four states are one byte. These
   backpointers are spilled as rows of a written table;
3. forward: each row meets its byte in one more sorted stream, in which the
   edits are applied, hashed or returned.

Rows are in the order of turn (null first), then role, then text digest. Null
roles and texts are one space. A row that has equal turn, role and text as
another is the other's repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletiq.llm.common import pick, save

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = "DIKR"  # in ASCII order, so the smallest number is the least letter
ROLES = {"user": 2, "assistant": 3}
#: Faults of a row.
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
#: Shape of a row for the edits: initial (0 other, 1 s, 2 u, 3 a), 4 if it breaks off, 8 if it must go.
BREAKS, GONE = 4, 8
#: States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
AFTER_INSERT = (2, 2, 3, 2)
COSTS_AT_END = (0, 2 * INSERT, INSERT, 0)
BLANKS = " \t\n\x0b\f\r"
REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ORDER = ("known", "at", "role", "digest")


def after_keep(state: int, initial: int) -> int | None:
    """The state after a kept row with this initial, None where it may not stand."""
    if initial == 1:
        return 1 if state == 0 else None
    if initial == 2:
        return 2 if state != 2 else None
    return 3 if initial == 3 and state == 2 else None


def step_back(shape: int, later: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Choices (two bits a state) at one row, and the costs from there, given the costs after it."""
    options = []
    for state in range(4):
        here = [DELETE + later[state], None, None, None]
        if shape < GONE:
            more = TRUNCATED if shape & BREAKS else 0
            kept = after_keep(state, shape & 3)
            if kept is not None:
                here[2] = KEEP + more + later[kept]
            here[3] = REROLE + more + later[AFTER_INSERT[state]]
        options.append(here)
    least = [min(x for x in here if x is not None) for here in options]
    user, assistant = least[2], least[3]
    least = [min(least[0], INSERT + user, 2 * INSERT + assistant), min(least[1], INSERT + user, 2 * INSERT + assistant),
             min(user, INSERT + assistant), min(assistant, INSERT + user)]
    code = 0
    for state, here in enumerate(options):
        here[1] = INSERT + least[AFTER_INSERT[state]]
        code |= here.index(least[state]) << (2 * state)
    return code, tuple(least)


def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    r = pick(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    r = r.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                 F.coalesce("text", F.lit(" ")).alias("text"))
    return r.select("conv", F.col("turn").isNotNull().cast("int").alias("known"),
                    F.coalesce("turn", F.lit(0)).cast("long").alias("at"), "role",
                    F.unhex(F.sha2("text", 256)).alias("digest"), "text")


def faults(rows: DataFrame) -> DataFrame:
    """One short row per distinct row, without its text: copies, fault of the first of them, shape."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    one = rows.select("conv", *ORDER, last.alias("last")).groupBy("conv", *ORDER).agg(
        F.count("*").alias("copies"), F.max("last").alias("last"))
    first = one.groupBy("conv", "role", "digest").agg(F.min(F.struct("known", "at")).alias("first"))
    first = first.select(F.col("conv").alias("c"), F.col("first.known").alias("k"), F.col("first.at").alias("a"),
                         F.col("role").alias("r"), F.col("digest").alias("d"))
    j = one.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("known") == F.col("k")) & (F.col("at") == F.col("a"))
                 & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = (F.when(F.col("last") == "", BLANK).when(F.col("d").isNull(), DUPLICATE)
             .when(~F.col("last").isin(".", "!", "?"), CUT_OFF).otherwise(0))
    initial = F.left("role", F.lit(1))
    shape = (F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
             + F.when(fault == CUT_OFF, BREAKS).otherwise(0) + F.when(fault.isin(BLANK, DUPLICATE), GONE).otherwise(0))
    return j.select("conv", *ORDER, "copies", fault.cast("int").alias("fault"), shape.cast("int").alias("shape"))


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's choices; copies of a row are deleted in every state alike and change no choice."""
    known: dict[tuple, tuple] = {}
    conv, costs = object(), COSTS_AT_END
    for batch in batches:
        codes = []
        for c, shape in zip(batch.column("conv").to_pylist(), batch.column("shape").to_pylist()):
            if c != conv:
                conv, costs = c, COSTS_AT_END
            found = known.get((shape, costs))
            if found is None:
                code, after = step_back(shape, costs)
                low = min(after)  # only differences between states matter
                found = known[shape, costs] = code, tuple(x - low for x in after)
            codes.append(found[0])
            costs = found[1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32())],
                                         names=[*batch.schema.names, "code"])


def choices(found: DataFrame) -> DataFrame:
    """``faults`` with the byte of choices of each row."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", code int"
    last_first = [F.col(c).desc() for c in ORDER]
    return (found.repartition("conv").sortWithinPartitions(F.col("conv"), *last_first)
            .mapInArrow(_backward, schema))


class Walk:
    """The edits of one conversation, row by row; ``emit(edit, role, text, turn, fault)`` gets each of them."""

    def __init__(self, emit: Callable):
        self.emit = emit
        self.state = self.cost = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.low = self.high = self.turns = None
        self.before: str | None = None

    def _insert(self) -> None:
        self.state = AFTER_INSERT[self.state]
        self.cost += INSERT
        self.emit("I", "user" if self.state == 2 else "assistant", "", None, 0)

    def row(self, turn: int | None, role: str, text: str, copies: int, fault: int, shape: int, code: int) -> None:
        if turn is not None:
            if self.low is None:
                self.low = self.high = turn
                self.turns = 1
            elif turn != self.high:
                self.high, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.before is not None and (self.before, initial) not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.before = initial
        self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        while True:
            edit = LETTERS[(code >> (2 * self.state)) & 3]
            if edit != "I":
                break
            self._insert()
        if edit == "D":
            self.cost += DELETE
        else:
            self.cost += (REROLE if edit == "R" else KEEP) + (TRUNCATED if fault == CUT_OFF else 0)
            if edit == "K":
                self.state = after_keep(self.state, shape & 3)
            else:
                self.state = AFTER_INSERT[self.state]
                role = "user" if self.state == 2 else "assistant"
        self.emit(edit, role, text, turn, fault)
        for _ in range(copies - 1):
            self.cost += DELETE
            self.emit("D", role, text, turn, BLANK if fault == BLANK else DUPLICATE)

    def end(self) -> None:
        while self.state in (1, 2):
            self._insert()

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _stream(batches: Iterator[pa.RecordBatch], begin: Callable, end: Callable, flush: Callable) -> Iterator[pa.RecordBatch]:
    """Runs ``Walk`` over a sorted stream in which each row's choices come right before its text."""
    conv, walk, pending = object(), None, None
    names = ("conv", "known", "at", "role", "digest", "text", "copies", "fault", "shape", "code")
    for batch in batches:
        for c, known, at, role, digest, text, copies, fault, shape, code in zip(
                *[batch.column(n).to_pylist() for n in names]):
            if walk is None or c != conv:
                if walk is not None:
                    walk.end()
                    end(conv, walk)
                conv, pending = c, None
                walk = begin(c)
            if code is not None:
                pending = (known, at, role, digest), copies, fault, shape, code
            elif pending is not None and text is not None and pending[0] == (known, at, role, digest):
                walk.row(at if known else None, role, text, *pending[1:])
                pending = None  # further copies of this row are in its count
        yield flush()
    if walk is not None:
        walk.end()
        end(conv, walk)
    yield flush()


def _sorted_stream(conversations: DataFrame, more_ids: DataFrame | None, cols: tuple) -> DataFrame:
    rows = _rows(conversations, *cols)
    spilled = save(choices(faults(rows)), "choices")
    none = {"copies": "long", "fault": "int", "shape": "int", "code": "int"}
    texts = rows.select("*", *[F.lit(None).cast(t).alias(n) for n, t in none.items()], F.lit(1).alias("kind"))
    codes = spilled.withColumn("text", F.lit(None).cast("string")).withColumn("kind", F.lit(0))
    both = codes.unionByName(texts)
    if more_ids is not None:
        blank = more_ids.select(F.col(f"`{more_ids.columns[0]}`").alias("conv"), F.lit(-1).alias("kind"))
        both = both.unionByName(blank, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", *ORDER, "kind")


def report(conversations: DataFrame, more_ids: DataFrame | None = None, conv_col: str = "conv_id",
           turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its faults, the cost and letters of its edits, the hash of the repaired text.

    ``more_ids`` (one column) adds conversations that have no rows: all zero, no
    edits. An empty table gives no rows; columns of other names are ignored.
    """
    kind = conversations.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []

        def begin(_) -> Walk:
            digest, audit, first = hashlib.sha256(), bytearray(), [True]

            def emit(edit: str, role: str, text: str, turn, fault) -> None:
                audit.append(ord(edit))
                if edit != "D":
                    digest.update(f"{'' if first[0] else chr(10)}{role}:{text}".encode())
                    first[0] = False

            walk = Walk(emit)
            walk.digest, walk.audit = digest, audit
            return walk

        def end(conv, w: Walk) -> None:
            ready.append((conv, w.gaps, w.faults[BLANK], w.faults[DUPLICATE], w.faults[CUT_OFF], w.illegal, w.cost,
                          w.audit.decode(), w.digest.hexdigest()))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*ready)) if ready else [()] * 9
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

        import pyspark.sql.pandas.types as arrow

        types = [arrow.to_arrow_type(conv_type), *[pa.int64()] * 6, pa.string(), pa.string()]
        names = [conv_col, *[x.split()[0] for x in REPORT.split(", ")]]
        yield from _stream(batches, begin, end, flush)

    conv_type = conversations.schema[conv_col].dataType
    stream = _sorted_stream(conversations, more_ids, (conv_col, turn_col, role_col, text_col))
    return stream.mapInArrow(run, f"`{conv_col}` {kind}, {REPORT}")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The repaired conversations: conversation, place (from 0), turn, role, text, edit.

    Inserted rows have no turn and an empty text. A conversation of which all
    rows are deleted has no rows here.
    """
    conv_type = conversations.schema[conv_col].dataType
    fields = f"`{conv_col}` {conv_type.simpleString()}, place long, turn long, role string, text string, edit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark.sql.pandas.types as arrow

        ready: list[tuple] = []
        types = [arrow.to_arrow_type(conv_type), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

        def begin(conv) -> Walk:
            place = [0]

            def emit(edit: str, role: str, text: str, turn, fault) -> None:
                if edit != "D":
                    ready.append((conv, place[0], turn, role, text, edit))
                    place[0] += 1

            return Walk(emit)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*ready)) if ready else [()] * 6
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                              names=[conv_col, "place", "turn", "role", "text", "edit"])

        yield from _stream(batches, begin, lambda conv, walk: None, flush)

    return _sorted_stream(conversations, None, (conv_col, turn_col, role_col, text_col)).mapInArrow(run, fields)


def damage(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test damage by crc32(``conv_id:turn``) % 20, nulls as one space: the damaged rows, and the ids of dropped ones.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats the
    row, 4 makes its role user.
    """
    r = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    r = r.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                 F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("d"))
    d = F.col("d")
    rows = r.where(d != 0).select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
    return rows, r.where(d == 0).select("conv_id")


def damaged_report(conversations: DataFrame) -> DataFrame:
    """``report`` of the damaged rows, with every original conversation."""
    rows, dropped = damage(conversations)
    return report(rows, dropped)
