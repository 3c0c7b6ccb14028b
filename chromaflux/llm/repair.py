"""Conversation structure repair by weighted finite-state composition.

Three machines are composed as far as a shortest path needs them: an acceptor of a conversation's turns (a chain), an edit
transducer (keep, rerole, delete, insert, with costs) and an acceptor of the legal sequences of roles. Weights are pairs
(cost, label string) in lexicographic order, a semiring: two paths of one cost between the same states never have labels
of which one begins the other, so the lesser label stays the lesser whatever follows. The composed machine has no cycle,
as the transducer counts the insertions since the turn it read last; states come in topological order turn by turn.

At scale the turns are dealt by range of (conversation, turn), so a conversation that holds a third of all rows is spread
over many tasks. A task solves each conversation that lies within its range. For those that its range cuts, of which it
has two at most, it gives the matrix of shortest paths between grammar states, and the matrices are multiplied in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import column, lean, remove, small_batches, written

#: Fixed values of the task: grammar (s?(ua)+)? as state -> role initial -> state, costs, and what a turn may end with.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANKS = "\t\n\v\f\r "
#: Turns whose paths are walked at once (labels are copied at each turn), and turns of conversations whose solution a worker keeps.
SEGMENT, SHORT = 128, 16

Symbol = tuple[str, str]  # role initial, fault ("" or its first letter)
Paths = dict[int, tuple[int, str]]  # grammar state -> best (cost, labels)


def _better(paths: Paths, state: int, cost: int, labels: str) -> None:
    if state not in paths or (cost, labels) < paths[state]:
        paths[state] = (cost, labels)


def inserting(paths: Paths) -> Paths:
    """The composed states after any insertions: one layer for each insertion since the last turn, no more than states, as a cycle never pays."""
    best, layer = dict(paths), paths
    for _ in range(len(GRAMMAR) - 1):
        onward: Paths = {}
        for state, (cost, labels) in layer.items():
            for initial in ROLES:
                if initial in GRAMMAR[state]:
                    _better(onward, GRAMMAR[state][initial], cost + COSTS["I"], labels + "I")
        for state, (cost, labels) in onward.items():
            _better(best, state, cost, labels)
        layer = onward
    return best


def reading(paths: Paths, symbol: Symbol) -> Paths:
    """The composed states after one more turn: kept, given another role, or deleted."""
    initial, fault = symbol
    out: Paths = {}
    for state, (cost, labels) in paths.items():
        _better(out, state, cost + COSTS["D"], labels + "D")
        if fault not in ("b", "d"):
            kept = cost + (TRUNCATED if fault == "t" else 0)
            if initial in GRAMMAR[state]:
                _better(out, GRAMMAR[state][initial], kept + COSTS["K"], labels + "K")
            for other in ROLES:
                if other in GRAMMAR[state]:
                    _better(out, GRAMMAR[state][other], kept + COSTS["R"], labels + "R")
    return out


def walked(symbols: Iterable[Symbol], start: int = 0) -> Paths:
    paths: Paths = {start: (0, "")}
    for symbol in symbols:
        paths = reading(inserting(paths), symbol)
    return paths


Matrix = list[Paths]  # from each grammar state


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        paths: Paths = {}
        for middle, (cost, labels) in row.items():
            for state, (more, further) in b[middle].items():
                _better(paths, state, cost + more, labels + further)
        out.append(paths)
    return out


def product(matrices: list[Matrix]) -> Matrix:
    """In order, by halves: labels are copied as often as the number of matrices can be halved."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else [{q: (0, "")} for q in GRAMMAR]


def matrix(symbols: list[Symbol]) -> Matrix:
    parts = [symbols[i : i + SEGMENT] for i in range(0, len(symbols), SEGMENT)]
    return product([[walked(part, q) for q in GRAMMAR] for part in parts])


def ended(paths: Paths) -> tuple[int, str]:
    """The best weight over final states, with insertions behind the last turn."""
    last = inserting(paths)
    return min(last[q] for q in FINAL if q in last)


@lru_cache(maxsize=1 << 14)
def _short(symbols: tuple[Symbol, ...]) -> tuple[int, str]:
    return ended(walked(symbols))


def cheapest(symbols: list[Symbol]) -> tuple[int, str]:
    """(cost, edits) of a conversation."""
    if len(symbols) <= SHORT:
        return _short(tuple(symbols))
    return ended(walked(symbols) if len(symbols) <= SEGMENT else matrix(symbols)[0])


def mended(labels: str, turns: Iterable[tuple[str, str, int]], state: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an edit string leaves. ``turns``: (role, text, copies). The edits fix all roles."""
    at = 0

    def put(edit: str) -> tuple[str, str, str]:
        nonlocal state
        initial = next(x for x in GRAMMAR[state] if x in ROLES)
        state = GRAMMAR[state][initial]
        return edit, ROLES[initial], ""

    for role, text, copies in turns:
        for _ in range(copies):
            while labels[at] == "I":
                yield put("I")
                at += 1
            edit = labels[at]
            at += 1
            if edit == "K":
                state = GRAMMAR[state][role[:1]]
                yield edit, role, text
            elif edit == "R":
                yield edit, put("R")[1], text
    for edit in labels[at:]:
        yield put(edit)


class Digest:
    """SHA-256 of ``role:text`` lines joined by line feeds, as they come."""

    def __init__(self) -> None:
        self.state, self.begun = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.state.update((b"\n" if self.begun else b"") + f"{role}:{text}".encode())
        self.begun = True

    def hex(self) -> str:
        return self.state.hexdigest()


class Run:
    """Turns of one conversation that one task holds, in order: what they add up to."""

    def __init__(self) -> None:
        self.turns: list[tuple[str, str, int]] = []
        self.symbols: list[Symbol] = []
        self.counts = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal = self.distinct = 0
        self.least: int | None = None
        self.most: int | None = None

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        if not copies:
            return
        body, initial = text.rstrip(BLANKS), role[:1]
        fault = "b" if not body else "d" if again else "" if body[-1] in ".!?" else "t"
        rest = "b" if not body else "d"
        self.illegal += bool(self.symbols and self.symbols[-1][0] + initial not in LEGAL) + (copies - 1)
        self.counts[fault] += 1
        self.counts[rest] += copies - 1
        self.symbols += [(initial, fault), *[(initial, rest)] * (copies - 1)]
        self.turns.append((role, text, copies))
        if turn is not None and turn != self.most:
            self.least, self.most, self.distinct = turn if self.least is None else self.least, turn, self.distinct + 1

    def summary(self) -> dict:
        return {
            "blank": self.counts["b"], "duplicate": self.counts["d"], "truncated": self.counts["t"], "illegal": self.illegal, "least": self.least, "most": self.most,
            "distinct_turns": self.distinct, "first": self.symbols[0][0] if self.symbols else None, "last": self.symbols[-1][0] if self.symbols else None,
        }


SUMMED = ("blank", "duplicate", "truncated")


def summed(parts: list[dict]) -> dict:
    """The counts of a whole conversation from those of its parts, in order."""
    held = [p for p in parts if p["first"] is not None]
    out = {k: sum(p[k] for p in held) for k in SUMMED}
    out["illegal"] = sum(p["illegal"] for p in held) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(held, held[1:], strict=False))
    dated = [p for p in held if p["most"] is not None]
    distinct = sum(p["distinct_turns"] for p in dated) - sum(a["most"] == b["least"] for a, b in zip(dated, dated[1:], strict=False))
    out["gaps"] = dated[-1]["most"] - dated[0]["least"] + 1 - distinct if dated else 0
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
_PART = "least long, most long, distinct_turns long, first string, last string, paths array<struct<start:int,state:int,cost:long,labels:string>>"
#: Kinds of rows that a task gives: a whole conversation, part of one, a turn of a part, a repaired turn.
WHOLE, PART, TURN, REPAIRED = range(4)
#: Bytes of text in an Arrow batch that a task gives.
BATCH = 8 << 20


class Out:
    """Rows as dictionaries, given as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, **row) -> bool:
        self.rows.append(row)
        self.bytes += 200 + len(row.get("text") or "") + len(row.get("audit") or "")
        return self.bytes > BATCH

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.bytes = self.rows, [], 0
        return pa.RecordBatch.from_pylist(rows, schema=self.schema)


def _turns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column(batch, n).to_pylist() for n in names), strict=True)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` after the damage that crc32 of ``conv_id:turn`` deals (nulls: one space).

    A dropped row stays as a row without a turn, of no copies, so its conversation is still known.
    """
    blank = F.lit(" ")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", F.when(kind != 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def repaired(turns: DataFrame, texts: bool = False) -> DataFrame:
    """The cheapest legal form of each conversation in ``turns`` (``conv_id``, ``turn``, ``role``, ``text``, ``copies``).

    Without ``texts`` a row a conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, the edits in
    ``audit`` and ``repaired_sha256``. With ``texts`` the repaired turns: ``conv_id``, ``position`` (from 0), ``edit``, ``role``, ``text``.

    Turns go by ``turn`` (nulls first), those of one turn by role, then text; equal rows are copies of one another. Null roles
    and texts count as one space, a null ``conv_id`` is a conversation, no copies (or none left) give zeros and an empty
    audit. An empty table gives no rows, other columns are ignored.

    Equal rows are counted before anything is dealt by range, so no row is hot. What is not spread is what one value needs:
    the audit of a conversation, and its SHA-256, which reads the turns of a cut conversation in order as a stream.
    """
    small_batches(turns.sparkSession)
    kind_of_id = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.col("copies").cast("long").alias("copies"))
    rows = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2("text", 256)))
    there = F.col("copies") > 0
    # where a text comes first in its conversation; a struct, as a null turn is the first of all
    first = rows.filter(there).groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("at"), F.count("*").alias("n"))
    first = first.filter("n > 1").drop("n")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    marked = rows.join(first, same, "left").select("conv_id", "turn", "role", "text", "copies", (F.col("at").isNotNull() & ~F.col("at.turn").eqNullSafe(F.col("turn"))).alias("again"))
    dealt = marked.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")

    schema = f"kind int, conv_id {kind_of_id}, part int, position long, edit string, role string, text string, copies long, {_RESULT}, {_PART}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, stream = TaskContext.get().partitionId(), Out(arrow), groupby(_turns(batches, "conv_id", "turn", "role", "text", "copies", "again"), key=lambda x: x[0])
        held: tuple | None = None  # the run that may be the last one

        def cut(conv, run: Run) -> Iterator[pa.RecordBatch]:
            paths = [{"start": i, "state": q, "cost": c, "labels": s} for i, row in enumerate(matrix(run.symbols)) for q, (c, s) in row.items()]
            out.add(kind=PART, conv_id=conv, part=part, paths=paths, **run.summary())
            for i, (role, text, copies) in enumerate(run.turns):
                if out.add(kind=TURN, conv_id=conv, part=part, position=i, role=role, text=text, copies=copies):
                    yield out.batch()

        def whole(conv, run: Run) -> Iterator[pa.RecordBatch]:
            cost, audit = cheapest(run.symbols)
            digest = Digest()
            for i, (edit, role, text) in enumerate(mended(audit, run.turns)):
                if not texts:
                    digest.add(role, text)
                elif out.add(kind=REPAIRED, conv_id=conv, position=i, edit=edit, role=role, text=text):
                    yield out.batch()
            if not texts and out.add(kind=WHOLE, conv_id=conv, cost=cost, audit=audit, repaired_sha256=digest.hex(), **summed([run.summary()])):
                yield out.batch()

        for k, (conv, group) in enumerate(stream):
            if held:
                yield from (cut if held[0] == 0 else whole)(*held[1:])
            run = Run()
            for _, turn, role, text, copies, again in group:
                run.add(turn, role, text, copies, again)
            held = (k, conv, run)
        if held:
            yield from cut(*held[1:])
        yield out.batch()

    found = written(dealt.mapInArrow(lean(task, 0), schema))
    remove(rows)

    def join(key: tuple, parts: pa.Table) -> pa.Table:
        """The matrices of a conversation's parts multiplied in order."""
        order = sorted(parts.to_pylist(), key=lambda p: p["part"])
        matrices: list[Matrix] = []
        for p in order:
            matrices.append([{} for _ in GRAMMAR])
            for x in p["paths"]:
                matrices[-1][x["start"]][x["state"]] = (x["cost"], x["labels"])
        cost, audit = ended(product(matrices)[0])
        return pa.Table.from_pylist([{"kind": PART, "conv_id": order[0]["conv_id"], "part": -1, "cost": cost, "audit": audit, **summed(order)}], schema=arrow)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut conversations as streams: the joined row with the audit, then the turns in order."""
        out = Out(arrow)
        for conv, group in groupby(_turns(batches, "conv_id", *COUNTS, "audit", "role", "text", "copies"), key=lambda x: x[0]):
            head = next(group)
            audit, digest = head[1 + len(COUNTS)], Digest()
            for i, (edit, role, text) in enumerate(mended(audit, (x[-3:] for x in group))):
                if not texts:
                    digest.add(role, text)
                elif out.add(kind=REPAIRED, conv_id=conv, position=i, edit=edit, role=role, text=text):
                    yield out.batch()
            if not texts and out.add(kind=WHOLE, conv_id=conv, audit=audit, repaired_sha256=digest.hex(), **dict(zip(COUNTS, head[1:], strict=False))):
                yield out.batch()
        yield out.batch()

    joined = found.filter(F.col("kind") == PART).groupBy("conv_id").applyInArrow(join, schema)
    streams = joined.unionByName(found.filter(F.col("kind") == TURN)).repartition("conv_id").sortWithinPartitions("conv_id", "part", "position")
    kind = REPAIRED if texts else WHOLE
    out = found.filter(F.col("kind") == kind).unionByName(streams.mapInArrow(lean(finish, 0), schema))
    return out.select("conv_id", *(("position", "edit", "role", "text") if texts else (*COUNTS, "audit", "repaired_sha256")))


def op11_repair(conversations: DataFrame) -> DataFrame:
    """What damage did to each conversation, the cheapest edits that make it legal, and the digest of what they leave."""
    return repaired(damaged(conversations))
