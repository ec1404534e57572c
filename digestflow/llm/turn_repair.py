"""Repair of a conversation's structure at least cost, by the auction algorithm for shortest paths.

A conversation's rows are edited so that the initials of the roles read ``(s?(ua)+)?``.  The states E (nothing yet), S, U and
A (last role kept or made) at each place between rows are the nodes of a lattice; Keep, Rerole and Delete lead past a row,
Insert leads on at the same place.  A path from E at the front to E or A at the end is a repair.

Every node has a price, at first 0.  A path grows from an origin along the arc that its last node's price pays exactly; where
no arc is paid for, the price rises to the cheapest arc's cost plus the price behind it, and the path contracts by that node.
Origins are taken from the end to the front, and a path ends at a node whose price is settled, so each costs a few steps.
Settled prices are distances; arcs that they pay exactly are tight, and following the least letter among tight arcs gives the
least of the cheapest edit strings.

Rows are sorted by range of (conversation, turn), and each task cuts its rows into pieces of at most PIECE rows.  A piece keeps,
for the states at its ends, cost and edits; a conversation is put together from its pieces, so none has to fit into one task.
Only its texts pass one task in the end, as a stream in order, which the digest of a text of them all demands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._shared import join_hot, n_partitions, sliced, staged

PIECE = 4096
#: States of the lattice, and the state that each next role's initial leads to.
E, S, U, A = range(4)
NEXT = {(E, "s"): S, (E, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
#: What Insert and Rerole lead to from each state.
NEED = {E: U, S: U, A: U, U: A}
#: Faults of rows, in the order in which they count.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
NEVER = 1 << 60
ORDER = ["turn", "role", "tie", "nr"]


def arcs(rows: list[tuple[str, int]], at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Letter, cost, place and state of the edits from a node, by letter."""
    if at < len(rows):
        initial, fault = rows[at]
        cost, usable = CUT * (fault == TRUNCATED), fault in (SOUND, TRUNCATED)
        yield "D", DELETE, at + 1, state
    yield "I", INSERT, at, NEED[state]
    if at < len(rows) and usable:
        if (state, initial) in NEXT:
            yield "K", cost, at + 1, NEXT[state, initial]
        yield "R", REROLE + cost, at + 1, NEED[state]


def prices(rows: list[tuple[str, int]], ends: tuple[int, ...]) -> dict[tuple[int, int], int]:
    """The least cost from each node to one of the states ``ends`` behind the last row; nodes that reach none are absent."""
    states = (E,) if ends == (E,) else (E, S) if ends == (S,) else (E, S, U, A)
    settled = {(len(rows), x): 0 for x in ends}
    price: dict[tuple[int, int], int] = {}
    for at in range(len(rows), -1, -1):
        for state in states:
            path = [] if (at, state) in settled else [(at, state)]
            while path:
                node = path[-1]
                paid = ((cost + settled.get(n, price.get(n, 0)), n) for _, cost, a, x in arcs(rows, *node) if (n := (a, x))[1] in states)
                best, to = min(paid, default=(NEVER, None))
                if best >= NEVER:  # no way from here
                    price[path.pop()] = NEVER
                elif price.get(node, 0) < best:  # raise and contract
                    price[node] = best
                    if len(path) > 1:
                        path.pop()
                elif to in settled:
                    settled |= {n: price.get(n, 0) for n in path}
                    path = []
                else:
                    path.append(to)
    return settled


def least_edits(rows: list[tuple[str, int]], state: int, ends: tuple[int, ...], settled: dict[tuple[int, int], int]) -> tuple[str, int]:
    """The least string of letters along tight arcs from state before the first row, and the state it ends in."""
    node, out = (0, state), []
    while not (node[0] == len(rows) and node[1] in ends):
        for letter, cost, at, x in arcs(rows, *node):
            if settled.get((at, x), NEVER) + cost == settled[node]:
                out.append(letter)
                node = (at, x)
                break
    return "".join(out), node[1]


PIECES = (
    "conv {}, part int, seq long, n long, turns long, first_turn {}, last_turn {}, least {}, most {}, first_role string, last_role string, "
    "illegal long, blank long, duplicate long, truncated long, edits array<struct<a:int,z:int,cost:long,audit:string>>"
)


def _piece(rows: list[tuple], starts: bool, stops: bool) -> tuple:
    """Of rows (turn, initial, fault) of one conversation: counts and edits; starts, stops: whether the conversation surely does so here."""
    turns = [t for t, _, _ in rows if t is not None]
    initials, faults = [r for _, r, _ in rows], [f for _, _, f in rows]
    lattice, edits = [(r, f) for _, r, f in rows], []
    for ends in [(E, A)] if stops else [(E,), (S,), (U,), (A,)]:
        settled = prices(lattice, ends)
        for state in (E,) if starts else (E, S, U, A):
            if (0, state) in settled:
                audit, end = least_edits(lattice, state, ends, settled)
                edits.append({"a": state, "z": end, "cost": settled[0, state], "audit": audit})
    return (
        len(rows), len(set(turns)), rows[0][0], rows[-1][0], min(turns, default=None), max(turns, default=None), initials[0], initials[-1],
        sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), edits,
    )


def pieces(steps: DataFrame, most: int = PIECE) -> DataFrame:
    """steps (conv, turn, role, tie, nr, fault) -> pieces of at most ``most`` rows of conversations, in order of (part, seq)."""
    kinds = dict(steps.dtypes)
    turn = kinds["turn"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, conv, starts, out = TaskContext.get().partitionId(), 0, [], None, False, []

        def close(stops: bool) -> None:
            nonlocal seq, held, starts
            out.append((conv, part, seq, *_piece(held, starts, stops)))
            seq, held, starts = seq + 1, [], False

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "fault"))):
                if held and key != conv:
                    close(True)
                    starts = True  # a conversation that begins within a partition begins here
                elif len(held) >= most:
                    close(False)
                held.append(tuple(row))
                conv = key
            yield flushed()
        if held:
            close(False)
        yield flushed()

    ddl = PIECES.format(kinds["conv"], turn, turn, turn, turn)
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    ordered = steps.select("conv", *ORDER[:1], F.substring("role", 1, 1).alias("role"), F.col("role").alias("whole"), "tie", "nr", "fault")
    by = ["conv", "turn", "whole", "tie", "nr"]
    return ordered.repartitionByRange(n_partitions(steps.sparkSession), *by).sortWithinPartitions(*by).select("conv", "turn", "role", "fault").mapInArrow(cut, ddl)


class Joined:
    """A conversation that is put together from its pieces, in order: counts, and the best way to each state so far."""

    def __init__(self):
        self.total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.best, self.last, self.least, self.most = {E: (0, "")}, None, None, None

    def add(self, p: dict) -> None:
        for k in self.total:
            self.total[k] += p[k]
        if self.last is not None:
            self.total["illegal"] += self.last["last_role"] + p["first_role"] not in ("su", "ua", "au")
            self.total["turns"] -= self.last["last_turn"] is not None and self.last["last_turn"] == p["first_turn"]
        if p["least"] is not None:
            self.least = p["least"] if self.least is None else min(self.least, p["least"])
            self.most = p["most"] if self.most is None else max(self.most, p["most"])
        ways: dict[int, tuple[int, str]] = {}
        for e in p["edits"]:
            if e["a"] in self.best:
                way = (self.best[e["a"]][0] + e["cost"], self.best[e["a"]][1] + e["audit"])
                ways[e["z"]] = min(ways.get(e["z"], way), way)
        self.best, self.last = ways, p

    def row(self, conv) -> dict:
        cost, audit = min(self.best[x] for x in (E, A) if x in self.best)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.total["turns"]
        return {"conv": conv, **self.total, "gaps": gaps, "cost": cost, "audit": audit}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(parts: DataFrame) -> DataFrame:
    """pieces -> conv, the counts, audit: one row per conversation.  A task reads the pieces of a conversation one after another."""
    kind = dict(parts.dtypes)["conv"]
    ddl = f"conv {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, joined, out = None, None, []
        for batch in sliced(batches):
            for row in batch.to_pylist():
                if joined and now != row["conv"]:
                    out.append(joined.row(now))
                    joined = None
                now, joined = row["conv"], joined or Joined()
                joined.add(row)
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
        yield pa.RecordBatch.from_pylist([joined.row(now)] if joined else [], schema)

    return parts.repartition(n_partitions(parts.sparkSession), "conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(put, ddl)


class Mended:
    """Follows an audit over a conversation's rows: the rows of the repaired conversation, a call at a time."""

    def __init__(self, audit: str):
        self.letters, self.state = iter(audit), E
        self.next = next(self.letters, None)

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.next == "I":
            yield self._made(""), ""
            self.next = next(self.letters, None)

    def _made(self, text: str) -> str:
        self.state = NEED[self.state]
        return "user" if self.state == U else "assistant"

    def past(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """Rows up to and with what becomes of the next row."""
        yield from self._inserted()
        if self.next == "K":
            self.state = NEXT[self.state, role[:1]]
            yield role, text
        elif self.next == "R":
            yield self._made(text), text
        self.next = next(self.letters, None)

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


class Repair:
    """Rows (conv, turn, role, text) of conversations, and what their repair takes.

    Rows of a conversation go by turn, nulls first; rows of one turn by role, then by a hash of the text.  A null role or text
    counts as one space, null conversations are one conversation.  A row's fault is the first of: blank (no character but
    ASCII white space), duplicate (role and text stand earlier in the conversation), truncated (the last such character is
    none of ``.!?``).  Blank and duplicate rows must go (Delete, 3); others may be kept (0) or get the role user or assistant
    (Rerole, 2), at 1 more if truncated; Insert puts an empty row of either role anywhere (2).  Of the cheapest ways the one
    whose letters come first is taken.  Turns must be integers.  Columns besides the four aren't read.
    """

    def __init__(self, rows: DataFrame, convs: DataFrame | None = None, piece: int = PIECE):
        """convs (conv): conversations to list even where they have no rows; piece: rows of a piece at most."""
        self.spark, self.piece = rows.sparkSession, piece
        text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
        plain = rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.xxhash64(text).alias("tie"))
        # written with their numbers, so that these last
        self.rows = staged(plain.withColumn("nr", F.monotonically_increasing_id()), "turns")
        convs = self.rows.select("conv") if convs is None else convs.select("conv").unionByName(self.rows.select("conv"))
        self.convs = convs.distinct()

    def steps(self) -> DataFrame:
        """Rows with their fault, without texts."""
        last = F.right(F.rtrim("text", F.lit(" \t\n\v\f\r")), F.lit(1))
        rows = self.rows.select("conv", *ORDER, F.sha2("text", 256).alias("digest"), last.alias("last"))
        keyed = staged(rows.withColumn("who", F.coalesce(F.col("conv").cast("string"), F.lit(""))).withColumn("none", F.col("conv").isNull()), "turns-keyed")
        keys = ["who", "none", "role", "digest"]
        again = staged(keyed.groupBy(*keys).agg(F.min(F.struct("turn", "nr")).alias("first"), F.count("*").alias("held")).where("held > 1"), "turns-repeated")
        marked = join_hot(keyed, again, keys, "held", keyed.count(), "left")
        fault = (
            F.when(F.col("last") == "", BLANK).when(F.col("first").isNotNull() & (F.struct("turn", "nr") != F.col("first")), DUPLICATE)
            .when(~F.col("last").isin(*".!?"), TRUNCATED).otherwise(SOUND)
        )
        return marked.select("conv", *ORDER, fault.alias("fault"))

    def audits(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows."""
        return audits(staged(pieces(staged(self.steps(), "turn-steps"), self.piece), "turn-pieces"))

    def _followed(self, audits: DataFrame, each, ddl: str) -> DataFrame:
        """each(audit row or None, iterator of (role, text)) for every conversation, over its rows in order.

        Conversation, audit and rows come one after another by a secondary sort, so a task holds one batch of rows.
        """
        names = ["conv", "kind", *ORDER]
        none = {c: F.lit(None).cast(k) for c, k in self.rows.dtypes if c != "conv"}
        info = audits.select("conv", F.lit(1).alias("kind"), F.struct(*COUNTS, "audit").alias("info"))
        empty = F.lit(None).cast(info.schema["info"].dataType)
        every = info.withColumns(none).unionByName(self.convs.select("conv", F.lit(0).alias("kind"), empty.alias("info")).withColumns(none))
        every = every.unionByName(self.rows.select("*", F.lit(2).alias("kind"), empty.alias("info")))
        sent = every.repartition(n_partitions(self.spark), "conv").sortWithinPartitions(*names).select("conv", "kind", "role", "text", "info")
        return sent.mapInArrow(each, ddl)

    def _schema(self, ddl: str) -> str:
        return f"conv {dict(self.rows.dtypes)['conv']}, {ddl}"

    def digests(self) -> DataFrame:
        """One row per conversation: the counts, audit and repaired_sha256 of its repaired ``role:text`` lines; zeros and empty
        strings where it has no rows."""
        ddl = self._schema(f"{', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
        schema = to_arrow_schema(StructType.fromDDL(ddl))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, now = [], None

            def put(lines: Iterator[tuple[str, str]]) -> None:
                for role, text in lines:
                    now["sha"].update(f"{now['join']}{role}:{text}".encode())
                    now["join"] = "\n"

            def close() -> None:
                put(now["mended"].rest())
                out.append({"conv": now["conv"], **now["info"], "repaired_sha256": now["sha"].hexdigest()})

            for batch in sliced(batches):
                for conv, kind, role, text, info in zip(*(c.to_pylist() for c in batch.columns)):
                    if kind == 0:
                        if now:
                            close()
                        now = {"conv": conv, "sha": hashlib.sha256(), "join": "", "mended": Mended(""), "info": dict.fromkeys(COUNTS, 0) | {"audit": ""}}
                    elif kind == 1:
                        now |= {"mended": Mended(info["audit"]), "info": info}
                    else:
                        put(now["mended"].past(role, text))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if now:
                close()
            yield pa.RecordBatch.from_pylist(out, schema)

        return self._followed(self.audits(), each, ddl)

    def repaired(self) -> DataFrame:
        """The repaired conversations: conv, turn (numbered anew from 0), role, text."""
        ddl = self._schema("turn long, role string, text string")
        schema = to_arrow_schema(StructType.fromDDL(ddl))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, n, mended = None, 0, Mended("")
            for batch in sliced(batches):
                out = []

                def put(lines: Iterator[tuple[str, str]]) -> None:
                    nonlocal n
                    for role, text in lines:
                        out.append({"conv": now, "turn": n, "role": role, "text": text})
                        n += 1

                for conv, kind, role, text, info in zip(*(c.to_pylist() for c in batch.columns)):
                    if kind == 0:
                        put(mended.rest())
                        now, n, mended = conv, 0, Mended("")
                    elif kind == 1:
                        mended = Mended(info["audit"])
                    else:
                        put(mended.past(role, text))
                yield pa.RecordBatch.from_pylist(out, schema)
            yield pa.RecordBatch.from_pylist([{"conv": now, "turn": n + i, "role": r, "text": t} for i, (r, t) in enumerate(mended.rest())], schema)

        return self._followed(self.audits(), each, ddl)
