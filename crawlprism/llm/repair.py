"""Conversation structure repair by an auction shortest-path algorithm.

Each conversation is a lattice of nodes (rows taken, state); the states are nothing yet, after the
system message, after a user and after an assistant message. An arc is an edit and its cost: Keep 0,
Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or assistant message) 5; a truncated
row that is not deleted costs 5 more, and blank or repeated rows must be deleted. Paths that end in
"nothing" or "after an assistant" give role initials `(s?(ua)+)?`.

The auction keeps a price per node, never above the cost of any arc plus the price behind it, and one
path of tight arcs. At the path's last node the price rises to the best arc's, and the path contracts
by a node, or it is there already, and the path extends along that arc; it ends at the sink. Prices
start at a valid bound (two for every row that costs two in any case), and go on from one origin to the
next. Then all shortest paths consist of tight arcs; those that reach the sink by tight arcs carry exact
prices, and the least letter at each node traces the lexicographically least repair. A conversation is
worked off in blocks of `BLOCK` rows from its end, the prices at a block's start being the exits of the
one before, so the auction's paths stay short. Blocks with the same faults and roles are solved once.

Rows are sorted by conversation and place over a range partitioning that also splits conversations, so
one with a third of all rows lies in many partitions. A conversation that ends and begins inside its
partition is repaired there. The first and the last of each partition may go on elsewhere: their rows
are written down with their fragment, repeats are found by a minimum per message, each fragment gives
its 4 x 4 matrix of costs between states, the fragments' exit prices follow from the matrices, and then
every fragment is traced for its four entry states. Only the digest of a repaired conversation is
sequential by definition: its rows are streamed in order through one hash, never gathered.

Defined cases: nulls count as one space in the key of the damage, in role and text (so a null text is
blank); a null id is one conversation; null turns come first. Rows of equal turn are ordered by the hash of
role and text. An empty role has no allowed initial. Very long texts and conversations are taken whole.
Repeated rows are duplicates. Other columns are not read. A conversation without rows keeps its
row: zeros, empty audit, hash of the empty string. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from crawlprism.llm.common import stored

BLOCK = 32
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
BLANKS = " \t\n\x0b\x0c\r"
FAR = 1 << 60  # no way
_AFTER = {"u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "s": (SYSTEM, None, None, None)}
_NEXT = (USER, USER, ASSISTANT, USER)
_SPLIT = re.compile(r"I*[DKR](?:I*$)?")

#: A row is coded by one byte: 0 if it must go, else 1 + 2 x initial (s, u, a, other), plus 1 if truncated.
GONE = 0


def code_of(role: str, text: str, repeated: bool) -> int:
    body = text.rstrip(BLANKS)
    if not body or repeated:
        return GONE
    initial = "sua".find(role[0]) if role else -1
    return 1 + 2 * (initial if initial >= 0 else 3) + (body[-1] not in ".!?")


def _row_arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that take a row, by letter."""
    arcs = [("D", DELETE, state)]
    if code != GONE:
        initial, more = "sua?"[(code - 1) // 2], UNFINISHED * ((code - 1) % 2)
        kept = _AFTER.get(initial, (None,) * 4)[state]
        if kept is not None:
            arcs.append(("K", more, kept))
        if "?sua"[_NEXT[state]] != initial:
            arcs.append(("R", REROLE + more, _NEXT[state]))
    return arcs


_ARCS = [[_row_arcs(code, state) for state in range(STATES)] for code in range(9)]


class Lattice:
    """The lattice of one block. Node 4 i + q: i rows are taken, the state is q. `exits` are the costs
    from the last nodes to the sink; the last block of a conversation may still insert there."""

    def __init__(self, codes: bytes, exits: tuple[int, ...], last: bool):
        n = len(codes)
        self.sink = STATES * (n + 1)
        self.arcs: list[list[tuple[str, int, int]]] = []
        for i in range(n + 1):
            for q in range(STATES):
                arcs = [(letter, c, STATES * (i + 1) + to) for letter, c, to in _ARCS[codes[i]][q]] if i < n else []
                if i < n or last:
                    arcs.append(("I", INSERT, STATES * i + _NEXT[q]))
                if i == n and exits[q] < FAR:
                    arcs.append(("", exits[q], self.sink))
                self.arcs.append(sorted(arcs))
        bound = min(exits)
        self.price = [bound] * (STATES * (n + 1)) + [0]
        for i in reversed(range(n)):
            bound += DELETE if codes[i] == GONE or not codes[i] % 2 else 0
            self.price[STATES * i : STATES * (i + 1)] = [bound] * STATES

    def can_reach(self) -> list[bool]:
        """Nodes with a way to the sink."""
        return self._back(lambda node, cost, to: True)

    def _back(self, counts) -> list[bool]:
        found = [False] * self.sink + [True]
        for level in reversed(range(self.sink // STATES)):
            for _ in range(3):  # at most two inserts follow each other before a state is met again
                for node in range(STATES * level, STATES * (level + 1)):
                    found[node] = found[node] or any(found[to] and counts(node, c, to) for _, c, to in self.arcs[node])
        return found

    def auction(self, origin: int) -> int:
        """The cost from an origin to the sink, which it must reach."""
        price, arcs, path = self.price, self.arcs, [origin]
        while path[-1] != self.sink:
            node = path[-1]
            best, to = FAR * 2, -1
            for _, cost, other in arcs[node]:
                if cost + price[other] < best:
                    best, to = cost + price[other], other
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[origin]

    def walks(self, origins: list[int]) -> list[tuple[str, int]]:
        """From each origin, after its auction: the least letters of a cheapest path and its last state."""
        price = self.price
        tight = self._back(lambda node, cost, to: price[node] == cost + price[to])
        made = []
        for origin in origins:
            node, letters = origin, []
            while True:
                letter, to = next((x, to) for x, c, to in self.arcs[node] if tight[to] and price[node] == c + price[to])
                if to == self.sink:
                    break
                letters.append(letter)
                node = to
            made.append(("".join(letters), node % STATES))
        return made


@lru_cache(maxsize=1 << 15)
def _block(codes: bytes, exits: tuple[int, ...], last: bool, first: bool) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Per entry state (only "nothing" for the first block of a conversation): cost and walk."""
    lattice = Lattice(codes, exits, last)
    reach = lattice.can_reach()
    origins = [q for q in range(1 if first else STATES) if reach[q]]
    costs = {q: lattice.auction(q) for q in origins}
    walks = dict(zip(origins, lattice.walks(origins)))
    return tuple(costs.get(q, FAR) for q in range(STATES)), tuple(walks.get(q, ("", q)) for q in range(STATES))


END = (0, FAR, FAR, 0)


def solve(codes: bytes, exits: tuple[int, ...] = END, *, last: bool = True, first: bool = True):
    """Per entry state: cost and (letters, last state) of the cheapest, then least, edits of some rows."""
    starts = range(0, max(1, len(codes)), BLOCK)
    walks = []
    for start in reversed(starts):
        part = codes[start : start + BLOCK]
        final = start + BLOCK >= len(codes)
        least = min(exits)
        costs, walk = _block(part, tuple(min(FAR, e - least) if e < FAR else FAR for e in exits), last and final, first and not start)
        exits = tuple(c + least if c < FAR else FAR for c in costs)
        walks.append(walk)
    walks.reverse()
    made = []
    for q in range(STATES):
        letters, state = [], q
        if exits[q] < FAR:
            for walk in walks:
                part, state = walk[state]
                letters.append(part)
        made.append(("".join(letters), state))
    return exits, made


def matrix(codes: bytes, last: bool) -> list[int]:
    """Costs from every entry to every exit state of some rows, row by row. In the last rows of a
    conversation the exits are its two ends."""
    columns = [solve(codes, tuple(0 if q == out else FAR for q in range(STATES)), last=last, first=False)[0] for out in range(STATES)]
    return [columns[out][q] for q in range(STATES) for out in range(STATES)]


class Digest:
    """What is told of a conversation, row by row in order, with the edits of each row."""

    def __init__(self):
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial: str | None = None
        self.state, self.audit, self.hash, self.any = NOTHING, [], hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def add(self, turn: int | None, role: str, text: str, code: int, edits: str) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.turn = self.high = turn
            self.low = turn if self.low is None else self.low
        if code == GONE:
            self.blank += (empty := not text.rstrip(BLANKS))
            self.duplicate += not empty
        else:
            self.truncated += (code - 1) % 2
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.audit.append(edits)
        for letter in edits:
            if letter == "D":
                self.cost += DELETE
                continue
            to = _NEXT[self.state]
            if letter == "K":
                if role[:1] == "s":
                    to = SYSTEM
                self._say(role, text)
            else:
                self._say("user" if to == USER else "assistant", text if letter == "R" else "")
            self.cost += INSERT if letter == "I" else (REROLE if letter == "R" else 0) + UNFINISHED * ((code - 1) % 2)
            self.state = to

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = ("gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long", "audit string", "repaired_sha256 string")


def repaired(rows: list[tuple]) -> tuple:
    """The result of one conversation: its (turn, role, text) in order."""
    seen, codes = set(), bytearray()
    for _, role, text in rows:
        codes.append(code_of(role, text, (role, text) in seen))
        seen.add((role, text))
    told = Digest()
    if rows:
        edits = _SPLIT.findall(solve(bytes(codes))[1][NOTHING][0])
        for (turn, role, text), code, some in zip(rows, codes, edits, strict=True):
            told.add(turn, role, text, code, some)
    return told.row()


# --- Spark ---------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame, *, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
            text_column: str = "text") -> DataFrame:
    """conv, turn, role, text and `there`: the rows after the damage that the hash of their key names. A
    dropped row stays with `there` false, so that its conversation is known."""
    conv, turn = F.col(id_column), F.col(turn_column)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_column, text_column))
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    new_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).when(kind != 0, text)
    row = F.struct(
        conv.alias("conv"), turn.cast("long").alias("turn"), F.when(kind == 4, "user").when(kind != 0, role).alias("role"),
        new_text.alias("text"), (kind != 0).alias("there"),
    )
    copies = F.when(kind == 3, F.array(row, row)).otherwise(F.array(row))
    return conversations.select(F.explode(copies).alias("row")).select("row.*")


def given(conversations: DataFrame, *, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
          text_column: str = "text") -> DataFrame:
    """As `damaged`, with the rows as they are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_column, text_column))
    return conversations.select(
        F.col(id_column).alias("conv"), F.col(turn_column).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.lit(True).alias("there"),
    )


def _lists(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _local(rows: DataFrame) -> DataFrame:
    """Conversations inside one partition, repaired, and the rows of the others by `part` and `pos`."""
    place = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("role", "text"), F.col("serial")]
    # The serial splits equal rows; it has no say in results, as rows that differ in it only are equal.
    ordered = rows.withColumn("serial", F.monotonically_increasing_id()).repartitionByRange(*place).sortWithinPartitions(*place)
    kind = rows.schema["conv"].dataType.simpleString()
    fields = [*RESULT, "part int", "pos long", "turn long", "role string", "text string", "there boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready, first = TaskContext.get().partitionId(), [], [], True
        schema: pa.Schema | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

        def opened(conv, rows: list[tuple]) -> list[tuple]:
            return [(conv, *[None] * len(RESULT), part, i, *row) for i, row in enumerate(rows)]

        conv = None
        for batch in batches:
            if schema is None:
                names = ["conv", *[f.split()[0] for f in fields]]
                types = [batch.schema.field("conv").type, *[_TYPES[f.split()[1]] for f in fields]]
                schema = pa.schema(list(zip(names, types)))
            for other, *row in _lists(batch, "conv", "turn", "role", "text", "there"):
                if held and other != conv:
                    if first:
                        ready += opened(conv, held)
                    else:
                        ready.append((conv, *repaired([r[:3] for r in held if r[3]]), *[None] * 6))
                    first, held = False, []
                conv = other
                held.append(tuple(row))
            if ready:
                yield batch_of(ready)
                ready = []
        for begin in range(0, len(held), 1 << 14):
            some = opened(conv, held[begin : begin + (1 << 14)])
            yield batch_of([(*r[:10], r[10] + begin, *r[11:]) for r in some])

    return ordered.select("conv", "turn", "role", "text", "there").mapInArrow(run, ", ".join([f"conv {kind}", *fields]))


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _across(rows: DataFrame) -> DataFrame:
    """The results of the conversations whose rows are given by `part` and `pos`."""
    kind = rows.schema["conv"].dataType.simpleString()
    rows = rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "text", "role"))
    there = rows.where("there")
    firsts = there.groupBy(F.col("conv").alias("c"), F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.min(F.struct("part", "pos")).alias("first"))
    known = there.join(firsts, _same("conv", "c") & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    body = F.rtrim(F.translate("text", BLANKS, " " * len(BLANKS)))
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(3)
    code = F.when((body == "") | (F.col("first") != F.struct("part", "pos")), GONE).otherwise(
        1 + 2 * initial + F.when(F.substring(body, -1, 1).isin(*".!?"), 0).otherwise(1)
    )
    coded = stored(known.select("conv", "part", "pos", "turn", "role", "text", code.cast("int").alias("code")), "coded")
    ends = coded.groupBy("conv").agg(F.max("part").alias("end"))
    fragments = coded.select("conv", "part", "pos", "code").join(
        ends.withColumnRenamed("conv", "c"), _same("conv", "c")
    ).drop("c")

    def costs(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        codes = bytes(group["code"].to_numpy().astype(np.uint8))
        part = group["part"][0].as_py()
        return pa.table({"conv": group["conv"][:1], "part": pa.array([part], pa.int32()),
                         "cost": pa.array([matrix(codes, part == group["end"][0].as_py())], pa.list_(pa.int64()))})


    costs_of = stored(fragments.groupBy("conv", "part").applyInArrow(costs, f"conv {kind}, part int, cost array<long>"), "costs")

    def prices(group: pa.Table) -> pa.Table:
        """The exit prices of each fragment; there are as many as partitions at most."""
        group = group.sort_by("part")
        exits, made = END, []
        for cost in reversed(group["cost"].to_pylist()):
            made.append(list(exits))
            exits = tuple(min(FAR, *(cost[STATES * q + out] + exits[out] for out in range(STATES))) for q in range(STATES))
        return pa.table({"conv": group["conv"], "part": group["part"], "exits": pa.array(made[::-1], pa.list_(pa.int64()))})

    exits = costs_of.groupBy("conv").applyInArrow(prices, f"conv {kind}, part int, exits array<long>")
    priced = fragments.join(
        exits.select(F.col("conv").alias("c"), F.col("part").alias("p"), "exits"), _same("conv", "c") & (F.col("part") == F.col("p"))
    ).select("conv", "part", "pos", "code", "end", "exits")

    def edits(group: pa.Table) -> pa.Table:
        """Per row: its edits for each of the four states its fragment may be entered in."""
        group = group.sort_by("pos")
        codes = bytes(group["code"].to_numpy().astype(np.uint8))
        last = group["part"][0].as_py() == group["end"][0].as_py()
        _, walks = solve(codes, tuple(group["exits"][0].as_py()), last=last, first=False)
        ways = [_SPLIT.findall(letters) or [""] * len(codes) for letters, _ in walks]
        return pa.table({"conv": group["conv"], "part": group["part"], "pos": group["pos"],
                         "ways": pa.array([list(w) for w in zip(*ways, strict=True)], pa.list_(pa.string()))})

    ways = priced.groupBy("conv", "part").applyInArrow(edits, f"conv {kind}, part int, pos long, ways array<string>")
    full = coded.join(
        ways.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("pos").alias("o"), "ways"),
        _same("conv", "c") & (F.col("part") == F.col("p")) & (F.col("pos") == F.col("o")),
    ).select("conv", "part", "pos", "turn", "role", "text", "code", "ways")
    stream = full.repartition("conv").sortWithinPartitions("conv", "part", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = conv = part = entry = typ = None

        def done() -> pa.RecordBatch:
            values = [pa.array([v], _TYPES[f.split()[1]]) for v, f in zip(told.row(), RESULT)]
            return pa.RecordBatch.from_arrays([pa.array([conv], typ), *values], ["conv", *[f.split()[0] for f in RESULT]])

        for batch in batches:
            typ = batch.schema.field("conv").type
            for other, of, _, turn, role, text, code, ways in _lists(batch, "conv", "part", "pos", "turn", "role", "text", "code", "ways"):
                if told is None or other != conv:
                    if told is not None:
                        yield done()
                    told, part, conv = Digest(), None, other
                if of != part:
                    part, entry = of, told.state
                told.add(turn, role, text, code, ways[entry])
        if told is not None:
            yield done()

    results = stream.mapInArrow(run, ", ".join([f"conv {kind}", *RESULT]))
    every = rows.select("conv").distinct()
    empty = Digest().row()
    return every.join(results.withColumnRenamed("conv", "c"), _same("conv", "c"), "left").select(
        "conv", *[F.coalesce(f.split()[0], F.lit(v)).alias(f.split()[0]) for v, f in zip(empty, RESULT)]
    )


def repair(rows: DataFrame, *, id_column: str = "conv_id") -> DataFrame:
    """Per conversation: id, counts of faults, cost and letters of the cheapest edits, hash of the
    repaired conversation. `rows` come from `damaged` or `given`."""
    made = stored(_local(rows), "conversations")
    names = [f.split()[0] for f in RESULT]
    whole = made.where("part IS NULL").select("conv", *names)
    split = _across(made.where("part IS NOT NULL").select("conv", "part", "pos", "turn", "role", "text", "there"))
    return whole.union(split).withColumnRenamed("conv", id_column)
