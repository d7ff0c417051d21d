"""Repair of the role structure of conversations, by generalised LR parsing.

The role grammar is turned into an LR automaton. All stacks that the edits so far can
lead to are kept at once; stacks are nodes of a graph that share what lies below their
tops, and equal stacks are one node with the least (cost, audit). A row is kept, given
another role or deleted, and roles are inserted between rows, each for a cost.

The stacks of a left-recursive grammar are few, so what a run of rows does is a small
table: the least (cost, edits) from each stack to each other. A conversation is cut into
runs that are parsed side by side, and the tables of its runs are then chained, however
long the conversation is.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseloom.llm.arrow import held as worker_held
from caseloom.llm.linededup import BLANKS
from caseloom.session import stored

#: Conversations are pairs of user and assistant after at most one system row.
GRAMMAR = (("S", ""), ("S", "T"), ("S", "sT"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Counts of a conversation that are sums over its runs, but for the seams.
COUNTS = ("blank", "duplicate", "truncated", "illegal")
RUN_ROWS = 16_384
RUN_BITS = 16
BATCH_ROWS = 2_048


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Automaton:
    """LR(0) states of a grammar whose first left side is the start symbol."""

    def __init__(self, grammar: Iterable[tuple[str, str]]):
        self.rules = [("", next(iter(grammar))[0]), *grammar]
        self.start = self.rules[0][1]
        left = {a for a, _ in grammar}
        self.terminals = sorted({x for _, right in grammar for x in right} - left)
        self.states: list[frozenset] = []
        self.go: dict[tuple[int, str], int] = {}
        self._state({(0, 0)}, left)

    def _state(self, items: set[tuple[int, int]], left: set[str]) -> int:
        """Number of the state of these (rule, place) items; its successors are made, too."""
        work = list(items)
        while work:
            rule, place = work.pop()
            ahead = self.rules[rule][1][place : place + 1]
            for i, (a, _) in enumerate(self.rules):
                if ahead == a and ahead in left and (i, 0) not in items:
                    items.add((i, 0))
                    work.append((i, 0))
        state = frozenset(items)
        if state in self.states:
            return self.states.index(state)
        self.states.append(state)
        number = len(self.states) - 1
        for symbol in sorted({self.rules[r][1][p : p + 1] for r, p in state} - {""}):
            after = {(r, p + 1) for r, p in state if self.rules[r][1][p : p + 1] == symbol}
            self.go[number, symbol] = self._state(after, left)
        return number

    def complete(self, state: int) -> list[tuple[str, int]]:
        """Rules that may be reduced in a state: left side and length."""
        return [(self.rules[r][0], p) for r, p in self.states[state] if r and p == len(self.rules[r][1])]


class Repair:
    """Stacks of the role grammar and what rows do to them.

    A row is a letter: b or d must be deleted (blank, duplicate); s, u and a have that
    role and o any other; in upper case the row is truncated.
    """

    def __init__(self, grammar=GRAMMAR, costs: Costs = Costs()):
        self.lr, self.costs = Automaton(grammar), costs
        #: a stack is its top state and the stack below; equal stacks have one number
        self.stacks: list[tuple[int, int | None]] = []
        self.numbers: dict[tuple[int, int | None], int] = {}
        self.first = self._number(0, None)
        self._shifts: dict[tuple[int, str], frozenset[int]] = {}
        #: every stack that some sequence of roles leads to
        self.live = [self.first]
        for stack in self.live:
            for role in self.lr.terminals:
                self.live += sorted(self.shift(stack, role) - {*self.live})
        self.row = functools.lru_cache(None)(self._row)
        self.moves = functools.lru_cache(1 << 15)(self._moves)

    def _number(self, state: int, below: int | None) -> int:
        if (state, below) not in self.numbers:
            self.numbers[state, below] = len(self.stacks)
            self.stacks.append((state, below))
        return self.numbers[state, below]

    def _reduced(self, stack: int, at_end: bool) -> Iterator[int]:
        """The stack and all that reductions make of it; the start symbol only forms at the end."""
        work, seen = [stack], {stack}
        while work:
            yield (top := work.pop())
            for left, length in self.lr.complete(self.stacks[top][0]):
                if left == self.lr.start and not at_end:
                    continue
                below = top
                for _ in range(length):
                    below = self.stacks[below][1]
                after = self.lr.go.get((self.stacks[below][0], left))
                if after is not None and (new := self._number(after, below)) not in seen:
                    seen.add(new)
                    work.append(new)

    def shift(self, stack: int, role: str) -> frozenset[int]:
        """Stacks after a role; those that can only be reduced further are left out."""
        if (stack, role) not in self._shifts:
            state = self.lr.go.get((self.stacks[stack][0], role))
            found = () if state is None else self._reduced(self._number(state, stack), False)
            self._shifts[stack, role] = frozenset(s for s in found if self._open(self.stacks[s][0]))
        return self._shifts[stack, role]

    def _open(self, state: int) -> bool:
        """A state that goes on with a role, or ends a conversation."""
        ends = any(left == self.lr.start for left, _ in self.lr.complete(state))
        return ends or any((state, role) in self.lr.go for role in self.lr.terminals)

    def _accepts(self, stack: int) -> bool:
        goal = self.lr.go[0, self.lr.start]
        return any(self.stacks[s] == (goal, self.first) for s in self._reduced(stack, True))

    @functools.cached_property
    def inserted(self) -> dict[int, dict[int, tuple[int, str]]]:
        """Least (cost, edits) from each stack to others by inserting roles alone."""
        every = {}
        for origin in self.live:
            best, work = {origin: (0, "")}, [origin]
            while work:
                stack = work.pop()
                cost, edits = best[stack]
                for role in ROLES:
                    for after in self.shift(stack, role):
                        new = (cost + self.costs.insert, edits + "I")
                        if after not in best or new < best[after]:
                            best[after] = new
                            work.append(after)
            every[origin] = best
        return every

    def _row(self, letter: str) -> dict[int, list[tuple[int, int, str]]]:
        """For each stack before a row: (stack after, cost, edits), the least of each."""
        role, extra = letter.lower(), self.costs.truncated if letter.isupper() else 0
        table = {}
        for origin, reach in self.inserted.items():
            best: dict[int, tuple[int, str]] = {}

            def put(stack: int, cost: int, edits: str) -> None:
                if stack not in best or (cost, edits) < best[stack]:
                    best[stack] = cost, edits

            for stack, (cost, edits) in reach.items():
                put(stack, cost + self.costs.delete, edits + "D")
                if role in "bd":
                    continue
                for after in self.shift(stack, role) if role in self.lr.terminals else ():
                    put(after, cost + extra, edits + "K")
                for other in ROLES:
                    for after in self.shift(stack, other):
                        put(after, cost + extra + self.costs.rerole, edits + "R")
            table[origin] = [(stack, *value) for stack, value in best.items()]
        return table

    def _moves(self, letters: str, inside: bool) -> list[tuple[int, int, int, str]]:
        """What a run of rows does: (origin, stack, cost, edits), the least for each two stacks.

        A run ``inside`` a conversation may find any stack, others only the first one.
        """
        out = []
        for origin in self.live if inside else [self.first]:
            front = {origin: (0, 0, None)}
            for letter in letters:
                front = self.advance(front, self.row(letter))
            out += [(origin, stack, cost, written(chain)) for stack, (cost, _, chain) in front.items()]
        return out

    def advance(self, front: dict, table: dict[int, list[tuple[int, int, str]]]) -> dict:
        """Stacks with (cost, rank, chain) after one more table.

        Edits are compared without writing them out: ranks order the chains of the stacks
        in front. No chain begins another, since each ends with the edit of the same row.
        """
        best: dict[int, tuple] = {}
        for stack, (cost, rank, chain) in front.items():
            for after, more, edits in table.get(stack, ()):
                new = (cost + more, rank, edits)
                if after not in best or new < best[after][0]:
                    best[after] = new, chain
        order = {key: i for i, key in enumerate(sorted({b[0][1:] for b in best.values()}))}
        return {s: (value[0], order[value[1:]], (chain, value[2])) for s, (value, chain) in best.items()}

    def finish(self, front: dict) -> tuple[int, str]:
        """Least (cost, edits) of a whole conversation, with the roles that are still inserted."""
        cost, _, added, chain = min(
            ((cost + more, rank, added, chain)
            for stack, (cost, rank, chain) in front.items()
            for after, (more, added) in self.inserted[stack].items()
            if self._accepts(after)),
            key=lambda end: end[:3],
        )
        return cost, written(chain) + added


def written(chain) -> str:
    parts = []
    while chain is not None:
        chain, edits = chain
        parts.append(edits)
    return "".join(reversed(parts))


class Replay:
    """Follows chosen edits and tells the role that each one gives."""

    def __init__(self, repair: Repair):
        self.repair, self.stacks = repair, frozenset([repair.first])

    def __call__(self, role: str | None = None) -> str:
        """The role of a kept row, or without one the role that rerole and insert give here."""
        for letter in ROLES if role is None else (role,):
            after = frozenset(s for stack in self.stacks for s in self.repair.shift(stack, letter))
            if after:
                self.stacks = after
                return letter
        raise ValueError("the edits do not fit the grammar")


def repairer(costs: Costs) -> Repair:
    return worker_held(("roles", costs), lambda: Repair(costs=costs))


def _groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], most: int) -> Iterator[dict[str, list]]:
    """Columns of consecutive rows with equal keys, at most ``most`` rows at a time."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        same = list(zip(*(columns[k] for k in keys)))
        start = 0
        for i in range(1, len(same) + 1):
            if i < len(same) and same[i] == same[start] and i - start < most:
                continue
            before = tuple(held[k][0] for k in keys) if held else None
            if before == same[start] and len(held[keys[0]]) + i - start <= most:
                for name, values in columns.items():
                    held[name] += values[start:i]
            else:
                if held:
                    yield held
                held = {name: values[start:i] for name, values in columns.items()}
            start = i
    if held:
        yield held


def ordered(turns: DataFrame) -> DataFrame:
    """Rows by conversation and turn with their place ``at``, stored.

    Rows are dealt by ranges of (conversation, turn, role), so that a long conversation
    lies in many partitions.
    """
    plain = turns.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    )
    spread = plain.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return stored(spread.withColumn("at", F.monotonically_increasing_id()), "turns")


def row_letters(rows: DataFrame) -> DataFrame:
    """conv_id, at, turn, initial of the role, and the letter of each ordered row (see ``Repair``)."""
    bare = F.btrim("text", F.lit(BLANKS))
    told = rows.select(
        "conv_id",
        "at",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.xxhash64("conv_id", "role", "text").alias("h1"),
        F.xxhash64(F.lit(1), "conv_id", "role", "text").alias("h2"),
    )
    again = told.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("times")).where("times > 1")
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = (
        F.when(F.col("blank"), "b")
        .when(F.col("at") > F.col("first"), "d")
        .when(F.col("truncated"), F.upper(role))
        .otherwise(role)
    )
    marked = told.join(again.drop("times"), ["h1", "h2"], "left")
    return marked.select("conv_id", "at", "turn", "initial", letter.alias("letter"))


def _schema(letters: DataFrame, columns: str) -> T.StructType:
    """conv_id as the table has it, and more columns."""
    return T.StructType([letters.schema["conv_id"], *T.StructType.fromDDL(columns)])


MOVES = "array<struct<origin:int,stack:int,cost:bigint,edits:string>>"
RUN = (
    "at bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, low bigint, "
    f"high bigint, initials array<string>, moves {MOVES}"
)
VERDICT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def parsed_runs(letters: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per run of rows of a conversation: its counts and what it does to the stacks."""
    # a stretch is consecutive places of one partition of the ordered table
    dealt = letters.withColumn("stretch", F.shiftright("at", RUN_BITS))
    dealt = dealt.repartition("stretch").sortWithinPartitions("at")
    out = _schema(letters, RUN)
    arrow = to_arrow_schema(out)

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, before, rows = repairer(costs), None, []
        for run in _groups(batches, ("conv_id", "stretch"), RUN_ROWS):
            letters, turns = "".join(run["letter"]), [t for t in run["turn"] if t is not None]
            here = run["conv_id"][0], run["stretch"][0]
            # at the start of a stretch, or after a full run, a conversation may go on
            inside = here == before or not run["at"][0] & (1 << RUN_BITS) - 1
            before = here
            moves = (repair.moves if len(letters) < 64 else repair._moves)(letters, inside)
            rows.append(
                {
                    "conv_id": here[0],
                    "at": run["at"][0],
                    "blank": letters.count("b"),
                    "duplicate": letters.count("d"),
                    "truncated": sum(map(str.isupper, letters)),
                    "illegal": sum(a + b not in LEGAL for a, b in zip(run["initial"], run["initial"][1:])),
                    "n_turns": len(set(turns)),
                    "low": turns[0] if turns else None,
                    "high": turns[-1] if turns else None,
                    "initials": [run["initial"][0], run["initial"][-1]],
                    "moves": [dict(zip(("origin", "stack", "cost", "edits"), move)) for move in moves],
                }
            )
            if len(rows) >= BATCH_ROWS or len(letters) >= 64:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, arrow)

    return dealt.mapInArrow(runs, out)


def verdicts(runs: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Counts, least cost and its edits for each conversation that has rows."""
    out = _schema(runs, VERDICT)
    arrow = to_arrow_schema(out)

    def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, state, rows = repairer(costs), None, []

        def ended() -> dict:
            cost, audit = repair.finish(state["front"])
            low, high = state["low"], state["high"]
            gaps = 0 if low is None else high - low + 1 - state["n_turns"]
            return {k: state[k] for k in ("conv_id", *COUNTS)} | {"gaps": gaps, "cost": cost, "audit": audit}

        for part in _groups(batches, ("conv_id",), 64):
            for run in (dict(zip(part, values)) for values in zip(*part.values())):
                if state is not None and state["conv_id"] != run["conv_id"]:
                    rows.append(ended())
                    state = None
                if state is None:
                    state = run | {"front": {repair.first: (0, 0, None)}}
                else:
                    for name in COUNTS:
                        state[name] += run[name]
                    state["illegal"] += state["initials"][1] + run["initials"][0] not in LEGAL
                    state["initials"] = run["initials"]
                    if run["low"] is not None:
                        # the turn at the seam may be one of both
                        state["n_turns"] += run["n_turns"] - (state["high"] == run["low"])
                        state["low"] = run["low"] if state["low"] is None else state["low"]
                        state["high"] = run["high"]
                table: dict[int, list] = {}
                for move in run["moves"]:
                    table.setdefault(move["origin"], []).append((move["stack"], move["cost"], move["edits"]))
                state["front"] = repair.advance(state["front"], table)
            if len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows = []
        if state is not None:
            rows.append(ended())
        yield pa.RecordBatch.from_pylist(rows, arrow)

    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(chained, out)


def _edited(batches: Iterable[pa.RecordBatch], repair: Repair) -> Iterator[tuple]:
    """Conversation and (edit, role, text) of each row left; (conversation, None) after the last."""
    conv, audit, place, replay = None, None, 0, None

    def inserts() -> Iterator[tuple]:
        nonlocal place
        while audit[place : place + 1] == "I":
            place += 1
            yield conv, ("I", ROLES[replay()], "")

    for rows in _groups(batches, ("conv_id",), BATCH_ROWS):
        for at, role, text in zip(rows["at"], rows["role"], rows["text"]):
            if at < 0:  # the edits come before the rows they are for
                if audit is not None:
                    yield from inserts()
                    yield conv, None
                conv, audit, place, replay = rows["conv_id"][0], text, 0, Replay(repair)
                continue
            yield from inserts()
            edit = audit[place]
            place += 1
            if edit == "K":
                replay(role[:1])
                yield conv, (edit, role, text)
            elif edit == "R":
                yield conv, (edit, ROLES[replay()], text)
    if audit is not None:
        yield from inserts()
        yield conv, None


def _with_edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of each conversation in order, its edits before them."""
    edits = found.select("conv_id", F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv_id", "at", "role", "text").union(edits)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at")


def repaired_turns(rows: DataFrame, found: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role and text."""
    out = _schema(rows, "place bigint, edit string, role string, text string")
    arrow = to_arrow_schema(out)

    def edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = [], 0
        for conv, row in _edited(batches, repairer(costs)):
            if row is None:
                place = 0
                continue
            held.append((conv, place, *row))
            place += 1
            if len(held) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return _with_edits(rows, found).mapInArrow(edited, out)


def repaired_digests(rows: DataFrame, found: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """SHA-256 of each repaired conversation, as lines ``role:text``; rows stream through the task."""
    out = _schema(rows, "repaired_sha256 string")
    arrow = to_arrow_schema(out)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, first = [], hashlib.sha256(), True
        for conv, row in _edited(batches, repairer(costs)):
            if row is None:
                held.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                digest, first = hashlib.sha256(), True
                if len(held) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held = []
                continue
            digest.update(f"{'' if first else chr(10)}{row[1]}:{row[2]}".encode())
            first = False
        yield pa.RecordBatch.from_pylist(held, arrow)

    return _with_edits(rows, found).mapInArrow(digests, out)


def examined(turns: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """The ordered rows, and the verdict on each conversation, both stored."""
    rows = ordered(turns)
    return rows, stored(verdicts(parsed_runs(row_letters(rows), costs), costs), "verdicts")


def repair_roles(turns: DataFrame, conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Faults of every conversation, and the cheapest repair of its roles.

    ``turns`` has conv_id, turn, role and text; ``conversations`` names the conversations
    to report (column conv_id, repeats allowed). Returns conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit and repaired_sha256. See ``Repair`` for the grammar and
    ``Costs`` for the costs; ties between cheapest repairs go to the least audit.

    A null role or text is one blank (so such a text is blank); a null turn comes first
    and makes no gap; a null conv_id is a conversation of its own. Rows of one turn are
    in order of role and text. Repeated rows are duplicates. Roles that begin with other
    letters than s, u or a have to be changed or deleted. A conversation without rows, and
    an empty table, give zeros, an empty audit and the digest of nothing, or no row. Other
    columns are ignored. Long conversations are parsed in runs of at most 16,384 rows in
    many tasks; only the digest reads a conversation's rows in one task, as a stream.
    """
    rows, found = examined(turns, costs)
    digests = repaired_digests(rows, found, costs)
    known = found.join(digests.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    joined = every.join(known, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    empty = hashlib.sha256().hexdigest()
    return joined.select(
        F.col("_id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", *COUNTS, "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
