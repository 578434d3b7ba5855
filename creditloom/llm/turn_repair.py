"""Repair of a conversation's role structure by a run-length dynamic programme.

A conversation is legal if its role initials are ``(s?(ua)+)?``. Four states tell how far a legal prefix is (nothing yet; a
system turn; a user turn; complete), so the cheapest way over one row is a 4 x 4 matrix in which costs add along a path and the
least of all paths counts (min-plus). Rows with the same role and fault have the same matrix. Runs of equal rows are collapsed, a run of
n rows is advanced through cached powers of two of its matrix, and the choices are unrolled afterwards from the costs that are still to go.

Nothing needs a whole conversation in memory. Rows are put in order by ranges of (conversation, turn), so a long conversation
lies in several tasks; what a task holds of a conversation is a piece, with runs and the product of their matrices. The
costs to go travel backwards over pieces; each piece is then unrolled by itself for every state it can start in, and a last stream picks
the start that fits, row by row. Texts are shuffled once, in that last step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from creditloom.llm.base import map_rows, ready
from creditloom.session import cut_lineage

# Costs of the edits; the order of the letters decides between equally cheap ones.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
TRUNCATED_COST = 1
FAR = 1 << 60

# States: nothing yet, a system turn, a user turn, complete.
STATES = range(4)
_EXPECTED = "uuau"
_AFTER = (2, 2, 3, 2)
ROLE = {"u": "user", "a": "assistant"}

# White space, and what a complete text ends with. Fixed values of the format.
BLANK = r"\A[\x20\x09-\x0D]*\z"
COMPLETE = r"[.!?][\x20\x09-\x0D]*+\z"
LEGAL_PAIRS = ("su", "ua", "au")


def symbol(initial: str, fault: int) -> tuple[str, int]:
    """What decides a row's matrix: its role initial (``-`` for any other) and 0 sound, 1 truncated or 2 to be deleted."""
    return ("-", 2) if fault >= 2 else (initial if initial and initial in "sua" else "-", fault)


def _ways(state: int, of: tuple[str, int]) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row in a state, in the order of their letters."""
    initial, fault = of
    found = [(DELETE, COST[DELETE], state)]
    if fault < 2:
        more = TRUNCATED_COST * fault
        if initial == _EXPECTED[state]:
            found.append((KEEP, COST[KEEP] + more, _AFTER[state]))
        elif initial == "s" and state == 0:
            found.append((KEEP, COST[KEEP] + more, 1))
        found.append((REROLE, COST[REROLE] + more, _AFTER[state]))
    return found


def _inserted(costs: tuple) -> tuple:
    """Costs to go when turns may be inserted first. Two insertions lead anywhere they ever should."""
    for _ in range(2):
        costs = tuple(min(costs[s], COST[INSERT] + costs[_AFTER[s]]) for s in STATES)
    return costs


# Costs to go after the last row.
END = _inserted((0, FAR, FAR, 0))


@lru_cache(maxsize=None)
def matrix(of: tuple[str, int]) -> np.ndarray:
    """Cost from state (row) to state (column) over one row, insertions before it included."""
    found = np.full((4, 4), FAR, dtype=np.int64)
    for target in STATES:
        costs = tuple(min([c for _, c, to in _ways(s, of) if to == target], default=FAR) for s in STATES)
        found[:, target] = np.minimum(_inserted(costs), FAR)
    return found


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product; also of a matrix and a vector."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1) if b.ndim == 2 else (a + b[None]).min(axis=1), FAR)


@lru_cache(maxsize=None)
def power(of: tuple[str, int], exponent: int) -> np.ndarray:
    """The matrix of ``2 ** exponent`` equal rows."""
    if not exponent:
        return matrix(of)
    half = power(of, exponent - 1)
    return times(half, half)


def advance(of: tuple[str, int], n: int, costs: np.ndarray) -> np.ndarray:
    """Costs to go before a run of ``n`` equal rows (or their matrix, from that of what follows)."""
    for exponent in range(n.bit_length()):
        if n >> exponent & 1:
            costs = times(power(of, exponent), costs)
    return costs


def product(runs: list) -> np.ndarray:
    """The matrix of a piece."""
    made = np.full((4, 4), FAR, dtype=np.int64)
    np.fill_diagonal(made, 0)
    for of, n in reversed(runs):
        made = advance(of, n, made)
    return made


@lru_cache(maxsize=1 << 16)
def _row(of: tuple[str, int], after: tuple) -> tuple[tuple, tuple]:
    """(costs to go before a row, per state its edits up to and with the row, and the next state), from those after it."""
    base = tuple(min(c + after[to] for _, c, to in _ways(s, of)) for s in STATES)
    before = _inserted(base)
    choices = []
    for state in STATES:
        letters, at = "", state
        while True:
            ways = [w for w in _ways(at, of) if w[1] + after[w[2]] == before[at]]
            # A deletion sorts before an insertion, an insertion before the rest.
            if ways and (ways[0][0] == DELETE or COST[INSERT] + before[_AFTER[at]] != before[at]):
                choices.append((letters + ways[0][0], ways[0][2]))
                break
            letters, at = letters + INSERT, _AFTER[at]
    return before, tuple(choices)


def _shifted(costs: tuple) -> tuple:
    """Costs relative to their least: all that choices depend on. They differ by a few edits at most."""
    least = min(costs)
    return tuple(c - least for c in costs)


@lru_cache(maxsize=1 << 14)
def _short(of: tuple[str, int], n: int, after: tuple, state: int) -> tuple[tuple[str, ...], int]:
    return _unrolled(of, n, after, state)


def _unrolled(of: tuple[str, int], n: int, after: tuple, state: int) -> tuple[tuple[str, ...], int]:
    """(edits per row, state at the end) of a run. Costs before r rows repeat from some r on, so few of them are worked out."""
    seen, steps, at = {}, [], after
    while at not in seen and len(steps) < n:
        seen[at] = len(steps)
        before, choices = _row(of, at)
        steps.append(choices)
        at = _shifted(before)
    start = seen.get(at, 0)
    cycle = max(len(steps) - start, 1)
    letters = []
    for left in range(n - 1, -1, -1):
        edit, state = steps[left if left < len(steps) else start + (left - start) % cycle][state]
        letters.append(edit)
    return tuple(letters), state


def unroll(runs: list, after: list[int], state: int) -> tuple[list[str], int]:
    """The cheapest, then ASCII-least edits of a piece, one text per row, and the state behind it; ``after`` are the costs to go there."""
    ahead, costs = [], np.array(after, dtype=np.int64)
    for of, n in reversed(runs):
        ahead.append(_shifted(tuple(costs.tolist())))
        costs = advance(of, n, costs)
    letters: list[str] = []
    for (of, n), left in zip(runs, reversed(ahead)):
        more, state = (_short if n <= 8 else _unrolled)(of, n, left, state)
        letters += more
    return letters, state


def tail(state: int) -> str:
    """The turns inserted after the last row."""
    return {0: "", 1: INSERT * 2, 2: INSERT, 3: ""}[state]


def applied(edits: str, state: int, role: str, text: str) -> tuple[list[tuple[str, str, str]], int]:
    """((edit, role, text) of the turns that a row's edits leave or delete, next state)."""
    turns = []
    for edit in edits:
        if edit == INSERT:
            turns.append((edit, ROLE[_EXPECTED[state]], ""))
            state = _AFTER[state]
        elif edit == DELETE:
            turns.append((edit, role, text))
        elif edit == REROLE:
            turns.append((edit, ROLE[_EXPECTED[state]], text))
            state = _AFTER[state]
        else:
            turns.append((edit, role, text))
            state = 1 if state == 0 and role[:1] == "s" else _AFTER[state]
    return turns, state


# Stages -------------------------------------------------------------------------------------------------------------

_ORDER = ("known", "turn", "role", "digest")
PIECE = "conv long, block int, known boolean, turn long, role string, digest string"
# Faults are 0 none, 1 truncated, 2 blank, 3 duplicate.
STATS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string"


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv, known, turn, role, digest, fault, again, pos) of all rows in order, without texts; written.

    ``pos`` grows along the order. Equal rows may lie in several ranges. ``again`` tells a text by its digest.
    """
    narrow = rows.filter("live").select(
        "conv", *_ORDER, "copies",
        F.when(F.col("text").rlike(BLANK), 2).when(F.col("text").rlike(COMPLETE), 0).otherwise(1).alias("fault"),
    )
    narrow = narrow.withColumn("__copy", F.explode(F.expr("sequence(1, copies)"))).drop("__copy", "copies")
    narrow = narrow.withColumn("__spread", F.monotonically_increasing_id())
    placed = narrow.repartitionByRange("conv", *_ORDER, "__spread").sortWithinPartitions("conv", *_ORDER).drop("__spread")
    return cut_lineage(placed.withColumn("pos", F.monotonically_increasing_id()))


class _Piece:
    """What is gathered of a conversation's rows in a task: runs and counts, no rows."""

    def __init__(self, conv, block: int, row: tuple):
        self.place = [conv, block, *row[:4]]
        self.runs: list = []
        self.faults, self.n, self.illegal, self.turns = [0] * 4, 0, 0, 0
        self.first_turn = self.last_turn = None
        self.first_role, self.last_role = row[2][:1], None

    def add(self, turn, role: str, fault: int) -> None:
        initial = role[:1]
        of = symbol(initial, fault)
        if self.runs and self.runs[-1][0] == of:
            self.runs[-1][1] += 1
        else:
            self.runs.append([of, 1])
        self.n += 1
        self.faults[fault] += 1
        self.illegal += self.last_role is not None and self.last_role + initial not in LEGAL_PAIRS
        self.last_role = initial
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn

    def made(self) -> list:
        return [
            *self.place, [f"{of[0]}{of[1]}" for of, _ in self.runs], [n for _, n in self.runs], product(self.runs).ravel().tolist(),
            self.n, self.faults[2], self.faults[3], self.faults[1], self.illegal, self.turns,
            self.first_turn, self.last_turn, self.first_role, self.last_role,
        ]


def _pieces(batches: Iterator[list]) -> Iterator[list]:
    """One row per (conversation, task), from rows in order: its place, runs, matrix and counts."""
    at, piece = None, None
    for columns in batches:
        out = []
        for conv, block, *row in zip(*columns):
            if at != (conv, block):
                if piece:
                    out.append(piece.made())
                at, piece = (conv, block), _Piece(conv, block, row)
            piece.add(row[1], row[2], row[4])
        yield [list(c) for c in zip(*out)] or [[]] * 19
    yield [[c] for c in piece.made()] if piece else [[]] * 19


def _behind(batches: Iterator[list]) -> Iterator[list]:
    """Costs to go behind each piece, the cost from its start if nothing stands before it, and whether that is so. Pieces fall."""
    last, costs, held = object(), None, None
    for columns in batches:
        out = []
        for conv, block, values in zip(*columns):
            if held is not None:
                out.append([*held, held[0] != conv])
            if conv != last:
                last, costs = conv, np.array(END, dtype=np.int64)
            after = costs.tolist()
            costs = times(np.array(values, dtype=np.int64).reshape(4, 4), costs)
            held = [conv, block, after, int(costs[0])]
        yield [list(c) for c in zip(*out)] or [[]] * 5
    yield [[c] for c in [*held, True]] if held is not None else [[]] * 5


def _unrolling(batches: Iterator[list]) -> Iterator[list]:
    """Edits of each piece for every state it can start in: one text per state, rows parted by commas, and the states behind it."""
    for *kept, symbols, sizes, after, first in batches:
        edits, exits = [], []
        for names, numbers, costs, starts in zip(symbols, sizes, after, first):
            runs = [((name[0], int(name[1])), n) for name, n in zip(names, numbers)]
            ways = [unroll(runs, costs, s) if s == 0 or not starts else ([], 0) for s in STATES]
            edits.append([",".join(letters) for letters, _ in ways])
            exits.append([state for _, state in ways])
        yield [*kept, edits, exits]


def _headers(rows: DataFrame) -> DataFrame:
    """Per piece the place of its first row, counts, and its edits and exits by start state."""
    ordered = _ordered(rows)
    block = F.shiftright("pos", 33).cast("int").alias("block")
    seen = ordered.groupBy("conv", F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    again = cut_lineage(seen.filter("n > 1").select(F.col("conv").alias("c"), "r", "d", "first"))
    same = ordered["conv"].eqNullSafe(again["c"]) & (ordered["role"] == again["r"]) & (ordered["digest"] == again["d"])
    marked = ordered.join(again, same, "left").select(
        "conv", block, "known", "turn", "role", "digest",
        F.when((F.col("fault") != 2) & (F.col("pos") > F.col("first")), 3).otherwise(F.col("fault")).alias("fault"), "pos",
    )
    marked = marked.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos").drop("pos")
    pieces = cut_lineage(map_rows(marked, _pieces, f"{PIECE}, symbols array<string>, sizes array<long>, matrix array<long>, {STATS}"))
    matrices = pieces.select("conv", "block", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    behind = map_rows(matrices, _behind, "c long, b int, after array<long>, cost long, first boolean")
    placed = pieces.join(behind, pieces["conv"].eqNullSafe(behind["c"]) & (pieces["block"] == behind["b"]))
    stats = [part.split()[0] for part in STATS.split(", ")]
    placed = placed.select("conv", "block", *_ORDER, *stats, "cost", "symbols", "sizes", "after", "first")
    return map_rows(placed, _unrolling, f"{PIECE}, {STATS}, cost long, edits array<string>, exits array<int>")


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str, live: Column, copies: Column) -> DataFrame:
    """Rows under names of our own. Nulls in role and text are one space; a null turn comes first."""
    ready(rows.sparkSession)
    body = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).isNotNull().alias("known"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.md5(body.cast("binary")).alias("digest"),
        body.alias("text"), live.alias("live"), copies.alias("copies"),
    )


def _streamed(rows: DataFrame, visit: Callable[[Iterator[tuple]], Iterator[list]], schema: str) -> DataFrame:
    """Run ``visit`` over tuples (conv, role, text, copies, live, header) in order: a piece's header before its rows.

    All rows of a conversation stream through one task, in order, and none is held.
    """
    none = F.lit(None)
    headers = _headers(rows)
    made = headers.select(
        "conv", *_ORDER, F.lit(0).alias("kind"), "block", none.cast("string").alias("text"), F.lit(0).alias("copies"), F.lit(True).alias("live"),
        F.struct(*[c for c in headers.columns if c not in ("conv", *_ORDER, "block")]).alias("header"),
    )
    texts = rows.select(
        "conv", *_ORDER, F.lit(1).alias("kind"), F.lit(0).alias("block"), F.when(F.col("live"), F.col("text")).alias("text"), "copies", "live",
        none.cast(made.schema["header"].dataType).alias("header"),
    )
    order = ("conv", F.desc("live"), *_ORDER, "kind", "block")
    stream = made.unionByName(texts).repartition("conv").sortWithinPartitions(*order)
    return map_rows(stream.select("conv", "role", "text", "copies", "live", "header"), visit, schema)


class _Reader:
    """The edits of a conversation as its rows come by."""

    def __init__(self) -> None:
        self.stats: dict = {}
        self.audit: list[str] = []
        self.turn_state = 0
        self.pieces: list[list[str]] = []
        self.enters = 0

    def header(self, h: dict) -> None:
        s = self.stats
        if not s:
            s.update({k: h[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "last_role", "cost")})
        else:
            s["illegal"] += h["illegal"] + (s["last_role"] + h["first_role"] not in LEGAL_PAIRS)
            for name in ("blank", "duplicate", "truncated"):
                s[name] += h[name]
            if h["turns"]:
                s["turns"] += h["turns"] - (s["last_turn"] == h["first_turn"])
                s["first_turn"] = h["first_turn"] if s["first_turn"] is None else s["first_turn"]
                s["last_turn"] = h["last_turn"]
            s["last_role"] = h["last_role"]
        # Pieces with equal first rows come together, in order; each gives its edits to the rows in turn.
        self.pieces.append(h["edits"][self.enters].split(",")[::-1])
        self.enters = h["exits"][self.enters]

    def row(self, role: str, text: str) -> list[tuple[str, str, str]]:
        while not self.pieces[0]:
            del self.pieces[0]
        edits = self.pieces[0].pop()
        self.audit.append(edits)
        turns, self.turn_state = applied(edits, self.turn_state, role, text)
        return turns

    def end(self) -> list[tuple[str, str, str]]:
        edits = tail(self.turn_state)
        self.audit.append(edits)
        turns, self.turn_state = applied(edits, self.turn_state, "", "")
        return turns


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    live: Column | None = None, copies: Column | None = None,
) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every conversation in their repaired order, deleted ones with a null place.

    Turns are taken by turn (nulls first), then role and the text's digest; nulls in role and text are one space. Only the
    cheapest edits count, of equally cheap ones those whose letters sort first. Repeated rows are duplicates of each other; a null id
    is a conversation of its own; a conversation without a live row has no turn here; an empty table gives no rows. Empty texts are blank and
    long ones are like any other. Other columns may have any name. ``live`` and ``copies``: rows that take part, and how often.
    """

    def visit(batches):
        last, reader, place = object(), None, 0

        def listed(out, conv, turns):
            nonlocal place
            for edit, r, t in turns:
                out.append((conv, None if edit == DELETE else place, edit, r, t))
                place += edit != DELETE

        for columns in batches:
            out: list = []
            for conv, r, t, n, alive, h in zip(*columns):
                if conv != last or reader is None:
                    if reader:
                        listed(out, last, reader.end())
                    last, reader, place = conv, _Reader(), 0
                if h is not None:
                    reader.header(h)
                elif alive:
                    for _ in range(n):
                        listed(out, conv, reader.row(r, t))
            yield [list(c) for c in zip(*out)] or [[]] * 5
        out = []
        if reader:
            listed(out, last, reader.end())
        yield [list(c) for c in zip(*out)] or [[]] * 5

    prepared = _prepared(rows, conv, turn, role, text, live if live is not None else F.lit(True), copies if copies is not None else F.lit(1))
    return _streamed(prepared, visit, "conv_id long, place long, edit string, role string, text string")


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def report(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    live: Column | None = None, copies: Column | None = None,
) -> DataFrame:
    """One row per conversation: its faults, the cost and letters of its edits, and the digest of the repaired turns.

    Cases are those of ``repair``; a conversation without a live row has zeros, no edits and the digest of an empty text. Only the
    digest and the letters of one conversation are held while its turns stream by.
    """

    def visit(batches):
        last, reader, digest, first = object(), None, None, True

        def hashed(turns):
            nonlocal first
            for edit, r, t in turns:
                if edit != DELETE:
                    digest.update(f"{'' if first else chr(10)}{r}:{t}".encode())
                    first = False

        def closed():
            s = reader.stats
            hashed(reader.end())
            audit = "".join(reader.audit)
            gaps = s["last_turn"] - s["first_turn"] + 1 - s["turns"] if s and s["turns"] else 0
            counts = [s[k] if s else 0 for k in ("blank", "duplicate", "truncated", "illegal", "cost")]
            return (last, gaps, *counts, audit, digest.hexdigest())

        for columns in batches:
            out: list = []
            for conv, r, t, n, alive, h in zip(*columns):
                if conv != last or reader is None:
                    if reader:
                        out.append(closed())
                    last, reader, digest, first = conv, _Reader(), hashlib.sha256(), True
                if h is not None:
                    reader.header(h)
                elif alive:
                    for _ in range(n):
                        hashed(reader.row(r, t))
            yield [list(c) for c in zip(*out)] or [[]] * 9
        out = [closed()] if reader else []
        yield [list(c) for c in zip(*out)] or [[]] * 9

    prepared = _prepared(rows, conv, turn, role, text, live if live is not None else F.lit(True), copies if copies is not None else F.lit(1))
    return _streamed(prepared, visit, REPORT)
