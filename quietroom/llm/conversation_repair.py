"""Repair of conversation structure by a run-length dynamic programme.

A row is a symbol: the class of its role's initial and its fault. The roles that may follow each
other are an automaton of four states, so a row is a 4 x 4 min-plus matrix: the least cost of coming
from one state to another by inserting before the row and keeping, rerolling or deleting it. Equal
consecutive symbols are collapsed to runs; a run is passed by the cached binary powers of its
symbol's matrix. The costs to go that this leaves at the ends of the runs let the choices be
unrolled from the front: of the letters that keep to the least cost the smallest, which makes the
smallest of the cheapest audits, as each letter leads to one state only.

Rows are dealt to ranges of (conversation, turn), so a conversation of any length is spread: a
stretch of it in one partition, of SEGMENT distinct rows at most, is a piece. Most conversations are
one piece and are solved where they lie. Of the others, the pieces' matrices are put together by
conversation, which gives each piece the costs to go at its end; it is unrolled from each of the four
states, and the pieces' exits then tell which one holds. Texts take no part in this: they join the
rows that stay by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietroom.llm.base import query, slices, stored, table

# Distinct rows of a piece.
SEGMENT = 65_536
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
MEMORY = 50_000

# Classes of role initials: other, s, u, a. States: start, after s, after u, after a.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {
    (0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2,
}
# The only state that an inserted or rerolled row can lead to, and its role.
FORCED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
ACCEPTED = (0, 3)
_KIND = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
GONE = 8  # symbol of a row that must be deleted; others are 2 * class + truncated
FAR = 1 << 60

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(
        tuple(min(min(a[i][k] + b[k][j] for k in range(4)), FAR) for j in range(4)) for i in range(4)
    )


def onto(a: Matrix, v: Vector) -> Vector:
    return tuple(min(min(x + y for x, y in zip(row, v, strict=True)), FAR) for row in a)


@cache
def inserts() -> Matrix:
    """Least costs of coming from one state to another by inserting alone."""
    rows = []
    for state in range(4):
        costs, cost = [FAR] * 4, 0
        while costs[state] > cost:
            costs[state] = cost
            state, cost = FORCED[state], cost + INSERT
        rows.append(tuple(costs))
    return tuple(rows)


UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


@cache
def power(symbol: int, exponent: int) -> Matrix:
    """The matrix of 2 ** exponent rows of a symbol."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    kind, cut = divmod(symbol, 2)
    extra = TRUNCATED * cut
    rows = []
    for state in range(4):
        costs = [FAR] * 4
        costs[state] = DELETE
        if symbol != GONE:
            costs[FORCED[state]] = min(costs[FORCED[state]], REROLE + extra)
            to = KEEP.get((state, kind))
            if to is not None:
                costs[to] = min(costs[to], extra)
        rows.append(tuple(costs))
    return times(inserts(), tuple(rows))


def run_onto(symbol: int, length: int, v: Vector) -> Vector:
    """The costs to go before a run, from those after it."""
    exponent = 0
    while length:
        if length & 1:
            v = onto(power(symbol, exponent), v)
        length, exponent = length >> 1, exponent + 1
    return v


def run_matrix(symbol: int, length: int) -> Matrix:
    out, exponent = UNIT, 0
    while length:
        if length & 1:
            out = times(out, power(symbol, exponent))
        length, exponent = length >> 1, exponent + 1
    return out


def ending() -> Vector:
    """Costs to go after the last row: by inserting, to a state that may end."""
    return tuple(min(row[state] for state in ACCEPTED) for row in inserts())


def costs_to_go(symbols: list[int], lengths: list[int], end: Vector) -> list[Vector]:
    """Before each run, and after the last."""
    out = [end]
    for symbol, length in zip(reversed(symbols), reversed(lengths), strict=True):
        out.append(run_onto(symbol, length, out[-1]))
    return out[::-1]


def unroll(
    symbols: list[int], lengths: list[int], state: int, end: Vector, closed: bool
) -> tuple[str, int]:
    """The smallest of the cheapest audits from ``state`` on, and the state that it leads to.

    ``closed``: the conversation ends here; otherwise inserting at the end is left to what follows.
    """
    ahead = costs_to_go(symbols, lengths, end)
    letters = []
    for at, (symbol, length) in enumerate(zip(symbols, lengths, strict=True)):
        if symbol == GONE:  # inserting first would never be smaller
            letters.append("D" * length)
            continue
        kind, cut = divmod(symbol, 2)
        extra, one = TRUNCATED * cut, power(symbol, 0)
        left = [ahead[at + 1]]  # costs to go with 0, 1, 2 ... rows of the run left
        while len(left) <= length:
            left.append(onto(one, left[-1]))
        while length:
            now, later = left[length], left[length - 1]
            forced, kept = FORCED[state], KEEP.get((state, kind))
            if now[state] == DELETE + later[state]:
                letters.append("D")
                length -= 1
            elif now[state] == INSERT + now[forced]:
                letters.append("I")
                state = forced
            elif kept is not None and now[state] == extra + later[kept]:
                letters.append("K")
                state, length = kept, length - 1
            else:
                letters.append("R")
                state, length = forced, length - 1
    while closed and state not in ACCEPTED:
        letters.append("I")
        state = FORCED[state]
    return "".join(letters), state


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with every twentieth row dropped and others made faulty.

    The remainder modulo 20 of the CRC-32 of ``conv_id:turn`` decides: 0 drops a row, 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it the user's. Nulls count as one space.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    drawn = F.crc32(F.concat_ws(":", *filled).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (
        rows.select("conv_id", "turn", "role", "text", drawn.alias("drawn"))
        .where("drawn <> 0")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.when(F.col("drawn") == 4, "user")
            .otherwise(F.coalesce("role", F.lit(" ")))
            .alias("role"),
            F.when(F.col("drawn") == 1, "")
            .when(F.col("drawn") == 2, F.translate(text, ".!?", ""))
            .otherwise(text)
            .alias("text"),
            F.explode(F.when(F.col("drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
                F.array(F.lit(0))
            )).alias("copy"),
        )
        .drop("copy")
    )


# A row's key without nulls: flags say whether conversation and turn are there.
CONVERSATION = ["has_conv", "conv"]
KEY = [*CONVERSATION, "has_turn", "at_turn", "role", "h1", "h2"]
PIECE = ["part", "k"]


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` as ``KEY`` columns and ``text``."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").isNotNull().alias("has_conv"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at_turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        text.alias("text"),
    )


def symbols(rows: DataFrame) -> DataFrame:
    """One row for each distinct row of ``keyed``: how often it occurs, its class and its fault.

    ``fault`` is that of the first copy: 0 none, 1 blank, 2 duplicate, 3 truncated; a further copy
    is blank or a duplicate. Whether a row is the first of its role and text is settled by a row
    for each such first, counted in with the others, so no role or text gathers in one task.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    ended = F.endswith(trimmed, F.lit(".")) | F.endswith(trimmed, F.lit("!"))
    ended = ended | F.endswith(trimmed, F.lit("?"))
    initial = F.substring("role", 1, 1)
    facts = rows.select(
        *KEY,
        F.when(initial == "s", SYSTEM).when(initial == "u", USER)
        .when(initial == "a", ASSISTANT).otherwise(OTHER).alias("kind"),
        (trimmed == "").alias("blank"),
        (~ended).alias("cut"),
    )
    spoken = [*CONVERSATION, "role", "h1", "h2"]
    firsts = (
        facts.where("NOT blank")
        .groupBy(*spoken)
        .agg(
            F.min("has_turn").alias("has_turn"),
            F.min(F.when(F.col("has_turn"), F.col("at_turn"))).alias("at_turn"),
        )
        .select(
            *[c if c != "at_turn" else F.when(F.col("has_turn"), F.col("at_turn"))
              .otherwise(0).alias("at_turn") for c in KEY],
            F.lit(None).cast("int").alias("kind"),
            F.lit(None).cast("boolean").alias("blank"),
            F.lit(None).cast("boolean").alias("cut"),
            F.lit(0).cast("long").alias("n"),
            F.lit(1).alias("first"),
        )
    )
    every = facts.withColumns({"n": F.lit(1).cast("long"), "first": F.lit(0)})
    counted = every.unionByName(firsts).groupBy(*KEY).agg(
        F.sum("n").alias("n"),
        F.max("first").alias("first"),
        F.max("kind").alias("kind"),
        F.max("blank").alias("blank"),
        F.max("cut").alias("cut"),
    )
    fault = F.when(F.col("blank"), 1).when(F.col("first") == 0, 2).when(F.col("cut"), 3)
    return counted.select(*KEY, "n", "kind", fault.otherwise(0).alias("fault"))


_LISTS = [("has_turn", pa.bool_()), ("at_turn", pa.int64()), ("role", pa.string()),
          ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())]
_FACTS = ["turns", "least_turn", "largest_turn", "blank", "duplicate", "truncated", "illegal",
          "first_kind", "last_kind"]
_PIECES = (
    "has_conv boolean, conv bigint, part int, k int, whole boolean, "
    + ", ".join(f"{c} bigint" for c in _FACTS)
    + ", matrix array<bigint>, symbols array<int>, lengths array<bigint>, cost bigint, audit string, "
    + "rows_has_turn array<boolean>, rows_at_turn array<bigint>, rows_role array<string>, "
    + "rows_h1 array<bigint>, rows_h2 array<bigint>, rows_n array<bigint>"
)
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True


class _Solved:
    """Cost and audit of whole conversations; equal runs are solved once."""

    def __init__(self):
        self.known: dict[tuple[bytes, bytes], tuple[int, str]] = {}

    def __call__(self, kinds: np.ndarray, lengths: np.ndarray) -> tuple[int, str]:
        key = (kinds.tobytes(), lengths.tobytes())
        if key not in self.known:
            if len(self.known) > MEMORY:
                self.known.clear()
            runs = kinds.tolist(), lengths.tolist()
            cost = costs_to_go(*runs, ending())[0][0]
            found = cost, unroll(*runs, 0, ending(), True)[0]
            if len(kinds) > 64:
                return found
            self.known[key] = found
        return self.known[key]


def _piece_rows(rows: pa.Table, starts: np.ndarray, whole: np.ndarray, part: int, k: int, solved):
    """A record batch of ``_PIECES``: one row for each stretch of ``rows`` from a start to the next."""
    n = rows["n"].to_numpy()
    kind, fault = rows["kind"].to_numpy(), rows["fault"].to_numpy()
    has, turn = rows["has_turn"].to_numpy(), rows["at_turn"].to_numpy()
    ends = np.append(starts[1:], len(n))
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    inner = np.ones(len(n), bool)  # the row before is of the same stretch
    inner[starts] = False

    def total(values):
        return np.add.reduceat(values.astype(np.int64), starts)

    legal = np.zeros(len(n), bool)
    legal[1:] = _LEGAL[kind[:-1], kind[1:]]
    new_turn = has.copy()
    new_turn[1:] &= ~(inner[1:] & has[:-1] & (turn[1:] == turn[:-1]))
    low = np.where(has, turn, np.iinfo(np.int64).max)
    high = np.where(has, turn, np.iinfo(np.int64).min)
    facts = {
        "turns": total(new_turn),
        "least_turn": np.minimum.reduceat(low, starts),
        "largest_turn": np.maximum.reduceat(high, starts),
        "blank": total(np.where(fault == 1, n, 0)),
        "duplicate": total(np.where(fault == 1, 0, n - 1 + (fault == 2))),
        "truncated": total(fault == 3),
        "illegal": total(n - 1) + total(inner & ~legal),
        "first_kind": kind[starts],
        "last_kind": kind[ends - 1],
    }
    first = np.where((fault == 1) | (fault == 2), GONE, 2 * kind + (fault == 3))
    symbol = np.stack([first, np.full(len(n), GONE)], 1).ravel().astype(np.int32)
    length = np.stack([np.ones(len(n), np.int64), n - 1], 1).ravel()
    of = np.repeat(owner, 2)[length > 0]
    symbol, length = symbol[length > 0], length[length > 0]
    begins = np.ones(len(symbol), bool)
    begins[1:] = (symbol[1:] != symbol[:-1]) | (of[1:] != of[:-1])
    begins = np.flatnonzero(begins)
    length, symbol, of = np.add.reduceat(length, begins), symbol[begins], of[begins]
    cuts = np.searchsorted(of, np.arange(len(starts) + 1))
    matrix, runs, cost, audit = [], [], [], []
    for i, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if whole[i]:
            found = solved(symbol[low:high], length[low:high])
            matrix.append(None)
            runs.append((None, None))
        else:
            runs.append((symbol[low:high].tolist(), length[low:high].tolist()))
            out = UNIT
            for s, m in zip(*runs[-1], strict=True):
                out = times(out, run_matrix(s, m))
            matrix.append([x for row in out for x in row])
            found = None, None
        cost.append(found[0])
        audit.append(found[1])
    offsets = pa.array(np.append(starts, len(n)).astype(np.int32))
    lists = [
        pa.ListArray.from_arrays(offsets, rows[name].combine_chunks().cast(kind_))
        for name, kind_ in _LISTS
    ]
    at = pa.array(starts)
    arrays = [
        rows["has_conv"].take(at).combine_chunks(),
        rows["conv"].take(at).combine_chunks(),
        pa.array(np.full(len(starts), part, np.int32)),
        pa.array(np.full(len(starts), k, np.int32)),
        pa.array(whole),
        *[pa.array(np.asarray(facts[name], np.int64)) for name in _FACTS],
        pa.array(matrix, pa.list_(pa.int64())),
        pa.array([a for a, _ in runs], pa.list_(pa.int32())),
        pa.array([b for _, b in runs], pa.list_(pa.int64())),
        pa.array(cost, pa.int64()),
        pa.array(audit, pa.string()),
        *lists,
    ]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _PIECES.split(", ")])


def pieces(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The rows of ``symbols`` in order, one row for each piece of a conversation, stored."""
    order = [*CONVERSATION, "has_turn", "at_turn", "role", "h1", "h2"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part, solved = TaskContext.get().partitionId(), _Solved()
        held, k, begun = None, 0, False
        # ``begun``: the first conversation of the partition is behind; it may have begun before.
        for batch in batches:
            found = pa.Table.from_batches([batch])
            held = found if held is None else pa.concat_tables([held, found])
            conv, has = held["conv"].to_numpy(), held["has_conv"].to_numpy()
            new = np.flatnonzero((conv[1:] != conv[:-1]) | (has[1:] != has[:-1])) + 1
            starts = np.append(0, new)
            if len(starts) > 1:
                done, last = held.slice(0, starts[-1]), held.slice(starts[-1])
                if not begun or k:
                    first = done.slice(0, starts[1])
                    yield _piece_rows(first, np.array([0]), np.array([False]), part, k, solved)
                    done, starts = done.slice(starts[1]), starts[1:] - starts[1]
                if len(starts) > 1:
                    whole = np.ones(len(starts) - 1, bool)
                    yield _piece_rows(done, starts[:-1], whole, part, 0, solved)
                held, k, begun = last, 0, True
            if len(held) >= segment:
                yield _piece_rows(held, np.array([0]), np.array([False]), part, k, solved)
                held, k = held.slice(0, 0), k + 1
                if not begun:
                    begun = True
        if held is not None and len(held):
            yield _piece_rows(held, np.array([0]), np.array([False]), part, k, solved)

    return stored(sorted_rows.mapInArrow(run, _PIECES), "conversation-pieces")


_TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _gaps(turns: int, least: int, largest: int) -> int:
    return largest - least + 1 - turns if turns else 0


def put_together(found: DataFrame) -> DataFrame:
    """For each open piece the costs to go at its end; the first one of each has the totals."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(PIECE, ignore_index=True)
        sums = {name: int(group[name].sum()) for name in _FACTS[3:7]}
        kinds = group[["first_kind", "last_kind"]].to_numpy()
        sums["illegal"] += int((~_LEGAL[kinds[:-1, 1], kinds[1:, 0]]).sum())
        # A turn that goes on in the next piece that has turns has been counted twice.
        dated = group[group["turns"] > 0]
        again = dated["largest_turn"].to_numpy()[:-1] == dated["least_turn"].to_numpy()[1:]
        turns = int(dated["turns"].sum()) - int(again.sum())
        sums["gaps"] = (
            _gaps(turns, int(dated["least_turn"].min()), int(dated["largest_turn"].max()))
            if len(dated) else 0
        )
        v, ends = ending(), []
        for flat in group["matrix"][::-1]:
            ends.append([int(x) for x in v])
            flat = [int(x) for x in flat]
            v = onto(tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4)), v)
        sums["cost"] = v[0]
        out = group[[*CONVERSATION, *PIECE]].copy()
        out["ahead"] = ends[::-1]
        out["last"] = [False] * (len(group) - 1) + [True]
        for name in _TOTALS:
            out[name] = [sums[name]] + [0] * (len(group) - 1)
        return out

    schema = "has_conv boolean, conv bigint, part int, k int, ahead array<bigint>, last boolean, "
    schema += ", ".join(f"{c} bigint" for c in _TOTALS)
    narrow = found.select(*CONVERSATION, *PIECE, *_FACTS, "matrix")
    return narrow.groupBy(*CONVERSATION).applyInPandas(run, schema)


def unrolled(found: DataFrame) -> DataFrame:
    """Open pieces with ``ahead, last``: for each state to start from, the exit and the audit."""

    def run(batches):
        for batch in batches:
            exits, audits = [], []
            rows = batch.select(["symbols", "lengths", "ahead", "last"]).to_pylist()
            for row in rows:
                ways = [
                    unroll(row["symbols"], row["lengths"], s, tuple(row["ahead"]), row["last"])
                    for s in range(4)
                ]
                exits.append([state for _, state in ways])
                audits.append([letters for letters, _ in ways])
            kept = [batch.column(c) for c in (*CONVERSATION, *PIECE)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(exits, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))],
                [*CONVERSATION, *PIECE, "exits", "audits"],
            )

    schema = "has_conv boolean, conv bigint, part int, k int, exits array<int>, audits array<string>"
    return found.select(*CONVERSATION, *PIECE, "symbols", "lengths", "ahead", "last").mapInArrow(
        run, schema
    )


def entries(found: DataFrame) -> DataFrame:
    """``entry``: the state in which each open piece starts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(PIECE, ignore_index=True)
        state, out = 0, []
        for exits in group["exits"]:
            out.append(state)
            state = int(exits[state])
        return group[[*CONVERSATION, *PIECE]].assign(entry=out)

    schema = "has_conv boolean, conv bigint, part int, k int, entry int"
    narrow = found.select(*CONVERSATION, *PIECE, "exits")
    return narrow.groupBy(*CONVERSATION).applyInPandas(run, schema)


def edits(found: DataFrame) -> DataFrame:
    """The rows that stay or come in, from pieces with ``entry`` and ``audit``.

    ``KEY`` columns of the row before the repair (null for inserted rows), ``part, k, i`` for the
    order within the conversation, ``edit`` and ``new_role`` (null: as it was).
    """
    schema = (
        "has_conv boolean, conv bigint, part int, k int, i bigint, has_turn boolean, "
        "at_turn bigint, role string, h1 bigint, h2 bigint, edit string, new_role string"
    )
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2048)):
            lists = {name: batch.column(f"rows_{name}") for name, _ in _LISTS}
            cells = {name: column.flatten() for name, column in lists.items()}
            begins = np.cumsum([0, *lists["n"].value_lengths().to_pylist()]).tolist()
            counts = cells["n"].to_pylist()
            kinds = [_KIND.get(role[:1], OTHER) for role in cells["role"].to_pylist()]
            owner, source, letters, roles, number = [], [], [], [], []
            audits, states = batch.column("audit").to_pylist(), batch.column("entry").to_pylist()
            for piece, (audit, state) in enumerate(zip(audits, states, strict=True)):
                at, copies, i = begins[piece], 0, 0
                for letter in audit:
                    if letter == "K":
                        state = KEEP[state, kinds[at]]
                    elif letter != "D":
                        state = FORCED[state]
                    if letter != "D":
                        owner.append(piece)
                        source.append(None if letter == "I" else at)
                        letters.append(letter)
                        roles.append(None if letter == "K" else ROLE[state])
                        number.append(i)
                        i += 1
                    if letter != "I":  # a row's further copies follow it, and are deleted
                        copies += 1
                        if copies == counts[at]:
                            at, copies = at + 1, 0
            piece, rows = pa.array(owner, pa.int64()), pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(piece) for c in (*CONVERSATION, *PIECE)],
                    pa.array(number, pa.int64()),
                    *[cells[c].take(rows) for c in ("has_turn", "at_turn", "role", "h1", "h2")],
                    pa.array(letters, pa.string()),
                    pa.array(roles, pa.string()),
                ],
                names,
            )

    lists = [f"rows_{name}" for name, _ in _LISTS]
    return found.select(*CONVERSATION, *PIECE, "entry", "audit", *lists).mapInArrow(run, schema)


@dataclass
class Repair:
    """``conversations``: one row each, with faults, cost and audit. ``rows``: what they become."""

    conversations: DataFrame
    rows: DataFrame


def repair(rows: DataFrame, segment: int = SEGMENT) -> Repair:
    """Repair the structure of the conversations in ``conv_id, turn, role, text`` rows.

    The rows of a conversation follow each other by turn, nulls first; rows that share a turn by
    role and then by a hash of the text. Nulls in role and text are one space; a null ``conv_id`` is
    a conversation of its own. A row is blank (nothing but white space), else a duplicate (role and
    text seen earlier), else truncated (its last character that is no white space isn't one of
    ``.!?``). Kept rows cost 0, rows set to user or assistant 3, deleted ones 4 (blank rows and
    duplicates must be), inserted ones 3, truncated rows that stay 3 more. What is left begins with
    at most one role in s and then alternates between roles in u and a, ending with a, or is empty.

    ``conversations``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row
    for each conversation that has rows; the audit is the ASCII-least among the cheapest. ``rows``:
    ``conv_id, part, k, i, edit, turn, role, text``, where the repaired conversation is in the order
    of ``part, k, i``; inserted rows have a null turn and an empty text. Repeated rows are
    duplicates like others. Further columns are not used. An empty table gives empty tables.
    """
    named = keyed(rows)
    found = pieces(symbols(named), segment)
    open_ones = found.where("NOT whole")
    ahead = stored(put_together(open_ones), "conversation-costs")
    ways = stored(unrolled(open_ones.join(ahead, [*CONVERSATION, *PIECE])), "conversation-audits")
    chosen = ways.join(entries(ways), [*CONVERSATION, *PIECE]).select(
        *CONVERSATION, *PIECE, "entry", F.get("audits", F.col("entry")).alias("audit")
    )
    chosen = stored(chosen, "conversation-choices")

    id_of = F.when(F.col("has_conv"), F.col("conv")).alias("conv_id")
    solved = found.where("whole").select(
        id_of,
        F.when(F.col("turns") > 0, F.col("largest_turn") - F.col("least_turn") + 1 - F.col("turns"))
        .otherwise(0).alias("gaps"),
        *_TOTALS[1:],
        "audit",
    )
    letters = F.sort_array(F.collect_list(F.struct("part", "k", "audit")))
    long_ones = (
        ahead.join(chosen, [*CONVERSATION, *PIECE])
        .groupBy(*CONVERSATION)
        .agg(
            *[F.sum(c).alias(c) for c in _TOTALS],
            F.array_join(F.transform(letters, lambda x: x["audit"]), "").alias("audit"),
        )
        .select(id_of, *_TOTALS, "audit")
    )

    lists = [f"rows_{name}" for name, _ in _LISTS]
    begun = found.where("whole").select(
        *CONVERSATION, *PIECE, F.lit(0).alias("entry"), "audit", *lists
    ).unionByName(
        open_ones.drop("audit").join(chosen, [*CONVERSATION, *PIECE])
        .select(*CONVERSATION, *PIECE, "entry", "audit", *lists)
    )
    kept = edits(begun)
    texts = named.groupBy(*KEY).agg(F.min("text").alias("text"))
    place = [id_of, *PIECE, "i", "edit"]
    old = kept.where("edit <> 'I'").join(texts, KEY).select(
        *place,
        F.when(F.col("has_turn"), F.col("at_turn")).alias("turn"),
        F.coalesce("new_role", "role").alias("role"),
        "text",
    )
    new = kept.where("edit = 'I'").select(
        *place, F.lit(None).cast("long").alias("turn"), F.col("new_role").alias("role"),
        F.lit("").alias("text"),
    )
    return Repair(solved.unionByName(long_ones), old.unionByName(new))


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, sha256``: hash of ``role:text`` of a repaired conversation's rows, newline-joined.

    A hash is sequential, so a conversation's rows stream through one task, in batches; no task
    holds more of them at a time.
    """
    order = ["has_conv", "conv_id", *PIECE, "i"]
    ready = (
        rows.withColumn("has_conv", F.col("conv_id").isNotNull())
        .withColumn("line", F.concat("role", F.lit(":"), "text"))
        .select(*order, "line")
        .repartition("conv_id")
        .sortWithinPartitions(*order)
    )

    def run(batches):
        held, state = None, None
        for batch in batches:
            names, out = [], []
            lines = batch.column("line").cast(pa.binary()).to_pylist()
            for conv, line in zip(batch.column("conv_id").to_pylist(), lines, strict=True):
                if state is None or conv != held:
                    if state is not None:
                        names.append(held)
                        out.append(state.hexdigest())
                    held, state = conv, hashlib.sha256(line)
                else:
                    state.update(b"\n")
                    state.update(line)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(out, pa.string())], ["conv_id", "sha256"]
            )
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([held], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "sha256"]
            )

    return ready.mapInArrow(run, "conv_id bigint, sha256 string")


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damage(rows))
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    hashes = digests(found.rows).withColumnsRenamed({"conv_id": "hash_id", "sha256": "hash"})
    results = found.conversations.withColumnRenamed("conv_id", "found_id")
    return (
        ids.join(results, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
        .join(hashes, F.col("conv_id").eqNullSafe(F.col("hash_id")), "left")
        .select(
            "conv_id",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _TOTALS],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("hash", F.lit(EMPTY_HASH)).alias("repaired_sha256"),
        )
    )
