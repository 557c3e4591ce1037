"""Repair of conversation structure by an auction for shortest paths.

The edits of a conversation are a path over a lattice: a node is a place between rows with what has
been put out last (nothing, a system turn, a user turn, an assistant turn), an arc an edit with its
integer cost.  A node has a price, at first 0 or a bound below its distance to the end; a path grows
from its start along the arc of least cost and price while that equals the price of its last node, and
else raises this price and draws back.  When it arrives, the prices are an optimal dual: every cheapest
path consists of arcs without slack.  The lattice is cut into blocks of ``BLOCK`` rows, solved from the last to the
first with the prices between them as ends, so the work is linear in the rows.  The arcs without
slack that lead on to the end are then followed from the start by the least letter, which gives the
least of all cheapest edit strings.

Rows are dealt by conversation and sorted in their partition; a task holds the rows of one conversation,
as its edit string and the digest of its text are one value each.

Defined results: null roles, texts, turns and ids count as one space where names and digests are made; rows
are taken by turn (nulls first), role and text; a role counts by its first letter, an empty role
must be changed or deleted; repeated rows are duplicates; an empty table gives no rows; other
columns are ignored; texts may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscribe.llm.common import BLOCK_BYTES, arrow_rows, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of the lattice that are solved at once.
BLOCK = 32
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: States that the next turn of a role may follow.
AFTER = {"s": (NOTHING,), "u": (NOTHING, SYSTEM, ASSISTANT), "a": (USER,)}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}

Arc = tuple[str, int, int, int]


@lru_cache(maxsize=None)
def arcs(kind: str, fault: str) -> tuple[tuple[Arc, ...], ...]:
    """By state: ``letter, cost, rows passed, next state`` of the edits before a row of this role and fault."""
    out: list[list[Arc]] = [[], [], [], []]
    for state in range(4):
        out[state].append(("D", DELETE, 1, state))
        for role in "ua":
            if state in AFTER[role]:
                out[state].append(("I", INSERT, 0, STATE[role]))
                if fault not in ("blank", "duplicate"):
                    out[state].append(("R", REROLE + TRUNCATED * (fault == "truncated"), 1, STATE[role]))
        if kind in AFTER and state in AFTER[kind] and fault not in ("blank", "duplicate"):
            out[state].append(("K", KEEP + TRUNCATED * (fault == "truncated"), 1, STATE[kind]))
    return tuple(tuple(sorted(x)) for x in out)


#: After the last row only insertions are left.
LAST = tuple(tuple(("I", INSERT, 0, STATE[r]) for r in "ua" if s in AFTER[r]) for s in range(4))
#: Distance to the end of the states after the last row.
ENDS = (0, 2 * INSERT, INSERT, 0)


def auction(lattice: list[tuple[tuple[Arc, ...], ...]], ends: tuple[int, ...]) -> list[list[int]]:
    """Prices of the nodes before each row of a block, and of its ends: exact for the first row's."""
    last, floor = len(lattice), min(ends)
    price = [[floor] * 4 for _ in lattice] + [list(ends)]
    for origin in range(4):
        path = [(0, origin)]
        while path[-1][0] < last:
            row, state = path[-1]
            best, to = min((cost + price[row + on][after], (row + on, after)) for _, cost, on, after in lattice[row][state])
            if price[row][state] < best:
                price[row][state] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return price


def _tight(arc: Arc, row: int, state: int, price: list[list[int]]) -> bool:
    return price[row][state] == arc[1] + price[row + arc[2]][arc[3]]


def _leading(lattice: list[tuple[tuple[Arc, ...], ...]], price: list[list[int]]) -> list[list[bool]]:
    """Which nodes have a way to the ends over arcs without slack."""
    good = [[False] * 4 for _ in lattice] + [[True] * 4]
    for row in reversed(range(len(lattice))):
        for _ in range(3):  # insertions lead over at most two states of a row
            for state in range(4):
                good[row][state] |= any(_tight(a, row, state, price) and good[row + a[2]][a[3]] for a in lattice[row][state])
    return good


@lru_cache(maxsize=1 << 16)
def edits(kinds: str, faults: tuple[str, ...]) -> tuple[int, str]:
    """Least cost, and the least of the edit strings of that cost, of rows with these role letters and faults."""
    rows = [arcs(k, f) for k, f in zip(kinds, faults, strict=True)]
    blocks, ends = [], ENDS
    for a in reversed(range(0, len(rows), BLOCK)):
        price = auction(rows[a : a + BLOCK], ends)
        blocks.append((rows[a : a + BLOCK], price))
        ends = tuple(price[0])
    state, out = NOTHING, []
    for lattice, price in reversed(blocks):
        good, row = _leading(lattice, price), 0
        while row < len(lattice):
            letter, _, on, after = next(a for a in lattice[row][state] if _tight(a, row, state, price) and good[row + a[2]][a[3]])
            out.append(letter)
            row, state = row + on, after
    while state in (SYSTEM, USER):
        out.append("I")
        state = LAST[state][0][3]
    return ends[NOTHING], "".join(out)


_SOLID, _END = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def fault(role: str, text: str, seen: set[bytes]) -> str | None:
    """The first fault of a row: blank, duplicate or truncated; ``seen`` has the rows before it."""
    key = blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
    before = key in seen
    seen.add(key)
    if not _SOLID.search(text):
        return "blank"
    if before:
        return "duplicate"
    return None if _END.search(text) else "truncated"


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: rows dropped, emptied, stripped of stops, repeated or given the user's role by a checksum."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", value("role").alias("role"), value("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


ROWS = "conv_id long, pos long, edit string, turn long, role string, text string, was string, fault string, cost long"
_ROWS = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("was", pa.string()), ("fault", pa.string()), ("cost", pa.int64())])


def _repaired(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> Iterator[tuple]:
    seen: set[bytes] = set()
    faults = tuple(fault(role, text, seen) or "" for _, role, text in rows)
    cost, letters = edits("".join(role[:1] or "-" for _, role, _ in rows), faults)
    state, row = NOTHING, 0
    for pos, letter in enumerate(letters):
        turn, role, text = (None, "", "") if letter == "I" else rows[row]
        name, was = role, None if letter == "I" else role
        if letter in "IR":
            name = "assistant" if state == USER else "user"
        if letter != "D":
            state = STATE[name[0]]
        yield conv_id, pos, letter, turn, None if letter == "D" else name, text, was, None if letter == "I" else faults[row] or None, cost
        row += letter != "I"


def repair(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, edit, turn, role, text, was, fault, cost``: the rows of each conversation after its cheapest edits.

    ``edit`` is K(eep), R(erole), D(elete) or I(nsert), ``was`` the role before (null: inserted), ``role``
    the one after (null: deleted), ``cost`` that of the conversation.  Rows that are not deleted are the repaired conversation.
    """
    small_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return arrow_rows(_ROWS, {f.name: list(columns[i]) for i, f in enumerate(_ROWS)})

        def finished(conv_id: int | None, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            for row in _repaired(conv_id, rows):
                out.append(row)
                size += len(row[5])
                if size > BLOCK_BYTES or len(out) >= 4096:
                    yield flushed()
                    out.clear()
                    size = 0

        now, held = None, []
        for batch in batches:
            for conv_id, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if held and conv_id != now:
                    yield from finished(now, held)
                    held = []
                now = conv_id
                held.append((turn, role, text))
        if held:
            yield from finished(now, held)
        if out:
            yield flushed()

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, ROWS)


def _joined(condition: Column, value: Column, mark: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("pos", value.alias("v"))))), lambda x: x["v"]), mark)


def summary(repaired: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal pairs, cost, edits and the digest of the repaired text."""
    here = F.col("edit") != "I"
    letter = F.substring("was", 1, 1)
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.size(F.collect_set("turn"))
    letters = F.transform(F.array_sort(F.collect_list(F.when(here, F.struct("pos", letter.alias("v"))))), lambda x: x["v"])
    rows = repaired.groupBy("conv_id").agg(
        gaps.alias("gaps"), count("blank"), count("duplicate"), count("truncated"), F.max("cost").alias("cost"), letters.alias("letters"),
        _joined(F.lit(True), F.col("edit"), "").alias("audit"), F.sha2(_joined(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"), "\n"), 256).alias("repaired_sha256"),
    )
    pairs = F.zip_with(F.slice("letters", 1, F.greatest(F.size("letters") - 1, F.lit(0))), F.slice("letters", 2, F.size("letters")), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    return rows.withColumn("illegal", illegal).drop("letters")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage and repair of all conversations, one row for each; those of which nothing is left have zeros."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = summary(repair(damage(conversations))).withColumnRenamed("conv_id", "_id")
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
