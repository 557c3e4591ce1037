"""Chat formatting by schema fingerprints.

A record is JSON of any layout.  Its fingerprint is the hash of those of its nested field paths
that some layout declares, and selects one of the ``LAYOUTS``: a SQL expression that maps the
record to canonical turns.  A path through an array (``messages[].content``) is there if any element
has it.  Fields that no layout knows do not count; if the fingerprint fits none, the first layout
whose paths the record all has is taken, those with a ``system`` text first.  Content parts are
joined by line breaks, parts without text and tool calls are kept as JSON.  Turns are then rendered one by one with markers around
role and text; a backslash escape keeps marker strings inside texts apart and is undone on
reading.  A formatted conversation is a sequence of pieces, one row per turn, so none has
to fit in memory; reading back streams over pieces sorted by conversation and turn.

Defined results: null roles and texts are empty, and a null or empty ``system`` gives no turn; texts of
any length are whole; equal turns of one conversation are
ordered by role and text; repeated records repeat their turns; a record that is null, no JSON or
of no known layout is kept as one turn of role ``unmapped`` with the record as its text, and is
also returned by ``unmapped``; extra columns are ignored; an empty table gives no rows.  All
turns of one conversation are read by one task, which its digest needs; they stream through, so
only one turn is held at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscribe.llm.common import arrow_rows

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
_PIECE = re.compile(r"\A<\|im_start\|>(.*?)\n(.*)<\|im_end\|>\n\Z", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


@dataclass(frozen=True)
class Layout:
    """``paths``: the field paths that the layout needs, in order; ``turns``: SQL over the variant
    ``v`` that gives ``array<struct<role, text>>``; ``turn``: SQL of the first number."""

    name: str
    paths: tuple[str, ...]
    turns: str
    turn: str = "0L"


def _messages(field: str, role: str, text: str) -> str:
    part = "coalesce(try_variant_get(p, '$.text', 'string'), try_variant_get(p, '$', 'string'), to_json(p))"
    parts = f"array_join(transform(try_variant_get(m, '$.{text}', 'array<variant>'), p -> {part}), '\n')"
    calls = "nullif(to_json(try_variant_get(m, '$.tool_calls', 'variant')), 'null')"
    said = f"concat_ws('\n', nullif(coalesce({parts}, try_variant_get(m, '$.{text}', 'string')), ''), {calls})"
    turn = f"struct(try_variant_get(m, '$.{role}', 'string') as role, {said} as text)"
    return f"transform(try_variant_get(v, '$.{field}', 'array<variant>'), m -> {turn})"


def _text(field: str) -> str:
    return f"try_variant_get(v, '$.{field}', 'string')"


def _pair(user: str, assistant: str) -> str:
    return f"array(struct('user' as role, {user} as text), struct('assistant' as role, {_text(assistant)} as text))"


_INPUT = f"concat_ws('\n\n', {_text('instruction')}, nullif({_text('input')}, ''))"
_CHAT, _SHARE = _messages("messages", "role", "content"), _messages("conversations", "from", "value")
_ROWS = f"array(struct({_text('role')} as role, {_text('text')} as text))"
_RECORDS = (
    Layout("messages with calls", ("messages[].content", "messages[].role", "messages[].tool_calls"), _CHAT),
    Layout("messages", ("messages[].content", "messages[].role"), _CHAT),
    Layout("calls", ("messages[].role", "messages[].tool_calls"), _CHAT),
    Layout("from and value", ("conversations[].from", "conversations[].value"), _SHARE),
    Layout("prompt and completion", ("completion", "prompt"), _pair(_text("prompt"), "completion")),
    Layout("prompt and response", ("prompt", "response"), _pair(_text("prompt"), "response")),
    Layout("instruction and input", ("input", "instruction", "output"), _pair(_INPUT, "output")),
    Layout("instruction", ("instruction", "output"), _pair(_text("instruction"), "output")),
)


def with_system(layout: Layout) -> Layout:
    """The layout with a ``system`` text beside its fields, which becomes the first turn."""
    first = f"filter(array(struct('system' as role, {_text('system')} as text)), t -> t.text <> '')"
    return Layout(f"{layout.name}, system", tuple(sorted((*layout.paths, "system"))), f"concat({first}, {layout.turns})", layout.turn)


LAYOUTS = (
    Layout("turn rows", ("role", "text", "turn"), _ROWS, "try_variant_get(v, '$.turn', 'long')"),
    *(with_system(layout) for layout in _RECORDS),
    *_RECORDS,
)
#: The role of a record that no layout fits.
UNMAPPED = "unmapped"
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def _known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths})


def _has(path: str) -> Column:
    """Has the variant ``v`` a field at the path, be it null; of an array, any element."""
    array, _, field = path.partition("[].")
    if field:
        any_of = f"exists(try_variant_get(v, '$.{array}', 'array<variant>'), m -> variant_get(m, '$.{field}', 'variant') is not null)"
        return F.expr(f"coalesce({any_of}, false)")
    return F.expr(f"variant_get(v, '$.{path}', 'variant') is not null")


def fingerprint(layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of those nested field paths of the variant ``v`` that the layouts know."""
    return F.xxhash64(F.concat_ws(" ", *(F.when(_has(p), F.lit(p)) for p in _known_paths(layouts))))


def _mapped(records: DataFrame, layouts: tuple[Layout, ...]) -> DataFrame:
    """``conv_id, record, layout`` (its number, null if none fits), ``turns, first``."""
    marked = records.select("conv_id", F.col("record").cast("string").alias("record"), F.try_parse_json("record").alias("v"))
    marked = marked.withColumn("print", fingerprint(layouts))
    exact, wide = [F.lit(None).cast("int")] * 2
    for number, layout in reversed(list(enumerate(layouts))):
        exact = F.when(F.col("print") == F.xxhash64(F.lit(" ".join(layout.paths))), number).otherwise(exact)
        all_there = F.lit(True)
        for path in layout.paths:
            all_there = all_there & _has(path)
        wide = F.when(all_there, number).otherwise(wide)
    marked = marked.withColumn("layout", F.coalesce(exact, wide))
    turns = first = F.lit(None)
    for number, layout in enumerate(layouts):
        turns = F.when(F.col("layout") == number, F.expr(layout.turns)).otherwise(turns)
        first = F.when(F.col("layout") == number, F.expr(layout.turn)).otherwise(first)
    return marked.select("conv_id", "record", "layout", turns.alias("turns"), first.alias("first"))


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id, turn, role, text`` of records (``conv_id``, JSON text ``record``)."""
    role = F.coalesce("t.role", F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    whole = F.array(F.struct(F.lit(UNMAPPED).alias("role"), F.col("record").alias("text")))
    found = _mapped(records, layouts).select("conv_id", "first", F.posexplode(F.coalesce("turns", whole)).alias("pos", "t"))
    return found.select(
        "conv_id",
        (F.coalesce("first", F.lit(0).cast("long")) + F.col("pos")).alias("turn"),
        F.coalesce(F.try_element_at(names, role), role).alias("role"),
        F.coalesce("t.text", F.lit("")).alias("text"),
    )


def unmapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id, record`` of the records that no layout fits."""
    return _mapped(records, layouts).filter("turns is null").select("conv_id", "record")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, piece, loss_from, loss_to``: rendered turns and, for assistants,
    the code-point span of the piece under the loss mask (else empty)."""
    head = F.concat(F.lit(BEGIN), F.replace(_escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = _escaped(F.col("text"))
    learned = F.col("role") == "assistant"
    return turns.select(
        "conv_id",
        "turn",
        F.concat(head, body, F.lit(END)).alias("piece"),
        F.when(learned, F.length(head)).otherwise(0).cast("long").alias("loss_from"),
        F.when(learned, F.length(head) + F.length(body)).otherwise(0).cast("long").alias("loss_to"),
    )


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def parse_piece(piece: str) -> tuple[str, str]:
    """The role and text of one rendered turn."""
    role, text = _PIECE.match(piece).groups()
    return unescape(role), unescape(text)


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SUMMARY = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
    + [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


class _Reader:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, loss_from: int, loss_to: int) -> None:
        role, text = parse_piece(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        learned = unescape(piece[loss_from:loss_to])
        self.loss.update(learned.encode())
        self.n, self.loss_chars, self.chars = self.n + 1, self.loss_chars + len(learned), self.chars + len(piece)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its pieces say."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reader | None = None
        for batch in batches:
            done = []
            for conv, piece, a, b in zip(*(batch[c].to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_to")), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv)
                now.add(piece, a, b)
            yield _rows(done)
        if now is not None:
            yield _rows([now.row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return ordered.mapInArrow(read, SUMMARY)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_SUMMARY)
    return arrow_rows(_SUMMARY, {f.name: list(c) for f, c in zip(_SUMMARY, columns, strict=True)})
