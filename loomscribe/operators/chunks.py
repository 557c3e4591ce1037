"""Chunking of files into line-tracked pieces.

``fixed_chunks`` is native.  The recursive splitter is sequential within a text, so it runs
as a small function over Arrow batches, as does the search for lines that no entity covers;
everything around it (spans by file, numbering) is joins and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def fixed_chunks(files: DataFrame, *keys: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``keys, chunk_idx, start, text``: overlapping character windows."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(step))
    cut = files.filter(F.length("content") > 0).select(*keys, "content", F.posexplode(starts).alias("chunk_idx", "start"))
    return cut.select(*keys, "chunk_idx", "start", F.substring("content", F.col("start") + 1, F.lit(size)).alias("text"))


Span = tuple[int, int]


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, base: int = 0) -> list[Span]:
    """Bounds of the chunks of ``text``, blanks at their ends left out.

    The first separator that occurs cuts the text, each piece keeping the one before it; pieces
    are merged up to ``size`` with a tail of ``overlap``, longer ones are cut by finer separators.
    """
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    mark, finer = separators[level], separators[level + 1 :]
    cuts = [0, *(m.start() for m in re.finditer(re.escape(mark), text)), len(text)] if mark else list(range(len(text) + 1))
    out, small = [], []
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= size:
            out += _merge(small, size, overlap) if small else []
            small = []
            out += split_text(text[a:b], size, overlap, finer, a) if finer else [(a, b)]
        elif a < b:
            small.append((a, b))
    out += _merge(small, size, overlap)
    return [(base + a, base + b) for a, b in (_stripped(text, *span) for span in out) if a < b]


def _merge(pieces: list[Span], size: int, overlap: int) -> list[Span]:
    """Adjoining pieces to chunks of at most ``size``, each beginning with at most ``overlap`` of the one before."""
    out, first = [], 0
    for k, (a, b) in enumerate(pieces):
        begin = pieces[first][0]
        if first < k and b - begin > size:
            out.append((begin, a))
            while first < k and (a - pieces[first][0] > overlap or b - pieces[first][0] > size):
                first += 1
    if pieces:
        out.append((pieces[first][0], pieces[-1][1]))
    return out


def _stripped(text: str, a: int, b: int) -> Span:
    body = text[a:b]
    return b - len(body.lstrip()), a + len(body.rstrip())


def with_lines(text: str, spans: list[Span]) -> list[tuple[str, int, int]]:
    """Chunks with their first and last line, by their place in the text."""
    found, line, seen = [], 1, 0
    for a, b in spans:
        line, seen = line + (text.count("\n", seen, a) if a >= seen else -text.count("\n", a, seen)), a
        found.append((text[a:b], line, line + text.count("\n", a, b)))
    return found


#: Characters of chunks that the splitter holds before it hands them on.
HANDED_CHARS = 1 << 22
_PIECES = [("piece_pos", pa.int32()), ("text", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32())]


def split_rows(rows: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """``keys, piece_pos, text, first_line, last_line``: the splitter over ``content``.

    Texts leave the Arrow batch one by one and chunks are handed on by bounded parts, so a batch of long
    texts is never held as Python objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [*((k, batch.schema.field(k).type) for k in keys), *_PIECES]
            out, held = [], 0

            def handed() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])

            for at in range(len(batch)):
                text = batch["content"][at].as_py() or ""
                if not text.strip():
                    continue
                key = [batch[k][at].as_py() for k in keys]
                for i, piece in enumerate(with_lines(text, split_text(text, size, overlap))):
                    out.append((*key, i, *piece))
                    held += len(piece[0])
                    if held >= HANDED_CHARS:
                        yield handed()
                        out, held = [], 0
            if out:
                yield handed()

    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "content").mapInArrow(run, f"{fields}, piece_pos int, text string, first_line int, last_line int")


def chunk_lines(files: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``repo_id, rel_path, piece_pos, text, start_line, end_line`` of whole files."""
    cut = split_rows(files, ["repo_id", "rel_path"], size, overlap)
    return cut.withColumnsRenamed({"first_line": "start_line", "last_line": "end_line"})


_RUNS = pa.schema([("repo_id", pa.string()), ("rel_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("piece_pos", pa.int32()), ("content", pa.string())])


def _by_file(files: DataFrame, entities: DataFrame, how: str = "left") -> DataFrame:
    """``repo_id, rel_path, content, all``: files with their entities; all that read it share its shuffles."""
    grouped = entities.groupBy("repo_id", "rel_path").agg(F.collect_list(F.struct(*(c for c in entities.columns if c not in ("repo_id", "rel_path")))).alias("all"))
    return files.select("repo_id", "rel_path", "content").join(grouped, ["repo_id", "rel_path"], how)


def _uncovered(content: str, first: list[int], last: list[int]) -> Iterator[tuple[int, int, str]]:
    """The runs of a text's lines outside the spans."""
    lines = content.split("\n")
    edge = [0] * (len(lines) + 2)
    for a, b in zip(first, last, strict=True):
        edge[min(a, len(lines) + 1)] += 1
        edge[min(b, len(lines)) + 1] -= 1
    covered = [c > 0 for c in accumulate(edge)]
    for inside, numbers in groupby(range(1, len(lines) + 1), covered.__getitem__):
        if not inside:
            numbers = list(numbers)
            yield numbers[0], numbers[-1], "\n".join(lines[numbers[0] - 1 : numbers[-1]])


def uncovered_runs(files: DataFrame, entities: DataFrame, size: int | None = None, overlap: int = 100) -> DataFrame:
    """``repo_id, rel_path, start_line, end_line, piece_pos, content``: the runs of lines that no entity's span covers.

    Spans are grouped by file and join it once; the lines of a file never leave its row.  With a ``size``, longer
    runs are split in the same pass, each piece with the run's range; chunks are handed on by bounded parts.
    """
    joined = _by_file(files, entities).select("repo_id", "rel_path", "content", F.col("all.start_line").alias("first"), F.col("all.end_line").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0

            def handed() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RUNS)], schema=_RUNS)

            for repo, path, content, first, last in zip(*(batch[c].to_pylist() for c in ("repo_id", "rel_path", "content", "first", "last")), strict=True):
                for a, b, text in _uncovered(content or "", first or [], last or []):
                    whole = size is None or len(text) <= size
                    pieces = [text] if whole else [text[i:j] for i, j in split_text(text, size, overlap) if text.strip()]
                    for i, piece in enumerate(pieces):
                        rows.append((repo, path, a, b, i, piece))
                        held += len(piece)
                        if held >= HANDED_CHARS:
                            yield handed()
                            rows, held = [], 0
            if rows:
                yield handed()

    return joined.mapInArrow(run, "repo_id string, rel_path string, start_line int, end_line int, piece_pos int, content string")


def uncovered_lines(files: DataFrame, entities: DataFrame) -> DataFrame:
    """``repo_id, rel_path, line_no, line``: the lines that no entity's span covers."""
    lines = uncovered_runs(files, entities).select("repo_id", "rel_path", "start_line", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    return lines.select("repo_id", "rel_path", (F.col("start_line") + F.col("i")).alias("line_no"), "line")


def islands(files: DataFrame, entities: DataFrame) -> DataFrame:
    """The uncovered runs of lines, blank ones dropped."""
    return uncovered_runs(files, entities).filter(F.col("content").rlike(r"\S")).drop("piece_pos")


def entity_texts(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with the text of their lines; a file meets all its entities in one join."""
    joined = _by_file(files, entities, "inner").select("repo_id", "rel_path", F.split("content", "\n").alias("lines"), "all")
    rows = joined.select("repo_id", "rel_path", "lines", F.explode("all").alias("e")).select("repo_id", "rel_path", "lines", "e.*")
    text = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return rows.withColumn("content", text).drop("lines").filter(F.col("content").rlike(r"\S"))


def chunk_entities(files: DataFrame, entities: DataFrame, size: int = 1500, overlap: int = 100) -> DataFrame:
    """``repo_id, rel_path, start_line, end_line, text, entity, entity_type, emit_pos``.

    Entities up to ``size`` characters are one chunk; longer ones are split, each piece with the lines
    that the pieces before it add up to, which is an estimate.  Runs of uncovered lines likewise: short ones
    are one chunk as they stand, longer ones are split, each piece with the run's range.
    """
    texts = entity_texts(files, entities)
    columns = ["repo_id", "rel_path", "start_line", "end_line", "text", "entity", "entity_type", "emit_pos"]
    named, short = texts.withColumnsRenamed({"name": "entity", "type": "entity_type"}), F.length("content") <= size
    whole = named.filter(short).withColumn("text", F.col("content")).withColumn("emit_pos", F.col("entity_pos") * 1000)
    keys = ["repo_id", "rel_path", "start_line", "end_line", "entity", "entity_type", "entity_pos"]
    split = split_rows(named.filter(~short), keys, size, overlap)
    before = F.coalesce(F.sum(F.col("last_line") - F.col("first_line") + 1).over(W.partitionBy("repo_id", "rel_path", "entity_pos").orderBy("piece_pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = (F.col("start_line") + before).cast("int")
    last = (first + F.col("last_line") - F.col("first_line")).cast("int")
    split = split.withColumn("a", first).withColumn("b", last).withColumn("emit_pos", F.col("entity_pos") * 1000 + F.col("piece_pos"))
    split = split.withColumn("start_line", F.col("a")).withColumn("end_line", F.col("b"))
    gaps = uncovered_runs(files, entities, size, overlap).filter(F.col("content").rlike(r"\S")).withColumnRenamed("content", "text")
    gaps = gaps.withColumns({"entity": F.lit(None).cast("string"), "entity_type": F.lit(None).cast("string"), "emit_pos": F.lit(1_000_000) + F.col("piece_pos")})
    return whole.select(columns).unionByName(split.select(columns)).unionByName(gaps.select(columns))


def chunk_index(files: DataFrame, entities: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``repo_id, file, chunk_idx, start_line, end_line, text, entity, entity_type`` of a corpus.

    Files with entities are cut along them, with the sizes of ``chunk_entities``, the others by lines; numbers run per file.
    """
    having = entities.select("repo_id", "rel_path").distinct()
    plain = chunk_lines(files.join(having, ["repo_id", "rel_path"], "left_anti"), size, overlap)
    plain = plain.withColumns({"entity": F.lit(None).cast("string"), "entity_type": F.lit(None).cast("string"), "emit_pos": F.col("piece_pos")}).drop("piece_pos")
    both = plain.unionByName(chunk_entities(files.join(having, ["repo_id", "rel_path"], "left_semi"), entities))
    order = W.partitionBy("repo_id", "rel_path").orderBy("start_line", "emit_pos", "text")
    return both.withColumn("chunk_idx", F.row_number().over(order) - 1).drop("emit_pos").withColumnRenamed("rel_path", "file")
