"""Shared helpers: staged tables, column hygiene and numpy tokenisation of Arrow text."""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscribe.sources.scratch import Workspace

#: Bytes of text that numpy works on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: Rows of an Arrow batch at most.
BATCH_ROWS = 2000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage durably."""
    table = Workspace(df.sparkSession, name).save(df, "rows")
    release(df.sparkSession)
    return table


def release(spark: SparkSession) -> None:
    """Ask Spark's cleaner for the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A bitmap has 2 ** BITMAP_BITS bits (8 MB), whatever the data; false bits only cost traffic.
BITMAP_BITS = 26


def bitmap(keys: DataFrame) -> np.ndarray:
    """64-bit words of the bitmap of the hashes in the one long column of ``keys``."""
    key = F.col(keys.columns[0])
    bit = F.shiftrightunsigned(key, 64 - BITMAP_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    found = keys.groupBy(F.shiftrightunsigned(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit hashes have their bit set."""
    bit = keys >> np.uint64(64 - BITMAP_BITS)
    return (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


#: Items that a task counts at once; beyond it, the rarer half is let go.
COUNTED = 400_000


def frequent(texts: DataFrame, items: Callable[[Counter], Counter], size: int, longest: int) -> list[str]:
    """The most frequent items of all texts, ``size`` at most, of at most ``longest`` bytes each.

    ``items`` turns counts of ``pieces`` into counts of items.  Every task counts its own texts and
    hands on at most ``size`` items.  A histogram of the counts (8 levels a doubling) gives the level
    from which on the items are few enough, so no task or driver sees more than ``size`` of them.
    The list only serves lookups that have another way for what it lacks.
    """
    out = pa.schema([("item", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                counts.update(pieces(text))
            if len(counts) > COUNTED:
                counts = Counter(dict(counts.most_common(COUNTED // 2)))
        best = [(i, n) for i, n in items(counts).most_common(size) if i and len(i.encode()) <= longest]
        yield arrow_rows(out, {"item": [i for i, _ in best], "n": [n for _, n in best]})

    counted = texts.select("text").mapInArrow(count, "item string, n long").groupBy("item").agg(F.sum("n").alias("n"))
    work = Workspace(texts.sparkSession, "frequent")
    counted = work.save(counted.withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "counted")
    left, least = size, None
    for level, n in sorted(counted.groupBy("level").count().collect(), reverse=True):
        if n > left:
            break
        left, least = left - n, level
    found = [] if least is None else counted.filter(F.col("level") >= least).select("item").toArrow()["item"].to_pylist()
    work.drop("counted")
    return found


_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_CLEAN = re.compile(r"\n?\S(?:.*\S)?", re.S).fullmatch


def pieces(text: str) -> list[str]:
    """The text cut at single spaces and before line breaks: the first piece is as it stands, a later
    one that begins with a line break follows on at once, any other follows on after a space."""
    return text.replace("\n", " \n").split(" ")


def clean(piece: str) -> bool:
    """Do the cuts on both sides of a piece lie between a space or line break and other characters.

    No pre-token of the vocabularies here reaches over a cut between two clean pieces."""
    return _CLEAN(piece) is not None


def uneven_pieces(text: str) -> list[str]:
    """The text cut at its clean cuts only, each part with the space or line break it begins with."""
    return _CUT.split(text)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit polynomial hash over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(kind: str, n: int) -> np.ndarray:
    base = _BASE if kind == "up" else _BASE_INVERSE
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES // 4)
        have = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base)]))
        if size <= 4 * BLOCK_BYTES:
            _powers[kind] = have
    return have


class Block:
    """Several whole texts as one byte array, with their words.

    ``data`` holds the bytes, ``offsets`` the texts' bounds in it; word ``i`` is
    ``data[start[i]:end[i]]`` of text ``doc[i]``.  Words are ``[^\\x20\\x09-\\x0D]+``.
    """

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1
        if len(data):
            solid = ~_SPACE[data]
            head = np.zeros(len(data) + 1, bool)
            head[offsets] = True
            begin = solid.copy()
            begin[1:] &= ~solid[:-1] | head[1:-1]
            stop = solid.copy()
            stop[:-1] &= ~solid[1:] | head[1:-1]
            self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes anywhere in the block."""
        if self._sums is None:
            terms = (self.data.astype(np.uint64) + np.uint64(1)) * _power("up", len(self.data) + 1)[: len(self.data)]
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        down = _power("down", len(self.data) + 1)
        raw = (self._sums[end] - self._sums[start]) * down[start]
        return mix(raw ^ ((end - start).astype(np.uint64) << np.uint64(40)))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def window_hash(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k``-word windows inside one text, and the first word of each."""
        if len(h) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(h) - k + 1
        out = np.zeros(m, np.uint64)
        for j in range(k):
            out = out * _ROLL + h[j : j + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        return mix(out[at]), at


def blocks(column: pa.Array) -> Iterator[Block]:
    """Blocks of whole texts of an Arrow string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        j = min(j, len(column))
        yield Block(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def arrow_rows(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    """A record batch of ``columns`` (numpy arrays, lists or Arrow arrays) in ``schema``."""
    arrays = []
    for field in schema:
        value = columns[field.name]
        arrays.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, nulls as empty texts; other columns never get in the way."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def keyed(rows: DataFrame, text: str = "text") -> DataFrame:
    """With ``text_key``, which tells the texts of one id apart; a null text is an empty one."""
    return rows.withColumn("text_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def rows_with(docs: DataFrame, keep: Callable[[Block], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text ``keep`` marks: a filter in one map-side pass."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch[text]):
                yield batch.slice(block.first, block.n).filter(pa.array(keep(block), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def small_batches(spark: SparkSession) -> None:
    """Bound the texts that a Python worker and its executor hold at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, BATCH_ROWS)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
