"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Every document's ids (an end id follows) are cut into pieces of at most ``LENGTH``.  Pieces
are dealt by hash into groups of about ``GROUP``, and a group is packed by itself: a sequence is filled
greedily with the longest pieces that fit; if a gap is left, its smallest piece is taken
out and the two unpacked pieces that fill the widened gap most tightly go in, if they fill
more.  Only lengths and keys take part, so a group is a few megabytes however large the corpus is.

Tokenising splits texts at ASCII white space, over which no token of this vocabulary
reaches, and keeps the ids of the parts in a bounded cache of the Python worker.

Defined results: a null or empty text is the end id alone; ids may be null; repeated rows and
ids are packed each for itself; very long texts are cut, whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomscribe.llm.common import arrow_rows, texts_of
from loomscribe.sources.scratch import Workspace

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LENGTH = 4096
END_ID = 1
#: Pieces of a group, about.
GROUP = 50_000
CACHE_ENTRIES = 600_000
MISS_BATCH = 8192

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
_PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
#: The vocabulary's own pre-tokenizing pattern on lower-case printable ASCII.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers; one per Python worker."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.cache, self.words = Tokenizer.from_file(vocabulary), {}, {}

    def learn(self, parts: list[bytes]) -> None:
        """Put the ids of whole parts into the cache."""
        rest = []
        for part in parts:
            text = part.decode()
            if part.isascii() and text.isprintable() and "<|" not in text:
                self.cache[part] = b"".join(map(self.word, _ASCII_WORDS.findall(text.lower())))
            else:
                rest.append((part, text))
        for (part, _), encoding in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            self.cache[part] = array("I", encoding.ids).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of one pre-token of printable ASCII, which byte-level mapping leaves as it is."""
        found = self.words.get(word)
        if found is None:
            found = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()
        return found

    def ids(self, text: str) -> bytes:
        parts = text.encode().split()
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
            self.words.clear()
        missed = list({p for p in parts if p not in self.cache})
        for i in range(0, len(missed), MISS_BATCH):
            self.learn(missed[i : i + MISS_BATCH])
        return b"".join(map(self.cache.__getitem__, parts))


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``PIECES``: the cuts of every document's ids."""
    out, end = pa.schema(_PIECES), np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield arrow_rows(out, {f.name: list(c) for f, c in zip(out, zip(*rows, strict=True), strict=True)})

    return texts_of(docs).mapInArrow(cut, PIECES)


class _Shelf:
    """Unpacked pieces by length, and the longest available length up to any bound."""

    def __init__(self, lengths: np.ndarray, top: int):
        self.order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[self.order], np.arange(top + 2))
        self.next, self.first = bounds[1:].copy(), bounds[:-1]
        self.best = np.zeros(top + 1, np.int64)
        self.refresh()

    def refresh(self) -> None:
        lengths = np.arange(len(self.best))
        np.maximum.accumulate(np.where(self.next > self.first, lengths, 0), out=self.best)

    def take(self, length: int) -> int:
        self.next[length] -= 1
        if self.next[length] == self.first[length]:
            self.refresh()
        return int(self.order[self.next[length]])

    def put_back(self, length: int, item: int) -> None:
        self.order[self.next[length]] = item
        self.next[length] += 1
        if self.next[length] == self.first[length] + 1:
            self.refresh()

    def pair(self, gap: int) -> tuple[int, int]:
        """The two available lengths of largest sum up to ``gap``."""
        a = np.flatnonzero(self.next[: gap + 1] > self.first[: gap + 1])
        a = a[a > 0]
        if not len(a):
            return 0, 0
        b = self.best[np.minimum(gap - a, a)]
        single = (b == a) & (self.next[a] - self.first[a] < 2)
        b = np.where(single, self.best[a - 1], b)
        sums = np.where(b > 0, a + b, 0)
        i = int(np.argmax(sums))
        return (int(a[i]), int(b[i])) if sums[i] else (0, 0)


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of indexes into ``lengths`` (each from 1 to ``capacity``)."""
    shelf, left, bins = _Shelf(lengths, capacity), len(lengths), []
    while left:
        gap, content = capacity, []
        while gap and (size := int(shelf.best[gap])):
            content.append((size, shelf.take(size)))
            gap -= size
        left -= len(content)
        if gap and len(content) > 1 and left:
            size, item = content[-1]
            a, b = shelf.pair(gap + size)
            if a + b > size:
                content[-1:] = [(a, shelf.take(a)), (b, shelf.take(b))]
                shelf.put_back(size, item)
                left -= 1
        bins.append([item for _, item in content])
    return bins


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``PIECES`` rows."""
    out = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema(_PIECES))
        table = table.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = table["length"].to_numpy()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        base = TaskContext.get().partitionId() << 36
        for k, content in enumerate(best_two_fit(sizes, length)):
            sequence[content] = base + k
            offset[content] = np.cumsum([0, *sizes[content[:-1]]])
        for batch in table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches(20000):
            yield arrow_rows(out, {n: batch[n] for n in out.names})

    cut, size = Workspace(cut.sparkSession, "packing").save(cut, "pieces", n=F.count(F.lit(1)))
    return cut.repartition(1 + size["n"] // GROUP, "doc_id", "piece", "ids_crc32").mapInArrow(fill, PACKED)
