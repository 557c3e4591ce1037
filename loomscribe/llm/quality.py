"""Quality rules by repetition coverage.

Rolling 64-bit hashes of every n-gram length in ``NGRAMS`` mark the words that lie in an
n-gram found twice or more in the same text; the share of the text's word characters under
such marks, per length, and the share inside repeated lines decide the verdict.  All work
is numpy over blocks of whole texts in Arrow batches: one pass, no shuffle, no state.

Defined results: a null or empty text has zero words and fails the base rule; repeated
rows and ids are scored one by one; extra columns are ignored; an empty table gives none.  Very
long texts are scored whole, each by one task, with some tens of bytes per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomscribe.llm.common import Block, arrow_rows, blocks, mix, rows_with, texts_of

#: n-gram length -> largest tolerated share of word characters inside duplicated n-grams.
NGRAMS = {5: 0.34, 6: 0.33, 7: 0.32, 8: 0.30, 9: 0.29, 10: 0.28}
#: Largest tolerated share of word characters inside repeated lines.
MAX_DUP_LINE_CHARS = 0.30
#: Texts under this many words are judged by the base rule alone.
MIN_WORDS = 20

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = COLUMNS + ", base_failed boolean, kept boolean, dup_ngram_share double, dup_line_share double"


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is its key found twice in its text; is it a later occurrence."""
    keys = mix(keys + doc.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def _covered(block: Block, h: np.ndarray, n: int) -> np.ndarray:
    """The words that lie in an n-gram found twice or more in their text."""
    keys, at = block.window_hash(h, n)
    twice, _ = _repeated(keys, block.doc[at])
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + n, -1)
    return np.cumsum(edge)[:-1] > 0


def measure(block: Block) -> dict[str, np.ndarray]:
    """The columns of ``SCHEMA`` but ``doc_id``, one value per text of the block."""
    lead = (block.data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    size = chars[block.end] - chars[block.start]
    n_words = block.n_words.astype(np.int64)
    word_chars = np.bincount(block.doc, size, block.n).astype(np.int64)
    h = block.word_hash()

    breaks = np.flatnonzero(block.data == 10)
    start = np.union1d(block.offsets[:-1], breaks + 1)
    start = start[start < len(block.data)]
    line_doc = np.searchsorted(block.offsets, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(block.data)), block.offsets[line_doc + 1])
    ended = (stop > start) & (block.data[np.maximum(stop - 1, 0)] == 10) if len(start) else np.zeros(0, bool)
    stop = stop - ended
    words_before = np.searchsorted(block.start, np.stack([start, stop]))
    worded = words_before[1] > words_before[0]
    start, stop, line_doc, words_before = start[worded], stop[worded], line_doc[worded], words_before[:, worded]
    _, later = _repeated(block.span_hash(start, stop), line_doc)
    size_sum = np.concatenate([[0], np.cumsum(size)])
    line_chars = (size_sum[words_before[1]] - size_sum[words_before[0]]) * later

    total = np.maximum(word_chars, 1)
    failed = np.zeros(block.n, bool)
    worst = np.zeros(block.n)
    repeat_words = None
    for n, limit in NGRAMS.items():
        inside = _covered(block, h, n)
        share = np.bincount(block.doc, size * inside, block.n) / total
        failed |= share > limit
        worst = np.maximum(worst, share)
        if n == 8:
            repeat_words = np.bincount(block.doc, inside, block.n).astype(np.int64)
    line_share = np.bincount(line_doc, line_chars, block.n) / total
    failed |= line_share > MAX_DUP_LINE_CHARS
    base_failed = (n_words < MIN_WORDS) | (100 * repeat_words > 30 * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": _per_doc(_SYMBOLS[block.data], block.offsets),
        "n_dup_lines": np.bincount(line_doc, later, block.n).astype(np.int64),
        "n_repeat_words": repeat_words,
        "base_failed": base_failed,
        "kept": ~base_failed & ~failed,
        "dup_ngram_share": worst,
        "dup_line_share": line_share,
    }


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, shares and verdict (``SCHEMA``)."""
    out = pa.schema(
        [("doc_id", pa.int64())]
        + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_ngram_share", pa.float64()), ("dup_line_share", pa.float64())]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                yield arrow_rows(out, {"doc_id": batch["doc_id"].slice(block.first, block.n)} | measure(block))

    return texts_of(docs).mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows, with all columns, that the rules keep."""
    return rows_with(docs, lambda block: measure(block)["kept"])
