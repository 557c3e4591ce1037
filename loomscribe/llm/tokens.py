"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table from frequent pre-tokens to their token counts.  Every task
counts the pre-tokens of its own texts and hands on the most frequent ones, so the statistic
covers the whole corpus while no pre-token occurrence is shuffled; ``TABLE_SIZE`` entries of at
most ``MAX_ENTRY_BYTES`` reach the driver, which bounds the table at some 10 MB.  Tier two
encodes what the table lacks and keeps it in a bounded cache of the Python worker, which later
tasks of that worker use again.  The table only saves time.

Here a pre-token is what stands between two single spaces or before a line break.  No pre-token
of the vocabulary reaches over such a cut between other characters, so the pieces are counted
alone and added up; texts with other white space at a cut go by ``uneven_pieces``.

Defined results: null counts as empty (0 bytes, 0 tokens); ids may be null and may repeat, every
row is counted; extra columns are ignored; an empty table gives no rows; very long texts are
counted piece by piece, lone very long pre-tokens are encoded uncached.
"""

from __future__ import annotations

import os
from collections import Counter as Counts
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from loomscribe.llm.common import arrow_rows, clean, frequent, pieces, texts_of, uneven_pieces

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TABLE_SIZE = 65536
MAX_ENTRY_BYTES = 48
CACHE_ENTRIES = 400_000
#: Missed pre-tokens that are encoded in one call.
MISS_BATCH = 8192
TOKEN_LIMIT = 1024
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_counters: dict[str, Counter] = {}


def frequent_pretokens(docs: DataFrame, size: int = TABLE_SIZE) -> list[str]:
    """The about ``size`` most frequent clean pieces of all texts, over-long ones left out."""
    return frequent(texts_of(docs), lambda counts: Counts({p: n for p, n in counts.items() if clean(p)}), size, MAX_ENTRY_BYTES)


class Counter:
    """Counts tokens of whole texts: table, then worker cache, then the tokenizer itself."""

    def __init__(self, vocabulary: str, table: dict[str, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.table, self.cache = table or {}, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, texts: list[str]) -> list[int]:
        out = []
        for i in range(0, len(texts), MISS_BATCH):
            out += [len(e) for e in self.tokenizer.encode_batch_fast(texts[i : i + MISS_BATCH], add_special_tokens=False)]
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of the texts; a key is a piece as it stands in the text, with its space."""
        totals, missed = [0] * len(texts), {}
        for i, text in enumerate(texts):
            if any(word in text for word in self.special):
                totals[i] = self.encode([text])[0]
                continue
            first, *rest = pieces(text)
            known = list(map(self.table.get, rest))
            if None in known:
                lacking = [p for p, n in zip(rest, known, strict=True) if n is None]
                known = [n for n in known if n is not None]
                if not all(map(clean, lacking)) or (rest and not clean(first)):
                    known, first, lacking = [], "", uneven_pieces(text)
                else:
                    lacking = [p if p[0] == "\n" else " " + p for p in lacking]
            elif rest and not clean(first):
                known, first, lacking = [], "", uneven_pieces(text)
            else:
                lacking = []
            total = sum(known)
            for part in [first, *lacking] if first else lacking:
                n = self.cache.get(part)
                if n is None:
                    missed.setdefault(part, []).append(i)
                else:
                    total += n
            totals[i] = total
            if len(missed) >= MISS_BATCH:
                self.settle(missed, totals)
        self.settle(missed, totals)
        return totals

    def settle(self, missed: dict[str, list[int]], totals: list[int]) -> None:
        """Encode the missed pre-tokens, add them to their texts and remember them."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        for part, n in zip(missed, self.encode(list(missed)), strict=True):
            for i in missed[part]:
                totals[i] += n
            if len(part) <= MAX_ENTRY_BYTES:
                self.cache[part] = n
        missed.clear()


def counter(vocabulary: str, table: dict[str, int]) -> Counter:
    """The worker's counter for a vocabulary, with its cache of earlier tasks."""
    found = _counters.get(vocabulary)
    if found is None:
        found = _counters[vocabulary] = Counter(vocabulary)
    found.table = table
    return found


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every document."""
    common = frequent_pretokens(docs)
    sizes = Counter(vocabulary).encode([p if p[0] == "\n" else " " + p for p in common])
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(common, sizes, strict=True)))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(vocabulary, table.value)
        for batch in batches:
            texts = batch["text"].to_pylist()
            n = by.count(texts)
            n_bytes = [len(t.encode()) for t in texts]
            yield arrow_rows(out, {"doc_id": batch["doc_id"], "n_bytes": n_bytes, "n_tokens": n, "over_limit": [x > limit for x in n]})

    return texts_of(docs).mapInArrow(count, SCHEMA)
