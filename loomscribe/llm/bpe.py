"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A word is an array of bytes.  It becomes an array of longs, each a part of the word: the rank of
the pair that the part makes with the next one (which is also the id of the merged piece), the
place among the parts, and its id.  A fold over the array merges, at every step, the leftmost
adjacent pair of lowest rank, which is the array's minimum, and looks up only the two pairs that
the merge touches.  What is left when no pair has a rank are the tokens.  Decoding concatenates
the binary pieces of the ids.  Spark finds keys of a literal map by scanning, so the rank map is
three literal arrays that answer with one probe: a pair (a, b) is at ``shift[a] + b``.

Texts go through in chunks of ``CHUNK_BYTES``.  A chunk is a row with its distinct words, each of
which the fold encodes and the decoder decodes once, and its texts as numbers of these words; the
next step puts the texts together.  Nothing is shuffled or broadcast but the ranks.  Each step of
the fold copies the word, so words of more than ``LONG`` bytes are merged in the same order by a
priority queue instead, which takes n log n steps; their ids are decoded like all others.

Texts are cut at single spaces and before line breaks, over which no word of the pattern
reaches (``common.pieces``), and the pattern runs on distinct pieces only, on all of a chunk at once.

Defined results: null and empty texts have no tokens; ids may be null, repeated rows and ids are
encoded each; extra columns are ignored; an empty table gives no rows; a text longer than a
chunk is a chunk of its own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscribe.llm.common import arrow_rows, texts_of

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHUNK_BYTES = 8 << 20
LONG = 128
#: Bits of an id and of a place in a part; the rank of its pair is above them, ``NONE`` if it has none.
ID_BITS, PLACE_BITS = 20, 8
RANK_BITS = ID_BITS + PLACE_BITS
IDS, PARTS = (1 << ID_BITS) - 1, (1 << RANK_BITS) - 1
NONE = IDS << RANK_BITS
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_WORD = regex.compile(public_tokenizers.PATTERN)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """``shift`` by id, and by slot ``left`` (the pair's first id, -1 if free) and ``rank``: the row of
    an id's pairs lies where none of its slots is taken, so that (a, b) has the slot shift[a] + b."""
    rows: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                rows.setdefault(a, {})[b] = rank
    taken, shift = 0, [0] * (max(ranks.values()) + 1)
    for a in sorted(rows, key=lambda a: -len(rows[a])):
        clash = row = 0
        for b in rows[a]:
            clash |= taken >> b
            row |= 1 << b
        shift[a] = (~clash & (clash + 1)).bit_length() - 1
        taken |= row << shift[a]
    left, rank = [-1] * taken.bit_length(), [NONE] * taken.bit_length()
    for a, row in rows.items():
        for b, r in row.items():
            left[shift[a] + b], rank[shift[a] + b] = a, r << RANK_BITS
    return shift, left, rank


def _literal(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<bigint>")


class RankMap:
    """The literal rank map over pairs of ids, and the literal pieces by id."""

    def __init__(self, ranks: dict[bytes, int], piece_of: dict[int, bytes]):
        last = max(ranks.values())
        if last >= IDS:
            raise ValueError("too many ids: raise ID_BITS")
        byte = [bytes([b]) for b in range(256)]
        ends = [NONE | ranks[b] for b in byte]
        starts = [ranks.get(a + b, IDS) << RANK_BITS | ranks[a] for a in byte for b in byte]
        self.tables = [*map(_literal, (starts, ends, *rank_table(ranks)))]
        self.pieces = F.split(F.lit(",".join(piece_of.get(i, b"").hex().upper() for i in range(last + 1))), ",")

    def encode(self, words: Column) -> Column:
        """The ids of words (arrays of byte values); the plan holds the rank map once."""
        tables: list[Column] = []

        def bind(table: Column) -> Column:
            tables.append(table)
            if len(tables) < len(self.tables):
                return _let(self.tables[len(tables)], bind)
            return F.transform(words, lambda word: self._fold(word, *tables))

        return _let(self.tables[0], bind)

    @staticmethod
    def _fold(word: Column, starts: Column, ends: Column, shift: Column, left: Column, ranks: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            """The rank of a pair of ids, in its place above a part; ``b`` may be null."""
            slot = F.get(shift, a) + b
            return F.when(F.get(left, slot) == a, F.get(ranks, slot)).otherwise(NONE)

        def part(b: Column, i: Column) -> Column:
            pair = F.get(starts, b * 256 + F.get(word, i + 1))
            return F.coalesce(pair, F.get(ends, b)) + i.cast("long") * (1 << ID_BITS)

        def merge(s: Column, least: Column) -> Column:
            new, at = F.shiftright(least, RANK_BITS), F.shiftright(least, ID_BITS).bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
            before = F.get(s, at - 1)
            merged = rank(new, F.get(s, at + 2).bitwiseAND(IDS)) + least.bitwiseAND(PARTS - IDS) + new
            before = rank(before.bitwiseAND(IDS), new) + before.bitwiseAND(PARTS)
            rest = F.transform(F.slice(s, at + 3, F.size(s)), lambda x: x - (1 << ID_BITS))
            return F.when(at == 0, F.concat(F.array(merged), rest)).otherwise(F.concat(F.slice(s, F.lit(1), at - 1), F.array(before, merged), rest))

        def step(s: Column, _: Column) -> Column:
            # A fold over one value binds it, and does not copy what it returns as ``_let`` does.
            return F.aggregate(F.array(F.array_min(s)), s, lambda s, least: F.when(least >= NONE, s).otherwise(merge(s, least)))

        parts = F.transform(word.cast("array<int>"), part)
        return F.when(F.size(word) == 0, F.expr("array()").cast("array<bigint>")).otherwise(
            F.aggregate(F.slice(word, 2, F.size(word)), parts, step, lambda s: F.transform(s, lambda x: x.bitwiseAND(IDS)))
        )

    def decode(self, words: Column) -> Column:
        """The bytes of the ids of words."""
        piece = lambda pieces, ids: F.array_join(F.transform(ids, lambda i: F.get(pieces, i.cast("int"))), "")
        return _let(self.pieces, lambda pieces: F.transform(words, lambda ids: F.unhex(piece(pieces, ids))))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word: the same merges in the same order, by a priority queue."""
    n, longest = len(word), max(map(len, ranks))
    end, before, whole = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    queue: list[tuple[int, int, int]] = []

    def offer(start: int, stop: int) -> None:
        if stop - start <= longest and (rank := ranks.get(word[start:stop])) is not None:
            heapq.heappush(queue, (rank, start, stop))

    for i in range(n - 1):
        offer(i, i + 2)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = end[i] if whole[i] else n
        if j >= n or end[j] != stop or not whole[j]:
            continue
        whole[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            offer(i, end[stop])
        if before[i] >= 0:
            offer(before[i], stop)
    found, i = [], 0
    while i < n:
        found.append(ranks[word[i : end[i]]])
        i = end[i]
    return found


def _values(words: pa.Array) -> pa.Array:
    """Byte arrays of words."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), np.uint8).astype(np.int16)))


def uneven(text: str) -> bool:
    """Has a text white space at an end, next to other white space, or other than spaces and line
    breaks (or none at all): only other texts have clean cuts alone."""
    return text.replace("\n", " ").split(" ") != text.split()


def worded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the numbers of all texts' words, and how many each text has."""
    bodies = texts.to_pylist()
    odd = [uneven(text) for text in bodies]
    even = pc.if_else(pa.array(odd, pa.bool_()), "", texts)
    cut = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
    flat, first = cut.flatten(), cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
    #: The words of a text's first piece, which follows on nothing, or of a text that is not cut.
    own = [_WORD.findall(body if o else piece) for body, o, piece in zip(bodies, odd, flat.take(pa.array(first)).to_pylist(), strict=True)]
    later = np.ones(len(flat), bool)
    later[first] = False
    rest = flat.filter(pa.array(later)).dictionary_encode()
    n = len(rest.dictionary)
    found: list[str] = []
    if n:
        all_of = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rest.dictionary)
        found = _WORD.findall((" " + pc.binary_join(all_of, " ")[0].as_py()).replace(" \n", "\n"))
    # A piece begins with a space or a line break, and no other word of it does.
    begins = np.flatnonzero([word[0] in " \n" for word in found])
    if len(begins) != n:
        raise ValueError("a word of the pattern reaches over a cut")
    index = np.empty(len(flat), np.int64)
    index[later], index[first] = rest.indices.to_numpy(), np.arange(n, n + len(bodies))
    lengths = np.concatenate([np.diff(np.append(begins, len(found))), [len(o) for o in own]]).astype(np.int64)
    for words in own:
        found += words
    words = pa.array(found, pa.string()).dictionary_encode()
    counts = lengths[index]
    start = (np.cumsum(lengths) - lengths)[index] - (np.cumsum(counts) - counts)
    codes = words.indices.to_numpy()[np.repeat(start, counts) + np.arange(counts.sum())]
    return words.dictionary, codes, np.add.reduceat(counts, first)


def _chunks(texts: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_ids, texts, words, long_ids``: one row per chunk; its texts are numbers of its words, the
    long ones of which come after the others and as ids."""
    spread = texts.sparkSession.sparkContext.broadcast(ranks)
    fields = {"doc_ids": pa.int64(), "texts": pa.list_(pa.int32()), "words": pa.list_(pa.int16()), "long_ids": pa.list_(pa.int64())}
    out = pa.schema([(name, pa.list_(kind)) for name, kind in fields.items()])

    def row(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        words, codes, sizes = worded(table["text"].chunk(0))
        long = pc.greater(pc.binary_length(words), LONG).to_numpy(zero_copy_only=False)
        number = np.empty(len(words), np.int32)
        number[np.argsort(long, kind="stable")] = np.arange(len(words), dtype=np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        columns = {
            "doc_ids": table["doc_id"].chunk(0),
            "texts": pa.ListArray.from_arrays(pa.array(offsets), pa.array(number[codes])),
            "words": _values(words.filter(pa.array(~long))),
            "long_ids": pa.array([merged(word.encode(), spread.value) for word in words.filter(pa.array(long)).to_pylist()], fields["long_ids"]),
        }
        return arrow_rows(out, {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            start = 0
            for i, n in enumerate(pc.binary_length(batch["text"]).to_pylist()):
                if size and size + n > CHUNK_BYTES:
                    held.append(batch.slice(start, i - start))
                    yield row(held)
                    held, start, size = [], i, 0
                size += n
            held.append(batch.slice(start))
        if sum(map(len, held)):
            yield row(held)

    return texts.mapInArrow(run, "doc_ids array<long>, texts array<array<int>>, words array<array<smallint>>, long_ids array<array<long>>")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of chunks, put together from what their words are encoded as and decoded to."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def joined(of: pa.Array, numbers: pa.ListArray, comma: bytes) -> list[str]:
        found: list[str] = []
        for start in range(0, len(numbers), 64):
            part = numbers.slice(start, 64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(part).to_numpy())]).astype(np.int64))
            lists = pa.LargeListArray.from_arrays(offsets, of.take(part.flatten()))
            found += [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(lists, pa.scalar(comma, of.type))]
        return found

    for batch in batches:
        for i in range(len(batch)):
            doc_ids, texts, names, decoded = (batch[c][i].values for c in ("doc_ids", "texts", "names", "decoded"))
            counts = pc.count_substring(names, ",").to_numpy(zero_copy_only=False).astype(np.int64) + 1
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(texts).to_numpy())])
            n_tokens = np.diff(np.concatenate([[0], np.cumsum(counts[texts.flatten().to_numpy()])])[ends])
            digests = [joined(of.cast(pa.large_binary()), texts, comma) for of, comma in ((names, b","), (decoded, b""))]
            yield arrow_rows(out, {"doc_id": doc_ids, "n_tokens": n_tokens, "ids_sha256": digests[0], "decoded_sha256": digests[1]})


def encode_documents(docs: DataFrame, path: str = VOCABULARY, piece_of: dict[int, bytes] | None = None) -> DataFrame:
    """``SCHEMA``: token counts and digests of the ids and of what they decode to.

    ``piece_of`` gives the pieces that ids are decoded by, those of the vocabulary if none."""
    plain = read_ranks(path)
    ranks = RankMap(plain, piece_of or {rank: token for token, rank in plain.items()})
    chunks = _chunks(texts_of(docs), plain)
    encoded = chunks.select("doc_ids", "texts", F.concat(ranks.encode(F.col("words")), "long_ids").alias("ids"))
    names = F.transform("ids", lambda w: F.array_join(w.cast("array<string>"), ","))
    return encoded.select("doc_ids", "texts", names.alias("names"), ranks.decode(F.col("ids")).alias("decoded")).mapInArrow(_assemble, SCHEMA)
