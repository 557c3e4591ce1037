"""Substring deduplication with sharded repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document.

0. Copies: a text that a smaller document also is, by 128 bits of hash, is one echo as a whole
   and leaves the other steps.
1. Regions: a window's anchor is the ``ANCHOR``-word gram of least hash in it, so equal windows
   have equal anchors.  Anchors of two or more documents set bits of a bitmap of fixed size; runs
   of windows over such anchors are the only parts of a document that can recur.  They are kept
   with their words, in pieces of ``PIECE`` windows, so a long document has no long rows.
2. Passages: the regions' windows are grouped by a 64-bit hash, with the first and last document
   and one place in the first combined before the shuffle, so a window of very many documents is no
   hot group.  A window of several documents is confirmed; its words are cut from that one place.
   No place of any later document is kept.
3. Automata: windows are dealt into shards by their anchor.  A shard numbers the words of its
   passages and compiles their windows into an Aho-Corasick automaton.  All documents are
   streamed: every run of windows whose anchor some passage has goes to its anchor's shard, whose
   automaton alone finds, word by word, where passages of smaller documents occur.  A shard with
   very many words to stream is dealt out to several tasks, each with the shard's passages; one
   with very many windows is compiled in parts, each of which sees the shard's whole stream.
4. A document's words are dropped where a window was found.

Words are ``[^\\x20\\x09-\\x0D]+``.  Of two different windows with one 64-bit hash only one would
be compiled: nothing is removed wrongly, but the other may stay (chance n * n / 2 ** 65 for n
windows).

Defined results: a null text has no words; a null id is never smaller or larger than
another, so its words stay; rows of one id do not remove each other, and each loses only
what its own text shares with smaller ids (a row is its id and the digest of its text);
texts under 13 words stay whole; extra columns are ignored; an empty table gives no rows.
Very long texts are worked on whole, each by one task, with some tens of bytes per byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscribe.llm.common import Block, arrow_rows, bitmap, blocks, in_bitmap, keyed, mix, release, texts_of
from loomscribe.sources.scratch import Workspace

WINDOW, ANCHOR = 13, 5
#: Anchors before the last one that a window may have.
REACH = WINDOW - ANCHOR
#: Rows of copies or of large shards (16 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Windows of a shard's passages and words that one task streams past them, about.
SHARD_WINDOWS, TASK_WORDS = 40_000, 2_000_000
#: A region is at most ``PIECE`` windows; a place is a region's number and a window in it.
PIECE_BITS = 12
PIECE = 1 << PIECE_BITS
#: Regions that one task may number.
REGION_BITS = 30


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows, and the hash of each window's anchor."""
    h = block.word_hash()
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(len(h) - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(gram)]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    least = gram[:n].copy()
    for j in range(1, REACH + 1):
        np.minimum(least, gram[j : j + n], out=least)
    starts = np.flatnonzero(block.doc[:n] == block.doc[WINDOW - 1 :])
    return starts, mix(least[starts])


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """``anchor, doc_id``: the anchors of each text."""
    out = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for block in blocks(batch["text"]):
                starts, gram = anchors(block)
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (block.doc[starts[1:]] != block.doc[starts[:-1]])
                yield arrow_rows(out, {"anchor": gram[new].view(np.int64), "doc_id": ids[block.first + block.doc[starts[new]]]})

    return texts.mapInArrow(rows, "anchor long, doc_id long")


def recurring_anchors(texts: DataFrame) -> np.ndarray:
    """The bitmap of anchors that two or more documents hold."""
    seen = _anchor_rows(texts).groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return bitmap(seen.filter("a < b").select("anchor"))


def spans_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans of a text block as strings; spans begin and end with whole characters."""
    size = end - start
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
    index += np.repeat((start - (ends - size)).astype(np.int32), size)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[index].tobytes())]).cast(pa.string())


def _runs(starts: np.ndarray, *marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive windows with equal marks begin, and the last window of each."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    for mark in marks:
        new[1:] |= mark[1:] != mark[:-1]
    new = np.flatnonzero(new)
    return new, np.append(new[1:], len(starts)) - 1


def _first_words(block: Block) -> np.ndarray:
    """How many words of the block lie before each text."""
    return np.concatenate([[0], np.cumsum(block.n_words)])


_REGIONS = pa.schema([("region", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("first_word", pa.int64()), ("words", pa.string())])


def regions(texts: DataFrame, recurring: np.ndarray) -> DataFrame:
    """``region, doc_id, text_key, first_word, words``: the runs of windows whose anchors recur, in
    pieces, numbered and with their place in the document."""
    shared = texts.sparkSession.sparkContext.broadcast(recurring)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << REGION_BITS
        for batch in batches:
            ids, keys = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            for block in blocks(batch["text"]):
                starts, gram = anchors(block)
                starts = starts[in_bitmap(shared.value, gram)]
                if not len(starts):
                    continue
                doc = block.doc[starts]
                run, _ = _runs(starts, doc)
                nth = np.arange(len(starts)) - np.repeat(run, np.diff(np.append(run, len(starts))))
                new, last = _runs(starts, doc, nth >> PIECE_BITS)
                doc, at = doc[new], block.first + doc[new]
                columns = {"region": number + np.arange(len(new)), "doc_id": ids[at], "text_key": keys[at]}
                words = spans_of(block.data, block.start[starts[new]], block.end[starts[last] + WINDOW - 1])
                yield arrow_rows(_REGIONS, {**columns, "first_word": starts[new] - _first_words(block)[doc], "words": words})
                number += len(new)

    return texts.mapInArrow(rows, "region long, doc_id long, text_key long, first_word long, words string")


def recurring_windows(found: DataFrame) -> DataFrame:
    """``place``: one place, in its first document, of every window of two or more documents."""
    out = pa.schema([("window", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, region = (batch[c].to_numpy() for c in ("doc_id", "region"))
            for block in blocks(batch["words"]):
                key, start = block.window_hash(block.word_hash(), WINDOW)
                at = start - _first_words(block)[block.doc[start]]
                doc = block.doc[start] + block.first
                yield arrow_rows(out, {"window": key.view(np.int64), "doc_id": ids[doc], "place": (region[doc] << PIECE_BITS) + at})

    windows = found.select("doc_id", "region", "words").mapInArrow(rows, "window long, doc_id long, place long")
    ends = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("place"))
    return ends.filter("first < last").select("place")


_PASSAGES = pa.schema([("doc_id", pa.int64()), ("windows", pa.int64()), ("words", pa.string())])


def passages(found: DataFrame, places: DataFrame) -> DataFrame:
    """``doc_id, windows, words``: the confirmed windows, neighbours together, and their first document."""
    at = places.select(F.shiftright("place", PIECE_BITS).alias("region"), F.col("place").bitwiseAND(PIECE - 1).alias("at"))
    at = at.groupBy("region").agg(F.array_sort(F.collect_list("at")).alias("at"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, at in zip(*(batch[c] for c in ("doc_id", "words", "at")), strict=True):
                words, at = text.as_py().encode().split(), at.values.to_numpy()
                new, last = _runs(at)
                for a, b in zip(at[new].tolist(), at[last].tolist(), strict=True):
                    out.append((doc_id.as_py(), b - a + 1, b" ".join(words[a : b + WINDOW]).decode()))
            yield arrow_rows(_PASSAGES, {f.name: [r[i] for r in out] for i, f in enumerate(_PASSAGES)})

    return found.join(at, "region").select("doc_id", "words", "at").mapInArrow(rows, "doc_id long, windows long, words string")


def compiled(phrases: list[tuple[int, list[bytes]]]) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """The automaton of the windows of phrases ``(document, words)``, and its word numbers."""
    number: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for first, words in phrases:
        seq = tuple(number.setdefault(w, len(number) + 1) for w in words)
        for i in range(len(seq) - WINDOW + 1):
            automaton.add_word(seq[i : i + WINDOW], first)
    automaton.make_automaton()
    return automaton, number


def occurrences(automaton: ahocorasick.Automaton, number: dict[bytes, int], doc_id: int, words: list[bytes]) -> list[int]:
    """Where in the words of a document windows start that a smaller document holds."""
    if not len(automaton):
        return []
    seq = tuple(number.get(w, 0) for w in words)
    return [end - WINDOW + 1 for end, first in automaton.iter(seq) if first < doc_id]


def _sharded(block: Block, n_shards: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shard, first, last``: runs of windows of one shard, by their anchors, and their words' bounds."""
    starts, gram = anchors(block)
    if wanted is not None:
        some = in_bitmap(wanted, gram)
        starts, gram = starts[some], gram[some]
    shard = (gram % np.uint64(n_shards)).astype(np.int64)
    new, last = _runs(starts, block.doc[starts], shard)
    return shard[new], starts[new], starts[last] + WINDOW - 1


_STREAM = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("first_word", pa.int64()), ("words", pa.string())])
_LOAD = pa.schema([("shard", pa.int64()), ("words", pa.int64())])


def stream(found: DataFrame, n_shards: int, wanted: np.ndarray | None = None) -> DataFrame:
    """``shard, doc_id, text_key, first_word, words``: what each shard has to see of each row of ``found``."""
    shared = found.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, base = (batch[c].to_numpy() for c in ("doc_id", "text_key", "first_word"))
            for block in blocks(batch["words"]):
                shard, first, last = _sharded(block, n_shards, shared.value)
                doc = block.doc[first]
                at = block.first + doc
                words = spans_of(block.data, block.start[first], block.end[last])
                columns = {"shard": shard, "doc_id": ids[at], "text_key": keys[at], "words": words}
                yield arrow_rows(_STREAM, {**columns, "first_word": base[at] + first - _first_words(block)[doc]})

    return found.select("doc_id", "text_key", "first_word", "words").mapInArrow(rows, "shard long, doc_id long, text_key long, first_word long, words string")


def load(found: DataFrame, n_shards: int, wanted: np.ndarray | None = None) -> DataFrame:
    """``shard, words``: how many words of ``stream`` each shard has, summed by task first."""
    shared = found.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["words"]):
                shard, first, last = _sharded(block, n_shards, shared.value)
                some, which = np.unique(shard, return_inverse=True)
                yield arrow_rows(_LOAD, {"shard": some, "words": np.bincount(which, last - first + 1, len(some)).astype(np.int64)})

    return found.select("words").mapInArrow(rows, "shard long, words long").groupBy("shard").agg(F.sum("words").alias("words"))


FOUND = "doc_id long, text_key long, starts array<long>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("starts", pa.list_(pa.int64()))])


def locate(work: Workspace, found: DataFrame, confirmed: DataFrame, n_windows: int) -> DataFrame:
    """``FOUND``: where in the regions of all documents automata find windows of smaller documents."""
    n_shards = 1 + n_windows // SHARD_WINDOWS
    confirmed = confirmed.select("doc_id", F.lit(0).cast("long").alias("text_key"), F.lit(0).cast("long").alias("first_word"), "words")
    wanted = bitmap(_anchor_rows(confirmed.select("doc_id", F.col("words").alias("text"))))
    sizes = load(found, n_shards, wanted).select("shard", F.ceil(F.col("words") / TASK_WORDS).alias("tasks"))
    parts = load(confirmed, n_shards).select("shard", F.ceil(F.col("words") / (4 * WINDOW * SHARD_WINDOWS)).alias("parts"))
    large, size = work.save(sizes.join(parts, "shard").filter("tasks > 1 or parts > 1"), "large", n=F.count(F.lit(1)))

    def dealt(rows: DataFrame, echo: bool) -> DataFrame:
        rows = rows.join(F.broadcast(large) if size["n"] <= BROADCAST_ROWS else large, "shard", "left")
        rows = rows.withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in ("tasks", "parts")}).withColumn("echo", F.lit(echo))
        own, others = ("tasks", "parts") if echo else ("parts", "tasks")
        rows = rows.withColumn(own, F.pmod(F.xxhash64("doc_id", "first_word", "words"), F.col(own)))
        return rows.withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))

    both = dealt(stream(confirmed, n_shards), False).unionByName(dealt(stream(found, n_shards, wanted), True))
    both = both.withColumn("unit", F.xxhash64("shard", "tasks", "parts")).repartition("unit")
    both = both.sortWithinPartitions("unit", "shard", "tasks", "parts", "echo").drop("unit")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, phrases, automaton, number = None, [], None, {}
        for batch in batches:
            out = []
            names = ("shard", "tasks", "parts", "echo", "doc_id", "text_key", "first_word", "words")
            for shard, task, part, echo, doc_id, key, base, text in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if (shard, task, part) != now:
                    now, phrases, automaton = (shard, task, part), [], None
                words = text.encode().split()
                if not echo:
                    phrases.append((doc_id, words))
                    continue
                if automaton is None:
                    automaton, number = compiled(phrases)
                    phrases = []
                if starts := occurrences(automaton, number, doc_id, words):
                    out.append((doc_id, key, [base + s for s in starts]))
            yield arrow_rows(_FOUND, {f.name: [r[i] for r in out] for i, f in enumerate(_FOUND)})

    return both.mapInArrow(rows, FOUND)


def copies(texts: DataFrame) -> DataFrame:
    """``doc_id, text_key``: the rows whose whole text a smaller document also is."""
    hashed = keyed(texts).select("doc_id", "text_key", F.xxhash64("text", F.lit(WINDOW)).alias("more"))
    first = hashed.groupBy("text_key", "more").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return hashed.join(first.drop("last"), ["text_key", "more"]).filter("first < doc_id").select("doc_id", "text_key").distinct()


def without(texts: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The texts but for ``n`` rows, which are broadcast if few enough, else joined by shuffle."""
    return keyed(texts).join(F.broadcast(rows) if n <= BROADCAST_ROWS else rows, ["doc_id", "text_key"], "left_anti")


def deduplicate(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns to ``carry`` (``doc_id`` among them), counts, the kept
    words joined by one space, and their digest."""
    spark, texts = docs.sparkSession, texts_of(docs)
    known = texts.filter("doc_id is not null")
    work = Workspace(spark, "substring")
    same, size = work.save(copies(known), "copies", n=F.count(F.lit(1)))
    known = without(known, same, size["n"])
    found = work.save(regions(known, recurring_anchors(known)), "regions")
    release(spark)
    places = work.save(recurring_windows(found), "windows")
    release(spark)
    confirmed, size = work.save(passages(found, places), "passages", windows=F.sum("windows"))
    work.drop("windows")
    release(spark)
    located = work.save(locate(work, found, confirmed, size["windows"] or 0), "located")
    work.drop("regions", "passages", "large")
    release(spark)
    starts = located.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("_starts"))
    starts = starts.withColumn("_copy", F.lit(False)).union(same.select("doc_id", "text_key", F.lit(None).cast("array<long>"), F.lit(True)))
    starts = starts.withColumnsRenamed({"doc_id": "_id", "text_key": "_of"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c for c in carry if c != "doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    here = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("_text") == F.col("_of"))
    marked = rows.join(starts, here, "left").drop("_id", "_of")
    added = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
    carried = rows.drop("_text").schema
    names = carried.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, at, copy in zip(batch["_text"], batch["_starts"], batch["_copy"].to_pylist(), strict=True):
                words = text.as_py().encode().split()
                n = len(words)
                if copy and n >= WINDOW:
                    words = []
                elif at.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    edge[at.values.to_numpy()] += 1
                    edge[at.values.to_numpy() + WINDOW] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                kept = b" ".join(words)
                found.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            out = batch.select(names)
            for i, (name, kind) in enumerate(added):
                out = out.append_column(name, pa.array([r[i] for r in found], kind))
            yield out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ["n_words long", "n_removed long", "kept_sha256 string", "kept_text string"])
    return marked.mapInArrow(cut, schema)
