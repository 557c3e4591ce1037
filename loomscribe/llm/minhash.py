"""Near-duplicate detection with HyperMinHash sketches.

A document's set holds its distinct ``SHINGLE``-word shingles over ASCII-lowercased words.  A
register keeps, of the least hash in its bucket, the leading-zero count and the mantissa bits
after the leading one.  Two sketches serve: ``BUCKETS`` registers of 16 bits for banding, whose
empty buckets copy a full one in an order fixed per bucket so that small sets band like large
ones, and ``FINE`` registers compressed to 8 bits (0 is empty) for judging pairs.

1. Equal sets (by a 128-bit digest of the whole set) are one node, so copies never pair up.
2. Four registers make a band; nodes that share a band are members of its group.  Only they get
   fine registers and full sets.
3. In a first round every member of the groups of ``FIRST`` bands names its nearest neighbour by
   fine registers, in a second one that of another component in any group; in the last round
   all pairs of a group that lie in different components are judged.  Groups whose members are
   one component take no further part, and a group is dealt out in cells of bounded size.
4. Judging: sizes first; then every bucket whose registers differ holds an element of one set
   only, which bounds the similarity for certain; then the collision-corrected estimate, which
   rejects ``MARGIN`` standard errors below the threshold.  What is left is confirmed on the
   full sets, and confirmed links join components.

After the last round every pair of a group has been judged or lies in one component, so no link
between members of a group is lost but by the estimate (chance under 3e-7 a pair).  At a
similarity of 0.8 a pair misses all 32 bands with probability 5e-8.  A group of m members in
several components costs m * m / ``CELL`` rows in the rounds it takes part in.

Defined results: null or blank texts have no shingles and link with nothing; a null id takes
no part, keeps its row and has a null component; of rows with one id each has the component of
its own set, and sets that have one smallest id are one; extra columns are ignored; an empty
table gives no rows.  Very long texts are worked on whole, each by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscribe.llm.common import Block, arrow_rows, bitmap, blocks, in_bitmap, keyed, mix, release, staged, texts_of
from loomscribe.operators.components import connected_components
from loomscribe.sources.scratch import Workspace

SHINGLE = 5
#: The similarity that links: 100 * intersection >= PERCENT * union.
PERCENT = 80
BUCKETS, ROWS, MANTISSA = 128, 4, 10
BANDS = BUCKETS // ROWS
#: Fine registers, of 4 bits of leading zeros and 4 of mantissa.
FINE, FINE_MANTISSA = 1024, 4
#: Bands whose groups the first round reads.
FIRST = 8
#: Members of a group that meet in one cell, about.
CELL = 4096
#: Standard errors below the threshold at which the estimate rejects a pair.
MARGIN = 5.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ORDER = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=1)


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their texts, ordered by text and hash."""
    h = block.word_hash()
    keys, at = block.window_hash(h, k)
    keys, docs = [keys], [block.doc[at]]
    for short in range(1, k):
        few, at = block.window_hash(h, short)
        at_doc = block.doc[at]
        whole = block.n_words[at_doc] == short
        keys.append(mix(few[whole] + np.uint64(short)))
        docs.append(at_doc[whole])
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def lowered(column: pa.Array) -> Iterator[Block]:
    for block in blocks(column):
        block.data = _LOWER[block.data]
        yield block


def _least(key: np.ndarray, doc: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ordered distinct shingles: the slot (text and bucket) of each full bucket, and of its least
    hash the leading zeros and the bits after the leading one, from the highest."""
    bits = np.uint64(n_buckets.bit_length() - 1)
    slot = doc * n_buckets + (key >> (np.uint64(64) - bits)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    slot, least = slot[first], (key[first] << bits) | np.uint64(1)
    exponent = np.frexp(least.astype(np.float64))[1]
    exponent = np.where((least >> np.minimum(exponent - 1, 63).astype(np.uint64)) == 0, exponent - 1, exponent)
    zeros = 64 - exponent
    shift = (zeros + 1).astype(np.uint64)
    tail = np.where(shift > 63, np.uint64(0), least << np.minimum(shift, np.uint64(63)))
    return slot, zeros, tail


def registers(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The banding sketches of ``n`` texts from their ordered distinct shingles."""
    slot, zeros, tail = _least(key, doc, BUCKETS)
    packed = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (tail >> np.uint64(64 - MANTISSA))
    out = np.zeros(n * BUCKETS, np.uint16)
    full = np.zeros(n * BUCKETS, bool)
    out[slot], full[slot] = packed.astype(np.uint16), True
    out, full = out.reshape(n, BUCKETS), full.reshape(n, BUCKETS)
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    for turn in range(BUCKETS):
        if not len(rows):
            break
        donor = _ORDER[cols, turn]
        ready = full[rows, donor]
        out[rows[ready], cols[ready]] = out[rows[ready], donor[ready]]
        rows, cols = rows[~ready], cols[~ready]
    return out


def fine_registers(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The sketches of ``n`` texts that judge pairs; 0 is an empty bucket."""
    slot, zeros, tail = _least(key, doc, FINE)
    out = np.zeros(n * FINE, np.uint8)
    out[slot] = ((np.minimum(zeros, 14) + 1) << FINE_MANTISSA) | (tail >> np.uint64(64 - FINE_MANTISSA)).astype(np.int64)
    return out.reshape(n, FINE)


SKETCH = "doc_id long, n_shingles long, digest_a long, digest_b long, registers binary"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest_a", pa.int64()), ("digest_b", pa.int64()), ("registers", pa.binary())])


def sketches(texts: DataFrame, k: int) -> DataFrame:
    """``SKETCH`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in lowered(batch["text"]):
                key, doc = shingles(block, k)
                digest = []
                for salt in (0x632BE59BD9B4E019, 0xE220A8397B1DCDAF):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key ^ np.uint64(salt)), dtype=np.uint64)])
                    bound = np.searchsorted(doc, np.arange(block.n + 1))
                    digest.append((sums[bound[1:]] - sums[bound[:-1]]).view(np.int64))
                yield arrow_rows(
                    _SKETCH,
                    {"doc_id": batch["doc_id"].slice(block.first, block.n), "n_shingles": np.bincount(doc, minlength=block.n)}
                    | {"digest_a": digest[0], "digest_b": digest[1], "registers": [r.tobytes() for r in registers(key, doc, block.n)]},
                )

    return texts.mapInArrow(run, SKETCH)


def _bands() -> Column:
    band = lambda b: F.xxhash64(b, F.substring("registers", b * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)


def collisions(n: np.ndarray | float, m: np.ndarray | float) -> np.ndarray | float:
    """Chance that fine registers of different least hashes are equal, for sets of n and m."""
    chance = 0.0
    for k in range(15):
        at = lambda x: (1 - 2.0 ** -(k + 1)) ** x - ((1 - 2.0**-k) ** x if k else 0)  # noqa: B023,E731
        chance = chance + at(np.maximum(n / FINE, 1)) * at(np.maximum(m / FINE, 1))
    return chance / (1 << FINE_MANTISSA)


class Group:
    """Members of a band's group (or of a cell of it), ordered by the size of their sets."""

    def __init__(self, ids: np.ndarray, component: np.ndarray, n: np.ndarray, fine: np.ndarray, part: np.ndarray, percent: int):
        order = np.argsort(n, kind="stable")
        self.ids, self.component, self.n, self.fine, self.part = (x[order] for x in (ids, component, n, fine, part))
        self.full = np.packbits(self.fine > 0, axis=1).view(np.uint64)
        self.count = np.bitwise_count(self.full).sum(axis=1).astype(np.int64)
        self.percent = percent
        self.low = np.searchsorted(self.n * 100, self.n * percent)
        self.high = np.searchsorted(self.n * percent, self.n * 100, "right")
        values, sizes = np.unique(self.component, return_counts=True)
        self.largest = values[np.argmax(sizes)]
        self.crossing = bool((self.part != self.part[0]).any())

    def judge(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The members of other components that may be similar to member ``i``, and their estimates."""
        j = np.arange(self.low[i], self.high[i])
        some = self.component[j] != self.component[i]
        if self.crossing:
            some &= self.part[j] != self.part[i]
        if not some.all():
            j = j[some]
        if not len(j):
            return j, np.zeros(0)
        whole = len(j) == self.high[i] - self.low[i]
        pick = slice(self.low[i], self.high[i]) if whole else j
        joint = self.count[j] + self.count[i] - np.bitwise_count(self.full[pick] & self.full[i]).sum(axis=1)
        same = np.bitwise_count((self.fine[pick] == self.fine[i]).view(np.uint64)).sum(axis=1).astype(np.int64) - (FINE - joint)
        total, differ = self.n[j] + self.n[i], joint - same
        chance = collisions(self.n[j], float(self.n[i]))
        estimate = (same / joint - chance) / (1 - chance)
        limit = self.percent / 100
        possible = (total - differ) * 100 >= self.percent * (total + differ)
        possible &= estimate >= limit - MARGIN * np.sqrt(limit * (1 - limit) / joint)
        return j[possible], estimate[possible]

    def pairs(self, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of possible pairs across components: all, or each member's nearest only."""
        left, right = [], []
        for i in np.flatnonzero(self.component != self.largest):
            j, estimate = self.judge(i)
            if nearest and len(j):
                j = j[[np.argmax(estimate)]]
            elif not nearest:
                j = j[(j > i) | (self.component[j] == self.largest)]
            left.append(np.full(len(j), self.ids[i]))
            right.append(self.ids[j])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = np.concatenate(left), np.concatenate(right)
        return np.minimum(a, b), np.maximum(a, b)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _possible(members: DataFrame, nodes: DataFrame, labels: DataFrame | None, percent: int, nearest: bool) -> DataFrame:
    """Distinct pairs ``a, b`` (a < b) of groups that may be linked and lie in different components."""
    if labels is not None:
        members = members.join(labels.withColumnRenamed("node", "id"), "id", "left")
        members = members.withColumn("component", F.coalesce("component", "id"))
    else:
        members = members.withColumn("component", F.col("id"))
    mixed = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    rows = members.join(mixed.filter("low < high").select("band", "parts"), "band")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("band", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "id", "component")
    rows = rows.join(nodes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "fine"), "id")
    rows = rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "id")

    def cell(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, component, n, part = (table[c].to_numpy() for c in ("id", "component", "n", "part"))
        fine = np.frombuffer(b"".join(table["fine"].to_pylist()), np.uint8).reshape(-1, FINE)
        a, b = Group(ids, component, n, fine, part, percent).pairs(nearest)
        return arrow_rows(_PAIRS, {"a": a, "b": b})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch[c].to_numpy() for c in ("band", "x", "y")], axis=1)
            at = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(batch)]
            for start, end in zip(at, at[1:]):
                this = tuple(key[start])
                if held and this != now:
                    yield cell(held)
                    held = []
                held.append(batch.slice(start, end - start))
                now = this
        if held:
            yield cell(held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets meet the threshold."""
    side = lambda c: nodes.select(F.col("doc_id").alias(c), F.col("keys").alias(f"k_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["k_a"], batch["k_b"], strict=True):
                x, y = (np.frombuffer(k.as_buffer(), np.uint64) for k in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
            yield arrow_rows(_PAIRS, {c: batch[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    return both.mapInArrow(run, "a long, b long").distinct()


NODES = "doc_id long, n_shingles long, fine binary, keys binary"
_NODES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fine", pa.binary()), ("keys", pa.binary())])


def _nodes(texts: DataFrame, involved: DataFrame, k: int) -> DataFrame:
    """``NODES`` of the texts of the ids ``involved``, found by their bitmap and then for certain."""
    hashed = F.xxhash64("doc_id")
    shared = texts.sparkSession.sparkContext.broadcast(bitmap(involved.select(hashed.alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(shared.value, batch["key"].to_numpy().view(np.uint64))))
            for block in lowered(batch["text"]):
                key, doc = shingles(block, k)
                keys = np.split(key, np.searchsorted(doc, np.arange(1, block.n)))
                yield arrow_rows(
                    _NODES,
                    {"doc_id": batch["doc_id"].slice(block.first, block.n), "n_shingles": np.bincount(doc, minlength=block.n)}
                    | {"fine": [r.tobytes() for r in fine_registers(key, doc, block.n)], "keys": [x.tobytes() for x in keys]},
                )

    found = texts.filter("doc_id is not null").withColumn("key", hashed).mapInArrow(run, NODES)
    return found.join(involved, "doc_id", "left_semi").filter("n_shingles > 0")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    texts = texts_of(docs)
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    all_sets = work.save(sketches(texts, k), "sketches")
    sets = all_sets.filter("n_shingles > 0 and doc_id is not null")
    classes = work.save(sets.groupBy("digest_a", "digest_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    nodes = sets.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    banded = nodes.select(F.col("doc_id").alias("id"), F.posexplode(_bands()).alias("number", "band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("band")
    members = work.save(banded.join(shared, "band").distinct(), "members")
    nodes = work.save(_nodes(texts, members.select(F.col("id").alias("doc_id")).distinct(), k), "nodes")
    release(spark)

    labels, tested = None, None
    for turn, (read, nearest) in enumerate(((members.filter(F.col("number") < FIRST), True), (members, True), (members, False))):
        pairs = _possible(read, nodes, labels, percent, nearest)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = work.save(pairs, f"pairs-{turn}")
        tested = pairs if tested is None else tested.union(pairs)
        links, found = work.save(_confirmed(pairs, nodes, percent), f"links-{turn}", n=F.count(F.lit(1)))
        release(spark)
        if found["n"] or labels is None:
            if labels is not None:
                links = links.union(labels.select("node", "component"))
            labels = work.save(connected_components(links, "a", "b"), f"labels-{turn}")
    work.drop("members", "nodes", *(f"{s}-{t}" for s in ("pairs", "links") for t in range(3)))

    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("digest_a", "digest_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    found = all_sets.drop("registers").join(of_class, ["digest_a", "digest_b", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, without those that a smaller row is a near copy of.

    Here each row is a document of its own, also where an id repeats: rows are ordered by id and
    then by a hash of the text, and of rows with equal id and text one is left.  Rows with a
    null id take no part and all stay.
    """
    known = keyed(docs.filter("doc_id is not null"))
    texts = staged(known.groupBy(F.col("doc_id").cast("long").alias("_id"), F.col("text_key").alias("_of")).count(), "ids")
    if texts.groupBy("_id").agg(F.sum("count").alias("n")).filter("n > 1").isEmpty():
        rows = known.withColumn("_row", F.col("doc_id").cast("long"))
    else:
        order = staged(texts.orderBy("_id", "_of").select("_id", "_of", F.monotonically_increasing_id().alias("_row")), "order")
        rows = known.join(order, (F.col("doc_id") == F.col("_id")) & (F.col("text_key") == F.col("_of")))
        rows = staged(rows.select(*docs.columns, "_row").dropDuplicates(["_row"]), "rows")
    kept = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), k, percent).filter("kept")
    left = rows.join(kept.select(F.col("doc_id").alias("_row")), "_row", "left_semi")
    return left.select(docs.columns).unionByName(docs.filter("doc_id is null"))
