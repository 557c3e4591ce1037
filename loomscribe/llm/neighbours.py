"""Approximate nearest neighbours by multi-index hashing.

Vectors are lifted by one coordinate to the next of a geometric ladder of norms, ``STEPS`` a
doubling: among vectors of one rung the largest inner product is the smallest angle, and no
vector is lifted far.  They are hashed by ``ROTATIONS`` learned rotations: principal axes, then
alternating sign codes and orthogonal fits (iterative quantization).  A code is split into
substrings of ``SUBSTRING`` bits.  Rows are dealt into blocks, and a block indexes each
substring by its value.  A query probes, in every substring, all values within ``PROBE`` bits
of its own; by the pigeonhole principle that retrieves every code within a Hamming radius of
m * (PROBE + 1) - 1 for m substrings, and many beyond it.  Of these, codes that differ in at most
``RADIUS`` of all bits are reranked on the original vectors in double precision.  A query goes on
with one more bit until that leaves ``WIDTH`` * k rows of the block (all bits: the whole block), so
none lacks rows; with the defaults only blocks of some thousand rows or less need it.

Queries travel in chunks of at most ``CHUNK``, each with every block; one shuffle serves all
chunks, a task holds one block's index and streams chunks through it, and a block returns at
most k rows per query, so no list of candidates leaves its task.

The rotations are fitted on the ``SAMPLE`` vectors of least id hash; every vector is indexed.
Isotropic vectors are the hardest case: there the defaults find about a third of the rows.  Where
norms differ widely the nearest vectors are long rather than close in angle, and recall falls.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do null ids; equal scores go to the smaller id; rows of
one id are not each other's neighbours, but each is a candidate of other queries, and of several
queries with one id that with the smallest vector is answered; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscribe.llm.common import arrow_rows

SAMPLE = 8192
ROTATIONS = 9
#: Rungs of the ladder of norms in a doubling.
STEPS = 8
#: Bits of a substring, and the differing bits that a probe allows at first.
SUBSTRING, PROBE = 13, 2
#: Share of all bits that may differ for a row to be reranked, and how often k rows must be left.
RADIUS, WIDTH = 0.47, 10
#: Vectors per index block, and queries per chunk.
BLOCK, CHUNK = 32768, 4096


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Codes:
    """Learned rotations of lifted vectors."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS):
        x = self.lift(sample)
        _, axes = np.linalg.eigh(x.T @ x)
        rng, self.rotations = np.random.default_rng(11), []
        for _ in range(rotations):
            r, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
            for _ in range(15):
                u, _, v = np.linalg.svd((x @ axes).T @ np.where(x @ axes @ r >= 0, 1.0, -1.0))
                r = u @ v
            self.rotations.append(axes @ r)

    @staticmethod
    def lift(x: np.ndarray) -> np.ndarray:
        """Scaled to the length one of their rung, so that norms of any size are in range."""
        size = np.abs(x).max(axis=1, keepdims=True)
        x = x / size
        rung = np.ceil((np.log2(size) + np.log2(np.linalg.norm(x, axis=1, keepdims=True))) * STEPS) / STEPS
        x = x / np.exp2(rung - np.log2(size))
        return np.concatenate([x, np.sqrt(np.maximum(1 - (x**2).sum(axis=1, keepdims=True), 0))], axis=1)

    def bits(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Sign codes; a query's own lift is zero."""
        lifted = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self.lift(x)
        return np.concatenate([lifted @ r >= 0 for r in self.rotations], axis=1)


def substrings(bits: np.ndarray) -> np.ndarray:
    """The substrings of codes as rows of numbers."""
    size = min(SUBSTRING, bits.shape[1])
    parts = bits[:, : bits.shape[1] // size * size].reshape(len(bits), -1, size)
    return parts @ (1 << np.arange(size))


def packed(bits: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    found = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(found, ((0, 0), (0, -found.shape[1] % 8)))).view(np.uint64)


class Index:
    """One block's vectors, indexed by the value of every substring of their codes."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        bits = codes.bits(vectors)
        self.n_bits, self.packed, code = bits.shape[1], packed(bits), substrings(bits)
        self.size = min(SUBSTRING, self.n_bits)
        order = np.argsort(code, axis=0, kind="stable").T
        values = np.arange((1 << self.size) + 1)
        bounds = np.stack([np.searchsorted(c[o], values) for c, o in zip(code.T, order, strict=True)])
        self.order, self.bounds = order.ravel().astype(np.int32), (bounds + len(ids) * np.arange(len(order))[:, None]).ravel().astype(np.int32)
        self.starts = len(values) * np.arange(len(order))[:, None]
        distance = np.bitwise_count(values[:-1])
        self.masks = [np.flatnonzero(distance <= PROBE), *(np.flatnonzero(distance == d) for d in range(PROBE + 1, self.size + 1))]

    def probes(self, code: np.ndarray) -> Iterator[np.ndarray]:
        """The rows that share a substring with the code, but for so many bits as a probe allows;
        then those with one bit more, until all rows are found."""
        found = np.zeros(len(self.ids), bool)
        for masks in self.masks:
            at = (masks ^ code[:, None]) + self.starts
            first, last = self.bounds[at].ravel(), self.bounds[at + 1].ravel()
            some = last > first
            first, size = first[some], (last - first)[some]
            ends = np.cumsum(size)
            if len(ends):
                found[self.order[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]] = True
            yield np.flatnonzero(found)

    def near_codes(self, bits: np.ndarray, code: np.ndarray, least: int) -> np.ndarray:
        """Probed rows within the radius; all probed ones once a probe has found every row."""
        for rows in self.probes(code):
            if len(rows) == len(self.ids):
                return rows
            near = rows[np.bitwise_count(self.packed[rows] ^ bits).sum(axis=1) <= RADIUS * self.n_bits]
            if len(near) >= least:
                return near
        return rows

    def nearest(self, query_id: int, query: np.ndarray, bits: np.ndarray, code: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        rows = self.near_codes(bits, code, WIDTH * k)
        rows = rows[self.ids[rows] != query_id]
        near = self.vectors[rows] @ query
        if len(near) > k:
            least = np.partition(near, len(near) - k)[len(near) - k]
            rows = rows[near >= least - 1e-9 * max(1.0, abs(least))]
        exact = (self.vectors[rows] * query).sum(axis=1)
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return [(query_id, int(self.ids[rows[i]]), float(exact[i])) for i in best]


HITS = "query_id long, vec_id long, score double"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(rows: DataFrame, asked: DataFrame, n_blocks: int, codes: Codes, k: int) -> DataFrame:
    """``HITS``: for each query, the best k of the rows that every block's index finds."""
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    queries = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    both = rows.select(block.alias("block"), F.lit(False).alias("query"), "vec_id", "vector").union(queries.select("block", F.lit(True), "vec_id", "vector"))
    both = both.repartition(n_blocks, "block").sortWithinPartitions("block", "query")
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def answers(index: Index, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        x = _matrix(queries["vector"].combine_chunks())
        bits = shared.value.bits(x, query=True)
        packs, code = packed(bits), substrings(bits)
        ids = queries["vec_id"].to_pylist()
        for a in range(0, len(ids), 256):
            hits = [h for i in range(a, min(a + 256, len(ids))) for h in index.nearest(ids[i], x[i], packs[i], code[i], k)]
            yield arrow_rows(_HITS, {f.name: [h[i] for h in hits] for i, f in enumerate(_HITS)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            kind = np.stack([batch["block"].to_numpy(), batch["query"].to_numpy(zero_copy_only=False)], axis=1)
            at = [0, *(np.flatnonzero((kind[1:] != kind[:-1]).any(axis=1)) + 1), len(batch)]
            for start, end in zip(at, at[1:]):
                number, query = kind[start]
                if number != now:
                    now, held, index = number, [], None
                part = batch.slice(start, end - start)
                if not query:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    table = pa.Table.from_batches(held)
                    index, held = Index(shared.value, table["vec_id"].to_numpy(), _matrix(table["vector"].combine_chunks())), []
                for a in range(0, len(part), CHUNK):
                    yield from answers(index, pa.Table.from_batches([part.slice(a, CHUNK)]))

    return both.mapInArrow(run, HITS)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows that satisfy ``queries`` (over ``vec_id``)."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    spark = vectors.sparkSession
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    rows = rows.filter(F.size("vector") == common["dim"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    codes = Codes(_matrix(sample["vector"].combine_chunks()))
    n_blocks = -(-common["n"] // BLOCK)
    asked = rows.filter(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    hits = _search(rows, asked, n_blocks, codes, k)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id")))
    best = hits.groupBy("query_id").agg(F.slice(order, 1, k).alias("best"))
    best = best.select("query_id", F.posexplode("best").alias("pos", "b"))
    return best.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.away")).alias("score"))
