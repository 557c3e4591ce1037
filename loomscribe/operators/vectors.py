"""Normalised vectors, embeddings and exact cosine search.

Top-k search works on blocks: the vectors of a repository that a task holds form a matrix, one product
scores them against all queries of the repository, and a task hands on at most k hits per query.  Queries
are the small side and are broadcast when their bytes are checked to be few; else both sides are dealt by
repository and a salt, the queries to every salt.  Models embed texts in calls of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscribe.plans.retry import OUTCOME, Retry

#: Bytes of query vectors that may be broadcast; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; zero vectors stay zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(x.cast("double") / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once and not for every element of arrays that ``use`` goes through."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hashed_bow(text: Column, dim: int = 64) -> Column:
    """Deterministic default embedding: counts of words by hash bucket."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dim)
    # a mark for every bucket and one more, in order: where each value ends, the distance to the end before is its count
    marked = F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(dim))))
    ends = _let(marked, lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: ~F.get(m, i).eqNullSafe(F.get(m, i + 1))))
    count = lambda e: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.get(e, i) - F.coalesce(F.get(e, i - 1), F.lit(-1)) - 1).cast("float"))
    return _let(ends, count)


def embed(rows: DataFrame, text: str = "text", embedder: Callable[[Column], Column] = hashed_bow) -> DataFrame:
    """Rows with ``embedding``; ``embedder`` may be a pandas UDF that batches a model."""
    return rows.withColumn("embedding", embedder(F.col(text)))


#: Texts of one call of a model at most.
PER_CALL = 100
_models: dict[str, Callable[[list[str]], Sequence[Sequence[float]]]] = {}


def embed_batches(
    rows: DataFrame, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], model: str, text: str = "text", per_call: int = PER_CALL, retry: Retry | None = None
) -> DataFrame:
    """``rows`` with ``embedding``, ``calls`` (texts of the call) and ``OUTCOME``, by a model that embeds lists of texts.

    ``load`` makes the model, once per worker process for each name ``model``.  Texts are regrouped to
    ``per_call`` a call across Arrow batches; null texts count as empty.  A call that fails for good
    leaves null embeddings and its error on its rows.
    """
    policy = retry or Retry()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def embedded(batch: pa.Table, function: Callable) -> Iterator[pa.RecordBatch]:
        batch = batch.combine_chunks()
        texts = [t or "" for t in batch[text].to_pylist()]
        vectors, attempts, error, notes = policy.call(lambda: list(function(texts)))
        if vectors is not None and len(vectors) != len(texts):
            vectors, error = None, f"ValueError: {len(texts)} texts gave {len(vectors)} vectors"
        n = len(texts)
        batch = batch.append_column("embedding", pa.array([None] * n if vectors is None else [np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32())))
        for name, value, kind in (("calls", n, pa.int32()), ("attempts", attempts, pa.int32()), ("error", error, pa.string()), ("notes", notes, pa.list_(pa.string()))):
            batch = batch.append_column(name, pa.array([value] * n, kind))
        yield from batch.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, per_call - n)
                held.append(part)
                n, batch = n + len(part), batch.slice(len(part))
                if n == per_call:
                    if model not in _models:
                        _models[model] = load()
                    yield from embedded(pa.Table.from_batches(held), _models[model])
                    held, n = [], 0
        if n:
            if model not in _models:
                _models[model] = load()
            yield from embedded(pa.Table.from_batches(held), _models[model])

    return rows.mapInArrow(run, f"{fields}, embedding array<float>, calls int, {OUTCOME}")


def _scored(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``repo_id, query_id, chunk_id, score`` of all chunks of each query's repository."""
    asked = queries.select("repo_id", "query_id", l2_normalize(F.col("embedding")).alias("q"))
    n_bytes = queries.agg(F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0))).first()[0]
    if n_bytes <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    scored = chunks.select("repo_id", "chunk_id", l2_normalize(F.col("embedding")).alias("v")).join(asked, "repo_id")
    return scored.select("repo_id", "query_id", "chunk_id", dot(F.col("q"), F.col("v")).alias("score"))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Best:
    """The best ``k`` chunks of each query of one repository, over the blocks that a task has seen."""

    def __init__(self, ids: list, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.hits: list[list[tuple[float, object]]] = [[] for _ in ids]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        near = self.queries @ vectors.T
        k = min(self.k, near.shape[1])
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1]
        for i in range(len(self.ids)):
            # the product only chooses; scores are summed anew in one order, so that equal vectors tie
            at = np.flatnonzero(near[i] >= least[i] - 1e-12)
            exact = (vectors[at] * self.queries[i]).sum(axis=1)
            self.hits[i] = sorted([*self.hits[i], *zip((-exact).tolist(), ids[at].tolist(), strict=True)])[: self.k]

    def rows(self) -> Iterator[tuple]:
        for query, hits in zip(self.ids, self.hits, strict=True):
            for away, chunk in hits:
                yield query, -away, chunk


#: Rows of a repository's chunks that are scored at once; when queries are not broadcast, chunks for each salt of a repository.
BLOCK_ROWS, SALT_ROWS = 4096, 65536


def _block_hits(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``repo_id, query_id, chunk_id, score``: of each task's chunks, the best k of every query."""
    queries, chunks = (rows.filter("embedding is not null") for rows in (queries, chunks))
    asked = queries.select("repo_id", "query_id", F.col("embedding").alias("q"))
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("repo_id", "query_id")}
    chunk_kind = chunks.schema["chunk_id"].dataType.simpleString()
    n_bytes = queries.agg(F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0))).first()[0]
    shared = asked.toArrow() if n_bytes <= BROADCAST_BYTES else None
    rows = chunks.select(F.lit(1).alias("kind"), "repo_id", F.lit(None).cast(kinds["query_id"]).alias("query_id"), "chunk_id", F.col("embedding").cast("array<double>").alias("v"))
    if shared is None:
        # queries are repeated for every salt, so a repository gets no more of them than its chunks need
        salts = chunks.groupBy("repo_id").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
        salted = rows.join(salts, "repo_id").select(*rows.columns, F.pmod(F.xxhash64("chunk_id"), F.col("salts")).cast("int").alias("salt"))
        every = F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int")))
        held = asked.join(salts, "repo_id").select(F.lit(0).alias("kind"), "repo_id", "query_id", F.lit(None).cast(chunk_kind).alias("chunk_id"), F.col("q").cast("array<double>").alias("v"), every.alias("salt"))
        rows = salted.unionByName(held).repartition("repo_id", "salt").sortWithinPartitions("repo_id", "salt", "kind").drop("salt")
    else:
        shared = queries.sparkSession.sparkContext.broadcast(shared)
    out_kinds = f"repo_id {kinds['repo_id']}, query_id {kinds['query_id']}, chunk_id {chunk_kind}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[object, _Best] = {}
        if shared is not None:
            table = shared.value
            for repo in table["repo_id"].unique().to_pylist():
                own = table.filter(pa.compute.equal(table["repo_id"], pa.scalar(repo, table["repo_id"].type)))
                best[repo] = _Best(own["query_id"].to_pylist(), _unit(own["q"].combine_chunks()), k)
        now, kind_now, held, size = None, None, [], 0
        types: pa.Schema | None = None

        def finish() -> None:
            if not held:
                return
            block = pa.Table.from_batches(held)
            v = block["v"].combine_chunks()
            if kind_now == 0:
                best.clear()  # sorted by repository and salt: what came before has been handed on
                best[now] = _Best(block["query_id"].to_pylist(), _unit(v), k)
            elif now in best:
                best[now].add(block["chunk_id"].to_numpy(zero_copy_only=False), _unit(v))

        def handed(repos: list) -> Iterator[pa.RecordBatch]:
            for repo in repos:
                hits = list(best[repo].rows())
                if hits:
                    columns = [[repo] * len(hits), *([h[i] for h in hits] for i in (0, 2, 1))]
                    names = ("repo_id", "query_id", "chunk_id", "score")
                    kinds_ = [types.field(n).type for n in names[:3]] + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_, strict=True)], list(names))

        for batch in batches:
            types = batch.schema
            if shared is not None:
                batch = batch.take(pa.compute.sort_indices(batch["repo_id"]))
            repos, numbers = batch["repo_id"].to_pylist(), batch["kind"].to_pylist()
            cuts = [0, *(i for i in range(1, len(batch)) if repos[i] != repos[i - 1] or numbers[i] != numbers[i - 1]), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (repos[a], numbers[a]) != (now, kind_now) or (kind_now == 1 and size >= BLOCK_ROWS):
                    finish()
                    if shared is None and numbers[a] == 0 and best:
                        yield from handed(list(best))
                        best.clear()
                    held, size = [], 0
                now, kind_now = repos[a], numbers[a]
                held.append(batch.slice(a, b - a))
                size += b - a
        finish()
        if types is not None:
            yield from handed(list(best))

    return rows.mapInArrow(run, out_kinds)


def topk(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """``repo_id, query_id, rank, score, chunk_id``: best chunks of each query's repository, by the
    unrounded score; the score returned is rounded to six places."""
    hits = _block_hits(queries, chunks, k)
    rank = F.row_number().over(W.partitionBy("repo_id", "query_id").orderBy(F.desc("score"), "chunk_id"))
    best = hits.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("repo_id", "query_id", "rank", F.round("score", 6).alias("score"), "chunk_id")


def scan(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``repo_id, query_id, score, chunk_id``: every query against every chunk of its repository, unranked."""
    return _scored(queries, chunks).select("repo_id", "query_id", F.round("score", 6).alias("score"), "chunk_id")


def multi_topk(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """``group_id, pos, chunk_id``: hits of a group's queries in query order, first appearance kept."""
    first = hits.join(groups, "query_id").groupBy("group_id", "chunk_id").agg(F.min(F.struct("query_pos", "rank")).alias("at"))
    pos = F.row_number().over(W.partitionBy("group_id").orderBy("at")) - 1
    return first.select("group_id", pos.alias("pos"), "chunk_id")


def retrieve(groups: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """``group_id, pos, chunk_id, text``: retrieved chunks with their text."""
    found = multi_topk(topk(queries, chunks, k), groups)
    return found.join(chunks.select("chunk_id", "text"), "chunk_id")
