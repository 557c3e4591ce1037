"""Toxicity by weak supervision.

1. Lexicon items are whole words and word prefixes of several byte lengths (over lower-cased
   ASCII, letters, digits and non-ASCII bytes).  Their counts in toxic and clean labelled
   texts, gathered by one grouped Spark aggregation, select at most ``ITEMS`` of them.
2. Voters are groups of items per kind (toxic or abstain), texts without any hit of a kind
   (clean or abstain) and patterns of several hits.  A generative label model, fitted by
   expectation maximisation without labels, estimates every voter's class means (its
   accuracy) and the voters' covariance within the classes, pooled over both (their correlations).
3. A logistic regression over the items is trained on the model's posterior labels.
4. All texts are scored in one map-side pass with the broadcast weights.

The fit uses at most ``SAMPLE`` labelled texts, those of least id hash; that bounds what
reaches the driver.  Everything else covers all rows.  Language, source and ids are no input.

Defined results: null and empty texts have no hits and get the base score; rows of one id
are scored each; a document with several labels counts as toxic if one says so; without
toxic labels every score is 0; extra columns are ignored; an empty table gives no rows.  Very long
texts are scored whole, each by one task, with some tens of bytes per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscribe.llm.common import Block, arrow_rows, blocks, mix, rows_with, texts_of

#: Labelled texts that the fit uses at most.
SAMPLE = 20_000
#: Lexicon items kept at most, and the toxic texts and odds an item needs.
ITEMS, LEAST_TOXIC, LEAST_ODDS = 2048, 5, 10.0
#: Prefix lengths in bytes; 0 is the whole word.
KINDS = (0, 4, 5, 6, 8)
GROUPS = 6
FOLDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[128:] = False
_BLANKED = np.where(_BREAK, np.uint8(32), np.arange(256, dtype=np.uint8)).astype(np.uint8)


def held_out(doc_id: Column) -> Column:
    """Is the id's fold kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def items(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per kind: its number, the hashes of its items and their texts."""
    words = Block(block.first, _BLANKED[_LOWER[block.data]], block.offsets)
    for kind, size in enumerate(KINDS):
        some = slice(None) if not size else words.end - words.start >= size
        start, end = words.start[some], words.end[some]
        h = words.span_hash(start, np.minimum(end, start + size) if size else end)
        yield kind, mix(h + np.uint64(kind)), words.doc[some]


def _item_rows(texts: DataFrame) -> DataFrame:
    """``toxic, kind, item``: the distinct items of each text."""
    out = pa.schema([("toxic", pa.int32()), ("kind", pa.int32()), ("item", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy()
            for block in blocks(batch["text"]):
                for kind, h, doc in items(block):
                    pair = np.unique(np.stack([doc.astype(np.int64), h.view(np.int64)], axis=1), axis=0)
                    item, at = pair[:, 1], pair[:, 0]
                    yield arrow_rows(out, {"toxic": toxic[block.first + at], "kind": np.full(len(at), kind), "item": item})

    return texts.mapInArrow(rows, "toxic int, kind int, item long")


@dataclass(frozen=True)
class Model:
    """Weights of the linear classifier by item hash (sorted), and what the voters are worth."""

    item: np.ndarray
    kind: np.ndarray
    weight: np.ndarray
    bias: float
    accuracy: np.ndarray
    correlation: np.ndarray

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Texts and item numbers of all hits, each pair once."""
        near = np.zeros(1 << 16, bool)
        near[self.item >> np.uint64(48)] = True
        rows, cols = [], []
        for _, h, doc in items(block):
            some = near[h >> np.uint64(48)]
            h, doc = h[some], doc[some]
            at = np.minimum(np.searchsorted(self.item, h), max(len(self.item) - 1, 0))
            same = self.item[at] == h if len(self.item) else np.zeros(len(h), bool)
            rows.append(doc[same])
            cols.append(at[same])
        pair = np.unique(np.concatenate(rows) * (len(self.item) + 1) + np.concatenate(cols))
        return pair // (len(self.item) + 1), pair % (len(self.item) + 1)

    def score(self, block: Block) -> np.ndarray:
        rows, cols = self.hits(block)
        return _sigmoid(self.bias + np.bincount(rows, self.weight[cols], block.n))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def votes(rows: np.ndarray, cols: np.ndarray, n: int, item: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The voters' matrix over ``n`` texts: 1 toxic, -1 clean, 0 no opinion."""
    columns = []
    group = (item % np.uint64(GROUPS)).astype(np.int64)
    per_kind = []
    for k in range(len(KINDS)):
        of_kind = kind[cols] == k
        per_kind.append(np.bincount(rows[of_kind], minlength=n))
        for g in range(GROUPS):
            hit = of_kind & (group[cols] == g)
            columns.append((np.bincount(rows[hit], minlength=n) > 0).astype(float))
    columns += [-(count == 0).astype(float) for count in per_kind]
    total, kinds = sum(per_kind), sum((count > 0).astype(int) for count in per_kind)
    columns += [(total >= 2).astype(float), (total >= 5).astype(float), (kinds >= 2).astype(float), (kinds >= 4).astype(float)]
    columns.append(np.where(total == 0, -1.0, np.where(per_kind[0] >= 2, 1.0, 0.0)))
    return np.stack(columns, axis=1)


def label_model(vote: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class, voter accuracies, and voter correlations within a class."""
    q = (vote.sum(axis=1) > 0).astype(float) * 0.9 + 0.05
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        mean1, mean0 = (q @ vote) / q.sum(), ((1 - q) @ vote) / (1 - q).sum()
        a, b = vote - mean1, vote - mean0
        cov = (a.T @ (a * q[:, None]) + b.T @ (b * (1 - q)[:, None])) / len(vote) + 0.02 * np.eye(vote.shape[1])
        w = np.linalg.solve(cov, mean1 - mean0)
        q = _sigmoid(vote @ w - (mean1 + mean0) @ w / 2 + np.log(prior / (1 - prior)))
    sign = np.sign(vote)
    right = (np.where(sign > 0, q[:, None], 0) + np.where(sign < 0, 1 - q[:, None], 0)).sum(axis=0)
    scale = np.sqrt(np.diag(cov))
    return q, right / np.maximum((sign != 0).sum(axis=0), 1), cov / np.outer(scale, scale)


def train_linear(rows: np.ndarray, cols: np.ndarray, n: int, m: int, target: np.ndarray, steps: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over binary sparse features, by Adam."""
    w, first, second = np.zeros(m + 1), np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, steps + 1):
        r = _sigmoid(w[m] + np.bincount(rows, w[cols], n)) - target
        g = np.append(np.bincount(cols, r[rows], m) / n + penalty * w[:m], r.mean())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w[:m], float(w[m])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from the labelled texts outside the held-out fold; None without toxic ones."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = texts_of(docs).join(F.broadcast(known), "doc_id").select("toxic", "text")
    counted = _item_rows(texts).groupBy("kind", "item").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    odds = (F.col("bad") + 0.5) / (F.col("all") - F.col("bad") + 0.5)
    chosen = counted.filter((F.col("bad") >= LEAST_TOXIC) & (odds >= LEAST_ODDS)).orderBy(F.desc(F.log(odds) * F.sqrt("bad")), "kind", "item").limit(ITEMS)
    found = chosen.select("kind", "item").toArrow()
    if not len(found):
        return None
    item = found["item"].to_numpy().view(np.uint64)
    order = np.argsort(item)
    item, kind = item[order], found["kind"].to_numpy()[order]
    rows, cols, n = _sample_hits(texts, Model(item, kind, np.zeros(len(item)), 0.0, None, None))
    posterior, accuracy, correlation = label_model(votes(rows, cols, n, item, kind))
    weight, bias = train_linear(rows, cols, n, len(item), posterior)
    return Model(item, kind, weight, bias, accuracy, correlation)


def _sample_hits(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """The sampled texts' hits, gathered on the driver: item numbers of at most SAMPLE texts."""
    out = pa.schema([("hits", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                rows, cols = model.hits(block)
                bound = np.searchsorted(rows, np.arange(block.n + 1)).astype(np.int32)
                yield arrow_rows(out, {"hits": pa.ListArray.from_arrays(pa.array(bound), pa.array(cols.astype(np.int32)))})

    found = texts.select("text").mapInArrow(run, "hits array<int>").toArrow()["hits"].combine_chunks()
    sizes = np.asarray(found.value_lengths())
    return np.repeat(np.arange(len(sizes)), sizes), found.flatten().to_numpy().astype(np.int64), len(sizes)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                value = np.zeros(block.n) if model is None else model.score(block)
                yield arrow_rows(out, {"doc_id": batch["doc_id"].slice(block.first, block.n), "score": value})

    scored = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all columns, that the classifier does not reject."""
    return docs if model is None else rows_with(docs, lambda block: model.score(block) < 0.5)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
