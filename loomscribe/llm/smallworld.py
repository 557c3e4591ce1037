"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class, led by its smallest id.  Classes are dealt into shards of at most about
``SHARD_ROWS`` rows (``SHARD_BYTES`` of vectors) by a hash of the id, and every shard builds its
graph once, into a table.  Each pair of shards then meets in one unit of work: the vectors of one
are searched in the graph of the other.  A search descends the sparse layers, goes on with a beam
over the base layer, and floods from all that lies in range, so a group of any size is found whole
whatever the beam.  A unit compares its answers for ``AUDIT`` of its queries with an exact scan; until
the recall of links is ``RECALL`` or more, the beam is doubled and the unit searched again (a beam as
wide as the shard is the exact scan).  Cosines are taken in double precision, and a link is credited to
both its ends.  A unit hands on one row per vector with links: their number, and the smallest id that
its links join it to inside the unit.  Pairs are never emitted; the joins over all units are united
by connected components.

Every query meets every shard, so the work grows with rows * rows / shard size, each at the cost of
a graph search instead of a scan.

Defined results: one row per id; null ids are left out; of rows of one id the smallest usable vector
counts; vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths do not link; copies link with each other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscribe.llm.common import arrow_rows
from loomscribe.llm.neighbours import usable
from loomscribe.operators.components import connected_components
from loomscribe.sources.scratch import Workspace

#: Rows of a shard, and bytes of its vectors in double precision.
SHARD_ROWS, SHARD_BYTES = 32768, 64 << 20
#: Neighbours of a node in the base layer and above, candidates they are chosen from, and nodes added at once.
DEGREE, SPARSE_DEGREE, CANDIDATES, STEP = 16, 16, 32, 1024
#: Further places of a node for neighbours that nothing else would lead to.
SPARE = 2
#: One node in so many is in the next layer; a layer of at most ``TOP`` nodes is the last.
THINNING, TOP = 16, 256
#: Beam at first, nodes of it that a round expands at least, queries searched together.
BEAM, EXPAND, TOGETHER = 16, 8, 256
#: Nodes that a layer hands down to the next to begin with.
ENTRIES = 8
#: Searches are in single precision, whose error is below this; what they find is judged in double precision.
ROUNDING = 1e-4
#: Queries of a unit that are compared with an exact scan, and the share of their links to be found.
AUDIT, RECALL = 256, 0.999


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors at unit length, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row, largest first."""
    if sims.shape[1] > k:
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        top = np.tile(np.arange(sims.shape[1]), (len(sims), 1))
    order = np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


class Layer:
    """One layer: the nodes 0 .. n - 1 of ``x`` with at most ``degree`` neighbours each and ``SPARE`` places, -1 for none."""

    def __init__(self, x: np.ndarray, degree: int, links: np.ndarray | None = None):
        self.x, self.degree = x, degree
        self.links = np.full((len(x), degree + SPARE), -1, np.int32) if links is None else links

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ``beam`` best nodes of each query with their similarity (-1, -inf for none), from its ``entry`` nodes.

        With ``least``, also the (query, node) pairs found at or above it; all of their neighbours are looked at.
        """
        rows, n = len(queries), len(self.x)
        seen = np.zeros(rows * n, bool)
        turn = np.zeros(rows * n, np.int32)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def fresh(row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Of parallel (row, node) those not seen before, each once: their places, and the similarities."""
            at = np.flatnonzero(node >= 0)
            key = row[at].astype(np.int64) * n + node[at]
            new = ~seen[key]
            at, key = at[new], key[new]
            turn[key] = np.arange(len(key))
            once = turn[key] == np.arange(len(key))
            at, key = at[once], key[once]
            seen[key] = True
            sim = np.empty(len(at), np.float32)
            for a in range(0, len(at), 1 << 16):
                part = at[a : a + (1 << 16)]
                sim[a : a + (1 << 16)] = np.einsum("ij,ij->i", queries[row[part]], self.x[node[part]])
            if least is not None:
                near = sim >= least
                found.append((row[at[near]], node[at[near]]))
            return at, row[at], node[at], sim

        def offered(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row = np.repeat(np.arange(rows), nodes.shape[1])
            sims = np.full(nodes.size, -np.inf, np.float32)
            at, _, _, sim = fresh(row, nodes.ravel())
            sims[at] = sim
            return np.where(np.isfinite(sims), nodes.ravel(), -1).reshape(nodes.shape), sims.reshape(nodes.shape)

        pool, sims = offered(entry)
        done = pool < 0
        line = np.arange(rows)[:, None]
        while True:
            order = _best(sims, beam)
            pool, sims, done = pool[line, order], sims[line, order], done[line, order]
            if done.all():
                break
            rank = np.where(done, -np.inf, sims)
            chosen = _best(rank, min(max(EXPAND, beam // 4), rank.shape[1]))
            opened = np.where(np.isfinite(rank[line, chosen]), pool[line, chosen], -1)
            np.put_along_axis(done, chosen, True, axis=1)
            around = np.where(opened[..., None] >= 0, self.links[opened], -1).reshape(rows, -1)
            nodes, near = offered(around)
            pool, sims = np.concatenate([pool, nodes], axis=1), np.concatenate([sims, near], axis=1)
            done = np.concatenate([done, nodes < 0], axis=1)
        if least is None:
            none = np.zeros(0, np.int64)
            return pool, sims, none, none
        frontier = (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        while len(frontier[0]):
            before, step = len(found), 1 << 15
            for a in range(0, len(frontier[0]), step):
                around = self.links[frontier[1][a : a + step]]
                fresh(np.repeat(frontier[0][a : a + step], self.links.shape[1]), around.ravel())
            frontier = tuple(np.concatenate([f[k] for f in found[before:]]) for k in (0, 1))
        return pool, sims, *(np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))

    def chosen(self, at: np.ndarray, candidates: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Diverse neighbours: a candidate is kept if it is nearer to its node than to all kept before; the nearest of the others fill up."""
        order = _best(sims, candidates.shape[1])
        candidates, sims = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(sims, order, axis=1)
        valid = np.isfinite(sims) & (candidates >= 0)
        vectors = self.x[candidates]
        between = vectors @ vectors.transpose(0, 2, 1)
        kept, n = np.zeros(candidates.shape, bool), np.zeros(len(at), int)
        for j in range(candidates.shape[1]):
            blocked = (kept[:, :j] & (between[:, j, :j] > sims[:, j, None])).any(axis=1)
            kept[:, j] = valid[:, j] & ~blocked & (n < self.degree)
            n += kept[:, j]
        rank = np.where(kept, 0, np.where(valid, 1, 2)) * candidates.shape[1] + np.arange(candidates.shape[1])
        first = np.argsort(rank, axis=1)[:, : self.degree]
        picked = np.where(np.take_along_axis(valid, first, axis=1), np.take_along_axis(candidates, first, axis=1), -1)
        out = np.full((len(at), self.degree), -1, np.int32)
        out[:, : picked.shape[1]] = picked
        return out

    def connect(self, at: np.ndarray, picked: np.ndarray) -> None:
        """Give the nodes ``at`` their neighbours, and these a link back, chosen anew where they have too many."""
        self.links[at, : self.degree] = picked
        source, target = np.repeat(at, self.degree), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        near = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-near, target))
        source, target = source[order], target[order]
        nodes, first, size = np.unique(target, return_index=True, return_counts=True)
        width = int(min(size.max(initial=0), 2 * self.degree))
        place = np.arange(len(target)) - np.repeat(first, size)
        back = np.full((len(nodes), width), -1, np.int64)
        inside = place < width
        back[np.searchsorted(nodes, target[inside]), place[inside]] = source[inside]
        for a in range(0, len(nodes), STEP):
            part = nodes[a : a + STEP]
            both = np.concatenate([self.links[part, : self.degree], back[a : a + STEP]], axis=1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.where(both >= 0, np.einsum("ij,ikj->ik", self.x[part], self.x[both]), -np.inf)
            self.links[part, : self.degree] = self.chosen(part, both, sims)

    def open_up(self, known: int) -> None:
        """Make every node one that its nearest lead to, and one that a path leads to from the first ``known``, by spare places."""
        near = np.full((len(self.x), self.degree), -np.inf)
        for a in range(0, len(self.x), STEP):
            near[a : a + STEP] = np.einsum("ij,ikj->ik", self.x[a : a + STEP], self.x[self.links[a : a + STEP, : self.degree]])
        hosts = np.take_along_axis(self.links[:, : self.degree], np.argsort(-np.where(self.links[:, : self.degree] >= 0, near, -np.inf), axis=1, kind="stable"), axis=1)
        back = (self.links[hosts[:, :2]] == np.arange(len(self.x))[:, None, None]).any(axis=2) & (hosts[:, :2] >= 0)
        for node in np.flatnonzero(~back.any(axis=1)):
            for host in hosts[node]:
                place = np.flatnonzero(self.links[host, -SPARE:] < 0) if host >= 0 else ()
                if len(place):
                    self.links[host, self.links.shape[1] - SPARE + place[0]] = node
                    break
        reached = np.zeros(len(self.x), bool)
        front = np.arange(known)
        while True:
            reached[front] = True
            while len(front):
                front = np.unique(self.links[front])
                front = front[(front >= 0) & ~reached[np.maximum(front, 0)]]
                reached[front] = True
            if reached.all():
                return
            lost = int(np.flatnonzero(~reached)[0])
            free = reached & (self.links[:, -SPARE:] < 0).any(axis=1)
            host = int(np.argmax(np.where(free, self.x @ self.x[lost], -np.inf)))
            place = self.links.shape[1] - SPARE + int(np.argmax(self.links[host, -SPARE:] < 0))
            self.links[host, place] = lost
            front = np.array([lost])


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; the upper layers hold the first rows."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None):
        self.x, x = x, x.astype(np.float32)
        sizes = [len(x)]
        while sizes[-1] > TOP:
            sizes.append(max(TOP, sizes[-1] // THINNING))
        degrees = [DEGREE, *[SPARSE_DEGREE] * (len(sizes) - 1)]
        self.layers = [Layer(x[:n], d, None if layers is None else layers[i]) for i, (n, d) in enumerate(zip(sizes, degrees, strict=True))]
        if layers is None:
            for level in reversed(range(len(self.layers))):
                self._build(level)

    def entries(self, queries: np.ndarray, level: int) -> np.ndarray:
        """Nodes from which a search of a layer begins: the best of the layer above; of the last layer, the best of all."""
        if level == len(self.layers) - 1:
            return _best(queries @ self.layers[level].x.T, ENTRIES)
        return self.layers[level + 1].search(queries, self.entries(queries, level + 1), ENTRIES)[0]

    def _build(self, level: int) -> None:
        layer, start = self.layers[level], min(TOP, len(self.layers[level].x))
        at = np.arange(start)
        sims = layer.x[:start] @ layer.x[:start].T
        np.fill_diagonal(sims, -np.inf)
        best = _best(sims, min(CANDIDATES, start))
        layer.connect(at, layer.chosen(at, best, np.take_along_axis(sims, best, axis=1)))
        while start < len(layer.x):
            end = min(len(layer.x), start + min(STEP, start))
            for a in range(start, end, TOGETHER):
                at = np.arange(a, min(end, a + TOGETHER))
                above = self.entries(layer.x[at], level)
                old, near, _, _ = Layer(layer.x[:start], layer.degree, layer.links[:start]).search(layer.x[at], np.where(above < start, above, 0), CANDIDATES)
                new = layer.x[at] @ layer.x[start:end].T
                new[np.arange(len(at)), at - start] = -np.inf
                best = _best(new, CANDIDATES // 2)
                candidates = np.concatenate([old, best + start], axis=1)
                picked = layer.chosen(at, candidates, np.concatenate([near, np.take_along_axis(new, best, axis=1)], axis=1))
                waiting = picked if a == start else np.concatenate([waiting, picked])
            layer.connect(np.arange(start, end), waiting)
            start = end
        layer.open_up(len(self.layers[level + 1].x) if level + 1 < len(self.layers) else min(TOP, len(layer.x)))

    def near(self, queries: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a similarity of ``least`` or more; queries that are nodes begin at their ``own``."""
        if beam >= len(self.x):
            return np.nonzero(queries @ self.x.T >= least)
        coarse = queries.astype(np.float32)
        entry = self.entries(coarse, 0) if own is None else own[:, None]
        _, _, query, node = self.layers[0].search(coarse, entry, beam, least - ROUNDING)
        sure = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", queries[query[a : a + 32768]], self.x[node[a : a + 32768]]) >= least for a in range(0, len(query), 32768))])
        return query[sure], node[sure]


class Unions:
    """Sets of numbers 0 .. n - 1, each led by its smallest."""

    def __init__(self, n: int):
        self.lead = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.lead[a], self.lead[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.lead, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.lead[self.lead]
                if (up == self.lead).all():
                    break
                self.lead = up


def links_between(graph: Graph, weight: np.ndarray, queries: np.ndarray, q_weight: np.ndarray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all nodes, then all queries: the vectors linked to each, the smallest place joined to it, and whether it has links.

    With ``same`` the queries are the graph's own nodes in their order, and links count at the query only.
    """
    n, m = len(graph.x), len(queries)
    audit = np.unique(np.linspace(0, m - 1, min(AUDIT, m)).astype(int))
    truth = queries[audit] @ graph.x.T >= least
    beam = BEAM
    while beam < n:
        hit = np.zeros_like(truth)
        for a in range(0, len(audit), TOGETHER):
            query, node = graph.near(queries[audit[a : a + TOGETHER]], least, beam, audit[a : a + TOGETHER] if same else None)
            hit[query + a, node] = True
        if (hit & truth).sum() >= RECALL * truth.sum():
            break
        beam *= 2
    counts, sets = np.zeros(n + m, np.int64), Unions(n if same else n + m)
    for a in range(0, m, TOGETHER):
        query, node = graph.near(queries[a : a + TOGETHER], least, beam, np.arange(a, min(a + TOGETHER, m)) if same else None)
        query = query + a
        if same:
            query, node = query[query != node], node[query != node]
            sets.unite(query, node)
        else:
            counts[:n] += np.bincount(node, q_weight[query], n).astype(np.int64)
            sets.unite(query + n, node)
        counts[n:] += np.bincount(query, weight[node], m).astype(np.int64)
    if same:
        return counts[n:], sets.lead, counts[n:] > 0
    return counts, sets.lead, counts > 0


_NODES = "dim int, shard int, pos int, vec_id long, n long, vector array<double>, links array<array<int>>"
_FOUND = pa.schema([("vec_id", pa.int64()), ("n_links", pa.int64()), ("lead", pa.int64())])


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys over sorted batches, as one table each."""
    now, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            key = tuple(c[a].item() for c in columns)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def build_graphs(classes: DataFrame) -> DataFrame:
    """``dim, shard, pos, vec_id, n, vector, links``: every shard's nodes with their neighbours by layer."""
    out = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("pos", pa.int32()), ("vec_id", pa.int64()), ("n", pa.int64()), ("vector", pa.list_(pa.float64())), ("links", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, shard), rows in _groups(batches, "dim", "shard"):
            graph = Graph(unit_rows(rows["vector"].combine_chunks()))
            for a in range(0, len(rows), 4096):
                part = rows.slice(a, 4096)
                end = a + len(part)
                links = [[layer.links[i].tolist() for layer in graph.layers if i < len(layer.x)] for i in range(a, end)]
                columns = {"dim": [dim] * len(part), "shard": [shard] * len(part), "pos": range(a, end), "links": links}
                columns |= {c: part[c].to_pylist() for c in ("vec_id", "n")} | {"vector": part["vector"].combine_chunks().cast(pa.list_(pa.float64()))}
                yield arrow_rows(out, columns)

    rows = classes.select("dim", "shard", F.xxhash64("vec_id").alias("_h"), "vec_id", "n", "vector")
    return rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "_h", "vec_id").drop("_h").mapInArrow(run, _NODES)


def _graph(rows: pa.Table) -> Graph:
    x = unit_rows(rows["vector"].combine_chunks())
    links = rows["links"].to_pylist()
    layers: list[np.ndarray] = []
    for level in range(len(links[0])):
        layers.append(np.array([node[level] for node in links if len(node) > level], np.int32))
    return Graph(x, layers)


def shard_links(nodes: DataFrame, least: float) -> DataFrame:
    """``vec_id, n_links, lead``: what every pair of shards adds to a vector, and an id it is joined to."""
    shards = nodes.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    both = nodes.join(F.broadcast(shards), "dim")
    asked = both.select("dim", F.explode(F.sequence("shard", F.col("shards") - 1)).alias("graph"), F.col("shard").alias("asker"), F.lit(1).alias("kind"), "pos", "vec_id", "n", "vector", F.lit(None).cast("array<array<int>>").alias("links"))
    held = both.select("dim", F.col("shard").alias("graph"), F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("asker"), F.lit(0).alias("kind"), "pos", "vec_id", "n", "vector", "links")
    units = held.unionByName(asked.filter("graph <> asker")).repartition("dim", "graph", "asker").sortWithinPartitions("dim", "graph", "asker", "kind", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = ids = weight = None
        for (_, number, asker, kind), rows in _groups(batches, "dim", "graph", "asker", "kind"):
            own, n = rows["vec_id"].to_numpy(), rows["n"].to_numpy()
            if kind == 0:
                graph, ids, weight = _graph(rows), own, n
                if asker != number:
                    continue
                counts, lead, linked = links_between(graph, weight, graph.x, weight, True, least)
            else:
                counts, lead, linked = links_between(graph, weight, unit_rows(rows["vector"].combine_chunks()), n, False, least)
            all_ids = ids if kind == 0 else np.concatenate([ids, own])
            smallest = np.full(len(all_ids), np.iinfo(np.int64).max)
            np.minimum.at(smallest, lead, all_ids)
            yield arrow_rows(_FOUND, {"vec_id": all_ids[linked], "n_links": counts[linked], "lead": smallest[lead[linked]]})

    return units.mapInArrow(run, "vec_id long, n_links long, lead long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: links by cosine of ``least`` or more, united."""
    work = Workspace(vectors.sparkSession, "smallworld")
    value = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(usable(value), value).alias("vector")).filter("vec_id is not null")
    rows = work.save(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "rows")
    sizes = rows.filter("vector is not null").groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("rows"))
    most = F.least(F.lit(SHARD_ROWS), F.greatest(F.lit(TOP), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    shards = sizes.select("dim", F.ceil(F.col("rows") / most).cast("int").alias("shards"))
    classes = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).withColumn("dim", F.size("vector"))
    classes = classes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("shards")).cast("int"))
    nodes = work.save(build_graphs(classes), "nodes")
    found = work.save(shard_links(nodes, least), "links")
    joined = connected_components(found, "vec_id", "lead").withColumnRenamed("node", "lead_id")
    counts = found.groupBy(F.col("vec_id").alias("lead_id")).agg(F.sum("n_links").alias("links"))
    copies = nodes.filter("n > 1").select("vector", F.col("vec_id").alias("class_id"), "n")
    led = rows.join(copies, "vector", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("lead_id"), F.coalesce("n", F.lit(1)).alias("n"))
    out = led.join(counts, "lead_id", "left").join(joined, "lead_id", "left")
    component = F.coalesce("component", "lead_id")
    links = F.coalesce("links", F.lit(0)) + F.col("n") - 1
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
