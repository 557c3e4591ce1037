"""The prefix tree of conversations, measured by an Euler tour.

A node is a distinct sequence of first turns; a running digest over a conversation's turns names it.
Every node has an enter and an exit arc.  The successor of an arc follows from the node's
children and siblings in the order of their numbers; siblings are linked within ranges of numbers and the
ranges among each other, so a node with very many children is no single group.  The list of arcs is
ranked distributedly: in each round the arcs whose hash is above both neighbours' leave the
list (a third of them, never two in a row) and hand their length to the arc before, until at most
``SHORT`` arcs are left, which one task walks along; the arcs that left then get their places round by round
in reverse from the arc that stood before them.  Prefix sums over the places, by blocks and then over the
blocks' sums, give at each arc the leaves and savings entered so far, and the difference between
a node's exit and its enter those of its subtree.

Texts are shuffled once, to order the turns; after that a turn is a digest and a length.  The digest of
the ids that end at a node streams over sorted rows.

Defined results: null roles and texts are empty; null ids are left out; turns are taken by
number (nulls first), then role and text; repeated rows are turns of their own; an empty
table has no nodes; other columns are ignored; texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscribe.llm.common import arrow_rows
from loomscribe.sources.scratch import Workspace

#: Arcs that one task ranks at the end.
SHORT = 16384
#: Sibling numbers of a range, and places of a block of prefix sums, as powers of two.
RANGE_BITS, BLOCK_BITS = 16, 16


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, key, chars``: turns numbered from 1, with a digest of role and text and the text's length."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    pos = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    key = F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return rows.withColumn("pos", pos).select("conv_id", "pos", key.alias("key"), F.length("text").cast("long").alias("chars"))


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, key, chars``: conversations that take their first turns from the one at the hundred below.

    Of conversation c the first h = crc32(c) % 6 turns are those of c - c % 100, as far as it has them, then its own follow.
    A conversation without turns is one row with depth 0.
    """
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    ids = turns.select("conv_id").distinct().withColumn("h", taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    heads = turns.filter("conv_id % 100 = 0 and pos <= 5").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "chars"))).alias("head"))
    ids = ids.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("h")))
    first = ids.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.key", "t.chars")
    own = turns.withColumn("h", taken).filter("pos > h").join(ids.select("conv_id", F.size("head").alias("before")), "conv_id")
    own = own.select("conv_id", (F.col("before") + F.col("pos") - F.col("h")).alias("depth"), "key", "chars")
    root = ids.select("conv_id", F.lit(0).alias("depth"), F.lit("").alias("key"), F.lit(0).cast("long").alias("chars"))
    return root.union(first).union(own)


_STEP = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.string()), ("parent", pa.string()), ("chars", pa.int64()), ("last", pa.bool_())])


def paths(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, chars, last``: the nodes on each conversation's way, named by a running digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, state = None, None, None
        for batch in batches:
            out = []
            for conv_id, depth, key, chars in zip(*(batch[c].to_pylist() for c in ("conv_id", "depth", "key", "chars")), strict=True):
                if held is not None:
                    out.append((*held, conv_id != held[0]))
                if depth == 0:
                    name, state = None, blake2b(digest_size=16)
                state.update(key.encode())
                parent, name = name, state.hexdigest()
                held = (conv_id, depth, name, parent, chars)
            if out:
                yield arrow_rows(_STEP, {f.name: [r[i] for r in out] for i, f in enumerate(_STEP)})
        if held is not None:
            yield arrow_rows(_STEP, {f.name: [v] for f, v in zip(_STEP, (*held, True), strict=True)})

    # dealt by a hash of the id: by the id itself, Spark would keep the join's partitions, which a skewed join may split
    rows = rebuilt.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "depth")
    return rows.mapInArrow(run, "conv_id long, depth int, node string, parent string, chars long, last boolean")


def id_digests(ended: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of ``node, conv_id``: the ids in order, joined by commas."""
    out = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for node, conv_id in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, sha256(str(conv_id).encode())
                else:
                    state.update(b",%d" % conv_id)
            if done:
                yield arrow_rows(out, {"node": [d[0] for d in done], "ends_sha256": [d[1] for d in done]})
        if now is not None:
            yield arrow_rows(out, {"node": [now], "ends_sha256": [state.hexdigest()]})

    rows = ended.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    return rows.mapInArrow(run, "node string, ends_sha256 string")


def numbered_nodes(steps: DataFrame, work: Workspace) -> DataFrame:
    """``id, parent_id, conv_id, depth, n_convs, gain, node``: the tree's nodes with numbers, ``gain`` being what a node itself saves."""
    nodes = steps.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("chars").alias("chars")
    )
    nodes = work.save(nodes.withColumn("id", F.monotonically_increasing_id()), "numbered")
    parents = nodes.select(F.col("node").alias("parent"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    gain = (F.col("n_convs") - 1) * F.col("chars")
    return work.save(nodes.join(parents, "parent", "left").select("id", "parent_id", "conv_id", "parent_conv_id", "depth", "n_convs", gain.alias("gain"), "node"), "nodes")


def sibling_links(nodes: DataFrame) -> DataFrame:
    """``id, before, after``: the neighbours among the children of one node, in the order of numbers."""
    span = F.shiftright("id", RANGE_BITS)
    kids = nodes.filter("parent_id is not null").select("id", "parent_id", span.alias("span"))
    inside = W.partitionBy("parent_id", "span").orderBy("id")
    kids = kids.withColumns({"before": F.lag("id").over(inside), "after": F.lead("id").over(inside)})
    spans = kids.groupBy("parent_id", "span").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    across = W.partitionBy("parent_id").orderBy("span")
    spans = spans.select("parent_id", "span", F.lag("last").over(across).alias("left"), F.lead("first").over(across).alias("right"))
    joined = kids.join(spans, ["parent_id", "span"])
    return joined.select("id", F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after"))


def tour(nodes: DataFrame) -> DataFrame:
    """``arc, prev, next, hop``: enter arcs 2 id and exit arcs 2 id + 1 of all nodes in the order of a walk around the tree."""
    ends = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    rows = nodes.select("id", "parent_id").join(ends, "id", "left").join(sibling_links(nodes), "id", "left")
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    parent = F.col("parent_id")
    arcs = F.array(
        F.struct(enter.alias("arc"), F.coalesce(F.col("before") * 2 + 1, parent * 2).alias("prev"), F.coalesce(F.col("first") * 2, leave).alias("next")),
        F.struct(leave.alias("arc"), F.coalesce(F.col("last") * 2 + 1, enter).alias("prev"), F.coalesce(F.col("after") * 2, parent * 2 + 1).alias("next")),
    )
    return rows.select(F.inline(arcs)).withColumn("hop", F.lit(1).cast("long"))


_PLACE = pa.schema([("arc", pa.int64()), ("place", pa.int64())])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the arcs of a whole short list."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    arc, hop = rows["arc"].to_numpy(), rows["hop"].to_numpy()
    order = np.argsort(arc)
    after = rows["next"].combine_chunks().fill_null(-1).to_numpy()
    after = np.where(after < 0, -1, order[np.minimum(np.searchsorted(arc[order], after), len(arc) - 1)])
    at, place, places = int(np.flatnonzero(rows["prev"].combine_chunks().is_null().to_numpy(zero_copy_only=False))[0]), 0, np.zeros(len(arc), np.int64)
    while at >= 0:
        places[at] = place
        place, at = place + hop[at], int(after[at])
    yield arrow_rows(_PLACE, {"arc": arc, "place": places})


def ranked(arcs: DataFrame, work: Workspace, short: int = SHORT) -> DataFrame:
    """``arc, place``: the position of each arc of the list, from 0."""
    left, state = work.save(arcs, "arcs", n=F.count(F.lit(1)))
    gone: list[DataFrame] = []
    while state["n"] > short:
        turn = len(gone)
        above = [F.xxhash64("arc", F.lit(turn)) > F.xxhash64(c, F.lit(turn)) for c in ("prev", "next")]
        marked = left.withColumn("out", F.col("prev").isNotNull() & F.col("next").isNotNull() & above[0] & above[1])
        removed = marked.filter("out").select("arc", "prev", "next", "hop")
        gone.append(work.save(removed, f"gone{turn}"))
        none = F.lit(None).cast("long")
        messages = marked.filter("not out").select("arc", "prev", "next", "hop", none.alias("new_prev"), none.alias("new_next"))
        to_prev = removed.select(F.col("prev").alias("arc"), none, none, F.col("hop"), none, F.col("next"))
        to_next = removed.select(F.col("next").alias("arc"), none, none, F.lit(0).cast("long"), F.col("prev"), none)
        grouped = messages.union(to_prev).union(to_next).groupBy("arc").agg(*(F.max(c).alias(c) for c in ("prev", "next", "new_prev", "new_next")), F.sum("hop").alias("hop"))
        # an arc may lie between two that have left: each end has at most one message
        kept = grouped.select("arc", F.coalesce("new_prev", "prev").alias("prev"), F.coalesce("new_next", "next").alias("next"), "hop")
        left, state = work.save(kept, f"left{turn}", n=F.count(F.lit(1)))
        work.drop("arcs" if turn == 0 else f"left{turn - 1}")
    walked = left.coalesce(1).mapInArrow(_walked, "arc long, place long")
    held = work.save(walked.join(left.select("arc", "hop"), "arc"), "places")
    for turn in reversed(range(len(gone))):
        # an arc stood before the one that left, as far ahead as its own hop was then
        before = gone[turn].select("arc", F.col("prev").alias("from"), F.col("hop").alias("own"))
        found = before.join(held.select(F.col("arc").alias("from"), "place", "hop"), "from").select("arc", (F.col("place") + F.col("hop") - F.col("own")).alias("place"), "own", "from")
        back = found.select(F.col("from").alias("arc"), F.col("own").alias("back"))
        kept = held.join(back, "arc", "left").select("arc", "place", (F.col("hop") - F.coalesce("back", F.lit(0))).alias("hop"))
        held = work.save(kept.union(found.select("arc", "place", "own")), f"places{turn}")
        work.drop(f"gone{turn}", "places" if turn == len(gone) - 1 else f"places{turn + 1}")
    return held.select("arc", "place")


def prefix_sums(rows: DataFrame, place: str, *values: str) -> DataFrame:
    """``rows`` with each value summed over all places up to its own: within blocks of places, then over the blocks."""
    rows = rows.withColumn("_block", F.shiftright(F.col(place), BLOCK_BITS))
    inner = W.partitionBy("_block").orderBy(place)
    sums = rows.groupBy("_block").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    outer = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_block", *(F.coalesce(F.sum(f"_{v}").over(outer), F.lit(0)).alias(f"_{v}") for v in values))
    joined = rows.withColumns({v: F.sum(v).over(inner) for v in values}).join(sums, "_block")
    return joined.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_block", *(f"_{v}" for v in values))


def prefix_tree(rebuilt: DataFrame, short: int = SHORT) -> DataFrame:
    """One row per node of the tree of ``conv_id, depth, key, chars`` (depth 0: a conversation itself)."""
    work = Workspace(rebuilt.sparkSession, "prefixes")
    steps = work.save(paths(rebuilt), "steps")
    nodes = numbered_nodes(steps, work)
    places = ranked(tour(nodes), work, short)
    kids = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    known = nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    arcs = places.select("place", F.shiftright("arc", 1).alias("id"), (F.col("arc") % 2 == 0).alias("enters"))
    weighed = arcs.join(known.select("id", "gain", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf")), "id")
    weighed = weighed.select("id", "place", "enters", *(F.when(F.col("enters"), F.col(c)).otherwise(0).alias(c) for c in ("gain", "leaf")))
    own = lambda c: F.when(F.col("enters"), -F.col(c)).otherwise(F.col(c))
    sums = prefix_sums(weighed, "place", "gain", "leaf").groupBy("id").agg(F.sum(own("leaf")).alias("leaves"), F.sum(own("gain")).alias("saved"))
    out = known.join(sums, "id").join(id_digests(steps.filter("last")), "node", "left")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    columns = {
        "depth": F.col("depth"), "n_convs": F.col("n_convs"), "n_children": F.col("n_children"), "n_leaves": F.col("leaves") + leaf, "saved_tokens": F.col("saved") + F.col("gain")
    }
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return out.select("conv_id", "parent_conv_id", *(v.cast("long").alias(c) for c, v in columns.items()), digest)


def conversation_prefixes(conversations: DataFrame) -> DataFrame:
    """The prefix tree of the rebuilt conversations of a table."""
    turns = Workspace(conversations.sparkSession, "turns").save(ordered_turns(conversations), "turns")
    return prefix_tree(rebuilt_turns(turns))
