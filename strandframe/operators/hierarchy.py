"""Full hierarchies from parent-child links of unknown depth.

Leaves are peeled to expose cycles; in what resists, roots are taken off and pointers doubled until only nodes on or below
cycles are left, and what was peeled learns from its parents, layer by layer. The remaining forest is laid out as Euler
tours, which parallel list ranking turns into places: an element's distance to the end of its tour and the sum of the steps
down and up that follow it. A node's entry and exit places give its depth, its root, its ancestors and its descendants.
Nothing is grouped per parent or per tree: siblings are chained by a global sort, and in list ranking every element has one
successor. All rounds run over all tasks at every size; their tables are written, so the planner knows how small they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strandframe.session import Shelf, cut, rows_of


def peel_leaves(links: DataFrame, shelf: Shelf) -> tuple[DataFrame, list[DataFrame]]:
    """The links that remain when nodes without children are taken off again and again, and those taken off, round by round.

    Rounds go on while they take off at least half of the links, so all rounds together cost about two of the
    first; deeper chains are left to pointer doubling. A node's links to all its parents are taken off together.
    """
    left, layers, before = links, [], None
    while True:
        inner = left.select(F.col("parent").alias("child"), F.lit(True).alias("inner")).distinct()
        marked, seen = shelf.put(left.select("child", "parent").join(inner, "child", "left"), n=rows_of(), rest=rows_of("inner"))
        left = marked.where("inner").select("child", "parent")
        layers.append(marked.where("inner IS NULL").select("child", "parent"))
        if not seen["rest"] or seen["rest"] > seen["n"] // 2:
            return left, layers


def caught_in_cycles(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(child): the nodes that are on a cycle of parent links or below one; a node may have several parents.

    In each round a link to a root is dropped, and a link to a node with one parent goes on to that parent, which doubles the reach
    of chains. While any node has a way up that ends, the last node of that way but one has a link to a root; so once a round
    drops nothing, all nodes with links left are caught.
    """
    left = links.select("child", "parent")
    while True:
        # links that have come to the same parent are one, but needn't be brought together for that
        up = left.groupBy("child").agg(F.min("parent").alias("up"), F.max("parent").alias("last")).withColumnRenamed("child", "parent")
        step = left.join(up, "parent", "left").select("child", F.when(F.col("up") == F.col("last"), F.col("up")).otherwise(F.col("parent")).alias("parent"), F.col("up").isNull().alias("dropped"))
        moved, seen = shelf.put(step, n=rows_of(), dropped=rows_of("dropped"))
        left = moved.where("NOT dropped").select("child", "parent")
        if not seen["dropped"] or seen["dropped"] == seen["n"]:
            return left.select("child").distinct()


def caught_below(caught: DataFrame, layers: list[DataFrame], shelf: Shelf) -> DataFrame:
    """(child): the caught nodes with those of the peeled layers that have one of them as a parent, the last layer first; once a link."""
    found = shelf.put(caught)
    tables = [found]
    for layer in reversed(layers):
        more, seen = shelf.put(layer.join(found.withColumnRenamed("child", "parent"), "parent", "left_semi").select("child"), n=rows_of())
        if seen["n"]:
            tables.append(more)
            found = shelf.read(*tables)
    return found


def _next_sibling(links: DataFrame) -> DataFrame:
    """(child, parent, sibling): the next child of the same parent in order of the ids, null for the last.

    The links are range-sorted over all partitions, so a parent with any number of children is spread out; each
    partition learns the first row of the next one from the driver (one row a partition).
    """
    form = "parent long, child long"
    placed = cut(links.select("parent", "child").repartitionByRange("parent", "child").sortWithinPartitions("parent", "child"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows and found is None:
                found = batch.slice(0, 1)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *found.columns], ["part", "parent", "child"])

    firsts = sorted((r.part, r.parent, r.child) for r in placed.mapInArrow(first, f"part int, {form}").collect())
    after = {p: (parent, child) for (p, _, _), (_, parent, child) in zip(firsts, firsts[1:])}

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            yield from pairs(rows)
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            parent, child = after.get(TaskContext.get().partitionId(), (None, None))
            same = parent == held.column(0)[0].as_py()
            yield pa.RecordBatch.from_arrays([held.column(1), held.column(0), pa.array([child if same else None], pa.int64())], ["child", "parent", "sibling"])

    def pairs(rows) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        n = rows.num_rows - 1
        if n:
            parent, child = rows.column(0), rows.column(1)
            same = pc.equal(parent.slice(0, n), parent.slice(1))
            yield pa.RecordBatch.from_arrays([child.slice(0, n), parent.slice(0, n), pc.if_else(same, child.slice(1), pa.scalar(None, pa.int64()))], ["child", "parent", "sibling"])

    return placed.mapInArrow(lead, "child long, parent long, sibling long")


def _tour(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Elements (node, out, next_node, next_out, step): entry (out 0) and exit (out 1) of each inner node, one element of each leaf."""
    chained = _next_sibling(links)
    inner = links.groupBy("parent").agg(F.min("child").alias("first_child")).withColumnRenamed("parent", "node")
    has_parent = chained.withColumnRenamed("child", "node")
    own = nodes.join(has_parent, "node", "left").join(inner, "node", "left")
    after = F.struct(F.coalesce("sibling", "parent").alias("n"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("o"))
    entry = F.struct(F.lit(0).alias("out"), F.when(F.col("first_child").isNotNull(), F.struct(F.col("first_child").alias("n"), F.lit(0).alias("o"))).otherwise(after).alias("to"), F.when(F.col("first_child").isNotNull(), 1).otherwise(0).alias("step"))
    leave = F.struct(F.lit(1).alias("out"), after.alias("to"), F.lit(-1).alias("step"))
    made = F.when(F.col("first_child").isNotNull(), F.array(entry, leave)).otherwise(F.array(entry))
    return own.select("node", F.explode(made).alias("e")).select("node", "e.out", F.col("e.to.n").alias("next_node"), F.when(F.col("e.to.n").isNotNull(), F.col("e.to.o")).alias("next_out"), F.col("e.step").cast("long").alias("step"), F.lit(1).cast("long").alias("rank"))


def rank_lists(elements: DataFrame, shelf: Shelf) -> DataFrame:
    """Parallel list ranking: adds for each element the sums of step and rank from it to the end, and the end's node (tail).

    Elements are keyed by (node, out); successors (next_node, next_out) are unique. A round joins the elements that
    are still under way with their successors and doubles every reach; finished elements leave the work. Where few are under
    way, the planner sends them to the finished ones, which then aren't shuffled.
    """
    # an exit points at the parent's exit, which a leaf doesn't have: parents always have both elements
    first = elements.withColumn("tail", F.when(F.col("next_node").isNull(), F.col("node")))
    now, seen = shelf.put(first, live=rows_of("next_node IS NOT NULL"))
    tables = [now]
    while seen["live"]:
        live = now.where("next_node IS NOT NULL")
        # an element that ends now jumps onto one that had ended in any round before
        ahead = now.unionByName(shelf.read(*tables[:-1]).where("next_node IS NULL")) if len(tables) > 1 else now
        ahead = ahead.select(F.col("node").alias("next_node"), F.col("out").alias("next_out"), F.col("next_node").alias("nn"), F.col("next_out").alias("no"), F.col("step").alias("s2"), F.col("rank").alias("r2"), F.col("tail").alias("t2"))
        moved = live.join(ahead, ["next_node", "next_out"]).select("node", "out", F.col("nn").alias("next_node"), F.col("no").alias("next_out"), (F.col("step") + F.col("s2")).alias("step"), (F.col("rank") + F.col("r2")).alias("rank"), F.col("t2").alias("tail"))
        now, seen = shelf.put(moved, live=rows_of("next_node IS NOT NULL"))
        tables.append(now)
    return shelf.read(*tables).where("next_node IS NULL").select("node", "out", "step", "rank", "tail")


def euler_forest(nodes: DataFrame, links: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root, depth, place_in, place_out) for a forest given by links (child, parent), each child once.

    Places count down along the tour: u is an ancestor of v, or v itself, if both have the same root and
    place_in(u) >= place_in(v) and place_out(u) <= place_out(v).
    """
    ranked = rank_lists(_tour(nodes, links), shelf)
    return ranked.groupBy("node").agg(
        F.max("tail").alias("root"),
        F.max(F.when(F.col("out") == 0, -F.col("step"))).alias("depth"),
        F.max("rank").alias("place_in"),
        F.min("rank").alias("place_out"),
    )


def hierarchy(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root, depth, place_in, place_out) for each node; on a cycle or below one root and depth are -1 and places null.

    ``nodes`` has a LONG column node, ``links`` LONG columns child and parent. Null, repeated and dangling links
    are ignored, repeated nodes count once, and a node without a parent is its own root with depth 0. Of several
    parents the smallest id is followed, unless one of them is on a cycle or below one: then so is the node.
    Empty tables give no rows; further columns aren't read.
    """
    shelf = Shelf(nodes.sparkSession)
    nodes = shelf.put(nodes.select("node").where("node IS NOT NULL").distinct())
    known = lambda c: nodes.withColumnRenamed("node", c)
    # the last join leaves the links placed by child, so that equal ones are together
    every = shelf.put(links.select("child", "parent").join(known("parent"), "parent", "left_semi").join(known("child"), "child", "left_semi").select("child", "parent").distinct())
    rest, layers = peel_leaves(every, shelf)
    caught = caught_below(caught_in_cycles(rest, shelf), layers, shelf)
    # of the other nodes no parent is caught
    forest = shelf.put(every.groupBy("child").agg(F.min("parent").alias("parent")).join(caught, "child", "left_anti"))
    lost = F.lit(-1).cast("long")
    out = euler_forest(nodes.join(caught.withColumnRenamed("child", "node"), "node", "left_anti"), forest, shelf)
    none = F.lit(None).cast("long")
    laid = shelf.put(out.unionByName(caught.distinct().select(F.col("child").alias("node"), lost.alias("root"), lost.alias("depth"), none.alias("place_in"), none.alias("place_out"))))
    shelf.clear(laid)
    return laid


def paths(laid: DataFrame) -> DataFrame:
    """(node, root, depth, path): the ids from the root down to the node. Nodes on or below cycles have a null path.

    The nodes are range-sorted along the tours and scanned with the current path as a stack. The stack that reaches a part of the
    order holds the ancestors of its first node: those whose interval of places the node lies in. Each node sends itself to the
    parts that begin within its interval; the driver sees one node a part.
    """
    shelf = Shelf(laid.sparkSession)
    good = laid.where("depth >= 0").select("node", "root", "depth", "place_in", "place_out")
    sorted_ = good.repartitionByRange("root", F.desc("place_in")).sortWithinPartitions("root", F.desc("place_in"))
    placed = shelf.put(sorted_.withColumn("part", F.spark_partition_id()))
    firsts = placed.groupBy("part").agg(F.min(F.struct("root", (-F.col("place_in")).alias("p"))).alias("f")).collect()
    begins = sorted((r.f.root, r.f.p, r.part) for r in firsts)
    roots, places, parts = (np.array([b[i] for b in begins], np.int64) for i in range(3))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root, depth, place_in, place_out = (batch.column(i).to_numpy() for i in range(5))
            # begins within the interval: of the same root, behind the entry, not behind the exit
            lo, hi = np.searchsorted(roots, root, "left"), np.searchsorted(roots, root, "right")
            rows, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in np.flatnonzero(hi > lo):
                own = places[lo[i] : hi[i]]
                a, b = np.searchsorted(own, -place_in[i], "right"), np.searchsorted(own, -place_out[i], "right")
                if b > a:
                    rows.append(np.full(b - a, i)), ats.append(np.arange(lo[i] + a, lo[i] + b))
            row, at = np.concatenate(rows), np.concatenate(ats)
            yield pa.RecordBatch.from_arrays([pa.array(parts[at].astype(np.int32)), pa.array(np.zeros(len(at), np.int32)), pa.array(node[row]), pa.array(root[row]), pa.array(depth[row]), pa.array(place_in[row])], ["part", "own", "node", "root", "depth", "place_in"])

    form = "part int, own int, node long, root long, depth long, place_in long"
    sent = placed.select("node", "root", "depth", "place_in", "place_out").mapInArrow(send, form)
    rows = placed.select("part", F.lit(1).alias("own"), "node", "root", "depth", "place_in").unionByName(sent)
    # ancestors come before the nodes of a part, from the root down
    order = ["part", "own", F.when(F.col("own") == 0, F.lit(0)).otherwise(F.col("root")), F.when(F.col("own") == 0, F.col("depth")).otherwise(-F.col("place_in"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[int] = []
        now, size = None, 0
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))], ["node", "root", "depth", "path"])

        for batch in batches:
            for part, own, n, root, d in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if part != now:
                    now, stack = part, []
                del stack[d:]
                stack.append(n)
                if own:
                    out.append((n, root, d, list(stack)))
                    size += d
                    if size >= 1 << 20:
                        yield made()
                        out, size = [], 0
        yield made()

    found = rows.repartition("part").sortWithinPartitions(*order).mapInArrow(run, "node long, root long, depth long, path array<long>")
    return found.unionByName(laid.where("depth < 0").select("node", "root", "depth", F.lit(None).cast("array<long>").alias("path")))


def descendants(laid: DataFrame) -> DataFrame:
    """(ancestor, node, distance): every node below every ancestor, from the paths; as many rows as the paths have ids."""
    up = paths(laid).where("depth > 0").select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.where("at < depth").select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
