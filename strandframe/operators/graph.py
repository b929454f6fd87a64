"""The graph of neighbouring pairs: components, weighted traversal, principal bundles and diffusion entropy.

Traversals are sequential by nature, so they run per connected component in one Arrow stream: components are found
with distributed star contraction, and only the distinct links of one component are in memory at a time.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from strandframe.operators.grouped import grouped_scan
from strandframe.session import cut

Node = tuple[int, int, int]


def flip(v: Node) -> Node:
    """The same vertex read on the other strand."""
    return v[0], v[1], 1 - v[2]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): connected components of an undirected graph; component is the smallest node.

    Alternating large and small stars (a published MapReduce algorithm): each round hooks neighbours onto smaller nodes,
    in a number of rounds that is logarithmic in practice. A node of any degree is aggregated, never gathered.
    """
    every = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = every.select(F.col("u").alias("node")).union(every.select(F.col("v").alias("node"))).distinct()
    now = cut(every.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = cut(small)
        seen = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def weighted_walk(after: dict[Node, list[Node]], before: dict[Node, list[Node]], weight: dict[Node, int], start: Node) -> Iterator[tuple]:
    """(node, parent, leaf, rank, branch, branch_rank) of a depth-first walk that prefers the heaviest forward neighbour.

    A visited vertex counts as visited on both strands. Neighbours that aren't preferred, and those of the other strand,
    wait in a heap by weight; a vertex without a forward neighbour left is a leaf. The rank is one more than the least
    rank of the vertices that lead to it on either strand. Ties go to the larger vertex.
    """
    rank: dict[Node, int] = {start: 0}
    seen: set[Node] = set()
    heap: list[tuple] = []
    ahead: Node | None = start
    branch = branch_rank = 0
    key = lambda v: (weight[v], v)
    push = lambda v: heapq.heappush(heap, (-weight[v], tuple(-x for x in v), v))
    while ahead is not None or heap:
        if ahead is None:
            ahead = heapq.heappop(heap)[2]
            branch, branch_rank = branch + 1, 0
        v, ahead = ahead, None
        if v in seen:
            continue
        seen |= {v, flip(v)}
        fresh = lambda u: sorted((w for w in after.get(u, ()) if w not in seen), key=key)
        forward = fresh(v)
        if forward:
            ahead = forward.pop()
        for w in (*forward, *fresh(flip(v))):
            push(w)
        parent, least = None, None
        for u in (*before.get(v, ()), *before.get(flip(v), ())):
            if u in rank and (least is None or rank[u] < least):
                parent, least = u, rank[u]
        rank[v] = rank[flip(v)] = (least or 0) + 1
        branch_rank += 1
        yield v, parent, ahead is None, rank[v], branch, branch_rank


def _graph(links: Iterable[tuple[Node, Node]]) -> tuple[dict, dict]:
    after, before = defaultdict(dict), defaultdict(dict)
    for v, w in links:
        after[v][w] = before[w][v] = True
    return {v: list(x) for v, x in after.items()}, {v: list(x) for v, x in before.items()}


def bundle_paths(links: list[tuple[Node, Node]], weight: dict[Node, int], start: Node, cutoff: int) -> list[list[Node]]:
    """Principal bundles of one component: unbranched paths of the graph that long walks of it span, longest first."""
    after, before = _graph(links)
    main, path = set(), []
    for v, _, leaf, *_ in weighted_walk(after, before, weight, start):
        path.append(v)
        if leaf:
            if len(path) > cutoff:
                main |= {(u[0], u[1]) for u in path}
            path = []
    kept = [(v, w) for v, w in links if v[:2] in main and w[:2] in main]
    after, before = _graph(kept)
    ends = {v for v, w in kept if len(after[v]) > 1 or len(before[w]) > 1}
    left = dict.fromkeys(sorted({v for e in kept for v in e}))
    incoming = {v: {u for u in before.get(v, ())} for v in left}
    ready = [v for v in left if not incoming[v]]
    heapq.heapify(ready)
    out = []
    while left:
        while ready and (ready[0] not in left or incoming[ready[0]]):
            heapq.heappop(ready)
        s = ready[0] if ready else next(iter(left))
        # from the start along unvisited vertices; a branch point closes the path, side arms go with it as in a depth-first search
        path, stack, visited = [], [s], set()
        while stack:
            v = stack.pop()
            if v in visited or v not in left:
                continue
            visited.add(v)
            path.append(v)
            if v in ends:
                break
            stack.extend(sorted(after.get(v, ())))
        for v in path:
            for u in (v, flip(v)):
                if u in left:
                    del left[u]
                    for w in after.get(u, ()):
                        if w in incoming:
                            incoming[w].discard(u)
                            if not incoming[w] and w in left:
                                heapq.heappush(ready, w)
        out.append(path)
    return sorted(out, key=lambda p: (-len(p), p))


def _by_component(links: DataFrame, weights: DataFrame) -> DataFrame:
    """Distinct directed links with the weights of both ends and the component; keys are packed as strings of the pair."""
    key = lambda p: F.concat_ws("_", F.col(f"{p}_h0"), F.col(f"{p}_h1"))
    distinct = links.groupBy("v_h0", "v_h1", "v_ori", "w_h0", "w_h1", "w_ori").agg(F.min("sid").alias("sid"))
    parts = components(distinct.select(key("v").alias("a"), key("w").alias("b")).distinct())
    at = lambda p: weights.select(F.col("h0").alias(f"{p}_h0"), F.col("h1").alias(f"{p}_h1"), F.col("n").alias(f"{p}_n"))
    out = distinct.join(at("v"), ["v_h0", "v_h1"]).join(at("w"), ["w_h0", "w_h1"])
    return out.withColumn("node", key("v")).join(parts, "node").drop("node")


def _kernel_input(rows: list[dict]):
    links = [((r["v_h0"], r["v_h1"], r["v_ori"]), (r["w_h0"], r["w_h1"], r["w_ori"])) for r in rows]
    weight = {}
    for r, (v, w) in zip(rows, links):
        weight[v] = weight[flip(v)] = r["v_n"]
        weight[w] = weight[flip(w)] = r["w_n"]
    first = min(range(len(rows)), key=lambda i: (rows[i]["sid"], links[i]))
    return links, weight, links[first][0]


_LINK = ["sid", "v_h0", "v_h1", "v_ori", "w_h0", "w_h1", "w_ori"]


def weighted_order(links: DataFrame, weights: DataFrame) -> DataFrame:
    """(component, ord, h0, h1, ori, p_h0, p_h1, p_ori, weight, leaf, rank, branch, branch_rank): the weighted walk of each component."""

    def work(key: tuple, rows: list[dict]):
        edges, weight, start = _kernel_input(rows)
        for o, (v, p, leaf, rank, branch, br) in enumerate(weighted_walk(*_graph(edges), weight, start)):
            yield (*key, o, *v, *(p or (None,) * 3), weight[v], leaf, rank, branch, br)

    form = "component string, ord int, h0 long, h1 long, ori int, p_h0 long, p_h1 long, p_ori int, weight long, leaf boolean, rank int, branch int, branch_rank int"
    return grouped_scan(_by_component(links, weights), ["component"], _LINK, work, form)


def principal_bundles(links: DataFrame, weights: DataFrame, cutoff: int = 8) -> DataFrame:
    """(component, bundle, pos, h0, h1, ori): the principal bundles of each component, numbered from the longest."""

    def work(key: tuple, rows: list[dict]):
        for b, path in enumerate(bundle_paths(*_kernel_input(rows), cutoff)):
            for p, v in enumerate(path):
                yield (*key, b, p, *v)

    return grouped_scan(_by_component(links, weights), ["component"], _LINK, work, "component string, bundle int, pos int, h0 long, h1 long, ori int")


def bundle_ids(bundles: DataFrame) -> DataFrame:
    """Adds bundle_id, one number over all components: by length, longest first, then by component."""
    size = bundles.groupBy("component", "bundle").agg(F.count("*").alias("size"))
    from pyspark.sql import Window

    # one row per bundle: numbering orders bundles, not vertices
    ids = size.withColumn("bundle_id", F.row_number().over(Window.orderBy(F.desc("size"), "component", "bundle")) - 1)
    return bundles.join(ids.drop("size"), ["component", "bundle"]).select("bundle_id", "pos", "h0", "h1", "ori")


def diffusion_entropy(links: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, weight, entropy): relative weights after ``rounds`` of diffusion over an undirected weighted graph (a, b, w), and their share of the entropy.

    Each round is a join and a sum, so the graph may have any size; the weights start equal and each node spreads its own in
    proportion to its links.
    """
    both = links.select("a", "b", "w").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    out = both.groupBy("a").agg(F.sum("w").alias("total"))
    step = cut(both.join(out, "a").select("a", "b", (F.col("w") / F.col("total")).alias("p")))
    nodes = step.select(F.col("a").alias("node")).distinct()
    n = nodes.count()
    now = cut(nodes.withColumn("weight", F.lit(1.0 / max(n, 1))))
    for _ in range(rounds):
        moved = step.join(now.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.sum(F.col("p") * F.col("weight")).alias("weight"))
        now = cut(moved.withColumnRenamed("b", "node"))
    return now.select("node", "weight", (-F.col("weight") * F.log("weight")).alias("entropy"))
