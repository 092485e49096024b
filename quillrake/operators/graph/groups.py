"""Components, communities and levels of graphs."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.plans.durable import cut, remove

from . import edges as edges_module
from .edges import Csr, few, in_one_task, nodes_of, on_components, on_csr, undirected


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is joined with by the edges a-b: hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not ((up := root[root]) == root).all():
            root = up
    return root


def _roots(g: Csr) -> np.ndarray:
    """The smallest node that each node reaches either way."""
    return _joined(len(g), g.source, g.target)


def _hashed(ids: np.ndarray, level: int) -> np.ndarray:
    """An order of the ids that is another one on each level."""
    x = ids.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _contracted(links: DataFrame, level: int) -> DataFrame:
    """(n, m) of every chunk of edges where it lies: each node n with the first node m that the chunk joins it with.

    First is the smallest on level 0 and that of a hashed order on others, so that no numbering makes long ways of it.
    """
    chunk = edges_module.CHUNK

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("source", "target")]
        nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
        if level:
            order = np.argsort(_hashed(nodes, level), kind="stable")
            turned = np.empty(len(order), np.int64)
            turned[order] = np.arange(len(order))
            nodes, place = nodes[order], turned[place]
        root = _joined(len(nodes), place[: len(ends[0])], place[len(ends[0]) :])
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk:
                yield work(held)
                held, rows = [], 0
        if rows:
            yield work(held)

    return links.mapInArrow(run, "n long, m long")


#: Rows that are sent to all tasks.
_SENT = 1_000_000


def _by_contraction(links: DataFrame, level: int = 0) -> DataFrame:
    """(node, component) of the nodes of edges of any number.

    Chunks are contracted where they lie. A node that is first nowhere leaves with one of its first nodes as its anchor;
    first nodes that a node ties together are the edges of the next level, which has fewer nodes.
    """
    stars, stars_at = cut(_contracted(links, level), "stars")
    spark = stars.sparkSession
    ends = stars.groupBy("n").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.max(F.col("n") == F.col("m")).alias("own"))
    nodes, _ = cut(ends.select(F.col("n").alias("node"), F.when(F.col("own"), F.col("n")).otherwise(F.col("low")).alias("anchor"), (F.col("low") != F.col("high")).alias("torn")), "nodes")
    torn = nodes.where("torn").select(F.col("node").alias("n"), "anchor")
    n = torn.count()
    if not n:
        remove(spark, stars_at)
        out = nodes.select("node", F.col("anchor").alias("rep"))
    else:
        more, _ = cut(stars.join(F.broadcast(torn) if n <= _SENT else torn, "n").where("m <> anchor").select(F.col("m").alias("source"), F.col("anchor").alias("target")).distinct(), "links")
        remove(spark, stars_at)
        rest, _ = cut(on_csr(more, _named_components, "node long, component long") if few(more) else _by_contraction(more, level + 1), "components")
        out = nodes.join(rest.toDF("anchor", "rep"), "anchor", "left").select("node", F.coalesce("rep", "anchor").alias("rep"))
    if not level:  # a node that left is larger than its anchor here
        return out.withColumnRenamed("rep", "component")
    out, _ = cut(out, "components")
    return out.join(out.groupBy("rep").agg(F.min("node").alias("component")), "rep").select("node", "component")


def _named_components(g: Csr) -> dict:
    return {"node": g.nodes, "component": g.nodes[_roots(g)] if len(g) else []}


def connected_components(edges: DataFrame, mode: str = "auto") -> DataFrame:
    """(node, component): the smallest node it is joined with, whatever the directions.

    Out of core: chunks of edges are contracted until what joins them fits one task.
    """
    e = edges.select("source", "target")
    if in_one_task(e, mode):
        return on_csr(e, _named_components, "node long, component long")
    return _by_contraction(e)


def in_components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(edges with their connected component, the number of edges of the largest component)."""
    of, _ = cut(connected_components(edges, "out_of_core"), "components")
    members, _ = cut(edges.join(of.withColumnRenamed("node", "source"), "source"), "members")
    return members, members.groupBy("component").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _tarjan(g: Csr) -> np.ndarray:
    """The smallest member of each node's strong component; an explicit stack instead of recursion."""
    n = len(g)
    index, low, done, comp = [-1] * n, [0] * n, [False] * n, [0] * n
    start, to = g.start.tolist(), g.target.tolist()
    stack: list[int] = []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, start[root])]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        while work:
            u, k = work.pop()
            if k < start[u + 1]:
                work.append((u, k + 1))
                w = to[k]
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    work.append((w, start[w]))
                elif not done[w]:
                    low[u] = min(low[u], index[w])
                continue
            if low[u] == index[u]:
                members = []
                while True:
                    w = stack.pop()
                    done[w] = True
                    members.append(w)
                    if w == u:
                        break
                name = min(members)
                for w in members:
                    comp[w] = name
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[u])
    return np.array(comp, np.int64)


def strongly_connected_components(edges: DataFrame, mode: str = "auto") -> DataFrame:
    """(node, component): the smallest node of its strong component.

    Out of core, components whose edges fit one task are dealt to tasks. Otherwise each round gives every node the largest id that reaches it (its colour); the nodes that reach their
    colour's root within the colour are its component and leave.
    """
    e = edges.select("source", "target")
    work, schema = lambda g: {"node": g.nodes, "component": g.nodes[_tarjan(g)] if len(g) else []}, "node long, component long"
    if in_one_task(e, mode):
        return on_csr(e, work, schema)
    members, most = in_components(e)
    if most <= edges_module.LOCAL_EDGES:
        return on_components(members, work, schema)
    links, _ = cut(e.where("source <> target").distinct(), "links")
    left, _ = cut(nodes_of(e), "nodes")
    found: list[DataFrame] = []
    while not left.isEmpty():
        colour, _ = cut(left.select("node", F.col("node").alias("colour")), "colour")
        while True:  # the largest id that reaches each node
            sent = links.join(colour.select(F.col("node").alias("source"), "colour"), "source").groupBy("target").agg(F.max("colour").alias("got"))
            new, _ = cut(colour.join(sent, colour["node"] == sent["target"], "left").select("node", F.greatest("colour", F.coalesce("got", "colour")).alias("colour"), (F.coalesce("got", "colour") > F.col("colour")).alias("moved")), "colour")
            colour = new.select("node", "colour")
            if new.where("moved").isEmpty():
                break
        inside, _ = cut(links.join(colour.toDF("source", "c1"), "source").join(colour.toDF("target", "c2"), "target").where("c1 = c2").select("source", "target", F.col("c1").alias("colour")), "inside")
        front, _ = cut(colour.where("node = colour"), "front")
        members = [front]
        while not front.isEmpty():  # who reaches the root, backwards
            known = functools.reduce(DataFrame.unionByName, members).select(F.col("node").alias("known"))
            back = inside.join(front.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node"), "colour").distinct()
            front, _ = cut(back.join(known, F.col("node") == F.col("known"), "left_anti"), "front")
            members.append(front)
        got, _ = cut(functools.reduce(DataFrame.unionByName, members), "members")
        least = got.groupBy("colour").agg(F.min("node").alias("component"))
        found.append(got.join(least, "colour").select("node", "component"))
        left, _ = cut(left.join(got.select("node"), "node", "left_anti"), "nodes")
        links, _ = cut(links.join(left.withColumnRenamed("node", "source"), "source", "left_semi").join(left.withColumnRenamed("node", "target"), "target", "left_semi"), "links")
    return functools.reduce(DataFrame.unionByName, found) if found else left.select("node", F.col("node").alias("component"))


def label_propagation(edges: DataFrame, iterations: int = 10, mode: str = "auto") -> DataFrame:
    """(node, community): every node takes the label most common among its neighbours and itself, the smallest of a tie.

    All nodes move at once; it stops early when none does. Loops are ignored and do not make a node.
    """
    e = edges.select("source", "target").where("source <> target")
    if in_one_task(e, mode):

        def work(g: Csr) -> dict:
            label = np.arange(len(g))
            for _ in range(iterations):
                node = np.concatenate([g.source, np.arange(len(g))])
                said = np.concatenate([label[g.target], label])
                votes, n = np.unique(np.stack([node, said], 1), axis=0, return_counts=True) if len(node) else (np.zeros((0, 2), int), np.zeros(0, int))
                order = np.lexsort((votes[:, 1], -n, votes[:, 0]))
                votes = votes[order]
                head = np.concatenate([[True], votes[1:, 0] != votes[:-1, 0]]) if len(votes) else np.zeros(0, bool)
                new = votes[head, 1]
                if (new == label).all():
                    break
                label = new
            return {"node": g.nodes, "community": g.nodes[label]}

        return on_csr(e, work, "node long, community long", directed=False)
    links, _ = cut(undirected(e), "links")
    label, at = cut(nodes_of(links).withColumn("community", F.col("node")), "labels")
    for _ in range(iterations):
        said = links.join(label.select(F.col("node").alias("source"), "community"), "source").select(F.col("target").alias("node"), "community").unionByName(label)
        votes = said.groupBy("node", "community").agg(F.count("*").alias("n"))  # combined before the second shuffle
        best = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("community")).alias("c"))).alias("b")).select("node", (-F.col("b.c")).alias("new"))
        new, new_at = cut(label.join(best, "node").select("node", F.col("new").alias("community"), (F.col("new") != F.col("community")).alias("moved")), "labels")
        label, old, at = new.select("node", "community"), at, new_at
        remove(label.sparkSession, old)
        if new.where("moved").isEmpty():
            break
    return label


def topological_levels(edges: DataFrame, most: int = 1000, mode: str = "auto") -> DataFrame:
    """(node, level): the length of the longest path to it from a node that nothing points to; an error for cycles.

    Out of core, connected components whose edges fit one task are dealt to tasks.
    """
    e = edges.select("source", "target")
    schema = "node long, level long"

    def work(g: Csr) -> dict:
        waiting = np.bincount(g.target, minlength=len(g))
        level = np.zeros(len(g), np.int64)
        now, done = np.flatnonzero(waiting == 0), 0
        while len(now):
            done += len(now)
            which, to = g.step(now)
            np.maximum.at(level, to, level[now[which]] + 1)
            np.subtract.at(waiting, to, 1)
            now = np.unique(to[waiting[to] == 0])
        if done < len(g):
            raise ValueError("the graph has a cycle")
        return {"node": g.nodes, "level": level}

    if in_one_task(e, mode):
        return on_csr(e, work, schema)
    members, most_edges = in_components(e)
    if most_edges <= edges_module.LOCAL_EDGES:
        return on_components(members, work, schema)
    links, _ = cut(e.distinct(), "links")
    level, _ = cut(nodes_of(links).withColumn("level", F.lit(0).cast("long")), "levels")
    front = level
    for _ in range(most):
        up = links.join(front.select(F.col("node").alias("source"), "level"), "source").groupBy(F.col("target").alias("node")).agg((F.max("level") + 1).alias("up"))
        new, _ = cut(level.join(up, "node", "left").select("node", F.greatest("level", F.coalesce("up", "level")).alias("level"), (F.coalesce("up", F.lit(-1)) > F.col("level")).alias("moved")), "levels")
        level, front = new.select("node", "level"), new.where("moved").select("node", "level")
        if front.isEmpty():
            return level
    raise ValueError(f"no fixed point after {most} steps: the graph has a cycle, or raise 'most'")


def _greedy(g: Csr, resolution: float, passes: int = 15, two_m: float | None = None) -> np.ndarray:
    """One level of greedy modularity moves, nodes in ascending order; the smallest community wins a tie.

    ``two_m``: twice the weight of the graph that ``g`` is a part of.
    """
    n = len(g)
    weight = np.where(g.source == g.target, 2.0, 1.0) * g.weight  # a loop adds twice to its node's degree
    degree = np.bincount(g.source, weights=weight, minlength=n)
    two_m = max(float(degree.sum()) if two_m is None else two_m, 1e-6)
    community = list(range(n))
    total, k = degree.tolist(), degree.tolist()
    others = g.source != g.target
    start = np.concatenate([[0], np.cumsum(np.bincount(g.source[others], minlength=n))]).tolist()
    to, w = g.target[others].tolist(), g.weight[others]
    w = None if (w == 1).all() else w.tolist()
    named = community.__getitem__
    for _ in range(passes):
        moved = False
        for u in range(n):
            mine = community[u]
            first, end = start[u], start[u + 1]
            near = map(named, to[first:end])
            if w is None:
                links = Counter(near)
            else:
                links = {}
                for c, x in zip(near, w[first:end], strict=True):
                    links[c] = links.get(c, 0.0) + x
            if not links or len(links) == 1 and mine in links:
                continue
            total[mine] -= k[u]
            best, gain = mine, links.get(mine, 0.0) - resolution * total[mine] * k[u] / two_m
            for c in sorted(links):
                d = links[c] - resolution * total[c] * k[u] / two_m
                if d > gain + 1e-12:
                    best, gain = c, d
            moved |= best != mine
            community[u] = best
            total[best] += k[u]
        if not moved:
            break
    return np.array(community, np.int64)


def _named_by_least(g: Csr, community: np.ndarray) -> np.ndarray:
    least = np.full(len(g), len(g))
    np.minimum.at(least, community, np.arange(len(g)))
    return g.nodes[least[community]]


def _communities(edges: DataFrame, weight: str | None, resolution: float, split: bool) -> DataFrame:
    """Greedy moves go from node to node, but only within a connected component: components are dealt to tasks.

    They share nothing but the weight of the whole graph, so the result is that of one walk over all nodes. A component
    is walked by one task, with a checked size.
    """
    cols = ["source", "target", *([F.coalesce(F.col(weight).cast("double"), F.lit(1.0)).alias("weight")] if weight else [])]
    e = edges.select(*cols)

    def work_of(two_m: float | None):
        def work(g: Csr) -> dict:
            if not len(g):
                return {"node": [], "community": []}
            community = _greedy(g, resolution, two_m=two_m)
            if split:
                same = community[g.source] == community[g.target]
                inner = object.__new__(Csr)
                inner.nodes, inner.source, inner.target = g.nodes, g.source[same], g.target[same]
                community = _roots(inner)
            return {"node": g.nodes, "community": _named_by_least(g, community)}

        return work

    schema = "node long, community long"
    if few(e):
        return on_csr(e, work_of(None), schema, directed=False)
    members, most = in_components(e)
    if most > edges_module.LOCAL_EDGES:
        raise ValueError(f"greedy communities take up to {edges_module.LOCAL_EDGES} edges that hang together; use label_propagation for larger graphs")
    loop = F.col("source") == F.col("target")
    if weight:  # as the adjacency has it: both directions of each row, and a loop twice more
        two_m = members.agg(F.sum(F.when(loop, 4.0).otherwise(2.0) * F.col("weight"))).first()[0]
    else:
        two_m = 2.0 * members.select(F.least("source", "target"), F.greatest("source", "target")).distinct().count()
    return on_components(members, work_of(two_m), schema, directed=False)


def louvain(edges: DataFrame, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """(node, community): one level of greedy modularity moves, at most 15 passes; named by the smallest member."""
    return _communities(edges, weight, resolution, False)


def leiden(edges: DataFrame, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """Like ``louvain``, with each community split into its connected parts."""
    return _communities(edges, weight, resolution, True)


def modularity(edges: DataFrame, source_community: str = "source_community", target_community: str = "target_community", weight: str | None = None) -> DataFrame:
    """(modularity) of labelled edges: the sum over communities of inner share minus squared share of ends; 0 without edges."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = edges.select(F.col(source_community).alias("a"), F.col(target_community).alias("b"), w.alias("w")).where("a IS NOT NULL AND b IS NOT NULL")
    ends = rows.select(F.explode(F.array(F.struct(F.col("a").alias("c"), "w", F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0).alias("inner")), F.struct(F.col("b").alias("c"), "w", F.lit(0.0).alias("inner")))).alias("x"))
    by = ends.groupBy("x.c").agg(F.sum("x.w").alias("ends"), F.sum("x.inner").alias("inner"))
    m = F.sum("ends") / 2
    return by.agg(F.coalesce(F.sum("inner") / m - F.sum(F.col("ends") * F.col("ends")) / (4 * m * m), F.lit(0.0)).alias("modularity"))


def with_communities(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges with the communities of both ends, as ``modularity`` takes them."""
    a = communities.select(F.col("node").alias("source"), F.col("community").alias("source_community"))
    b = communities.select(F.col("node").alias("target"), F.col("community").alias("target_community"))
    return edges.join(a, "source").join(b, "target")
