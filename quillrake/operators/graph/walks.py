"""Breadth-first walks: neighbourhoods, induced subgraphs and shortest paths.

A frontier is a small table; each hop is one join with the edges, a minimum per node and an anti-join with what has been
reached. Ties go to the smallest id, so results do not depend on partitioning.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.plans.durable import cut

from .edges import Csr, both_ways, in_one_task, on_csr


def _turned(edges: DataFrame, directed: bool) -> DataFrame:
    e = edges.select("source", "target")
    return e if directed else both_ways(e)


def bfs(edges: DataFrame, seeds: Sequence[int], hops: int | None = None, directed: bool = True, max_degree: int | None = None, max_nodes: int | None = None, mode: str = "auto", stop: int | None = None) -> DataFrame:
    """(node, hop, seed, parent) of all nodes within ``hops`` of a seed, the seeds at hop 0; the first seed to arrive counts.

    ``max_degree``: nodes with more neighbours are reached but not left. ``max_nodes``: keep that many, nearest first,
    then by id. Both are off by default. A seed without edges is a row too. Out of core the walk ends with the hop that
    reaches ``stop``.
    """
    seeds = list(dict.fromkeys(int(s) for s in seeds))
    if not seeds:
        raise ValueError("a walk needs a seed")
    e = _turned(edges, directed)
    if max_degree is not None:
        e = e.distinct()
        busy = e.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > max_degree).select("source")
        e = e.join(busy, "source", "left_anti")
    if in_one_task(e, mode):

        def work(g: Csr) -> dict:
            known = [s for s in sorted(seeds) if len(g.index([s]))]
            hop, owner, parent = g.distances(g.index(known), hops) if known else (np.full(len(g), -1),) * 3
            got = np.flatnonzero(hop >= 0)
            alone = [s for s in seeds if s not in set(known)]
            names = np.array(known, np.int64)
            parents = [None if p < 0 else int(g.nodes[p]) for p in parent[got].tolist()]
            return {"node": [*g.nodes[got].tolist(), *alone], "hop": [*hop[got].tolist(), *[0] * len(alone)], "seed": [*(names[owner[got]].tolist() if known else []), *alone], "parent": [*parents, *[None] * len(alone)]}

        out = on_csr(e, work, "node long, hop long, seed long, parent long")
    else:
        spark = edges.sparkSession
        front = spark.createDataFrame([(s, 0, s, None) for s in seeds], "node long, hop long, seed long, parent long")
        parts, h = [front], 0
        while hops is None or h < hops:
            h += 1
            reached = functools.reduce(DataFrame.unionByName, parts).select(F.col("node").alias("done"))
            met = e.join(front.select(F.col("node").alias("source"), "seed"), "source")
            best = met.groupBy(F.col("target").alias("node")).agg(F.min(F.struct("seed", "source")).alias("m"))
            new = best.join(reached, F.col("node") == F.col("done"), "left_anti").select("node", F.lit(h).cast("long").alias("hop"), F.col("m.seed").alias("seed"), F.col("m.source").alias("parent"))
            front, _ = cut(new, "front")
            if front.isEmpty():
                break
            parts.append(front)
            if stop is not None and not front.where(F.col("node") == stop).isEmpty():
                break
        out = functools.reduce(DataFrame.unionByName, parts)
    return out.orderBy("hop", "node").limit(max_nodes) if max_nodes is not None else out


def neighbors(edges: DataFrame, node: int, hops: int = 1, directed: bool = True, mode: str = "auto") -> DataFrame:
    """(node): all others within ``hops``."""
    return bfs(edges, [node], hops, directed, mode=mode).where(F.col("node") != int(node)).select("node")


def subgraph(edges: DataFrame, seeds: Sequence[int], hops: int, directed: bool = True, relation: str | None = None, relations: Sequence[str] | None = None, time_col: str | None = None, since=None, until=None, max_degree: int | None = None, max_nodes: int | None = None, mode: str = "auto") -> DataFrame:
    """(source, target): distinct edges between nodes within ``hops`` of a seed, after filters on relation and time."""
    if relations is not None:
        edges = edges.where(F.col(relation or "relation").isin(*relations))
    if since is not None:
        edges = edges.where(F.col(time_col) >= F.lit(since))
    if until is not None:
        edges = edges.where(F.col(time_col) <= F.lit(until))
    near, _ = cut(bfs(edges, seeds, hops, directed, max_degree, max_nodes, mode).select("node"), "near")
    return within(edges, near)


def within(edges: DataFrame, near: DataFrame) -> DataFrame:
    """(source, target): the distinct edges between nodes of ``near``; others go before anything is made distinct."""
    e = edges.select("source", "target")
    return e.join(near.withColumnRenamed("node", "source"), "source", "left_semi").join(near.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target").distinct()


def _path_back(walk: DataFrame, end: int) -> list[int] | None:
    """Follow parents to the start: one lookup per hop of a single path."""
    path, at = [], end
    while at is not None:
        row = walk.where(F.col("node") == at).select("parent").first()
        if row is None:
            return None
        path.append(at)
        at = row["parent"]
    return path[::-1]


def shortest_path(edges: DataFrame, start: int, end: int, directed: bool = True, mode: str = "auto") -> DataFrame:
    """(node, hop) along one shortest path, the one with the smallest parents; no rows if there is none."""
    spark = edges.sparkSession
    schema = "node long, hop long"
    e = _turned(edges, directed)
    if start == end:
        known = e.where((F.col("source") == start) | (F.col("target") == start)).limit(1)
        return known.select(F.lit(start).cast("long").alias("node"), F.lit(0).cast("long").alias("hop"))
    if in_one_task(e, mode):

        def work(g: Csr) -> dict:
            path: list[int] = []
            a, b = g.index([start]), g.index([end])
            if len(a) and len(b):
                hop, _, parent = g.distances(a)
                at = int(b[0]) if hop[b[0]] >= 0 else -1
                while at >= 0:
                    path.append(int(g.nodes[at]))
                    at = int(parent[at])
            return {"node": path[::-1], "hop": list(range(len(path)))}

        return on_csr(e, work, schema)
    path = _path_back(cut(bfs(e, [start], mode="out_of_core", stop=end), "walk")[0], end)
    return spark.createDataFrame([(n, i) for i, n in enumerate(path or [])], schema)


def all_shortest_paths(edges: DataFrame, start: int, end: int, directed: bool = True, mode: str = "auto") -> DataFrame:
    """(path): every shortest path, as arrays of nodes. Their number can grow with the power of the length."""
    e = _turned(edges, directed).distinct()
    ahead, _ = cut(bfs(e, [start], mode=mode).select("node", "hop"), "ahead")
    back, _ = cut(bfs(e.select(F.col("target").alias("source"), F.col("source").alias("target")), [end], mode=mode).select("node", F.col("hop").alias("left")), "back")
    row = ahead.where(F.col("node") == int(end)).first()
    if row is None:
        return ahead.select(F.array("node").alias("path")).limit(0)
    length = row["hop"]
    on = ahead.join(back, "node").where(F.col("hop") + F.col("left") == length)
    dag = e.join(on.select(F.col("node").alias("source"), F.col("hop").alias("h")), "source").join(on.select(F.col("node").alias("target"), F.col("hop").alias("h2")), "target").where("h2 = h + 1").select("source", "target")
    dag, _ = cut(dag, "dag")
    paths = dag.sparkSession.createDataFrame([([int(start)],)], "path array<long>")
    for _ in range(length):
        paths = paths.join(dag, F.element_at("path", -1) == F.col("source")).select(F.concat("path", F.array("target")).alias("path"))
    return paths


def connecting_paths(edges: DataFrame, seeds: Sequence[int], directed: bool = True, mode: str = "auto") -> DataFrame:
    """(source, target): the union of one shortest path between each two of the seeds, in the order given."""
    seeds = list(dict.fromkeys(int(s) for s in seeds))
    if len(seeds) < 2:
        raise ValueError("two seeds or more")
    e = _turned(edges, directed).distinct()
    schema = "source long, target long"
    pairs = list(itertools.combinations(seeds, 2))
    if in_one_task(e, mode):

        def work(g: Csr) -> dict:
            found = set()
            walks = {a: g.distances(g.index([a])) for a, _ in pairs if len(g.index([a]))}
            for a, b in pairs:
                at = g.index([b])
                if a in walks and len(at) and walks[a][0][at[0]] >= 0:
                    parent, x = walks[a][2], int(at[0])
                    while parent[x] >= 0:
                        found.add((int(g.nodes[parent[x]]), int(g.nodes[x])))
                        x = int(parent[x])
            both = sorted(found)
            return {"source": [x for x, _ in both], "target": [y for _, y in both]}

        return on_csr(e, work, schema)
    found = set()
    for a, group in itertools.groupby(pairs, key=lambda p: p[0]):
        walk, _ = cut(bfs(e, [a], mode="out_of_core"), "walk")
        for _, b in group:
            path = _path_back(walk, b) or []
            found.update(itertools.pairwise(path))
    return edges.sparkSession.createDataFrame(sorted(found), schema)
