"""Drifting search over communities of a graph, and retrieval that combines seeds, neighbourhoods and rank.

A drifting search keeps a list of actions, each a few seeds with a score. In each epoch the best pending actions run a
personalised PageRank and keep their top nodes; nodes bordering on what was found, a few from each community, become
the next actions with a lower score. All ties go to the smallest id. The walk itself is small: it runs in one task
on the connected components of its seeds, whose size is checked; ``regional_drift`` first cuts a region out of a graph of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.plans.durable import cut

from . import edges as edges_module
from .edges import Csr, few, on_components, on_csr
from .groups import in_components, leiden, louvain
from .rank import personalized_pagerank
from .walks import bfs, subgraph, within


@dataclass(frozen=True)
class DriftSettings:
    """The numbers of a drifting search; these defaults are fixed values."""

    n_depth: int = 2
    k_followups: int = 3
    top_k: int = 5
    alpha: float = 0.85
    threshold: float = 0.0
    iterations: int = 30
    tolerance: float = 1e-6
    first_seeds: int = 10
    border_communities: int = 5
    border_nodes: int = 3
    border_score: float = 0.8
    decay: float = 0.7


def _labels(g: Csr, rounds: int = 15) -> np.ndarray:
    """Communities by label propagation, one node after the other in ascending order."""
    label = list(range(len(g)))
    for _ in range(rounds):
        moved = False
        for u in range(len(g)):
            near, n = np.unique([label[v] for v in g.out(u).tolist()], return_counts=True)
            if len(near) and label[u] != (best := int(near[n.argmax()])):
                label[u], moved = best, True
        if not moved:
            break
    return np.array(label, np.int64)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> list[int]:
    return ids[np.lexsort((ids, -score))][:k].tolist()


def _local_rank(g: Csr, seeds: list[int], s: DriftSettings) -> np.ndarray:
    base = np.zeros(len(g))
    base[seeds] = 1.0 / len(seeds)
    out, rank = np.diff(g.start), base.copy()
    for _ in range(s.iterations):
        share = np.where(out > 0, rank / np.maximum(out, 1), 0.0)
        new = (1 - s.alpha) * base + s.alpha * (np.bincount(g.target, weights=np.repeat(share, out), minlength=len(g)) + rank[out == 0].sum() * base)
        moved, rank = np.abs(new - rank).sum(), new
        if moved < s.tolerance:
            break
    return rank


def _drift(g: Csr, label: np.ndarray, seeds: list[int], s: DriftSettings) -> list[int]:
    pending: list[tuple[float, int, list[int]]] = [(-1.0, 0, seeds)] if seeds else []
    found: set[int] = set()
    number = 0
    for epoch in range(s.n_depth):
        pending.sort()
        run = [a for a in pending[: s.k_followups] if -a[0] >= s.threshold]
        if not run:
            break
        pending = [a for a in pending if a not in run]
        fresh: set[int] = set()
        for _, _, start in run:
            rank = _local_rank(g, start, s)
            reached = np.flatnonzero(rank > 0)
            fresh.update(_best(reached, rank[reached], s.top_k))
        found |= fresh
        _, to = g.step(np.array(sorted(fresh), np.int64))
        border, links = np.unique(to[~np.isin(to, list(fresh))], return_counts=True)
        groups = [(int(links[label[border] == c].sum()), int(c)) for c in np.unique(label[border])]
        for _, c in sorted(groups, key=lambda x: (-x[0], x[1]))[: s.border_communities]:
            mine = label[border] == c
            number += 1
            pending.append((-s.border_score * s.decay ** (epoch + 1), number, _best(border[mine], links[mine].astype(float), s.border_nodes)))
    return sorted(found)


#: The largest region of one walk: about 1 GB while its adjacency is made.
REGION_EDGES = 12_000_000


def _checked(e: DataFrame) -> DataFrame:
    if e.count() > REGION_EDGES:
        raise ValueError(f"a drifting search takes up to {REGION_EDGES} edges of connected components with seeds; cut a region first")
    return e


def drift_search(edges: DataFrame, top_communities: Sequence[int] | None = None, settings: DriftSettings = DriftSettings()) -> DataFrame:
    """(node): nodes found from the members with most neighbours of the communities, by default of the largest five.

    A community is named by any of its members. On larger graphs communities are found on whole connected components, dealt to
    tasks; a walk never leaves the components of its seeds, so it runs on these alone. Both sizes are checked.
    """
    e = edges.select("source", "target")

    def work(g: Csr) -> dict:
        if not len(g):
            return {"node": []}
        label = _labels(g)
        if top_communities is None:
            names, n = np.unique(label, return_counts=True)
            chosen = _best(names, n.astype(float), 5)
        else:
            chosen = np.unique(label[g.index(top_communities)]).tolist()
        members = np.flatnonzero(np.isin(label, chosen))
        seeds = _best(members, np.diff(g.start)[members].astype(float), settings.first_seeds)
        return {"node": g.nodes[_drift(g, label, seeds, settings)] if seeds else []}

    if few(e):
        return on_csr(e, work, "node long")
    members, most = in_components(e)
    if most > edges_module.LOCAL_EDGES:
        raise ValueError(f"a drifting search takes connected components of up to {edges_module.LOCAL_EDGES} edges; cut a region first")

    def labelled(g: Csr) -> dict:
        label = _labels(g)
        return {"node": g.nodes, "label": g.nodes[label], "degree": np.diff(g.start)}

    labels, _ = cut(on_components(members, labelled, "node long, label long, degree long"), "labels")
    if top_communities is None:
        chosen = labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label").limit(5)
    else:
        chosen = labels.where(F.col("node").isin(*[int(x) for x in top_communities]) if top_communities else F.lit(False)).select("label").distinct()
    first = labels.join(chosen, "label", "left_semi").orderBy(F.col("degree").desc(), "node").limit(settings.first_seeds)
    start = [r["node"] for r in first.select("node").collect()]  # a few by the settings
    around = members.where(F.col("source").isin(*start) | F.col("target").isin(*start) if start else F.lit(False)).select("component").distinct()
    region, _ = cut(members.join(F.broadcast(around), "component", "left_semi").select("source", "target").distinct(), "region")  # a component for each seed at most
    named = region.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(labels.select("node", "label"), "node")
    both = _checked(region).withColumn("edge", F.lit(True)).unionByName(named.select(F.col("node").alias("source"), F.col("label").alias("target"), F.lit(False).alias("edge")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        source, target, edge = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in table]) if table else np.zeros(0, np.int64) for c in ("source", "target", "edge"))
        edge = edge.astype(bool)
        g = Csr(source[edge], target[edge])
        label = np.zeros(len(g), np.int64)
        label[g.index(source[~edge])] = g.index(target[~edge])  # in the order of the labels' ids
        found = _drift(g, label, g.index(start).tolist(), settings) if start else []
        yield pa.RecordBatch.from_arrays([pa.array(g.nodes[found], pa.int64())], ["node"])

    return both.repartition(1).mapInArrow(walk, "node long")


def regional_drift(edges: DataFrame, seeds: Sequence[int], hops: int = 1, settings: DriftSettings = DriftSettings(n_depth=1), max_degree: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """(node): a drifting search within ``hops`` (in any direction) of the seeds; communities with seeds come first."""
    wanted = [int(x) for x in seeds]
    e = edges.select("source", "target")
    near, _ = cut(bfs(e, wanted, hops, False, max_degree, max_nodes).select("node"), "near")
    region, _ = cut(within(e, near), "region")

    def work(g: Csr) -> dict:
        if not len(g):
            return {"node": []}
        label, degree = _labels(g), np.diff(g.start)
        score = np.bincount(label, weights=degree, minlength=len(g))
        np.add.at(score, label[g.index(wanted)], 10)
        present = np.unique(label)
        chosen = _best(present, score[present], 5)
        members = np.flatnonzero(np.isin(label, chosen))
        return {"node": g.nodes[_drift(g, label, _best(members, degree[members].astype(float), settings.first_seeds), settings)]}

    return on_csr(_checked(region.select("source", "target")), work, "node long")


#: Seeds of one question.
MOST_SEEDS = 10_000


def graph_rag_local(docs: DataFrame, id_col: str, edges: DataFrame, seeds: DataFrame, hops: int = 2, alpha: float = 0.85, directed: bool = False, max_nodes: int = 50, relations: Sequence[str] | None = None, max_degree: int | None = None, score_col: str | None = None) -> DataFrame:
    """The documents around the seeds by personalised PageRank: the columns of ``docs`` and ``score``, best first.

    ``seeds`` (id, perhaps a score as weight) is a result list, a few rows by construction.
    """
    rows = seeds.select(F.col(id_col).cast("long"), F.col(score_col) if score_col else F.lit(1.0)).limit(MOST_SEEDS + 1).collect()
    if len(rows) > MOST_SEEDS:
        raise ValueError(f"more than {MOST_SEEDS} seeds")
    ids, weights = [r[0] for r in rows], [max(float(r[1]), 0.0) for r in rows]
    near, _ = cut(subgraph(edges, ids, hops, directed, relations=relations, max_degree=max_degree), "region")
    rank = personalized_pagerank(near, ids, alpha, directed=directed, seed_weights=weights)
    best = rank.where("score > 0").orderBy(F.col("score").desc(), "node").limit(max_nodes)
    return docs.join(F.broadcast(best), docs[id_col] == best["node"]).drop("node").orderBy(F.col("score").desc(), id_col)  # at most max_nodes rows


def community_summaries(edges: DataFrame, seeds: Sequence[int] = (), algorithm: str = "leiden", resolution: float = 1.0, summarize: Callable[[int, list[int]], str] | None = None) -> DataFrame:
    """(community, members, size, inner_edges, seed_overlap[, summary]): what a global question is answered from.

    ``summarize`` is called on the driver for each community, as a language model would be; leave it out at scale.
    """
    communities = (leiden if algorithm == "leiden" else louvain)(edges, resolution=resolution)
    communities, _ = cut(communities, "communities")
    hit = F.col("node").isin(*[int(s) for s in seeds]) if seeds else F.lit(False)
    size = communities.groupBy("community").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("members"), F.sum(hit.cast("long")).alias("seed_overlap"))
    inner = edges.join(communities.toDF("source", "community"), "source").join(communities.toDF("target", "other"), "target").where("community = other").groupBy("community").agg(F.count("*").alias("inner_edges"))
    out = size.join(inner, "community", "left").na.fill(0, ["inner_edges"])
    if summarize is None:
        return out
    said = [(r["community"], summarize(r["community"], r["members"])) for r in out.select("community", "members").toLocalIterator()]
    return out.join(edges.sparkSession.createDataFrame(said, "community long, summary string"), "community")


def graph_rag_global(edges: DataFrame, seeds: Sequence[int], top_k: int = 5, algorithm: str = "leiden", resolution: float = 1.0) -> DataFrame:
    """The ``top_k`` communities by seeds in them, then by size."""
    return community_summaries(edges, seeds, algorithm, resolution).orderBy(F.col("seed_overlap").desc(), F.col("size").desc(), "community").limit(top_k)
