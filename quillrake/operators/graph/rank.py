"""PageRank and personalised PageRank: fixed numbers of steps, rank of sinks given back to all nodes or to the seeds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.plans.durable import cut, remove

from .edges import Csr, both_ways, in_one_task, nodes_of, on_csr


def _power(g: Csr, base: np.ndarray, damping: float, iterations: int) -> np.ndarray:
    out = np.diff(g.start)
    rank = base.copy()
    for _ in range(iterations):
        share = np.where(out > 0, rank / np.maximum(out, 1), 0.0)
        moved = np.bincount(g.target, weights=np.repeat(share, out), minlength=len(g))
        rank = (1 - damping) * base + damping * (moved + rank[out == 0].sum() * base)
    return rank


def _power_frames(edges: DataFrame, base: DataFrame, damping: float, iterations: int) -> DataFrame:
    """``base``: (node, base) of all nodes. A step is one join with the edges and one sum by target."""
    degree = edges.groupBy("source").agg(F.count("*").alias("out"))
    links, links_at = cut(edges, "links")
    state, at = cut(base.join(degree, base["node"] == degree["source"], "left").select("node", "base", F.coalesce("out", F.lit(0)).alias("out"), F.col("base").alias("rank")), "rank")
    for _ in range(iterations):
        sunk = state.where("out = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = links.join(state.where("out > 0").select(F.col("node").alias("source"), (F.col("rank") / F.col("out")).alias("share")), "source").groupBy("target").agg(F.sum("share").alias("moved"))
        rank = (1 - damping) * F.col("base") + damping * (F.coalesce("moved", F.lit(0.0)) + F.lit(sunk) * F.col("base"))
        new, new_at = cut(state.join(sent, state["node"] == sent["target"], "left").select("node", "base", "out", rank.alias("rank")), "rank")
        remove(state.sparkSession, at)
        state, at = new, new_at
    remove(state.sparkSession, links_at)
    return state.select("node", F.col("rank").alias("score"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 30, mode: str = "auto") -> DataFrame:
    """(node, score) of all nodes. Repeated edges count once; the scores sum to 1. No edges give no rows."""
    e = edges.select("source", "target")
    if in_one_task(e, mode):
        return on_csr(e, lambda g: {"node": g.nodes, "score": _power(g, np.full(len(g), 1.0 / max(1, len(g))), damping, iterations)}, "node long, score double")
    e = e.distinct()
    nodes, _ = cut(nodes_of(e), "nodes")
    n = nodes.count()
    return _power_frames(e, nodes.withColumn("base", F.lit(1.0 / max(1, n))), damping, iterations)


def personalized_pagerank(edges: DataFrame, seeds: Sequence[int], damping: float = 0.85, iterations: int = 30, directed: bool = False, seed_weights: Sequence[float] | None = None, mode: str = "auto") -> DataFrame:
    """(node, score): rank starts from the seeds and sinks give theirs back to them. Repeated edges count as often.

    Seeds that are not nodes are ignored; without any the scores are 0.
    """
    weights = [1.0] * len(seeds) if seed_weights is None else [float(w) for w in seed_weights]
    if len(weights) != len(seeds) or any(w < 0 for w in weights):
        raise ValueError("seed_weights are one number of 0 or more for each seed")
    wanted: dict[int, float] = {}
    for s, w in zip(seeds, weights, strict=True):
        wanted[int(s)] = wanted.get(int(s), 0.0) + w
    e = edges.select("source", "target")
    if in_one_task(e, mode):

        def work(g: Csr) -> dict:
            base = np.zeros(len(g))
            for s, w in wanted.items():
                base[g.index([s])] += w
            total = base.sum()
            return {"node": g.nodes, "score": _power(g, base / total, damping, iterations) if total > 0 else base}

        return on_csr(e, work, "node long, score double", directed, distinct=False)
    e = e if directed else both_ways(e)
    nodes = nodes_of(e)
    given = F.create_map(*[x for s, w in wanted.items() for x in (F.lit(s), F.lit(w))]) if wanted else F.lit(None).cast("map<bigint,double>")
    base, _ = cut(nodes.withColumn("w", F.coalesce(given[F.col("node")], F.lit(0.0))), "nodes")
    total = base.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    if not total > 0:
        return base.select("node", F.lit(0.0).alias("score"))
    return _power_frames(e, base.select("node", (F.col("w") / F.lit(total)).alias("base")), damping, iterations)
