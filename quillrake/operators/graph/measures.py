"""Degrees, similarities, triangles and centralities."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrake.plans.durable import cut

from .edges import Csr, few, gathered, nodes_of, undirected


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct targets of each node, 0 for sinks."""
    e = edges.select("source", "target").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("n")), F.struct(F.col("target").alias("node"), F.lit(0).alias("n")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.n").cast("long").alias("degree"))


def _around(edges: DataFrame, node: int, directed: bool) -> DataFrame:
    out = edges.where(F.col("source") == int(node)).select(F.col("target").alias("neighbor"))
    return (out if directed else out.union(edges.where(F.col("target") == int(node)).select(F.col("source").alias("neighbor")))).distinct()


def jaccard(edges: DataFrame, a: int, b: int, directed: bool = False) -> DataFrame:
    """(score): shared over all neighbours of two nodes; 0 if they have none."""
    both = _around(edges, a, directed).withColumn("n", F.lit(1)).union(_around(edges, b, directed).withColumn("n", F.lit(1))).groupBy("neighbor").agg(F.sum("n").alias("n"))
    return both.agg(F.coalesce(F.sum((F.col("n") == 2).cast("double")) / F.count("*"), F.lit(0.0)).alias("score"))


def _rows_degree(edges: DataFrame) -> DataFrame:
    """(node, degree) counting edge rows at both ends."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def preferential_attachment(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(score): product of the two degrees, which count edge rows at either end."""
    at = lambda n: F.sum((F.col("source") == int(n)).cast("double") + (F.col("target") == int(n)).cast("double"))
    return edges.agg(F.coalesce(at(a) * at(b), F.lit(0.0)).alias("score"))


def _shared(edges: DataFrame, a: int, b: int, least: int, part: Column) -> DataFrame:
    common = _around(edges, a, False).join(_around(edges, b, False), "neighbor", "left_semi").withColumnRenamed("neighbor", "node")
    return common.join(_rows_degree(edges), "node").where(F.col("degree") > least).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("score"))


def adamic_adar(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(score): sum of 1 / ln(degree) over shared neighbours with a degree above 1; degrees count edge rows."""
    return _shared(edges, a, b, 1, 1.0 / F.log(F.col("degree").cast("double")))


def resource_allocation(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(score): sum of 1 / degree over shared neighbours."""
    return _shared(edges, a, b, 0, 1.0 / F.col("degree").cast("double"))


def common_neighbor_scores(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with jaccard, adamic_adar, resource_allocation and common for each pair, by joins on the pairs alone."""
    e = undirected(edges)
    pairs = pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).distinct()
    deg = _rows_degree(edges)
    size = e.groupBy("source").agg(F.count("*").alias("n"))
    met = pairs.join(e.select(F.col("source").alias("a"), F.col("target").alias("z")), "a").join(e.select(F.col("source").alias("b"), F.col("target").alias("z")), ["b", "z"])
    d = F.col("degree").cast("double")
    sums = met.join(deg.withColumnRenamed("node", "z"), "z").groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(F.when(d > 1, 1.0 / F.log(d)).otherwise(0.0)).alias("adamic_adar"), F.sum(1.0 / d).alias("resource_allocation"))
    out = pairs.join(sums, ["a", "b"], "left").join(size.toDF("a", "na"), "a", "left").join(size.toDF("b", "nb"), "b", "left").na.fill(0)
    union = F.col("na") + F.col("nb") - F.col("common")
    return out.select("a", "b", "common", F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("jaccard"), "adamic_adar", "resource_allocation")


def _ranked(edges: DataFrame) -> DataFrame:
    """(source, target): each undirected edge once, from the end with the lower degree, so that no node points to many."""
    pairs = edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).where("u < v").distinct()
    deg = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    ranked = pairs.join(deg.toDF("u", "du"), "u").join(deg.toDF("v", "dv"), "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    return ranked.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("source"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("target"))


def _triangles(e: DataFrame) -> DataFrame:
    """(u, w, v) of edges u-v, v-w and u-w."""
    return e.toDF("u", "v").join(e.toDF("v", "w"), "v").join(e.toDF("u", "w"), ["u", "w"], "left_semi")


def triangle_count(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(triangles): u < v < w with edges u-v, v-w and u-w; directed ones must point to the larger id.

    Undirected wedges start at the end with the lower degree, which keeps hubs from making most of them.
    """
    e = edges.select("source", "target").where("source < target").distinct() if directed else _ranked(edges)
    return _triangles(e).agg(F.count("*").alias("triangles"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """(node, coefficient): share of a node's pairs of neighbours that are linked; 0 with fewer than two. Loops are ignored.

    Triangles are found as in ``triangle_count`` and counted at their three nodes.
    """
    e, _ = cut(_ranked(edges), "ranked")
    deg = e.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    closed = _triangles(e).select(F.explode(F.array("u", "v", "w")).alias("a")).groupBy("a").agg(F.count("*").alias("n"))
    score = F.when(F.col("d") > 1, 2 * F.coalesce("n", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return deg.join(closed, deg["node"] == closed["a"], "left").select("node", score.cast("double").alias("coefficient"))


def density(edges: DataFrame) -> DataFrame:
    """(density): 2 E / (V (V - 1)) with all edge rows; 0 for fewer than two nodes."""
    v = nodes_of(edges).agg(F.count("*").alias("v"))
    n = edges.agg(F.count("*").alias("e"))
    return n.crossJoin(v).select(F.when(F.col("v") > 1, 2.0 * F.col("e") / (F.col("v") * (F.col("v") - 1))).otherwise(0.0).alias("density"))  # one row each


#: Places (sources times nodes) that a task marks at once, and steps of a hop beyond which it takes half of its sources.
_MARKS, _STEPS = 1 << 26, 1 << 22


class _Walks:
    """Walks from many sources at once, whose work is what they reach and not the graph for each source.

    A walk's place is source times nodes plus node. Marks are kept from batch to batch and only what was reached is cleared.
    """

    def __init__(self, g: Csr) -> None:
        self.g, self.n = g, max(1, len(g))
        self.width = max(1, min(1024, _MARKS // self.n))
        self.seen = np.zeros(self.width * self.n, bool)

    def layers(self, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """For each hop (places, which of the last hop's places each edge leaves, which of these it enters); None if that is
        too much at once."""
        now = np.arange(len(rows)) * self.n + rows
        self.seen[now] = True
        out = [(now, np.zeros(0, np.int64), np.zeros(0, np.int64))]
        done = True
        while len(now):
            at = now % self.n
            if len(rows) > 1 and (self.g.start[at + 1] - self.g.start[at]).sum() > _STEPS:
                done = False
                break
            which, to = self.g.step(at)
            key = now[which] - at[which] + to
            fresh = ~self.seen[key]
            which, key = which[fresh], key[fresh]
            now, enters = np.unique(key, return_inverse=True)
            self.seen[now] = True
            if len(now):
                out.append((now, which, enters))
        for places, _, _ in out:
            self.seen[places] = False
        return out if done else None

    def batches(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, list]]:
        """(rows, their layers) over all ``rows``."""
        todo = [rows[i : i + self.width] for i in range(0, len(rows), self.width)][::-1]
        while todo:
            part = todo.pop()
            if (got := self.layers(part)) is None:
                todo += [part[len(part) // 2 :], part[: len(part) // 2]]
            else:
                yield part, got


def _from_each_source(graph_edges: DataFrame, sources: DataFrame | None, work, schema: str) -> DataFrame:
    """``work(walks, places of sources)`` in tasks that each take some of the sources, on the edges of a checked size.

    The adjacency goes to every task.
    """
    spark = graph_edges.sparkSession
    graph = spark.sparkContext.broadcast(gathered(iter(graph_edges.toArrow().to_batches())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [b.column("node").to_numpy(zero_copy_only=False) for b in batches]
        if ids:
            yield from work(_Walks(graph.value), graph.value.index(np.concatenate(ids)))

    start = nodes_of(graph_edges) if sources is None else sources.select(F.col("node").cast("long"))
    return start.repartition(max(2, spark.sparkContext.defaultParallelism), "node").mapInArrow(run, schema)


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})


def _layers(e: DataFrame, sources: DataFrame | None, ways: bool = False) -> Iterator[DataFrame]:
    """(s, v[, ways]) of each hop from 1 on: the nodes v first reached from s in it, and on how many shortest paths.

    Tables of pairs, as many as there are pairs that are joined: all-pairs work, bounded by the disk and not by memory.
    """
    links, _ = cut(e.where("source <> target").distinct(), "links")
    first = links if sources is None else links.join(sources.select(F.col("node").cast("long").alias("source")).distinct(), "source", "left_semi")
    front, _ = cut(first.select(F.col("source").alias("s"), F.col("target").alias("v"), *([F.lit(1.0).alias("ways")] if ways else [])), "front")
    seen: list[DataFrame] = []
    while not front.isEmpty():
        yield front
        seen.append(front.select("s", "v"))
        step = front.join(links, F.col("v") == F.col("source")).where("s <> target").select("s", F.col("target").alias("v"), *(["ways"] if ways else []))
        step = step.groupBy("s", "v").agg(F.sum("ways").alias("ways")) if ways else step.distinct()
        front, _ = cut(step.join(functools.reduce(DataFrame.unionByName, seen), ["s", "v"], "left_anti"), "front")


def _reached(e: DataFrame, sources: DataFrame | None) -> DataFrame:
    """(s, hop): a row for each pair that is joined, and one of hop 0 for each node of the graph."""
    parts = [part.select("s", F.lit(h).cast("long").alias("hop")) for h, part in enumerate(_layers(e, sources), 1)]
    none = nodes_of(e).select(F.col("node").alias("s"), F.lit(0).cast("long").alias("hop"))
    return functools.reduce(DataFrame.unionByName, parts, none)


def closeness(edges: DataFrame) -> DataFrame:
    """(node, closeness): (reached - 1) / sum of distances along edges, 0 if nothing is reached."""
    e = edges.select("source", "target").distinct()
    if not few(e):
        hop = F.sum("hop")
        return _reached(e, None).groupBy(F.col("s").alias("node")).agg(F.when(hop > 0, F.sum((F.col("hop") > 0).cast("long")) / hop).otherwise(0.0).alias("closeness"))

    def work(walks: _Walks, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part, layers in walks.batches(rows):
            n, total = np.zeros(len(part)), np.zeros(len(part))
            for h, (places, _, _) in enumerate(layers):
                met = np.bincount(places // walks.n, minlength=len(part)) * (h > 0)
                n, total = n + met, total + h * met
            yield _batch(node=walks.g.nodes[part], closeness=np.where(total > 0, n / np.maximum(total, 1), 0.0))

    return _from_each_source(e, None, work, "node long, closeness double")


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness): Brandes' sums over directed shortest paths, neither normalised nor halved.

    Each task sums over its sources; the partial sums meet in one aggregate by node.
    """
    e = edges.select("source", "target").distinct()
    if not few(e):
        return _betweenness_frames(e)

    def work(walks: _Walks, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        score = np.zeros(len(walks.g))
        for _, layers in walks.batches(rows):
            sigma = [np.ones(len(layers[0][0]))]
            for places, leaves, enters in layers[1:]:
                sigma.append(np.bincount(enters, weights=sigma[-1][leaves], minlength=len(places)))
            delta = np.zeros(len(layers[-1][0]))
            for h in range(len(layers) - 1, 0, -1):
                places, leaves, enters = layers[h]
                np.add.at(score, places % walks.n, delta)
                delta = np.bincount(leaves, weights=sigma[h - 1][leaves] / sigma[h][enters] * (1 + delta[enters]), minlength=len(layers[h - 1][0]))
        yield _batch(node=walks.g.nodes, part=score)

    return _from_each_source(e, None, work, "node long, part double").groupBy("node").agg(F.sum("part").alias("betweenness"))


def _betweenness_frames(e: DataFrame) -> DataFrame:
    """Layer by layer back from the last hop; ``share`` is what each path to a pair's node hands to the node before."""
    layers = list(_layers(e, None, ways=True))
    found = [nodes_of(e).select("node", F.lit(0.0).alias("part"))]
    share = None
    back = e.where("source <> target")
    for h in range(len(layers) - 1, -1, -1):
        if share is None:
            now = layers[h].withColumn("delta", F.lit(0.0))
        else:
            got = share.join(back, F.col("v") == F.col("target")).groupBy("s", F.col("source").alias("v")).agg(F.sum("share").alias("got"))
            now, _ = cut(layers[h].join(got, ["s", "v"], "left").select("s", "v", "ways", (F.col("ways") * F.coalesce("got", F.lit(0.0))).alias("delta")), "delta")
            found.append(now.groupBy(F.col("v").alias("node")).agg(F.sum("delta").alias("part")))
        share = now.select("s", "v", ((1 + F.col("delta")) / F.col("ways")).alias("share"))
    return functools.reduce(DataFrame.unionByName, found).groupBy("node").agg(F.sum("part").alias("betweenness"))


def average_path_length(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(pairs, average): mean distance over all ordered pairs that are joined, from all nodes or the ``sources`` (node)."""
    e = edges.select("source", "target").distinct()
    sources = None if sources is None else sources.select("node").distinct()
    if few(e):

        def work(walks: _Walks, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for _, layers in walks.batches(rows):
                n = np.array([len(places) for places, _, _ in layers[1:]], np.int64)
                yield _batch(n=[int(n.sum())], total=[int((n * np.arange(1, len(n) + 1)).sum())])

        sums = _from_each_source(e, sources, work, "n long, total long")
    else:
        sums = _reached(e, sources).where("hop > 0").agg(F.count("*").alias("n"), F.sum("hop").alias("total"))
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), (F.sum("total") / F.when(F.sum("n") > 0, F.sum("n"))).alias("average"))
