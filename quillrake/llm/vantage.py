"""Vantage-point trees over 64-bit codes: exact search for all pairs within a Hamming radius, shard by shard.

A node of a tree has a vantage point, which is one of the codes, and a threshold near the median of the distances to it. A code
at distance d goes inside if d <= threshold, else outside; its way down ends in one leaf, its home. By the triangle
inequality a ball of radius r around it can hold codes on the inside only if d - r <= threshold, and on the outside
only if d + r > threshold: all other branches are pruned. Where the ball overlaps both sides, the search goes down both and the
code visits each leaf that it reaches. A leaf is a shard: its own codes are compared with each other and with visitors.
A visitor goes only to leaves numbered above its home, since of two codes in different leaves one is such a visitor of the other.

Distances of 64-bit codes lie close together, so a ball of the whole radius overlaps most boundaries. Two codes within
``radius`` differ in at most ``radius // 2`` bits of one half, so each half of the bits has a tree of its own and is searched
at that radius; whoever meets there is compared on all bits.

Vantage points and thresholds come from a sample of at most ``SAMPLE`` codes, chosen by hash, which the driver holds with the tree;
every code is dealt, whatever the sample. A node is split while its share of all codes exceeds ``LEAF``, if no more than
half of the sample overlaps the boundary. What cannot be split (a dense cluster, or a share of a table so large that the sample
runs out) is a dense leaf: its codes are dealt out to blocks, which others of the leaf visit, or, above ``DENSE`` codes, it takes a
way that is linear in its size: two codes lie within two bits if and only if their balls of radius one share a point. Codes at home in
a block are held together by one task; visitors, however many, pass by in batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SAMPLE = 1 << 16
LEAF = 512
#: Leaves' worth of codes at home in one block of a dense leaf, and codes from which a leaf takes the linear way.
BLOCKS, DENSE = 4, 32 * LEAF
#: Sampled codes that are weighed up as vantage points of a node, and the least share of a side.
CANDIDATES, LEAST_SIDE = 8, 0.15
_HALVES = (0xFFFFFFFF, 0xFFFFFFFF00000000)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@dataclass
class VantageTree:
    """Nodes as arrays; a child below zero is the leaf ~child. ``slack`` is the search radius in the bits of ``mask``."""

    mask: int
    slack: int
    point: np.ndarray
    threshold: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    leaves: int

    @classmethod
    def grown(cls, sample: np.ndarray, mask: int, slack: int, most: int, seed: int = 7) -> VantageTree:
        """A tree over unsigned codes whose leaves have ``most`` of them at most, dense ones excepted."""
        rng, bits = np.random.default_rng(seed), np.uint64(mask)
        point, threshold, sides, leaves = [], [], [], 0
        todo: list[tuple[np.ndarray, int, int]] = [(sample, -1, 0)]
        while todo:
            codes, parent, side = todo.pop()
            best = None
            if len(codes) > most:
                for v in codes[rng.choice(len(codes), min(CANDIDATES, len(codes)), replace=False)]:
                    count = np.bincount(np.bitwise_count((codes ^ v) & bits), minlength=66).astype(np.int64)
                    below = np.cumsum(count)
                    both = below[np.minimum(np.arange(65) + slack, 65)] - np.where(np.arange(65) - slack >= 0, below[np.maximum(np.arange(65) - slack, 0)], 0)
                    fair = np.minimum(below[:65], len(codes) - below[:65]) >= max(1, LEAST_SIDE * len(codes))
                    for t in np.flatnonzero(fair & (both <= len(codes) / 2)):
                        cost = (both[t] / len(codes), abs(2 * int(below[t]) - len(codes)))
                        if best is None or cost < best[0]:
                            best = (cost, v, int(t))
            if best is None:
                here, leaves = ~leaves, leaves + 1
            else:
                here = len(point)
                point.append(best[1])
                threshold.append(best[2])
                sides.append([0, 0])
                near = np.bitwise_count((codes ^ best[1]) & bits) <= best[2]
                todo += [(codes[~near], here, 1), (codes[near], here, 0)]
            if parent >= 0:
                sides[parent][side] = here
        sides = np.array(sides, np.int64).reshape(-1, 2)
        return cls(mask, slack, np.array(point, np.uint64), np.array(threshold, np.int64), sides[:, 0], sides[:, 1], leaves)

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for the home of each unsigned code and for each leaf above it that its ball overlaps."""
        row = np.arange(len(codes))
        if not len(self.point):
            return row, np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
        node, home = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(row):
            d = np.bitwise_count((codes[row] ^ self.point[node]) & np.uint64(self.mask)).astype(np.int64)
            t = self.threshold[node]
            near, far = d - self.slack <= t, d + self.slack > t
            at = np.concatenate([self.inside[node[near]], self.outside[node[far]]])
            home = np.concatenate([home[near] & (d[near] <= t[near]), home[far] & (d[far] > t[far])])
            row = np.concatenate([row[near], row[far]])
            leaf = at < 0
            done.append((row[leaf], ~at[leaf], home[leaf]))
            row, node, home = row[~leaf], at[~leaf], home[~leaf]
        row, leaf, home = (np.concatenate(x) for x in zip(*done, strict=True))
        own = np.empty(len(codes), np.int64)
        own[row[home]] = leaf[home]
        keep = home | (leaf > own[row])
        return row[keep], leaf[keep], home[keep]


def grow_trees(nodes: DataFrame, radius: int, leaf: int = LEAF, sample: int = SAMPLE) -> list[VantageTree]:
    """A tree for each half of the bits, from a sample of the codes of ``nodes`` that reaches the driver (8 bytes each)."""
    n = nodes.count()
    share = min(1.0, sample / max(1, n))
    some = nodes.where(F.pmod(F.xxhash64("code"), F.lit(1 << 30)) < int(share * (1 << 30))).select("code").limit(2 * sample)
    codes = some.toArrow().column("code").to_numpy().astype(np.int64).view(np.uint64)
    codes = np.unique(codes)
    return [VantageTree.grown(codes, mask, radius // 2, max(8, int(leaf * share))) for mask in _HALVES]


def _dealt(trees: list[VantageTree]):
    """Every row once for its home and once for each leaf that it visits, in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                codes = batch.column("code").to_numpy(zero_copy_only=False).astype(np.int64)
                node = batch.column("node").to_numpy(zero_copy_only=False)
                for k, tree in enumerate(trees):
                    row, leaf, home = tree.search(codes.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf + (k << 40)), pa.array(home), pa.array(node[row]), pa.array(codes[row])], ["shard", "home", "node", "code"])

    return run


def least_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` members the least one that it reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _linked(node: np.ndarray, code: np.ndarray, home: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the first ``home`` codes of a leaf with each other and with the rest, its visitors."""
    i, j = [], []
    for at in range(0, len(code), 1024):
        x, y = np.nonzero(np.bitwise_count(code[:home, None] ^ code[None, at : at + 1024]) <= radius)
        i.append(x)
        j.append(y + at)
    label = least_labels(np.concatenate(i), np.concatenate(j), len(code))
    joined = label != np.arange(len(code))
    if joined.any():
        yield pa.RecordBatch.from_arrays([pa.array(node[joined]), pa.array(node[label[joined]])], ["a", "b"])


def _leaf_links(radius: int):
    """Links within groups (shard, block) that lie together, codes at home first; visitors are met as they come, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node, code = None, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            shard, block, nodes, codes = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "block", "node", "code"))
            home, codes = batch.column("home").to_numpy(zero_copy_only=False).astype(bool), codes.view(np.uint64)
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(shard)]):
                if a == b:
                    continue
                if (shard[a], block[a]) != now:
                    now, node, code = (shard[a], block[a]), node[:0], code[:0]
                visits = a + int(home[a:b].sum())
                node, code = np.concatenate([node, nodes[a:visits]]), np.concatenate([code, codes[a:visits]])
                if len(code):
                    yield from _linked(np.concatenate([node, nodes[visits:b]]), np.concatenate([code, codes[visits:b]]), len(code), radius)

    return run


def _midpoint_links(dense: DataFrame) -> DataFrame:
    """Links of dense leaves without pairs, at a radius of two: codes that share a point of their balls; at most 65 share one."""
    flips = F.array(*[F.lit(0).cast("long")], *[F.lit(signed(1 << b)) for b in range(64)])
    ball = dense.select("node", "code").distinct().withColumn("flip", F.explode(flips)).withColumn("point", F.col("code").bitwiseXOR(F.col("flip")))
    low = ball.groupBy("point").agg(F.min("node").alias("b"), F.collect_list("node").alias("all")).where(F.size("all") > 1)
    return low.select(F.explode("all").alias("a"), "b").where("a <> b")


def code_links(nodes: DataFrame, radius: int = 2, trees: list[VantageTree] | None = None, leaf: int = LEAF, dense: int = DENSE) -> DataFrame:
    """(a, b) spanning the links between the codes of ``nodes`` (node, code), which are distinct, within ``radius`` bits; none is missed."""
    trees = trees or grow_trees(nodes, radius, leaf)
    rows, _ = cut(nodes.select("node", "code").mapInArrow(_dealt(trees), "shard long, home boolean, node long, code long"), "leaves")
    full, _ = cut(rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("home").alias("own")).where("n > 1 AND own > 0"), "sizes")
    members = rows.join(full, "shard")
    linear = radius == 2
    small = members.where(F.col("own") <= dense) if linear else members
    parts = F.ceil(F.col("own") / F.lit(BLOCKS * leaf)).cast("int")
    small = small.withColumn("parts", parts).withColumn("at", F.pmod(F.xxhash64("node", "shard"), "parts").cast("int"))
    last = F.when(F.col("home"), F.col("at")).otherwise(F.col("parts") - 1)  # a code is at home in one block and visits those before
    dealt = small.select("shard", "node", "code", "home", "at", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    dealt = dealt.select("shard", "block", (F.col("home") & (F.col("at") == F.col("block"))).alias("home"), "node", "code")
    order = ["shard", "block", F.col("home").desc()]
    links = dealt.repartition("shard", "block").sortWithinPartitions(*order).mapInArrow(_leaf_links(radius), "a long, b long")
    return links.union(_midpoint_links(members.where(F.col("own") > dense))) if linear else links
