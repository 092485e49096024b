"""Edge tables, their ways of execution, and adjacency inside one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column names by which ends of edges are known; fixed values.
SOURCE_NAMES = ("source", "src", "src_id", "from", "u")
TARGET_NAMES = ("target", "dst", "dst_id", "to", "v")
#: The largest graph that one task takes: about 100 MB of adjacency.
LOCAL_EDGES = 4_000_000
#: Edges that a task takes at once of those dealt to it.
CHUNK = 1_000_000
MODES = ("auto", "in_memory", "out_of_core")


def _named(df: DataFrame, names: tuple[str, ...]) -> str:
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"no column of {names} in {df.columns}")


def edge_table(df: DataFrame, source: str | None = None, target: str | None = None, weight: str | None = None) -> DataFrame:
    """(source, target[, weight]) as longs and a double, without null ends; null weights are 1."""
    cols = [F.col(source or _named(df, SOURCE_NAMES)).cast("long").alias("source"), F.col(target or _named(df, TARGET_NAMES)).cast("long").alias("target")]
    if weight:
        cols.append(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)).alias("weight"))
    return df.select(*cols).where("source IS NOT NULL AND target IS NOT NULL")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; nothing is dropped or combined."""
    more = [c for c in edges.columns if c not in ("source", "target")]
    return edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *more))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges in both directions without loops."""
    return both_ways(edges.select("source", "target")).where("source <> target").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def few(edges: DataFrame) -> bool:
    """Whether one task takes them; counted where the edges are, as a limit would send rows of every partition to one task."""
    return edges.count() <= LOCAL_EDGES


def in_one_task(edges: DataFrame, mode: str) -> bool:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "out_of_core":
        return False
    small = few(edges)
    if mode == "in_memory" and not small:
        raise ValueError(f"more than {LOCAL_EDGES} edges do not fit one task; use mode='out_of_core'")
    return small


class Csr:
    """Compressed adjacency of the edges of a task; nodes are numbered in ascending order of their ids."""

    def __init__(self, source: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, directed: bool = True, distinct: bool = True) -> None:
        self.nodes, place = np.unique(np.concatenate([source, target]), return_inverse=True)
        a, b = place[: len(source)], place[len(source) :]
        w = np.ones(len(a)) if weight is None else weight
        if not directed:
            a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        if distinct and len(a):
            head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            w = np.add.reduceat(w, np.flatnonzero(head)) if weight is not None else w[head]
            a, b = a[head], b[head]
        self.source, self.target, self.weight = a, b, w
        self.start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(self.nodes)))]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.nodes)

    def out(self, u: int) -> np.ndarray:
        return self.target[self.start[u] : self.start[u + 1]]

    def reversed(self) -> Csr:
        turned = object.__new__(Csr)
        order = np.lexsort((self.source, self.target))
        turned.nodes, turned.source, turned.target, turned.weight = self.nodes, self.target[order], self.source[order], self.weight[order]
        turned.start = np.concatenate([[0], np.cumsum(np.bincount(turned.source, minlength=len(self.nodes)))]).astype(np.int64)
        return turned

    def step(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, neighbour) for all edges out of the rows."""
        counts = self.start[rows + 1] - self.start[rows]
        which = np.repeat(np.arange(len(rows)), counts)
        first = np.repeat(self.start[rows] - (np.cumsum(counts) - counts), counts)
        return which, self.target[first + np.arange(len(which))]

    def index(self, ids) -> np.ndarray:
        """Places of those ``ids`` that are nodes."""
        ids = np.asarray(list(ids), np.int64)
        at = np.searchsorted(self.nodes, ids)
        ok = (at < len(self.nodes)) & (self.nodes[np.minimum(at, len(self.nodes) - 1)] == ids) if len(self.nodes) else np.zeros(len(ids), bool)
        return at[ok]

    def distances(self, seeds: np.ndarray, hops: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hop or -1, number of the first seed to arrive, parent) of each node; ties go to the smaller."""
        hop, owner, parent = np.full(len(self), -1), np.full(len(self), -1), np.full(len(self), -1)
        for k, s in reversed(list(enumerate(seeds.tolist()))):
            hop[s], owner[s] = 0, k
        now, h = np.unique(seeds), 0
        while len(now) and (hops is None or h < hops):
            which, to = self.step(now)
            fresh = hop[to] < 0
            which, to = which[fresh], to[fresh]
            order = np.lexsort((now[which], owner[now[which]], to))
            to, which = to[order], which[order]
            head = np.concatenate([[True], to[1:] != to[:-1]]) if len(to) else np.zeros(0, bool)
            h += 1
            fresh_nodes, via = to[head], now[which[head]]
            hop[fresh_nodes], owner[fresh_nodes], parent[fresh_nodes] = h, owner[via], via
            now = fresh_nodes
        return hop, owner, parent


def gathered(batches: Iterator[pa.RecordBatch], directed: bool = True, distinct: bool = True) -> Csr:
    table = list(batches)
    column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in table]) if table else np.zeros(0, np.int64)
    weight = column("weight") if table and "weight" in table[0].schema.names else None
    return Csr(column("source").astype(np.int64), column("target").astype(np.int64), weight, directed, distinct)


def on_csr(edges: DataFrame, work: Callable[[Csr], dict], schema: str, directed: bool = True, distinct: bool = True) -> DataFrame:
    """``work`` on the whole graph in one task; it returns columns by name. Callers have checked the size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _columns(work(gathered(batches, directed, distinct)), schema)

    return edges.repartition(1).mapInArrow(run, schema)  # what comes before stays in many tasks


def _columns(got: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    fields = [(x.split(" ", 1)[0], kinds[x.split(" ", 1)[1]]) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(got[n], k) for n, k in fields], [n for n, _ in fields])


def on_components(members: DataFrame, work: Callable[[Csr], dict], schema: str, directed: bool = True, distinct: bool = True) -> DataFrame:
    """``work`` on graphs of some whole components each; callers have checked the largest.

    ``members``: edges with their component. They are dealt by component, and a task takes about ``CHUNK`` edges at once.
    """
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            component = b.column("component").to_numpy(zero_copy_only=False)
            if rows >= chunk:
                same = int(np.searchsorted(component, last, "right"))
                held.append(b.slice(0, same))
                if same == b.num_rows:
                    continue
                yield _columns(work(gathered(iter(held), directed, distinct)), schema)
                held, rows, b = [], 0, b.slice(same)
            held.append(b)
            rows, last = rows + b.num_rows, component[-1]
        if held:
            yield _columns(work(gathered(iter(held), directed, distinct)), schema)

    parts = max(2 * members.sparkSession.sparkContext.defaultParallelism, members.count() // chunk)  # a number that stays, as small rows are much work
    return members.repartition(parts, "component").sortWithinPartitions("component").mapInArrow(run, schema)
