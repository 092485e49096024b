"""Embedding near-duplicates by lattice hashing, verified by cosine.

Each table projects a vector onto random orthonormal directions, ``blocks`` times eight of them, and decodes every
eight to the nearest point of the E8 lattice; the points name a cell. The ``probes`` least costly moves of one block
to its next coset give neighbouring cells. Two vectors are compared if they share any cell of any table.

Equal vectors are collapsed first and keep a weight, so copies meet nowhere. Cells with one vector are dropped before
vectors travel. A cell with more than ``BLOCK`` vectors is dealt out as pairs of blocks, each to a group of bounded
size, so no task holds a whole cell and no comparison is dropped. A pair counts in the smallest cell it shares and
nowhere else, which gives exact counts without a list of pairs; only sums and spanning links leave a task.

With the defaults about 99 % of the links at a cosine of exactly 0.9 are found (all above 0.95); more
``tables`` raise that, more ``blocks`` keep cells small on larger inputs. Nothing below the threshold is linked.

Vectors that are null, zero, empty or hold null or non-finite numbers link with nothing; vectors of different lengths
never link. Rows that repeat an id and vector are further copies; an id with several vectors is one node. A null id
has no component. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Forest, components, cut
from .vantage import least_labels

BLOCKS, TABLES, WIDTH, PROBES = 5, 16, 0.55, 2
BLOCK = 1024
SEED = 20


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of the checkerboard lattice: whole coordinates with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    if len(odd):
        miss = x[odd] - r[odd]
        worst = np.abs(miss).argmax(1)
        r[odd, worst] += np.where(miss[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest E8 points of rows of eight, the nearest points of the other coset, and what those cost more."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    da, db = ((x - a) ** 2).sum(1), ((x - b) ** 2).sum(1)
    first = (da <= db)[:, None]
    return np.where(first, a, b), np.where(first, b, a), np.abs(da - db)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Lattice:
    def __init__(self, dim: int, blocks: int = BLOCKS, tables: int = TABLES, width: float = WIDTH, probes: int = PROBES, seed: int = SEED) -> None:
        rng = np.random.default_rng([seed, dim])
        self.blocks, self.probes, self.width = blocks, min(probes, blocks), width
        self.turns = []
        for _ in range(tables):
            square = rng.standard_normal((max(dim, 8 * blocks), 8 * blocks))
            self.turns.append((np.linalg.qr(square)[0][:dim], rng.random(8 * blocks)))
        self.scale = np.sqrt(64 / max(dim, 8 * blocks))  # widths are tuned for 64 dimensions

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes) cell names, unsigned."""
        out = np.empty((len(unit), len(self.turns), 1 + self.probes), np.uint64)
        rows = np.arange(len(unit))
        name = lambda p: np.ascontiguousarray((2 * p).astype(np.int8)).view(np.uint64)[:, 0]
        for t, (turn, shift) in enumerate(self.turns):
            y = unit @ turn / (self.width * self.scale) + shift
            home, other, cost = [], [], []
            for b in range(self.blocks):
                p, q, c = decode_e8(y[:, 8 * b : 8 * b + 8])
                salt = np.uint64(((t * self.blocks + b + 1) * 0x9E3779B97F4A7C15) % 2**64)
                home.append(_mixed(name(p) + salt))
                other.append(_mixed(name(q) + salt))
                cost.append(c)
            home, other = np.array(home), np.array(other)
            order = np.argsort(np.array(cost), axis=0, kind="stable")
            base = home.sum(0, dtype=np.uint64)
            out[:, t, 0] = base
            for k in range(self.probes):
                b = order[k]
                out[:, t, 1 + k] = base - home[b, rows] + other[b, rows]
        return out


def _packed(x: np.ndarray) -> bytes:
    """A vector in single precision if that loses nothing, else in double; the last byte tells."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return single.tobytes() + b"f" if (single == x).all() else x.tobytes() + b"d"


def _by_dimension(vectors: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors in double precision) for each number of dimensions."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for k, v in enumerate(vectors):
        x = np.frombuffer(v, np.float32 if v[-1:] == b"f" else np.float64, (len(v) - 1) // (4 if v[-1:] == b"f" else 8))
        rows, parts = held.setdefault(len(x), ([], []))
        rows.append(k)
        parts.append(x)
    for rows, parts in held.values():
        yield np.array(rows), np.array(parts, np.float64)


def _hashed(settings: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                vectors = batch.column("vector").to_pylist()
                key: list = [None] * len(vectors)
                packed: list = [None] * len(vectors)
                cells: list = [None] * len(vectors)
                by_dim: dict[int, tuple[list, list]] = {}
                for i, v in enumerate(vectors):
                    if not v or any(x is None for x in v):
                        continue
                    x = np.array(v, np.float64)
                    norm = np.sqrt(x @ x)
                    if not np.isfinite(x).all() or not (norm > 0 and np.isfinite(norm)):
                        big = np.abs(x).max() if np.isfinite(x).all() else 0
                        if not big > 0:
                            continue
                        x = x / big  # too large or small to square
                        norm = np.sqrt(x @ x)
                    key[i] = hashlib.md5(x.tobytes()).digest()
                    packed[i] = _packed(x)
                    rows, unit = by_dim.setdefault(len(x), ([], []))
                    rows.append(i)
                    unit.append(x / norm)
                for dim, (rows, unit) in by_dim.items():
                    if dim not in lattices:
                        lattices[dim] = Lattice(dim, *settings)
                    for i, c in zip(rows, lattices[dim].cells(np.array(unit)), strict=True):
                        cells[i] = c.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(key, pa.binary()), pa.array(packed, pa.binary()), pa.array(cells, pa.binary())], ["id", "key", "vector", "cells"])

    return run


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            cells = [np.unique(np.frombuffer(c, np.int64)) for c in batch.column("cells").to_pylist()]
            if cells:
                rows = np.repeat(np.array(batch.column("rep").to_pylist(), np.int64), [len(c) for c in cells])
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(cells))], ["rep", "cell"])


def _compared(threshold: float, width: int):
    """Sums and spanning links of groups that lie together, sorted by (cell, b1, b2). Groups are of bounded size."""

    def counted(group: dict, i: np.ndarray, j: np.ndarray, cell: int, n: np.ndarray, local: np.ndarray) -> None:
        a, b = group["cells"][i].reshape(len(i), -1, width), group["cells"][j].reshape(len(j), -1, width)
        shared = np.where(a[:, :, :, None] == b[:, :, None, :], a[:, :, :, None], np.iinfo(np.int64).max)
        mine = shared.reshape(len(i), -1).min(1) == cell
        np.add.at(local, i[mine], n[j[mine]])
        np.add.at(local, j[mine], n[i[mine]])

    def compare(group: dict, cell: int, b1: int, b2: int, forest: Forest, sums: dict) -> None:
        rep, n, side = group["rep"], np.array(group["n"], np.int64), np.array(group["block"])
        local, links = np.zeros(len(rep), np.int64), [(side[:0].astype(np.int64),) * 2]
        for rows, x in _by_dimension(group["vector"]):
            x = x / np.sqrt((x * x).sum(1))[:, None]
            for at in range(0, len(rows), 256):
                near = x[at : at + 256] @ x.T >= threshold
                i, j = np.nonzero(near)
                i += at
                ok = (i < j) if b1 == b2 else (side[rows[i]] == b1) & (side[rows[j]] == b2)
                i, j = rows[i[ok]], rows[j[ok]]
                links.append((i, j))
                for k in range(0, len(i), 4096):
                    counted(group, i[k : k + 4096], j[k : k + 4096], cell, n, local)
        label = least_labels(*(np.concatenate(x) for x in zip(*links, strict=True)), len(rep))
        for x in np.flatnonzero(label != np.arange(len(rep))).tolist():
            forest.join(rep[x], rep[label[x]])
        for x in np.flatnonzero(local).tolist():
            sums[rep[x]] = sums.get(rep[x], 0) + int(local[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sums = Forest(), {}
        held: dict[str, list] = {}
        now = None

        def done() -> None:
            if now is not None and len(held["rep"]) > 1:
                held["cells"] = np.frombuffer(b"".join(held["cells"]), np.int64).reshape(len(held["rep"]), -1)
                compare(held, *now, forest, sums)

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for k, at in enumerate(zip(cols["cell"], cols["b1"], cols["b2"], strict=True)):
                if at != now:
                    done()
                    now, held = at, {c: [] for c in ("rep", "n", "vector", "cells", "block")}
                for c, v in held.items():
                    v.append(cols[c][k])
        done()
        edges = forest.edges()
        a = [*sums, *(e[0] for e in edges)]
        b = [None] * len(sums) + [e[1] for e in edges]
        n = [*sums.values(), *[0] * len(edges)]
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, blocks: int = BLOCKS, tables: int = TABLES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other rows linked directly), component_id (smallest id), kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    base, _ = cut(rows.mapInArrow(_hashed((blocks, tables, width, probes)), "id long, key binary, vector binary, cells binary"), "vectors")
    known = base.where("key IS NOT NULL")
    same = known.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"), F.first("cells").alias("cells"))
    reps, _ = cut(same.where("rep IS NOT NULL"), "reps")
    cells, _ = cut(reps.select("rep", "cells").mapInArrow(_cell_rows, "rep long, cell long").distinct(), "cells")
    full, _ = cut(cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1"), "full")
    dealt = cells.join(full, "cell").withColumn("parts", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", "cell"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("rep", "cell", "block", other).select("rep", "cell", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    met = dealt.join(reps.drop("key"), "rep")
    parts = [F.col(c) for c in ("cell", "b1", "b2")]
    found = met.repartition(*parts).sortWithinPartitions(*parts).mapInArrow(_compared(threshold, 1 + min(probes, blocks)), "a long, b long, n long")
    found, _ = cut(found, "links")
    roots = components(found.where("b IS NOT NULL"), "a", "b")
    sums = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("sum"))
    info = reps.select("key", "rep", "n").join(sums, F.col("rep") == F.col("a"), "left").drop("a").join(roots, F.col("rep") == F.col("node"), "left")
    info = info.select(F.col("key").alias("k"), (F.coalesce("sum", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    info, _ = cut(info.where("n_links > 0"), "info")
    out = base.select("id", "key").join(info, F.col("key") == F.col("k"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
