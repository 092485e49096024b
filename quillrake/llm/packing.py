"""Packing token sequences by best-fit decreasing over a segment tree of remaining capacities.

A document is first cut into full windows; what is left over is one piece. Pieces are dealt to shards of about
``SHARD_PIECES`` by hash. In a shard the pieces go, longest first, each to the open window with the least room that
still holds it, found in a segment tree indexed by remaining capacity. Only lengths travel: the text is encoded in
the task that reads it. Shards are alike at every size; their number follows the number of documents.

With the places of a mixture the shards are ranges of them instead, numbered in that order, and a shard numbers its
windows by their first pieces. So sequences in order of their ids go through the mixture shard by shard.

A sequence counts as padded to ``size`` unless the ids in it are a power of two. Null and empty texts have the end
id alone. Rows that repeat an id are packed as separate documents with equal rows told apart by their order.
An empty table gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CACHE_PIECES, encoded, public_path

SIZE = 2048
SHARD_PIECES = 4096
#: Bits of a sequence id for the window within its shard; the rest names the shard.
WINDOW_BITS = 28


class CapacityTree:
    """Counts of open windows by remaining capacity 0..size; finds the least capacity of at least n."""

    def __init__(self, size: int) -> None:
        self.base = 1 << size.bit_length()
        self.tree = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def push(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = self.base + room
        while i:
            self.tree[i] += 1
            i >>= 1

    def pop(self, room: int) -> int:
        i = self.base + room
        while i:
            self.tree[i] -= 1
            i >>= 1
        return self.open[room].pop()

    def tightest(self, n: int) -> int | None:
        i = self.base + n
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i ^ 1]):
                i >>= 1
            if i <= 1:
                return None
            i ^= 1
            while i < self.base:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.base


def best_fit_decreasing(lengths: list[int], size: int = SIZE) -> list[tuple[int, int]]:
    """(window, offset) of each piece, in the order given; lengths are 1..size."""
    tree, windows, out = CapacityTree(size), 0, [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        room = tree.tightest(n)
        if room is None:
            room, window = size, windows
            windows += 1
        else:
            window = tree.pop(room)
        out[k] = (window, size - room)
        if room > n:
            tree.push(room - n, window)
    return out


def _cut_rows(path: str, size: int, end: int, cache: int):
    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, length, crc, total = [], [], [], [], []
            ids = batch.column("id").to_pylist()
            for i, data in encoded(batch, "text", path, end, cache):
                view, n = memoryview(data), len(data) // 4
                for s in range(0, n, size):
                    part = view[4 * s : 4 * (s + size)]
                    doc.append(ids[i])
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field("id").type), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut_batches


def _by_first_piece(placed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same windows, numbered in the order in which their first pieces stand."""
    number: dict[int, int] = {}
    for w, _ in placed:
        number.setdefault(w, len(number))
    return [(number[w], offset) for w, offset in placed]


def _pack_rows(size: int, places: list[str]):
    def pack(keys: tuple, table: pa.Table) -> pa.Table:
        (shard,) = (k.as_py() for k in keys)
        table = table.sort_by([(c, "ascending") for c in (*places, "id", "start", "length", "ids_crc32")])
        placed = best_fit_decreasing(table.column("length").to_pylist(), size)
        if places:
            placed = _by_first_piece(placed)
        if len(placed) >> WINDOW_BITS:
            raise OverflowError("a shard has more pieces than a sequence id can number")
        fill: dict[int, int] = {}
        for (window, offset), n in zip(placed, table.column("length").to_pylist(), strict=True):
            fill[window] = max(fill.get(window, 0), offset + n)
        padded = {w: n if n & (n - 1) == 0 else size for w, n in fill.items()}
        table = table.drop_columns(["shard", *places]).append_column("sequence_id", pa.array([shard << WINDOW_BITS | w for w, _ in placed], pa.int64()))
        table = table.append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        return table.append_column("sequence_length", pa.array([padded[w] for w, _ in placed], pa.int64()))

    return pack


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 1, tokenizer: str | None = None, cache: int = CACHE_PIECES, order: DataFrame | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length (with padding).

    ``cache`` bounds what a worker remembers of pieces already encoded; a smaller one costs time and never results.
    ``order`` has the place of every id in a mixture, as ``mixed_places`` gives it.
    """
    path = tokenizer or public_path()
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(_cut_rows(path, size, end_id, cache), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    if order is None:
        shards = max(1, -(-docs.count() // SHARD_PIECES))
        places, dealt = [], pieces.withColumn("shard", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(shards)))
    else:
        at = order.withColumn("shard", F.expr(f"__at div {SHARD_PIECES}"))
        places, dealt = ["__at"], pieces.join(at, pieces["id"].eqNullSafe(at["__id"])).drop("__id")
    out = dealt.groupBy("shard").applyInArrow(_pack_rows(size, places), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long")
    return out.withColumnRenamed("id", id_col)
