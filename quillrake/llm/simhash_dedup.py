"""SimHash near-duplicates: codes linked within a Hamming radius by vantage-point trees (``vantage``), and a stage that
drops near copies, whose links are verified on the sets of shingles.

Equal codes are one node from the start, so copies never meet in a shard; only spanning links leave one.

Documents without words have code zero and link like any other. Null texts count as empty. Rows that repeat an id
are one document. A null id has a code but its component is null. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Forest, byte_slices, components, cut, release
from .vantage import code_links, signed
from .words import BASES, PIECE, Words, mixed

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 15


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded length; bytes.split() splits at exactly x20 and x09-x0D."""
    while data:
        parts = data.split(None, 1 << 16)
        data = parts.pop() if len(parts) > 1 << 16 else b""
        yield parts


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit code: the bits set in over half of the hashes of all shingles, repeats included."""
    digest, counts, n, carry = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, []
    for run in _words((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        words = carry + run
        hashes = [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
        for i in range(0, len(hashes), _CHUNK):
            bits = np.unpackbits(np.frombuffer(b"".join(hashes[i : i + _CHUNK]), np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
        carry = words[max(0, len(words) - shingle + 1) :] if len(words) >= shingle else words
    if not n:
        if not carry:
            return 0
        return int.from_bytes(digest(b" ".join(carry), SEED), "big")
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 1 << 22):
            codes = [signed(simhash(t, shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.int64())], ["id", "code"])

    return run


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id it reaches)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, _ = cut(rows.mapInArrow(_fingerprints(shingle), "id long, code long"), "codes")
    nodes, _ = cut(rows.where("id IS NOT NULL").groupBy("code").agg(F.min("id").alias("node"), F.count("*").alias("n")), "nodes")
    roots = components(code_links(nodes.select("node", "code"), radius), "a", "b")
    known = nodes.join(roots, "node", "left").select("code", F.coalesce("root", "node").alias("component_id"), "n", "node")
    known = known.where("n > 1 OR component_id <> node").select("code", "component_id")
    out = rows.join(known, "code", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


#: Words of a shingle of the stage, and bins of its two sketches: the coarse one has bands, the fine one estimates similarities.
STAGE_SHINGLE, COARSE, FINE = 5, 128, 512
#: Coarse sketches that agree in 0.8 of their bins agree in all bins of some band with a chance of 0.998.
BANDS, BAND_BINS = 21, 6
#: A fine sketch estimates a similarity with a standard error of 0.018 at most; pairs estimated this far below the threshold are not read.
MARGIN = 0.07
#: Members of a band's bucket compared in one group, and members of a larger bucket that every other member is compared with.
#: What this leaves out is found by the shingles of the sets' prefixes, whose buckets are compared whole, in blocks of ``BLOCK``.
BUCKET, REPRESENTATIVES, BLOCK = 512, 8, 1024
#: Documents sampled for shingles that are frequent, and how many of these come last in the order of prefixes, from which count.
SAMPLE, FREQUENT, LEAST_COUNT, SAMPLE_PARTS = 1 << 15, 1 << 17, 4, 16
#: Shingles of all sets for each part that the prefixes' shingles are dealt to; a part is one table of a worker.
PART = 1 << 21
#: Shared shingles before one, by which a pair that has met before is known.
BEFORE = 4
#: Bits of a set that say of how many of its shingles, odd or even, the hash ends so.
PARITY = 4096


def _shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each five-word shingle of the lower-cased texts, in order; of shorter texts the whole sequence."""
    words = Words(texts, lower=True)
    runs = words.runs(STAGE_SHINGLE)
    whole = words.doc[: len(runs)] == words.doc[STAGE_SHINGLE - 1 :]
    short = np.flatnonzero((words.counts > 0) & (words.counts < STAGE_SHINGLE))
    doc = np.concatenate([words.doc[: len(runs)][whole], short])
    h = np.concatenate([runs[whole], words.whole(BASES[1])[short]])
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def _distinct_shingles(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, bool)
    return doc[head], h[head]


def _per_document(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (rows for each shingle, sorted by document) for each of ``n`` documents."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0, dtype=values.dtype)])
    ends = np.searchsorted(doc, np.arange(n), "right")
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def _codes(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each document: bits set in over half of its shingles' hashes, repeats included."""
    sums, times = np.zeros((n, 64), np.int64), np.bincount(doc, minlength=n)
    for at in range(0, len(h), _CHUNK):
        d, part = doc[at : at + _CHUNK], h[at : at + _CHUNK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
        here = slice(int(d[0]), int(d[-1]) + 1)
        sums[here] += _per_document(d - d[0], bits, int(d[-1] - d[0]) + 1)
    return np.packbits(2 * sums > times[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def _sketches(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The coarse and the fine sketch of each set of shingles: a byte of the least hash in each bin; 0 for an empty bin."""
    none = np.uint64(2**64 - 1)
    fine = np.full(n * FINE, none, np.uint64)
    np.minimum.at(fine, doc * FINE + (h % np.uint64(FINE)).astype(np.int64), h)
    fine = fine.reshape(n, FINE)
    coarse = fine.reshape(n, FINE // COARSE, COARSE).min(1)
    return tuple(np.where(x == none, 0, 1 + (x >> np.uint64(20)) % np.uint64(255)).astype(np.uint8) for x in (coarse, fine))


def _dealt(key: np.ndarray, others: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """(part, rows) of the parts of keys: the keys and the ``others`` of each part, one array after the other."""
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    columns = [x[order] for x in (key, *others)]
    used = np.flatnonzero(np.diff(ends, prepend=0))
    rows = [b"".join(x[a:b].tobytes() for x in columns) for a, b in zip((ends[used] - np.diff(ends, prepend=0)[used]).tolist(), ends[used].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(used), pa.array(rows, pa.binary())], ["part", "rows"])


def _gathered(rows: pa.ChunkedArray, types: list[str]) -> list[np.ndarray]:
    """The arrays of ``_dealt`` rows of one part, put together."""
    out, width = [[np.zeros(0, t)] for t in types], sum(np.dtype(t).itemsize for t in types)
    for value in rows:
        data, at = value.as_buffer(), 0
        n = len(data) // width
        for column, t in zip(out, types, strict=True):
            column.append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) for x in out]


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", PIECE):
        yield _dealt(_distinct_shingles(*_shingle_hashes(batch.column("text")))[1], [], SAMPLE_PARTS)
    release()


def _frequent(part: pa.Table) -> pa.Table:
    keys, n = np.unique(_gathered(part.column("rows"), ["u8"])[0], return_counts=True)
    often = n >= LEAST_COUNT
    out = pa.table({"key": pa.array(keys[often].view(np.int64)), "n": pa.array(n[often])})
    del keys, n, often
    release()
    return out


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the most frequent shingles in a sample of ``rows`` (id, text), and their ranks, 1 for the rarest.

    The driver holds ``FREQUENT`` at most. They only order the shingles; with any order the same pairs are found.
    """
    share = min(1.0, SAMPLE / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).mapInArrow(_shingles, "part long, rows binary")
    top = some.groupBy("part").applyInArrow(_frequent, "key long, n long").orderBy(F.desc("n"), "key").limit(FREQUENT)
    keys = top.select("key").toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], len(keys) - order


def _prefixes(doc: np.ndarray, h: np.ndarray, n: int, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, pa.Array]:
    """The size of each of ``n`` sets (rows sorted by document and hash) and its first shingles, rare ones before ``frequent`` ones.

    All sets follow one order. Of two sets x and y with at least ``similarity``, at least similarity * |x| shingles are shared,
    so that one of the first |x| - ceil(similarity * |x|) + 1 is, and the first shared one is so far to the front in both.
    """
    size, (keys, ranks) = np.bincount(doc, minlength=n), frequent
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        rank = np.where(keys[at] == h, ranks[at], 0)
        h = h[np.argsort(doc * (len(keys) + 1) + rank, kind="stable")]
    length = np.minimum(size, size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1)
    place = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return size, pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[place < length[doc]].view(np.int64)))


def _parities(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The size and the parity bits of each set. Two sets differ in as many shingles at least as in bits."""
    out = np.zeros((n, 1 + PARITY // 64), np.uint64)
    out[:, 0] = np.bincount(doc, minlength=n)
    at = h % np.uint64(PARITY)
    np.bitwise_xor.at(out, (doc, 1 + (at // np.uint64(64)).astype(np.int64)), np.uint64(1) << at % np.uint64(64))
    return out


def _features(frequent: tuple[np.ndarray, np.ndarray], similarity: float):
    """Code and sketch of each text, 128 bits of its set of shingles, which tell sets apart, and the set's size, prefix and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", PIECE):
            n = batch.num_rows
            doc, h = _shingle_hashes(batch.column("text"))
            code = _codes(doc, h, n)
            doc, h = _distinct_shingles(doc, h)
            s1, s2 = (_per_document(doc, x, n) for x in (h, mixed(h + np.uint64(SEED))))
            signed64 = [pa.array(x.view(np.int64)) for x in (code, s1, s2)]
            sketches = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in _sketches(doc, h, n)]
            size, prefix = _prefixes(doc, h, n, frequent, similarity)
            parity = pa.array([x.tobytes() for x in _parities(doc, h, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *signed64, *sketches, pa.array(size, pa.int64()), prefix, parity], ["id", "code", "s1", "s2", "coarse", "sketch", "size", "prefix", "parity"])
        release()

    return run


def resemblance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from sketches, row by row; chance agreement of bytes is taken out."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    return np.where(used > 0, (same / np.maximum(used, 1) - 1 / 255) / (1 - 1 / 255), 1.0)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """The keys of the bands of each sketch (a row of bytes, one above zero at least). Empty bins borrow from the next used one."""
    n, size = sketches.shape
    at = np.where(sketches > 0, np.arange(size), 3 * size)
    at = np.minimum.accumulate(np.concatenate([at, at + size], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :size] % size
    bins = (at * 256 + np.take_along_axis(sketches, at, 1)).astype(np.uint64)
    keys = np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BAND_BINS):
        keys = mixed(keys + bins[:, k : BANDS * BAND_BINS : BAND_BINS])
    return keys


def _sketch_rows(column: pa.Array, size: int = FINE) -> np.ndarray:
    sketches = column.cast(pa.binary(size))
    return np.frombuffer(sketches.buffers()[1] or b"", np.uint8)[sketches.offset * size :][: len(sketches) * size].reshape(-1, size)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _sketch_rows(batch.column("coarse"), COARSE)
        used = np.flatnonzero((rows > 0).any(1))  # texts without words are one node
        node = batch.column("node").to_numpy(zero_copy_only=False)[used]
        for i in range(0, len(used), 1024):
            keys = band_keys(rows[used[i : i + 1024]])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(node[i : i + 1024], BANDS))], ["shard", "node"])


def _spanning(rows: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """A forest of greatest estimates over a group, by Prim's way."""
    n, hi, lo = len(rows), [], []
    best, come, left = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n):
        x = int(np.where(left, best, -2.0).argmax())
        if best[x] >= least:
            hi.append(x)
            lo.append(int(come[x]))
        left[x] = False
        estimate = resemblance(rows[x : x + 1], rows)
        better = left & (estimate > best)
        best[better], come[better] = estimate[better], x
    return hi, lo


def _bucket_pairs(least: float):
    """(a, b) to be verified in each group: a spanning forest of the estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                members = batch.column("members").slice(at, 256)
                flat, sizes = members.flatten(), pc.list_value_length(members).to_numpy(zero_copy_only=False)
                node, rows = flat.field("node").to_numpy(zero_copy_only=False), _sketch_rows(flat.field("sketch"))
                starts = (np.cumsum(sizes) - sizes).astype(np.int64)
                twos = starts[sizes == 2]  # most groups; compared at once
                twos = twos[resemblance(rows[twos], rows[twos + 1]) >= least] if len(twos) else twos
                out = [(node[twos], node[twos + 1])]
                for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                    if n > 2:
                        own = slice(start, start + n)
                        i, j = _spanning(rows[own], least)
                        out.append((node[own][i], node[own][j]))
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).astype(np.int64)), pa.array(np.maximum(a, b).astype(np.int64))], ["a", "b"])
        release()

    return run


def band_members(nodes: DataFrame) -> DataFrame:
    """(shard, block, node, sketch) of the groups to compare: nodes whose sketches share a band.

    A bucket of over ``BUCKET`` nodes is dealt out as blocks, each with the bucket's ``REPRESENTATIVES`` in it, so the work is linear in
    its size; pairs that this keeps apart are left to ``apart``. Sketches travel only where a bucket has two.
    """
    keys, _ = cut(nodes.select("node", "coarse").mapInArrow(_banded, "shard long, node long"), "bands")
    full = keys.groupBy("shard").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("all"), F.min("node").alias("least")).where("n > 1")
    full, _ = cut(full.groupBy("n", "all", "least").agg(F.min("shard").alias("shard")).select("shard", "n"), "bands")  # of buckets with equal members one
    members = nodes.select("node", "sketch").join(keys.join(full, "shard"), "node").select("shard", "n", "node", "sketch")
    members, _ = cut(members, "bands")
    parts = F.ceil(F.col("n") / F.lit(BUCKET)).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node", "shard"), parts).cast("int"))
    pick = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("by"), "node", "sketch")) for k in range(REPRESENTATIVES)]
    chosen = members.where(F.col("n") > BUCKET).groupBy("shard").agg(F.max("n").alias("n"), F.array(*pick).alias("x")).select("shard", "n", F.explode(F.array_distinct(F.transform("x", lambda x: F.struct(x.node, x.sketch)))).alias("x"))
    chosen = chosen.select("shard", "n", "x.node", "x.sketch").withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.unionByName(chosen).select("shard", "block", "node", "sketch")


def _candidates(members: DataFrame, least: float) -> DataFrame:
    """``_bucket_pairs`` of the groups of ``members`` (shard, block, node, sketch)."""
    groups = members.groupBy("shard", "block").agg(F.collect_list(F.struct("node", "sketch")).alias("members"))
    return groups.where(F.size("members") > 1).select("members").mapInArrow(_bucket_pairs(least), "a long, b long")


def _posted(parts: int):
    """The shingles of the prefixes, dealt by their hashes, each with (node, node - label, size of the set, place in the prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                prefix = some.column("prefix")
                n = pc.list_value_length(prefix).to_numpy(zero_copy_only=False)
                node, label, size = (some.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "size"))
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                key = prefix.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                yield _dealt(key, [np.repeat(node, n), np.repeat(node - label, n), np.repeat(size, n).astype(np.int32), place.astype(np.int32)], parts)
        release()

    return run


def _shared(part: pa.Table) -> pa.Table:
    """The rows of one part whose shingle occurs under two labels."""
    key, node, away, size, pos = _gathered(part.column("rows"), ["u8", "i8", "i8", "i4", "i4"])
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    n = np.diff(heads, append=len(key))
    label = (node - away)[order]
    two = np.minimum.reduceat(label, heads) < np.maximum.reduceat(label, heads)
    rows = order[np.repeat(two, n)]
    values = key[rows].view(np.int64), node[rows], node[rows] - away[rows], size[rows].astype(np.int64), pos[rows].astype(np.int64)
    out = pa.table([pa.array(x) for x in values], ["key", "node", "label", "size", "pos"])
    del key, node, away, size, pos, order, heads, n, label, rows, values
    release()
    return out


def _partners(similarity: float):
    """(a, b) of all pairs of two labels in each group whose sets, by size and by what follows the shared shingle, can be that similar.

    A pair with a common shingle among the ``BEFORE`` ones before this has met there, where more follows, and is left to that group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                members = batch.column("members").slice(at, 256)
                flat, sizes = members.flatten(), pc.list_value_length(members).to_numpy(zero_copy_only=False)
                node, label, size, pos, part = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "label", "size", "pos", "part"))
                before = [flat.field(f"before{k}").to_numpy(zero_copy_only=False).astype(np.int64) for k in range(BEFORE)]
                group = np.repeat(np.arange(len(sizes)), sizes)
                two = np.repeat(batch.column("two").slice(at, 256).to_numpy(zero_copy_only=False).astype(bool), sizes)
                rest, out, i, k = size - pos, [np.zeros((2, 0), np.int64)], np.arange(len(node)), 0
                while len(i):
                    k += 1  # each member with the one k places on
                    i = i[i + k < len(node)]
                    i = i[group[i] == group[i + k]]
                    j = i + k
                    need = np.ceil(similarity / (1 + similarity) * (size[i] + size[j]) - 1e-6)
                    meet = (label[i] != label[j]) & (np.minimum(rest[i], rest[j]) >= need) & (~two[i] | (part[i] != part[j]))
                    x, y = i[meet], j[meet]
                    met = np.zeros(len(x), bool)
                    for p in before:
                        for q in before:
                            met |= p[x] == q[y]
                    a, b = node[x[~met]], node[y[~met]]
                    out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                a, b = np.unique(np.concatenate(out, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        release()

    return run


def apart(sets: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b), all pairs of ``sets`` (node, label, size, prefix; a size below zero: a node of several sets) of two labels that can be ``similarity`` alike; none is missed.

    Two such sets share a shingle of their prefixes. Shingles under one label need nothing more. Under others each member meets
    each, in blocks of ``BLOCK`` members and pairs of blocks, so no task holds a whole bucket.
    """
    parts = 1 + (sets.agg(F.sum(F.abs("size"))).first()[0] or 0) // PART
    posted = sets.select("node", "label", "size", "prefix").mapInArrow(_posted(parts), "part long, rows binary")
    members, _ = cut(posted.groupBy("part").applyInArrow(_shared, "key long, node long, label long, size long, pos long"), "postings")
    line = Window.partitionBy("node").orderBy("pos")
    before = {f"before{k}": F.when(F.col("size") > 0, F.lag("key", k + 1).over(line)) for k in range(BEFORE)}
    members, _ = cut(members.select("*", *[F.coalesce(x, F.expr("-1 - node")).alias(name) for name, x in before.items()]).withColumn("size", F.abs("size")), "postings")
    full = members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    dealt = members.join(full, "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")]
    groups = dealt.groupBy(*keys).agg(F.collect_list(F.struct("node", "label", "size", "pos", "part", *before)).alias("members"))
    return groups.select("members", (F.col("lo") < F.col("hi")).alias("two")).mapInArrow(_partners(similarity), "a long, b long").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", PIECE):
        doc, h = _distinct_shingles(*_shingle_hashes(batch.column("text")))
        ends = np.searchsorted(doc, np.arange(batch.num_rows), "right")
        sets = [h[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["node", "shingles"])
    release()


def _similar(similarity: float):
    def check(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both)

    return check


def _parity_allows(similarity: float):
    """Whether two sets can be ``similarity`` alike, of their sizes and parity bits; never false for two that are."""

    def check(x: np.ndarray, y: np.ndarray) -> bool:
        return int(np.bitwise_count(x[1:] ^ y[1:]).sum(dtype=np.int64)) <= (1 - similarity) / (1 + similarity) * (int(x[0]) + int(y[0])) + 1e-6

    return check


def _alike(check):
    """The pairs whose sets pass ``check``, of rows sorted by (a, salt, b): the hub's own set comes first, with a null b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for whole in batches:
            for batch in byte_slices([whole], "shingles", 1 << 24):
                hi, lo = [], []
                sets = batch.column("shingles")
                for k, (a, salt, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), strict=True)):
                    x = np.frombuffer(sets[k].as_buffer(), np.uint64)
                    if (a, salt) != hub:
                        hub, own = (a, salt), []
                    if b is None:
                        own.append(x.copy())
                        continue
                    for y in own:  # several only where rows repeat an id
                        if check(x, y):
                            hi.append(b)
                            lo.append(a)
                            break
                yield pa.RecordBatch.from_pydict({"a": pa.array(lo, pa.int64()), "b": pa.array(hi, pa.int64())})
        release()

    return run


def _met(pairs: DataFrame, sets: DataFrame, check, salts: int = 64) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (node, shingles) pass ``check``.

    A set goes to each of its pairs; that of the first document of many pairs goes once to each of their ``salts`` groups.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    hubs = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    others = salted.join(sets, F.col("b") == F.col("node")).select("a", "salt", "b", "shingles")
    met = hubs.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return met.mapInArrow(_alike(check), "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose documents of ``rows`` (id, text) have sets of shingles that similar, exactly.

    Each document of a pair is read once more and its set written.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
    sets, _ = cut(rows.join(ends, rows["id"] == ends["wanted"], "left_semi").mapInArrow(_sets, "node long, shingles binary"), "sets")
    return _met(pairs, sets, _similar(similarity))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(id, component_id) of documents that share a component, by links of sets of five-word shingles of ``similarity`` or more.

    Equal sets are one node. First pairs to verify come from the vantage-point trees over SimHash codes (within ``radius`` bits, and
    equal codes) and from bands of the sketches, which also find pairs whose codes lie too far apart for trees to prune. In each
    bucket a spanning forest of the pairs, best estimates first, is verified on the sets themselves. This joins nearly all that
    belongs together, by exact links only, but neither meets every pair. So then all pairs between different components that can
    reach ``similarity``, by prefixes of the sets (``apart``) and their parity bits, are verified too, and the components are those
    of brute force.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    features = _features(frequent_shingles(rows), similarity)
    known, _ = cut(rows.mapInArrow(features, "id long, code long, s1 long, s2 long, coarse binary, sketch binary, size long, prefix array<long>, parity binary"), "features")
    nodes, _ = cut(known.groupBy("s1", "s2").agg(F.min(F.struct("id", "code", "coarse", "sketch")).alias("x")).select("s1", "s2", F.col("x.id").alias("node"), "x.code", "x.coarse", "x.sketch"), "nodes")
    firsts, _ = cut(nodes.groupBy("code").agg(F.min("node").alias("first"), F.count("*").alias("n")), "firsts")
    equal = nodes.select("code", "node").join(firsts.where("n > 1"), "code").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = code_links(firsts.select(F.col("first").alias("node"), "code"), radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    banded = _candidates(band_members(nodes), similarity - MARGIN)
    pairs, _ = cut(banded.union(equal).union(close).where("a <> b").distinct(), "pairs")
    links, _ = cut(verified(pairs, rows, similarity), "links")
    label, _ = cut(components(links, "a", "b"), "labels")
    named = nodes.join(label, "node", "left").select("s1", "s2", "node", F.coalesce("root", "node").alias("label"))
    moved = known.select("id", "s1", "s2").join(named, ["s1", "s2"]).withColumn("times", F.count("*").over(Window.partitionBy("id")))
    moved = moved.where("id <> node OR label <> node OR times > 1").select("id", "s1", "s2", "label", "times", F.expr("id <> node").alias("copy")).distinct()
    moved, _ = cut(moved, "labels")
    sets = known.join(moved, ["id", "s1", "s2"], "left").where("copy IS NULL OR NOT copy")
    sets = sets.select(F.col("id").alias("node"), F.coalesce("label", "id").alias("label"), F.expr("if(times > 1, -size, size)").alias("size"), "prefix")
    more, _ = cut(apart(sets, similarity).join(pairs, ["a", "b"], "left_anti"), "pairs")
    more, _ = cut(_met(more, known.select(F.col("id").alias("node"), F.col("parity").alias("shingles")), _parity_allows(similarity)).distinct(), "pairs")
    found, _ = cut(verified(more, rows, similarity), "links")
    roots = components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found), "a", "b")
    named = nodes.join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("component_id"))
    return known.select("id", "s1", "s2").join(named, ["s1", "s2"]).where("id <> component_id").select(F.col("id").alias(id_col), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` but for those with a smaller id in their component, all columns unchanged. Null ids stay."""
    gone = near_components(docs, id_col, text_col, similarity).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
