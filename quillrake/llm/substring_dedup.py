"""Substring deduplication over a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words of one document. Its fingerprint in the index is its minimizer: the least hash
among its runs of ``GRAM`` words. Equal windows have equal minimizers, and a text has about one for every 14 words, so the
index is small and misses nothing. The index (``fingerprint_log``) is a log of immutable sorted runs: each batch becomes a run,
and is merge-joined with the runs before it as it is written. Fingerprints that occur again, in the batch or in history, are
suspects.

Suspects are then verified: documents that hold one are read again, those of earlier calls too, and only windows whose
minimizer is a suspect send 96 bits of two independent hashes of all their words. Each task first combines equal windows of
its own, so a passage in a third of all documents sends a row or so per task. Documents that repeat another's whole word
sequence are settled by a hash of the document and only their first one sends windows.

With a log in a folder of its own, calls are batches of a growing corpus: a window of this call's documents is removed if it also
starts elsewhere in them or in a document of an earlier call, whose texts the log keeps. Documents of earlier calls are not
judged again. Calling again with the name of a batch that the log has gives the same rows and adds nothing.

Words are the runs of characters other than x20 and x09-x0D. Null texts have none. Rows that repeat an id share the
positions removed. A document shorter than a window loses nothing. Whole texts are read, in pieces if very long. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fingerprint_log import FingerprintLog
from .shared import byte_slices, cut
from .words import BASES, PIECE, Words, mixed

WINDOW, GRAM = 35, 8
#: Runs that one call adds to the log; enough for a compaction.
BATCHES = 4
_U = np.uint64


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of grams, minimizer of each window, whether the window lies in one document)."""
    grams = words.runs(GRAM)
    k = len(words.hash) - WINDOW + 1
    if k <= 0:
        return grams, np.zeros(0, _U), np.zeros(0, bool)
    least = grams
    for p in (1, 2, 4, 8):
        least = np.minimum(least[:-p], least[p:])
    reach = WINDOW - GRAM + 1 - 16
    least = np.minimum(least[:-reach], least[reach:])
    return grams, least, words.doc[:k] == words.doc[WINDOW - 1 :]


def _anchors(grams: np.ndarray, least: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Places of the grams that are the minimizer of some window of one document."""
    if not len(least):
        return np.zeros(0, np.int64)
    span = WINDOW - GRAM
    most = np.concatenate([np.zeros(span, _U), np.where(inside, least, _U(0)), np.zeros(span, _U)])
    for p in (1, 2, 4, 8):
        most = np.maximum(most[:-p], most[p:])
    reach = span + 1 - 16
    most = np.maximum(most[:-reach], most[reach:])
    return np.flatnonzero((most == grams) & (grams > 0))


def _distinct(doc: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each fingerprint of a document once, with 1 or 2 for how often (2 or more) the document has it."""
    order = np.lexsort((prints, doc))
    doc, prints = doc[order], prints[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[head], prints[head], np.minimum(np.diff(np.append(head, len(doc))), 2).astype(np.int8)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", PIECE):
        words = Words(batch.column("text"))
        grams, least, inside = _windows(words)
        places = _anchors(grams, least, inside)
        doc, prints, times = _distinct(words.doc[places], grams[places])
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (prints.view(np.int64), times)]
        signed = [pa.array(words.whole(b).view(np.int64)) for b in BASES]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words.counts), *signed, *lists], ["id", "n_words", "h1", "h2", "anchors", "times"])


_SENT = 1 << 18


def _combined(ids: list[pa.Array], parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct window, and the places of windows that repeat within these parts as further rows."""
    if not parts:
        return
    h1, h2, doc, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, doc, h2, h1))
    h1, h2, doc, at, n = h1[order], h2[order], doc[order], at[order], n[order]
    head = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, bool)
    group = np.cumsum(head) - 1
    total = np.bincount(group, weights=n).astype(np.int64)
    rest = np.flatnonzero(~head)
    salt = mixed(doc[rest].astype(_U) * _U(0x9E3779B97F4A7C15) + at[rest].astype(_U))  # spread out, never met by a window
    out1 = np.concatenate([h1[head], salt.view(np.int64)])
    out2 = np.concatenate([h2[head], np.full(len(rest), -1, np.int32)])
    rows = np.concatenate([np.flatnonzero(head), rest])
    count = np.concatenate([total, np.full(len(rest), 2, np.int64)])
    names = pa.concat_arrays(ids).take(pa.array(doc[rows]))
    yield pa.RecordBatch.from_arrays([pa.array(out1), pa.array(out2), names, pa.array(at[rows].astype(np.int32)), pa.array(np.minimum(count, 2).astype(np.int8))], ["w1", "w2", "id", "at", "n"])


def _suspect_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[pa.Array] = []
    parts: list[tuple[np.ndarray, ...]] = []
    docs = held = 0
    for batch in byte_slices(batches, "text", PIECE):
        words = Words(batch.column("text"))
        _, least, inside = _windows(words)
        suspects = pa.array(batch.column("suspects")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        mine = np.flatnonzero(inside & np.isin(least.view(np.int64), suspects))
        w1, w2 = (words.runs(WINDOW, b)[mine] for b in BASES)
        doc = words.doc[mine]
        twice, past = (np.array(batch.column(c).to_pylist(), bool) for c in ("twice", "past"))
        at = np.where(past[doc], -1, mine - words.first[doc])  # windows of history count and have no place
        parts.append((w1.view(np.int64), ((w2 >> _U(33)).astype(np.int32)), doc + docs, at, 1 + twice[doc].astype(np.int64)))
        ids.append(batch.column("id"))
        docs += batch.num_rows
        held += len(mine)
        if held >= _SENT:
            yield from _combined(ids, parts)
            ids, parts, docs, held = [], [], 0, 0
    yield from _combined(ids, parts)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", 1 << 22):
        n_words, n_removed, digest = [], [], []
        for text, starts, all_of in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), batch.column("all_of").to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n = len(words)
            if all_of and n >= WINDOW:
                words, gone = [], n
            elif starts:
                change = np.zeros(n + 1, np.int64)
                s = np.unique(np.array(starts))
                s = s[s + WINDOW <= n]
                change[s] += 1
                change[s + WINDOW] -= 1
                cover = np.cumsum(change[:-1]) > 0
                gone = int(cover.sum())
                words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
            else:
                gone = 0
            n_words.append(n)
            n_removed.append(gone)
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])


_PRINTS = "id long, n_words long, h1 long, h2 long, anchors array<long>, times array<byte>"


def _holders(prints: DataFrame, suspects: DataFrame) -> DataFrame:
    """(wanted, twice, suspects) of the documents of ``prints`` that hold a suspect."""
    found = prints.select("id", "twice", F.explode("anchors").alias("fingerprint")).join(suspects, "fingerprint", "left_semi")
    return found.groupBy("id").agg(F.collect_set("fingerprint").alias("suspects"), F.max("twice").alias("twice")).withColumnRenamed("id", "wanted")


def _history(log: FingerprintLog, name: str, suspects: DataFrame) -> list[DataFrame]:
    """The documents of other batches of the log that hold a suspect; of equal word sequences in a batch one."""
    out = []
    for batch in log.batches:
        if batch["name"] == name:
            continue
        prints = log.spark.read.schema(_PRINTS).parquet(f"{batch['path']}/prints")
        prints = prints.groupBy("h1", "h2").agg(F.min(F.struct("id", "anchors")).alias("x")).select("x.*", F.lit(False).alias("twice"))
        wanted = _holders(prints, suspects)
        texts = log.spark.read.schema("id long, text string").parquet(f"{batch['path']}/texts")
        out.append(texts.join(wanted, F.col("id").eqNullSafe(F.col("wanted"))).select("id", "text", "suspects", "twice", F.lit(True).alias("past")))
    return out


def repeated_windows(docs: DataFrame, log: FingerprintLog | None = None, batch: str | None = None, batches: int = BATCHES) -> DataFrame:
    """(id, starts, all_of) of the documents (id, text) with windows that also start elsewhere in ``docs`` or in the log's history.

    ``starts`` are word positions; ``all_of`` marks documents whose whole word sequence occurs in another row.
    """
    spark = docs.sparkSession
    kept, name = log is not None, batch or uuid.uuid4().hex
    log = log or FingerprintLog(spark)
    path = log.new_batch()
    docs.mapInArrow(_fingerprints, _PRINTS).write.parquet(f"{path}/prints")
    prints = spark.read.schema(_PRINTS).parquet(f"{path}/prints")
    if kept:
        docs.write.parquet(f"{path}/texts")
    log.size_for(prints)
    suspects = None
    for b in range(batches):
        again = log.append(prints.where(F.pmod(F.xxhash64("h1", "id"), F.lit(batches)) == b))
        suspects = again if suspects is None else suspects.union(again)
    suspects = suspects.distinct()
    if kept:
        log.publish(name, path)
    long = prints.where(F.col("n_words") >= WINDOW)
    same, _ = cut(long.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "same")
    marked = prints.join(same, ["h1", "h2"], "left").select("id", "anchors", "n_words", F.col("rows").isNotNull().alias("twice"), (F.col("rows").isNull() | F.col("id").eqNullSafe(F.col("rep"))).alias("sends"))
    wanted = _holders(marked.where("sends"), suspects)
    met = docs.join(wanted, F.col("id").eqNullSafe(F.col("wanted"))).select("id", "text", "suspects", "twice", F.lit(False).alias("past"))
    for old in _history(log, name, suspects) if kept else []:
        met = met.unionByName(old)
    windows = met.mapInArrow(_suspect_windows, "w1 long, w2 int, id long, at int, n byte")
    total = F.sum("n").over(Window.partitionBy("w1", "w2"))
    starts = windows.withColumn("total", total).where("total > 1 AND at >= 0").groupBy("id").agg(F.collect_list("at").alias("starts")).withColumn("all_of", F.lit(False))
    whole = marked.where("twice").select("id", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("all_of")).distinct()
    both = starts.unionByName(whole).groupBy("id").agg(F.max("starts").alias("starts"), F.max("all_of").alias("all_of"))
    return both


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", log: FingerprintLog | None = None, batch: str | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256. With a ``log``, ``docs`` are its next batch."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gone = repeated_windows(rows, log, batch, batches).withColumnRenamed("id", "gone")
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left").select("id", "text", "starts", "all_of")
    return out.mapInArrow(_kept, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)
