"""Token files: ids of whole documents in ascending id order, Simple-8b coded in blocks with offsets.

A file holds the documents of one range of ids. Layout, little-endian:
  magic | blocks: words (u64), exceptions (u32) | documents: id (i64), present (u8), tokens (u64)
  | blocks' table: offset (u64), ids (u32), words (u32), exceptions (u32) | n docs, n blocks, offset of documents (u64) | magic
Blocks have ``BLOCK_IDS`` ids but for the last; a document may span blocks, and any block decodes alone.

Null and empty texts have the end id alone. Null ids sort first. Rows that repeat an id are documents of their own,
in order of text. An empty table writes files without documents. Other columns are not read. Ids must be integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import opened, write_part
from .shared import byte_slices
from .simple8b import decode_block, encode_block
from .tokens import encoded, public_path

MAGIC = b"QRS8B001"
BLOCK_IDS = 1 << 17
_TAIL = struct.Struct("<QQQ8s")
_BLOCK = np.dtype([("offset", "<u8"), ("ids", "<u4"), ("words", "<u4"), ("exceptions", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("present", "u1"), ("tokens", "<u8")])


class TokenFileWriter:
    def __init__(self, out) -> None:
        self.out, self.at = out, 0
        self.docs: list[tuple[int, int, int]] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        self.held: list[bytes] = []
        self.held_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append((doc or 0, doc is not None, len(ids) // 4))
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        if self.held_ids >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            part = ids[i : min(i + BLOCK_IDS, whole)]
            words, exceptions = encode_block(part)
            self.blocks.append((self.at, len(part), len(words), len(exceptions)))
            self._put(words.tobytes() + exceptions.tobytes())
        self.held = [ids[whole:].tobytes()]
        self.held_ids = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        place = self.at
        self._put(np.array(self.docs, _DOC).tobytes())
        self._put(np.array(self.blocks, _BLOCK).tobytes())
        self._put(_TAIL.pack(len(self.docs), len(self.blocks), place, MAGIC))


class TokenFile:
    """Random access to the blocks of a file, and its documents in order."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        n_docs, n_blocks, place, magic = _TAIL.unpack(source.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.docs = np.frombuffer(source.read_at(n_docs * _DOC.itemsize, place), _DOC)
        self.blocks = np.frombuffer(source.read_at(n_blocks * _BLOCK.itemsize, place + n_docs * _DOC.itemsize), _BLOCK)

    def block(self, k: int) -> np.ndarray:
        b = self.blocks[k]
        words, exceptions = int(b["words"]), int(b["exceptions"])
        data = self.source.read_at(8 * words + 4 * exceptions, int(b["offset"]))
        return decode_block(np.frombuffer(data, "<u8", words), np.frombuffer(data, "<u4", exceptions, 8 * words), int(b["ids"]))

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """(id, tokens, pieces of its ids); the pieces must be read before the next document."""
        k, data, at = 0, b"", 0

        def pieces(left: int) -> Iterator[bytes]:
            nonlocal k, data, at
            while left:
                if at == len(data):
                    data, at = self.block(k).tobytes(), 0
                    k += 1
                take = min(4 * left, len(data) - at)
                yield data[at : at + take]
                at += take
                left -= take // 4

        for doc, present, n in self.docs.tolist():
            yield (doc if present else None), n, pieces(n)


def _write(folder: str, tokenizer: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        totals = [0, 0]

        def fill(out) -> None:
            writer = TokenFileWriter(out)
            for batch in byte_slices(batches, "text", 1 << 22):
                ids = batch.column("id").to_pylist()
                for i, data in encoded(batch, "text", tokenizer, end):
                    writer.add(ids[i], data)
                    totals[0] += 1
                    totals[1] += len(data) // 4
            writer.close()

        uri = write_part(folder, ".s8b", fill)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "file": [uri], "n_docs": pa.array([totals[0]], pa.int64()), "n_ids": pa.array([totals[1]], pa.int64())})

    return write


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokenizer: str | None = None) -> str:
    """Write ``docs`` as token files; returns the path of the table that lists them (part, file, n_docs, n_ids)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    listed = rows.mapInArrow(_write(folder, tokenizer or public_path(), end_id), "part long, file string, n_docs long, n_ids long")
    listed.write.parquet(f"{folder}/files")
    return f"{folder}/files"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, at in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
            system, path = opened(uri)
            out: tuple[list, list, list, list] = ([], [], [], [])
            with system.open_input_file(path) as source:
                for doc, n, pieces in TokenFile(source).documents():
                    crc = 0
                    for piece in pieces:
                        crc = zlib.crc32(piece, crc)
                    for held, v in zip(out, (doc, at, n, crc), strict=True):
                        held.append(v)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, listed: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(listed)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    files = files.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = files.repartition(max(1, spark.read.parquet(listed).count()))
    return files.select("file", "before").mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
