"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats, masked_text, parse
from .exact_dedup import exact_groups
from .language_id import identify_languages
from .lattice_dedup import embedding_links
from .mixing import pfair_schedule
from .packing import pack_documents
from .shared import cut, new_path
from .simhash_dedup import simhash_components
from .substring_dedup import substring_dedup
from .token_files import read_token_files, write_token_files
from .warc import assemble_captures, read_warc_records, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = write_token_files(_table(spark, sf_dir, "documents"), new_path(spark, "tokens"))
    return read_token_files(spark, listed)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = write_warc(_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    records = read_warc_records(spark, listed).withColumns({"payload": F.lit(None).cast("binary"), "block": F.lit(None).cast("binary")})
    main = F.col("response")
    rows = assemble_captures(records).select(F.col("metadata.page_id").alias("page_id"), "record_id", main.payload_bytes.alias("payload_bytes"), main.payload_digest.alias("payload_digest"), main.kind.alias("record_type"), main.refers_to.alias("refers"))
    # Written once: the archives are read once, and joins see the table's size, not that of the list of files.
    rows, _ = cut(rows, "captures")
    named = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    found = rows.where("refers IS NOT NULL").join(named, "refers", "left")
    both = rows.where("refers IS NULL").withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _chat_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        columns = [[x.values.to_numpy(zero_copy_only=False) for x in batch.column(c)] for c in ("token_start", "token_end", "loss_mask")]
        for formatted, starts, ends, mask in zip(batch.column("formatted").to_pylist(), *columns, strict=True):
            turns = parse(formatted)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            loss = masked_text(formatted, starts, ends, mask)
            for held, v in zip(out, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)), strict=True):
                held.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(x) if x else pa.array(x, pa.string() if i in (1, 3) else pa.int64()) for i, x in enumerate(out))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = format_chats(rows.unionByName(more))
    kind = dict(done.dtypes)["conv_id"]
    return done.mapInArrow(_chat_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_schedule(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_lattice": op2_lattice,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_warc": op5_warc,
    "op6_chat": op6_chat,
    "op7_substring": op7_substring,
    "op8_language": op8_language,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
