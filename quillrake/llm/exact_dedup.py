"""Exact deduplication by 128-bit content hash, with the bytes compared inside each hash.

Grouping by (hash, text) compares whole texts. The map side combines first, so each task sends one row for each
distinct text it has seen: a text that a third of all rows share crosses the network once for each task. Only the
groups with several rows are joined back, on (hash, SHA-256), where adaptive execution splits a hot group.

Null texts count as empty. Rows that repeat an id count as further copies. A null id is never kept while its
group has an id. An empty table gives an empty result. Only the two named columns are read; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256. ``keep``: smallest or largest id."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = base.withColumn("h", F.unhex(F.md5("text")))
    same = hashed.groupBy("h", "text").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    same = same.where("group_size > 1").select("h", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
    rows = base.select("id", F.unhex(F.md5("text")).alias("h"), F.sha2("text", 256).alias("sha"))
    out = rows.join(same, ["h", "sha"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select("id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256")).withColumnRenamed("id", id_col)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` but for later copies of a text, all columns unchanged.

    The ids of the rows that go are anti-joined, so rows without copies never leave their place in the plan.
    A row that repeats both id and text of a kept row stays beside it: ids tell rows apart.
    """
    gone = exact_groups(docs, id_col, text_col, keep).where("NOT kept").select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")
