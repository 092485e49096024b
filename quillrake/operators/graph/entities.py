"""Entities of a graph: lookup by name or id, equivalence classes, and communities whose names stay the same."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import edge_table
from .groups import connected_components, leiden, louvain

RELATION_NAMES = ("relation", "predicate", "type", "rel", "edge_type")


def find_entities(nodes: DataFrame, query: str, limit: int = 10, text_col: str = "title", id_col: str = "id") -> DataFrame:
    """(id, name) of names that contain the text in any case: whole names first, then by length and id."""
    name = F.col(text_col)
    hits = nodes.select(id_col, text_col).where(F.lower(name).contains(query.lower()))
    return hits.orderBy((F.lower(name) == query.lower()).desc(), F.length(name), id_col).limit(limit)


def lookup_entities(nodes: DataFrame, ids: Sequence[int], text_col: str = "title", id_col: str = "id") -> DataFrame:
    """(id, name) of the ids that there are."""
    return nodes.select(id_col, text_col).where(F.col(id_col).isin(*[int(i) for i in ids]) if ids else F.lit(False))


def resolve_entities(edges: DataFrame, relation: str = "same_as", relation_col: str | None = None, mode: str = "auto") -> DataFrame:
    """(node, canonical): the smallest node that ``relation`` edges join it with, over any number of steps."""
    column = relation_col or next((c for c in RELATION_NAMES if c in edges.columns), None)
    same = edges.where(F.col(column) == relation) if column else edges
    return connected_components(edge_table(same), mode).withColumnRenamed("component", "canonical")


def update_communities(edges: DataFrame, previous: DataFrame | None = None, resolution: float = 1.0, algorithm: str = "leiden") -> DataFrame:
    """(node, community): communities keep their name in ``previous`` (node, community) where most of their old members are.

    Each old name goes to the new community that shares the most nodes with it, the smaller of a tie, and only once;
    the other communities get numbers above all names used before.
    """
    now = (leiden if algorithm == "leiden" else louvain)(edges, resolution=resolution)
    if previous is None:
        return now
    shared = now.join(previous.select("node", F.col("community").alias("old")), "node").groupBy("community", "old").agg(F.count("*").alias("n"))
    by_old = Window.partitionBy("old").orderBy(F.col("n").desc(), "community")
    by_new = Window.partitionBy("community").orderBy(F.col("n").desc(), "old")
    kept = shared.withColumn("a", F.row_number().over(by_old)).withColumn("b", F.row_number().over(by_new)).where("a = 1 AND b = 1").select("community", "old")
    fresh = now.select("community").distinct().join(kept, "community", "left_anti")
    most = previous.agg(F.coalesce(F.max("community"), F.lit(-1))).first()[0]
    numbered = fresh.withColumn("old", F.lit(most) + F.row_number().over(Window.orderBy("community")))  # a row for each new community
    return now.join(kept.unionByName(numbered), "community").select("node", F.col("old").cast("long").alias("community"))


def extract_graph(docs: DataFrame, id_col: str, text_col: str, extract: Callable[[str], Iterable[tuple[str, str, str]]]) -> DataFrame:
    """(id, subject, relation, object) that ``extract`` finds in each text; it runs in the tasks, a batch of texts at a time."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            rows = [(i, *triple) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for triple in extract(t)]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, pa.string()) for c in cols[1:])], ["id", "subject", "relation", "object"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, subject string, relation string, object string")


def graph_of_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, title; edges: source, target, relation, weight) of (subject, relation, object).

    An id is a hash of the lower-cased name, so it is the same in every batch; weights count triples.
    """
    key = lambda c: F.xxhash64(F.lower(F.trim(c)))
    names = triples.select(F.explode(F.array("subject", "object")).alias("title")).where("title IS NOT NULL")
    nodes = names.groupBy(key(F.col("title")).alias("id")).agg(F.min("title").alias("title"))
    ends = triples.where("subject IS NOT NULL AND object IS NOT NULL")
    edges = ends.groupBy(key(F.col("subject")).alias("source"), key(F.col("object")).alias("target"), "relation").agg(F.count("*").cast("double").alias("weight"))
    return nodes, edges


