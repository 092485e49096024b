"""Full-text search: postings, BM25 with statistics of the whole corpus, phrases."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrake.functions.text import let, tokens

K1, B = 1.2, 0.75


def postings(df: DataFrame, id_col: str, text_col: str, analyzer: str = "standard") -> DataFrame:
    """(term, id, tf, positions, dl): an inverted index as a table; write it to keep it.

    The postings of a text are made where it lies, with no shuffle of words.
    """
    words = df.select(F.col(id_col).alias("id"), tokens(text_col, analyzer).alias("words"))
    schema = T.StructType([T.StructField("term", T.StringType()), words.schema["id"], T.StructField("dl", T.IntegerType()), T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 100):  # a text may be long
                b = batch.slice(first, 100)
                lists = b.column("words")
                length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                if not len(coded):
                    continue
                doc = np.repeat(np.arange(len(length)), length)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
                code = coded.indices.to_numpy(zero_copy_only=False)
                order = np.lexsort((place, doc, code))
                code, doc, place = code[order], doc[order], place[order]
                head = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))
                ends = np.append(head, len(code))
                positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
                cols = [coded.dictionary.take(pa.array(code[head])).cast(pa.string()), b.column("id").take(pa.array(doc[head])), pa.array(length[doc[head]], pa.int32()), pa.array(np.diff(ends), pa.int64()), positions]
                yield pa.RecordBatch.from_arrays(cols, ["term", "id", "dl", "tf", "positions"])

    return words.mapInArrow(run, schema)


def _query_terms(df: DataFrame, query: str, analyzer: str) -> list[str]:
    row = df.sparkSession.range(1).select(tokens(F.lit(query), analyzer).alias("t")).first()
    return row["t"] or []


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda w: w == term


def bm25(df: DataFrame, id_col: str, text_col: str, query: str, analyzer: str = "standard", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of the documents with a query term. Term frequencies are counted in the scan, without exploding words.

    Document frequencies and lengths are one aggregate over the corpus: a single row, which is joined back.
    """
    terms = list(dict.fromkeys(_query_terms(df, query, analyzer)))
    if not terms:
        return df.select(F.col(id_col), F.lit(0.0).alias("score")).where(F.lit(False))
    named = [f"__tf{i}" for i in range(len(terms))]

    def counted(words: Column) -> Column:
        return F.struct(F.size(words).alias("__dl"), *[F.size(F.filter(words, _equals(t))).alias(n) for t, n in zip(terms, named, strict=True)])

    # Bound once: a plain reference to the words would tokenise the text again for each count.
    docs = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), let(tokens(text_col, analyzer), counted).alias("__c")).select(F.col(id_col), *[F.col(f"__c.{n}").alias(n) for n in ("__dl", *named)])
    stats = docs.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(terms))])
    rows = docs.where(sum(F.col(f"__tf{i}") for i in range(len(terms))) > 0).crossJoin(F.broadcast(stats))  # one row
    norm = 1 - b + b * F.col("__dl") / F.col("__avg")
    part = lambda i: F.log((F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5) + 1) * F.col(f"__tf{i}") * (k1 + 1) / (F.col(f"__tf{i}") + k1 * norm)
    return rows.select(F.col(id_col), sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def corpus_statistics(df: DataFrame, text_col: str, analyzer: str = "standard") -> dict[str, float]:
    """Documents and their mean length in words; null texts are none."""
    r = df.where(F.col(text_col).isNotNull()).agg(F.count("*"), F.avg(F.size(tokens(text_col, analyzer)))).first()
    return {"docs": r[0], "mean_length": r[1] or 0.0}


def _of_terms(postings: DataFrame, query: str, analyzer: str) -> tuple[DataFrame, list[str]]:
    terms = list(dict.fromkeys(_query_terms(postings, query, analyzer)))
    return postings.where(F.col("term").isin(*terms)) if terms else postings.limit(0), terms


def bm25_of_postings(postings: DataFrame, statistics: Mapping, id_col: str, query: str, analyzer: str = "standard", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) from the postings of the query's terms alone; ``statistics`` are ``corpus_statistics``.

    The scan reads the row groups of those terms, since postings are sorted by term.
    """
    found, _ = _of_terms(postings.select("term", "id", "tf", "dl"), query, analyzer)
    df = found.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    norm = 1 - b + b * F.col("dl") / F.lit(float(statistics["mean_length"]) or 1.0)
    idf = F.log((F.lit(int(statistics["docs"])) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    scored = found.join(F.broadcast(df), "term").withColumn("part", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm))
    return scored.groupBy(F.col("id").alias(id_col)).agg(F.sum("part").alias("score"))


def documents_of_terms(postings: DataFrame, id_col: str, query: str, analyzer: str = "standard") -> DataFrame:
    """The ids of documents that hold every term of the query."""
    found, terms = _of_terms(postings.select("term", "id"), query, analyzer)
    return found.groupBy(F.col("id").alias(id_col)).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select(id_col)


def keyword_search(df: DataFrame, id_col: str, text_col: str, query: str, k: int, analyzer: str = "standard") -> DataFrame:
    return bm25(df, id_col, text_col, query, analyzer).orderBy(F.col("score").desc(), id_col).limit(k)


def phrase_search(df: DataFrame, id_col: str, text_col: str, phrase: str, slop: int = 0, analyzer: str = "standard") -> DataFrame:
    """(id, freq): documents with the terms in order, with at most ``slop`` other words in between; freq counts starts."""
    terms = _query_terms(df, phrase, analyzer)
    words = df.select(F.col(id_col), tokens(text_col, analyzer).alias("__w"))
    if not terms:
        return words.select(id_col, F.lit(0).cast("long").alias("freq")).where(F.lit(False))
    if slop == 0:

        def starts(ws: Column) -> Column:
            def here(w: Column, i: Column) -> Column:
                hit = w == terms[0]
                for k, t in enumerate(terms[1:], 1):
                    hit = hit & (F.get(ws, i + k) == t)
                return F.coalesce(hit, F.lit(False))

            return F.size(F.filter(ws, here))
    else:

        def starts(ws: Column) -> Column:
            def places(t: str) -> Column:
                return F.filter(F.transform(ws, lambda w, i: F.when(w == t, i)), lambda i: i.isNotNull())

            def follow(hits: Column, t: str) -> Column:  # the nearest next place of each term leaves the most room for the rest
                def next_place(after: Column) -> Column:
                    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.array_min(F.filter(after, lambda p: p > h["last"])).alias("last")))

                return let(places(t), next_place)

            hits = F.transform(places(terms[0]), lambda p: F.struct(p.alias("start"), p.alias("last")))
            for t in terms[1:]:
                hits = follow(hits, t)
            return F.size(F.filter(hits, lambda h: h["last"].isNotNull() & (h["last"] - h["start"] - (len(terms) - 1) <= slop)))

    return words.select(id_col, let(F.col("__w"), starts).cast("long").alias("freq")).where("freq > 0")


def highlight(column, query_terms: list[str], before: str = "<em>", after: str = "</em>"):
    """The text with each query term between marks."""
    terms = "|".join(rf"\Q{t}\E" for t in query_terms)
    return F.regexp_replace(column, rf"(?iu)(?<![\p{{L}}\p{{N}}])({terms})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}")
