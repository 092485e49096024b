"""Vector search. Exact by default; an IVF index is opt-in and re-scores its candidates exactly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrake.functions.vector import METRICS, Vector


def knn(df: DataFrame, vector: str, query: Vector, k: int, id_col: str, metric: str = "l2", where: Column | str | None = None, offset: int = 0, radius: float | None = None, score: str = "distance") -> DataFrame:
    """The ``k`` nearest rows after ``offset``, nearest first, ties by id. ``where`` applies before the search.

    The plan is a scan with pushed filters under TakeOrderedAndProject: each task keeps k + offset rows.
    """
    rows = df.where(where) if where is not None else df
    rows = rows.withColumn(score, METRICS[metric](vector, query)).where(F.col(score).isNotNull())
    if radius is not None:
        rows = rows.where(F.col(score) <= radius)
    return rows.orderBy(score, id_col).offset(offset).limit(k) if offset else rows.orderBy(score, id_col).limit(k)


def radius_search(df: DataFrame, vector: str, query: Vector, radius: float, metric: str = "l2", score: str = "distance") -> DataFrame:
    """All rows within ``radius``, in no order."""
    return df.withColumn(score, METRICS[metric](vector, query)).where(F.col(score) <= radius)


MOST_QUERIES = 10_000


def _near_pairs(rows: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """(__q, __v, __id, __x): pairs that can be among the ``k`` nearest by L2, and all pairs with an odd vector.

    Matrix products give each squared distance within a margin; a pair goes if ``k`` rows of its task are nearer for certain.
    Odd are vectors with nulls, values that are not finite or beyond 1e100, and lengths unlike that of most queries.
    """
    asked = q.toArrow()  # at most MOST_QUERIES, which is checked
    vectors = asked.column("__v").to_pylist()
    sizes = [len(v) for v in vectors if v is not None]
    dim = max(set(sizes), key=sizes.count) if sizes else 0
    sound = lambda v: v is not None and len(v) == dim and all(x is not None and abs(x) < 1e100 for x in v)
    even = np.array([i for i, v in enumerate(vectors) if sound(v)], np.int64)
    odd = np.array([i for i, v in enumerate(vectors) if not sound(v)], np.int64)
    m = np.array([vectors[i] for i in even], float).reshape(len(even), dim)
    sent = rows.sparkSession.sparkContext.broadcast((m, even, odd))
    schema = T.StructType([rows.schema["__id"], T.StructField("__x", T.ArrayType(T.DoubleType())), T.StructField("__n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, even, odd = sent.value
        mm = (m * m).sum(1)
        best = np.full((len(m), k), np.inf)  # the smallest upper ends of squared distances so far
        for b in batches:
            x = b.column("__x")
            good = np.array([sound(v) for v in x.to_pylist()], bool)
            at = np.flatnonzero(good)
            a = x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
            aa = (a * a).sum(1)
            pairs = [(np.repeat(np.flatnonzero(~good), len(m) + len(odd)), np.tile(np.concatenate([even, odd]), int((~good).sum()))), (np.repeat(at, len(odd)), np.tile(odd, len(at)))]
            step = max(1, 4_000_000 // max(1, len(at)))
            for i in range(0, len(m) if len(at) else 0, step):
                part = slice(i, i + step)
                both = mm[part, None] + aa[None, :]
                d, margin = both - 2 * (m[part] @ a.T), 1e-14 * (dim + 8) * both
                high = d + margin
                high = high if high.shape[1] <= k else np.partition(high, k - 1, axis=1)[:, :k]
                best[part] = np.sort(np.concatenate([best[part], high], 1), axis=1)[:, :k]
                query, row = np.nonzero(d - margin <= best[part, -1:])
                pairs.append((at[row], even[query + i]))
            for row, query in pairs:
                for j in range(0, len(row), 10_000):
                    take = pa.array(row[j : j + 10_000])
                    yield pa.RecordBatch.from_arrays([b.column("__id").take(take), x.take(take), pa.array(query[j : j + 10_000])], ["__id", "__x", "__n"])

    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    numbered = rows.sparkSession.createDataFrame(asked.append_column("__n", pa.array(range(len(vectors)), pa.int64())), T.StructType([*q.schema.fields, T.StructField("__n", T.LongType())]))
    return spread.mapInArrow(run, schema).join(F.broadcast(numbered), "__n")


def knn_join(df: DataFrame, vector: str, id_col: str, queries: DataFrame, query_vector: str, query_id: str, k: int, metric: str = "l2", score: str = "distance") -> DataFrame:
    """The ``k`` nearest rows of ``df`` for each query vector: (query id, id, distance, rank).

    ``queries`` is a stated set of at most ``MOST_QUERIES`` rows, which is checked; it goes to every task in blocks, and each
    task keeps k rows per query before the shuffle. L2 distances are bounded by matrix products first, and computed for pairs
    that these leave.
    """
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; split them")
    q = queries.select(F.col(query_id).alias("__q"), F.col(query_vector).cast("array<double>").alias("__v"))
    rows = df.select(F.col(id_col).alias("__id"), F.col(vector).cast("array<double>").alias("__x"))
    met = _near_pairs(rows, q, k) if metric == "l2" and k > 0 else rows.join(F.broadcast(q), F.lit(True))
    met = met.select("__q", "__id", METRICS[metric](F.col("__x"), F.col("__v")).alias(score)).where(F.col(score).isNotNull())
    near = Window.partitionBy("__q").orderBy(score, "__id")
    # Spark prunes inside each task first (WindowGroupLimit), so the shuffle holds k rows for each query and task.
    out = met.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    return out.select(F.col("__q").alias(query_id), F.col("__id").alias(id_col), score, "rank")


def rrf(lists: Sequence[DataFrame], id_col: str, k: float = 60, rank: str = "rank", score: str = "rrf_score") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank from 1): sum of 1 / (k + rank) per id."""
    rows = None
    for x in lists:
        part = x.select(F.col(id_col), (1.0 / (F.lit(float(k)) + F.col(rank))).alias("__part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(id_col).agg(F.sum("__part").alias(score))


def ranked(df: DataFrame, score: str, id_col: str, descending: bool = False, rank: str = "rank") -> DataFrame:
    """Number a bounded result list from 1 by score, ties by id."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    return df.withColumn(rank, F.row_number().over(Window.orderBy(order, id_col)))


def multi_vector_search(df: DataFrame, id_col: str, searches: Sequence[tuple[str, Vector]], k: int, metric: str = "l2", candidates: int | None = None, rrf_k: float = 60) -> DataFrame:
    """Several (column, query) searches fused by reciprocal rank; the ``k`` best ids."""
    n = candidates or 2 * k
    lists = [ranked(knn(df, c, q, n, id_col, metric).select(id_col, "distance"), "distance", id_col) for c, q in searches]
    return rrf(lists, id_col, rrf_k).orderBy(F.col("rrf_score").desc(), id_col).limit(k)


def hybrid_search(df: DataFrame, id_col: str, vector: str, query: Vector, keyword: DataFrame, k: int, metric: str = "l2", candidates: int | None = None, rrf_k: float = 60) -> DataFrame:
    """Vector and keyword lists (id, score) of ``candidates`` rows each, fused by reciprocal rank."""
    n = candidates or 2 * k
    near = ranked(knn(df, vector, query, n, id_col, metric).select(id_col, "distance"), "distance", id_col).select(id_col, "rank")
    said = ranked(keyword.orderBy(F.col("score").desc(), id_col).limit(n), "score", id_col, True).select(id_col, "rank")
    return rrf([near, said], id_col, rrf_k).orderBy(F.col("rrf_score").desc(), id_col).limit(k)


def recommend(df: DataFrame, vector: str, id_col: str, positive: Sequence[Sequence[float]], negative: Sequence[Sequence[float]], k: int, strategy: str = "average_vector") -> DataFrame:
    """Rows like the positive and unlike the negative examples, best first, by cosine similarity."""
    pos, neg = np.array(positive, float), np.array(negative, float)
    sim = lambda v: 1 - METRICS["cosine"](vector, [float(x) for x in v])
    if strategy == "average_vector":
        target = pos.mean(0) if not len(neg) else 2 * pos.mean(0) - neg.mean(0)
        score = sim(target)
    elif strategy == "best_score":
        best = F.greatest(*[sim(v) for v in pos]) if len(pos) > 1 else sim(pos[0])
        worst = (F.greatest(*[sim(v) for v in neg]) if len(neg) > 1 else sim(neg[0])) if len(neg) else F.lit(0.0)
        score = best - worst
    else:
        raise ValueError(f"no strategy {strategy!r}")
    return df.withColumn("score", score).orderBy(F.col("score").desc(), id_col).limit(k)


def discover(df: DataFrame, vector: str, id_col: str, target: Sequence[float], pairs: Sequence[tuple[Sequence[float], Sequence[float]]], k: int) -> DataFrame:
    """Rows on the positive side of most context pairs, then by similarity to the target."""
    sim = lambda v: 1 - METRICS["cosine"](vector, [float(x) for x in v])
    side = sum((F.when(sim(p) > sim(n), 1).otherwise(-1) for p, n in pairs), F.lit(0))
    return df.withColumn("context", side).withColumn("score", sim(target)).orderBy(F.col("context").desc(), F.col("score").desc(), id_col).limit(k)


class IvfIndex:
    """Inverted file: k-means cells fitted on a bounded sample, every row indexed, Parquet partitioned by cell.

    A search reads only the ``probes`` nearest cells (partition pruning), scores exactly, and so only its recall can
    differ from the full scan. With ``probes`` equal to the cells it is the full scan.
    """

    SAMPLE_ROWS = 50_000

    def __init__(self, path: str, centroids: np.ndarray, vector: str, id_col: str) -> None:
        self.path, self.centroids, self.vector, self.id_col = path, centroids, vector, id_col

    @classmethod
    def build(cls, df: DataFrame, vector: str, id_col: str, path: str, cells: int = 64, seed: int = 1) -> IvfIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = df.where(F.col(vector).isNotNull())
        total = max(1, rows.count())
        sample = rows if total <= cls.SAMPLE_ROWS else rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(total)) < cls.SAMPLE_ROWS)
        fitted = KMeans(k=cells, seed=seed, maxIter=15).fit(sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")))
        index = cls(path, np.array(fitted.clusterCenters()), vector, id_col)
        index._assigned(rows).write.mode("overwrite").partitionBy("ivf_cell").parquet(path)
        return index

    def _assigned(self, df: DataFrame) -> DataFrame:
        centers = df.sparkSession.sparkContext.broadcast(self.centroids)  # cells x dimensions, set by the caller

        def cell(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), float)
            c = centers.value
            return pd.Series(((c * c).sum(1) - 2 * x @ c.T).argmin(1))

        return df.withColumn("ivf_cell", F.pandas_udf(cell, "int")(F.col(self.vector)))

    def search(self, spark, query: Sequence[float], k: int, probes: int = 8, metric: str = "l2", where: Column | str | None = None) -> DataFrame:
        order = np.argsort(((self.centroids - np.array(query, float)) ** 2).sum(1), kind="stable")[:probes]
        rows = spark.read.parquet(self.path).where(F.col("ivf_cell").isin([int(c) for c in order]))
        return knn(rows, self.vector, list(query), k, self.id_col, metric, where).drop("ivf_cell")
