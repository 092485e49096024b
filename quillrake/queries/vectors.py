"""Vector, JSON and text functions; vector aggregates; exact and indexed retrieval."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrake.functions import jsonfn, text, vector
from quillrake.operators import fulltext, retrieval
from quillrake.operators.vector_aggs import vector_aggregate
from quillrake.plans.durable import new_path

from .registry import Register, table

R = Register()

DIM = 64
#: Query vectors of these examples: rounded waves.
PROBE = [round(math.sin(0.7 * i + 0.3), 3) for i in range(DIM)]
SECOND = [round(math.cos(0.4 * i), 3) for i in range(DIM)]


def _lit(v: list[float]) -> str:
    return f"[{', '.join(map(str, v))}]::DOUBLE[]"


def _pairs(v: str, q: str, body: str) -> str:
    return f"list_sum(list_transform(list_zip({v}, {q}), lambda p: {body}))"


E = "embedding::DOUBLE[]"
_DISTANCES = {
    "l2": f"list_distance({E}, {_lit(PROBE)})",
    "cosine": f"greatest(0, list_cosine_distance({E}, {_lit(PROBE)}))",
    "ip": f"-list_inner_product({E}, {_lit(PROBE)})",
    "l1": _pairs(E, _lit(PROBE), "abs(p[1] - p[2])"),
    "hamming": _pairs(f"list_transform({E}, lambda x: round(x, 0))", f"list_transform({_lit(PROBE)}, lambda x: round(x, 0))", "CASE WHEN p[1] <> p[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "jaccard": f"(1 - {_pairs(f'list_transform({E}, lambda x: round(x, 0))', f'list_transform({_lit(PROBE)}, lambda x: round(x, 0))', 'CASE WHEN p[1] > 0 AND p[1] = p[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')} / {_pairs(f'list_transform({E}, lambda x: round(x, 0))', f'list_transform({_lit(PROBE)}, lambda x: round(x, 0))', 'CASE WHEN p[1] > 0 OR p[2] > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')})",
}


@R.add(f"SELECT vec_id, {', '.join(f'round({sql}, 6) AS {name}' for name, sql in _DISTANCES.items())} FROM embeddings")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, whole = F.col("embedding"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, 0))
    rounded = [float(math.floor(abs(x) + 0.5) * (1 if x > 0 else -1)) for x in PROBE]
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", *[F.round(vector.METRICS[m](v, PROBE), 6).alias(m) for m in ("l2", "cosine", "ip", "l1")],
        F.round(vector.dist_hamming(whole, rounded), 6).alias("hamming"), F.round(vector.dist_jaccard(whole, rounded), 6).alias("jaccard"),
    )


@R.add(f"""
    SELECT vec_id, generate_subscripts(v, 1) AS pos, round(unnest(v), 6) AS added, round(unnest(m), 6) AS multiplied, round(unnest(n), 6) AS normalized FROM (
      SELECT vec_id, list_transform(list_zip({E}, {_lit(PROBE)}), lambda p: p[1] + p[2]) AS v, list_transform(list_zip({E}, {_lit(PROBE)}), lambda p: p[1] * p[2]) AS m,
             list_transform({E}, lambda x: x / sqrt(list_inner_product({E}, {E}))) AS n FROM embeddings)""")
def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(vector.vector_add(v, PROBE).alias("a"), vector.vector_mul(v, PROBE).alias("m"), vector.l2_normalize(v).alias("n"))).alias("p", "x"))
    return rows.select("vec_id", (F.col("p") + 1).cast("long").alias("pos"), F.round("x.a", 6).alias("added"), F.round("x.m", 6).alias("multiplied"), F.round("x.n", 6).alias("normalized"))


_BITS = "list_sum(list_transform(range(1, 9), lambda j: CASE WHEN embedding[8 * {} + j] {} 0 THEN 2 ** (j - 1) ELSE 0 END))::BIGINT"


@R.add(f"""
    SELECT vec_id, 64 AS dims, round(sqrt(list_inner_product({E}, {E})), 6) AS norm, {_BITS.format(0, '>')} AS byte0, {_BITS.format(7, '>=')} AS byte7,
           round(list_sum(embedding[3:6]::DOUBLE[]), 6) AS part, len(list_filter(embedding, lambda x: x <> 0)) AS nnz, round(list_sum({E}), 6) AS sparse_sum, 128 AS joined FROM embeddings""")
def vector_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions, norms, quantised bytes, sub-vectors, sparse vectors and back, concatenation."""
    v = F.col("embedding")
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    sparse = vector.vector_to_sparse(v)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", vector.vector_dims(v).alias("dims"), F.round(vector.vector_norm(v), 6).alias("norm"), F.get(vector.binary_quantize(v), F.lit(0)).cast("long").alias("byte0"), F.get(vector.vector_to_binary(v), F.lit(7)).cast("long").alias("byte7"),
        total(vector.subvector(v, 2, 4)).alias("part"), vector.sparse_nnz(sparse).cast("long").alias("nnz"), total(vector.sparse_to_vector(sparse)).alias("sparse_sum"), F.size(vector.vector_concat(v, PROBE)).alias("joined"),
    )


@R.add(f"SELECT vec_id, round(list_inner_product({E}, {_lit(PROBE)}), 6) AS dot, round(list_distance({E}, {_lit(PROBE)}), 6) AS l2, round(list_cosine_distance({E}, {_lit(PROBE)}), 6) AS cosine FROM embeddings")
def sparse_vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = vector.vector_to_sparse(F.col("embedding")), vector.vector_to_sparse(PROBE)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.sparse_inner_product(a, b), 6).alias("dot"), F.round(vector.sparse_l2(a, b), 6).alias("l2"), F.round(vector.sparse_cosine(a, b), 6).alias("cosine"))


@R.add(f"SELECT vec_id, bit_count(xor({_BITS.format(0, '>')}, 170))::BIGINT AS differing FROM embeddings")
def packed_vector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.slice(vector.binary_quantize(F.col("embedding")), 1, 1)
    return table(spark, sf_dir, "embeddings").select("vec_id", vector.packed_hamming(first, F.array(F.lit(170))).alias("differing"))


_AGGS = {"vector_sum": "sum(x)", "vector_avg": "avg(x)", "vector_min": "min(x)", "vector_max": "max(x)", "vector_stddev": "stddev_pop(x)", "vector_median": "median(x)"}


@R.add(f"""
    SELECT label, pos, {', '.join(f'round({sql}, 5) AS {name}' for name, sql in _AGGS.items())}
    FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest({E}) AS x FROM embeddings) GROUP BY ALL""")
def vector_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_aggregate(table(spark, sf_dir, "embeddings"), "embedding", ["label"], tuple(_AGGS))
    return _by_place(out, "label", tuple(_AGGS), 5)


def _by_place(rows: DataFrame, key: str, aggs: tuple[str, ...], digits: int) -> DataFrame:
    flat = rows.select(key, F.posexplode(F.arrays_zip(*aggs)).alias("p", "x"))
    return flat.select(key, (F.col("p") + 1).cast("long").alias("pos"), *[F.round(f"x.{a}", digits).alias(a) for a in aggs])


@R.add(f"SELECT label, pos, round(avg(x), 5) AS centroid FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest({E}) AS x FROM embeddings) GROUP BY ALL")
def vector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_place(vector_aggregate(table(spark, sf_dir, "embeddings"), "embedding", ["label"], ("centroid",), DIM), "label", ("centroid",), 5)


# JSON.
@R.add("SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k, json_extract_string(props, '$.k') AS k_text, json_exists(props, '$.k') AS has_k, json_exists(props, '$.zz') AS has_zz, 'object' AS kind, props = '{\"k\": 7}' AS seven FROM events")
def json_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id", jsonfn.json_extract_path(p, "k").alias("k"), jsonfn.json_extract_path_text(p, "k").alias("k_text"), jsonfn.json_exists(p, "k").alias("has_k"), jsonfn.json_path_exists(p, "$.zz").alias("has_zz"),
        jsonfn.json_typeof(p).alias("kind"), jsonfn.json_contains(p, '{"k": 7}').alias("seven"),
    )


@R.add("""
    SELECT k, path, value FROM (SELECT json_extract_string(props, '$.k')::BIGINT AS k, unnest(['$.a[0]', '$.a[1].b', '$.c']) AS path, unnest([json_extract_string(props, '$.k'), '"x"', '{"d":true,"z":null}']) AS value FROM events)
    GROUP BY ALL""")
def json_paths_of_nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{"c": {"z": null, "d": true}, "a": ['), F.col("k").cast("string"), F.lit(', {"b": "x"}]}'))
    rows = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).distinct().select("k", doc.alias("j"))
    paths = F.explode(F.array(*[F.lit(p) for p in ("$.a[0]", "$.a[1].b", "$.c")])).alias("path")
    return rows.select("k", "j", paths).select("k", "path", F.get(jsonfn.json_path_query(F.col("j"), F.col("path")), F.lit(0)).alias("value"))


# Text.
_TERMS = r"list_filter(list_transform(regexp_split_to_array(lower({}), '\s+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> '')"
_SAID = "the of tion the"


def _tf(term: str) -> str:
    return f"len(list_filter({_TERMS.format('text')}, lambda w: w = '{term}'))"


@R.add("SELECT doc_id, round(" + " + ".join(f"({_tf(t)} * 2.2 / ({_tf(t)} + 1.2))" for t in _SAID.split()) + ", 6) AS score FROM documents WHERE text IS NOT NULL")
def bm25_of_single_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.round(text.bm25_score("text", _SAID), 6).alias("score"))


@R.add(f"SELECT item_id, len(list_distinct({_TERMS.format('text')})) AS terms, round(list_sum(list_transform(list_distinct({_TERMS.format('text')}), lambda t: len(list_filter({_TERMS.format('text')}, lambda w: w = t)) / len({_TERMS.format('text')}))), 6) AS total FROM benchmark")
def tf_idf_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = text.tf_idf("text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(shares).cast("long").alias("terms"), F.round(F.aggregate(shares, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@R.add(f"SELECT doc_id, len({_WORDS}) AS standard, len(list_filter({_WORDS}, lambda w: w NOT IN ({', '.join(repr(w) for w in text.STOP_WORDS)}))) AS english, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS spaced FROM documents WHERE text IS NOT NULL")
def token_counts_by_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda a: F.size(text.tokens("text", a)).cast("long")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", count("standard").alias("standard"), count("english").alias("english"), count("whitespace").alias("spaced"))


# Retrieval.
@R.add(f"SELECT vec_id, round({_DISTANCES['l2']}, 6) AS distance FROM embeddings ORDER BY {_DISTANCES['l2']}, vec_id LIMIT 10")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through SQL with a vector operator."""
    from quillrake.session import Engine

    engine = Engine(spark)
    engine.register("embeddings", table(spark, sf_dir, "embeddings"))
    return engine.sql(f"SELECT vec_id, round(embedding <-> '{PROBE}'::vector, 6) AS distance FROM embeddings ORDER BY embedding <-> '{PROBE}'::vector, vec_id LIMIT 10")


@R.add(f"SELECT vec_id, label, round({_DISTANCES['cosine']}, 6) AS distance FROM embeddings WHERE label IN (1, 3) ORDER BY {_DISTANCES['cosine']}, vec_id LIMIT 10 OFFSET 5")
def knn_filtered_with_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.knn(table(spark, sf_dir, "embeddings"), "embedding", PROBE, 10, "vec_id", "cosine", where="label IN (1, 3)", offset=5)
    return rows.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@R.add(f"SELECT vec_id, round({_DISTANCES['cosine']}, 6) AS distance FROM embeddings WHERE {_DISTANCES['cosine']} <= 0.9")
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.radius_search(table(spark, sf_dir, "embeddings"), "embedding", PROBE, 0.9, "cosine").select("vec_id", F.round("distance", 6).alias("distance"))


@R.add("""
    SELECT q, vec_id, rank, round(d, 6) AS distance FROM (
      SELECT a.vec_id AS q, b.vec_id, list_distance(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), b.vec_id) AS rank
      FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 5""")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows of every hundredth vector, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    out = retrieval.knn_join(e, "embedding", "vec_id", asked, "v", "q", 5)
    return out.select("q", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def _ranked(order: str, where: str = "", n: int = 20) -> str:
    return f"SELECT vec_id, row_number() OVER (ORDER BY {order}, vec_id) AS r FROM embeddings {where} ORDER BY {order}, vec_id LIMIT {n}"


@R.add(f"""
    SELECT vec_id, round(sum(1.0 / (60 + r)), 9) AS rrf_score FROM (SELECT * FROM ({_ranked(_DISTANCES['l2'])}) UNION ALL SELECT * FROM ({_ranked(_DISTANCES['l2'].replace(_lit(PROBE), _lit(SECOND)))}))
    GROUP BY vec_id ORDER BY sum(1.0 / (60 + r)) DESC, vec_id LIMIT 10""")
def multi_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.multi_vector_search(table(spark, sf_dir, "embeddings"), "vec_id", [("embedding", PROBE), ("embedding", SECOND)], 10)
    return rows.select("vec_id", F.round("rrf_score", 9).alias("rrf_score"))


_QUERY = "tion ouen the"
_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _bm25_sql(query: str = _QUERY) -> str:
    terms = query.split()
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(terms)))
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""WITH d AS (SELECT doc_id, len(w) AS dl, {tf} FROM (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL)), s AS (SELECT count(*) AS n, avg(dl) AS av, {dfs} FROM d),
        b AS (SELECT doc_id, {score} AS score FROM d CROSS JOIN s WHERE {hit})"""


@R.add(f"{_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY score DESC, doc_id LIMIT 20")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fulltext.keyword_search(table(spark, sf_dir, "documents"), "doc_id", "text", _QUERY, 20)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@R.add(f"SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS freq FROM (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL) WHERE freq > 0")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.phrase_search(table(spark, sf_dir, "documents"), "doc_id", "text", "of the")


@R.add(f"SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND (w[i + 1] = 'the' OR w[i + 2] = 'the' OR w[i + 3] = 'the'))) AS freq FROM (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL) WHERE freq > 0")
def phrase_search_with_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.phrase_search(table(spark, sf_dir, "documents"), "doc_id", "text", "of the", slop=2)


@R.add(f"SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) GROUP BY term")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fulltext.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@R.add(f"""{_bm25_sql()}, k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b ORDER BY score DESC, doc_id LIMIT 20),
    v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_DISTANCES['l2']}, vec_id) AS r FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY {_DISTANCES['l2']}, vec_id LIMIT 20)
    SELECT id AS doc_id, round(sum(1.0 / (60 + r)), 9) AS rrf_score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = fulltext.bm25(docs, "doc_id", "text", _QUERY)
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    return retrieval.hybrid_search(vectors, "doc_id", "embedding", PROBE, said, 10).select("doc_id", F.round("rrf_score", 9).alias("rrf_score"))


def _cos(v: list[float]) -> str:
    return f"(1 - greatest(0, list_cosine_distance({E}, {_lit(v)})))"


_MEAN = [2 * a - b for a, b in zip(PROBE, SECOND, strict=True)]


@R.add(f"SELECT vec_id, round({_cos(_MEAN)}, 6) AS score FROM embeddings ORDER BY {_cos(_MEAN)} DESC, vec_id LIMIT 10")
def recommend_by_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recommend(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", [PROBE], [SECOND], 10).select("vec_id", F.round("score", 6).alias("score"))


@R.add(f"SELECT vec_id, round({_cos(PROBE)} - {_cos(SECOND)}, 6) AS score FROM embeddings ORDER BY {_cos(PROBE)} - {_cos(SECOND)} DESC, vec_id LIMIT 10")
def recommend_by_best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recommend(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", [PROBE], [SECOND], 10, "best_score").select("vec_id", F.round("score", 6).alias("score"))


@R.add(f"SELECT vec_id, CASE WHEN {_cos(PROBE)} > {_cos(SECOND)} THEN 1 ELSE -1 END AS context, round({_cos(SECOND)}, 6) AS score FROM embeddings ORDER BY context DESC, {_cos(SECOND)} DESC, vec_id LIMIT 10")
def discover_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.discover(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", SECOND, [(PROBE, SECOND)], 10).select("vec_id", "context", F.round("score", 6).alias("score"))


@R.add(f"SELECT vec_id, round({_DISTANCES['l2']}, 6) AS distance FROM embeddings ORDER BY {_DISTANCES['l2']}, vec_id LIMIT 10")
def ivf_search_of_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index never changes an answer: with all cells probed it is the exact search."""
    index = retrieval.IvfIndex.build(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", new_path(spark, "ivf"), cells=8)
    return index.search(spark, PROBE, 10, probes=8).select("vec_id", F.round("distance", 6).alias("distance"))


@R.add()
def ivf_search_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.IvfIndex.build(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", new_path(spark, "ivf"), cells=16)
    return index.search(spark, PROBE, 10, probes=6).select("vec_id", F.round("distance", 6).alias("distance"))
