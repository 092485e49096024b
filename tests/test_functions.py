"""Scalar functions at their edges."""

import pytest
from pyspark.sql import functions as F

from quillrake.functions import jsonfn, text, vector
from quillrake.functions.registry import SQL_FUNCTIONS, register_functions
from quillrake.operators.vector_aggs import vector_aggregate


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def failure(spark, col):
    with pytest.raises(Exception, match="different dimensions"):
        one(spark, col)


def test_distances(spark):
    a, b, z = [1.0, 2.0, 0.0], [1.0, 0.0, 2.0], [0.0, 0.0, 0.0]
    r = one(spark, vector.dist_l2(a, b), vector.dist_cosine(a, b), vector.dist_ip(a, b), vector.dist_l1(a, b), vector.dist_hamming(a, b), vector.dist_jaccard(a, b), vector.dist_cosine(a, z), vector.dist_jaccard(z, z), vector.inner_product(a, b))
    assert list(r) == pytest.approx([8**0.5, 0.8, -1, 4, 2, 2 / 3, 1, 0, 1])
    failure(spark, vector.dist_l2([1.0], [1.0, 2.0]))
    null = F.lit(None).cast("array<double>")
    assert list(one(spark, vector.dist_l2(null, a), vector.dist_cosine(F.array(F.lit(1.0), F.lit(None), F.lit(0.0)), a), vector.vector_add(a, null), vector.vector_dims(null))) == [None] * 4


def test_text_vectors_and_empty_ones(spark):
    r = one(spark, vector.dist_l2("[3, 4]", [0.0, 0.0]), vector.vector_norm("[]"), vector.vector_concat("[1]", "[2]"))
    assert list(r) == [5.0, 0.0, [1.0, 2.0]]


def test_shapes(spark):
    nine = [1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 2.0, 5.0]
    r = one(spark, vector.binary_quantize(nine), vector.vector_to_binary(nine), vector.subvector(nine, 7, 9), vector.subvector(nine, 12, 2), vector.l2_normalize([0.0, 0.0]), vector.vector_to_sparse([0.0, 5.0, 0.0]), vector.sparse_to_vector(vector.vector_to_sparse([0.0, 5.0, 0.0])))
    assert list(r) == [[129, 1], [251, 1], [2.0, 5.0], [], [0.0, 0.0], ([1], [5.0], 3), [0.0, 5.0, 0.0]]
    assert list(one(spark, vector.packed_hamming(F.array(F.lit(5)), F.array(F.lit(6))), vector.packed_jaccard(F.array(F.lit(5)), F.array(F.lit(6))))) == [2, pytest.approx(2 / 3)]


def test_sparse_distances_over_different_places(spark):
    a, b = vector.vector_to_sparse([0.0, 2.0, 1.0]), vector.vector_to_sparse([3.0, 2.0, 0.0])
    assert list(one(spark, vector.sparse_inner_product(a, b), vector.sparse_l2(a, b), vector.sparse_cosine(a, vector.vector_to_sparse([0.0, 0.0, 0.0])))) == pytest.approx([4, 10**0.5, 1])


def test_fusion(spark):
    assert list(one(spark, vector.reciprocal_rank_fusion(F.array(F.lit(1), F.lit(None))), vector.hybrid_score(F.lit(1.0), F.lit(3.0), 0.25))) == pytest.approx([1 / 61, 2.5])


def test_aggregates_by_both_ways(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (1, [3.0, 1.0]), (1, None), (2, [2.0, 2.0]), (3, None)], "k int, v array<double>")
    got = {r["k"]: r for r in vector_aggregate(df, "v", ["k"], ("vector_sum", "vector_stddev", "vector_max")).collect()}
    wide = {r["k"]: r for r in vector_aggregate(df, "v", ["k"], ("vector_sum", "vector_stddev", "vector_max", "vector_median")).collect()}
    assert got[1][1:] == ([4.0, 6.0], [1.0, 2.0], [3.0, 5.0]) and got[3][1:] == (None, None, None)
    assert {k: r[1:4] for k, r in wide.items()} == {k: r[1:4] for k, r in got.items()} and wide[1][4] == [2.0, 3.0]
    mixed = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="different dimensions"):
        vector_aggregate(mixed, "v", ["k"]).collect()


JSON = '{"a": {"b": [10, 20, {"c": "x"}]}, "z y": null, "b": 1.5}'


@pytest.mark.parametrize(
    "call, want",
    [
        (lambda j: jsonfn.json_extract_path(j, "a", "b", "2", "c"), '"x"'),
        (lambda j: jsonfn.json_extract_path_text(j, "a", "b", "2", "c"), "x"),
        (lambda j: jsonfn.json_extract_path(j, "a"), '{"b":[10,20,{"c":"x"}]}'),
        (lambda j: jsonfn.json_extract_path(j, "zz"), None),
        (lambda j: jsonfn.json_extract_path(j, "z y"), "null"),
        (lambda j: jsonfn.json_extract_path_text(j, "z y"), None),
        (lambda j: jsonfn.json_extract_path(j, F.lit(None).cast("string")), None),
        (lambda j: jsonfn.json_contains(j, '{"a": {"b": [{"c": "x"}, 10]}}'), True),
        (lambda j: jsonfn.json_contains(j, '{"a": {"b": 11}}'), False),
        (lambda j: jsonfn.json_exists(j, "z y"), True),
        (lambda j: jsonfn.json_exists(j, "c"), False),
        (lambda j: jsonfn.json_path_exists(j, '$."z y"'), True),
        (lambda j: jsonfn.json_path_exists(j, "$.a.b[7]"), False),
        (lambda j: jsonfn.json_path_query(j, "$.a.b[*]"), ["10", "20", '{"c":"x"}']),
        (lambda j: jsonfn.json_path_query(j, "$.*"), ['{"b":[10,20,{"c":"x"}]}', "1.5", "null"]),
        (lambda j: jsonfn.json_path_query(j, "broken"), []),
        (lambda j: jsonfn.json_typeof(j), "object"),
    ],
)
def test_json(spark, call, want):
    assert one(spark, call(F.lit(JSON)))[0] == want


def test_json_of_bad_text_and_null(spark):
    bad, null = F.lit("{oops"), F.lit(None).cast("string")
    assert list(one(spark, jsonfn.json_contains(bad, "1"), jsonfn.json_path_exists(bad, "$"), jsonfn.json_typeof(bad), jsonfn.json_extract_path(bad, "a"), jsonfn.json_path_query(bad, "$"), jsonfn.json_contains(null, "1"))) == [False, False, None, None, [], None]
    assert [one(spark, jsonfn.json_typeof(F.lit(x)))[0] for x in ("null", "true", "1.5", '"s"', "[]")] == ["null", "boolean", "number", "string", "array"]
    assert one(spark, jsonfn.json_contains(F.lit("[1, [2]]"), "1"), jsonfn.json_contains(F.lit("true"), "1"))[:] == (True, False)


def test_text_scores(spark):
    r = one(spark, text.bm25_score(F.lit("The cat, the dog!"), "the THE cat"), text.tf_idf(F.lit("a b a")), text.bm25_score(F.lit(""), "a"), text.bm25_score(F.lit(None).cast("string"), "a"))
    assert r[0] == pytest.approx(2 * (2 * 2.2 / 3.2) + 1.0) and r[1] == pytest.approx([2 / 3, 1 / 3]) and r[2] == 0 and r[3] is None
    t = F.lit("Über-cool, it's 42°!")
    assert list(one(spark, text.tokens(t), text.tokens(t, "english"), text.tokens(t, "whitespace"), text.tokens(t, "identity"))) == [["über", "cool", "it", "s", "42"], ["über", "cool", "s", "42"], ["Über-cool,", "it's", "42°!"], ["Über-cool, it's 42°!"]]


def test_sql_functions_are_the_column_functions(spark):
    names = register_functions(spark)
    assert {n for a in SQL_FUNCTIONS for n in a} <= set(names) and len(names) == len(set(names))
    r = spark.sql("SELECT dist_cosine(array(1, 2), array(2, 1)), l2_normalize(array(3, 4)), bm25_score('The cat', 'cat'), tf_idf('a b a'), reciprocal_rank_fusion(array(1)), json_path_query('[1,2]', '$[*]')").first()
    assert r[0] == pytest.approx(0.2) and r[1] == [0.6, 0.8] and r[2] == pytest.approx(1.0) and r[3] == pytest.approx([2 / 3, 1 / 3]) and r[4] == pytest.approx(1 / 61) and r[5] == ["1", "2"]


def test_knn_join_bounds_before_it_measures(spark):
    """Few pairs are left to measure, and ranks are those of all pairs, with ties, nulls and values that are not finite."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quillrake.functions.vector import METRICS
    from quillrake.operators import retrieval

    r = random.Random(4)
    data = [(i, [float(r.randrange(4)) for _ in range(6)] if i % 9 else [1e8 + i % 5] * 6) for i in range(400)]
    data += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6)]
    df = spark.createDataFrame(data, "id long, x array<double>")
    q = spark.createDataFrame([(i, x) for i, x in data if i % 40 == 0 or i > 399], "q long, v array<double>")
    got = sorted(map(str, retrieval.knn_join(df, "x", "id", q, "v", "q", 7).collect()))
    all_pairs = df.join(q).select("q", "id", METRICS["l2"](F.col("x"), F.col("v")).alias("distance")).where("distance IS NOT NULL")
    want = all_pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where("rank <= 7")
    assert got == sorted(map(str, want.collect()))
    plain = df.where("id < 400").select(F.col("id").alias("__id"), F.col("x").alias("__x")).coalesce(1)
    assert retrieval._near_pairs(plain, q.where("q < 400").select(F.col("q").alias("__q"), F.col("v").alias("__v")), 7).count() < 2 * 400
    with pytest.raises(Exception):
        retrieval.knn_join(df, "x", "id", spark.createDataFrame([(1, [1.0])], "q long, v array<double>"), "v", "q", 2).collect()


def test_postings_are_made_without_a_shuffle(spark):
    from quillrake.operators.fulltext import postings

    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "b é b b"), (5, "a")], "id long, t string").coalesce(1)
    out = postings(df, "id", "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["term"], r["id"], r["tf"], r["dl"], r["positions"]) for r in out.collect())
    assert got == [("a", 1, 2, 3, [0, 2]), ("a", 5, 1, 1, [0]), ("b", 1, 1, 3, [1]), ("b", 4, 3, 4, [0, 2, 3]), ("é", 4, 1, 4, [1])]
