"""Queries of the declarative DSL: every filter clause and every aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrake.operators import dsl

from .registry import Register, table

R = Register()

#: Name to (table, key, query, SQL condition).
FILTERS = {
    "match_all": ("part", "p_partkey", {"match_all": {}}, "true"),
    "term": ("part", "p_partkey", {"term": {"p_brand": "Brand#7"}}, "p_brand = 'Brand#7'"),
    "terms": ("part", "p_partkey", {"terms": {"p_size": [1, 5, 9]}}, "p_size IN (1, 5, 9)"),
    "range": ("part", "p_partkey", {"range": {"p_retailprice": {"gte": 950, "lt": 1000}}}, "p_retailprice >= 950 AND p_retailprice < 1000"),
    "exists": ("documents", "doc_id", {"exists": {"field": "text"}}, "text IS NOT NULL"),
    "prefix": ("part", "p_partkey", {"prefix": {"p_name": "red"}}, "starts_with(p_name, 'red')"),
    "wildcard": ("part", "p_partkey", {"wildcard": {"p_name": "*d?e*"}}, "p_name LIKE '%d_e%'"),
    "regexp": ("part", "p_partkey", {"regexp": {"p_brand": "Brand#1[0-5]"}}, "regexp_full_match(p_brand, 'Brand#1[0-5]')"),
    "fuzzy": ("part", "p_partkey", {"fuzzy": {"p_type": {"value": "ECONOMI", "fuzziness": 2, "prefix_length": 1}}}, "starts_with(p_type, 'E') AND levenshtein(p_type, 'ECONOMI') <= 2"),
    "ids": ("part", "p_partkey", {"ids": {"values": [3, 5, 8]}}, "p_partkey IN (3, 5, 8)"),
    "bool": ("part", "p_partkey", {"bool": {"must": [{"range": {"p_size": {"gt": 10}}}], "filter": {"term": {"p_type": "ECONOMY"}}, "should": [{"prefix": {"p_name": "red"}}, {"prefix": {"p_name": "small"}}], "must_not": [{"term": {"p_brand": "Brand#7"}}]}}, "p_size > 10 AND p_type = 'ECONOMY' AND (starts_with(p_name, 'red') OR starts_with(p_name, 'small')) AND p_brand <> 'Brand#7'"),
    "minimum_should_match": ("part", "p_partkey", {"bool": {"should": [{"range": {"p_size": {"gt": 20}}}, {"prefix": {"p_name": "red"}}, {"term": {"p_type": "ECONOMY"}}], "minimum_should_match": 2}}, "(p_size > 20)::INT + starts_with(p_name, 'red')::INT + (p_type = 'ECONOMY')::INT >= 2"),
    "match": ("documents", "doc_id", {"match": {"text": "Eanenan thexyz"}}, "contains(lower(text), 'eanenan') OR contains(lower(text), 'thexyz')"),
    "match_phrase": ("documents", "doc_id", {"match_phrase": {"text": "of the"}}, "contains(lower(text), 'of the')"),
    "multi_match": ("part", "p_partkey", {"multi_match": {"query": "red econ", "fields": ["p_name", "p_type^2"]}}, "contains(lower(p_name), 'red') OR contains(lower(p_name), 'econ') OR contains(lower(p_type), 'red') OR contains(lower(p_type), 'econ')"),
    "query_string": ("part", "p_partkey", {"query_string": {"query": "(p_name:red* OR p_name:small*) AND p_size:[5 TO 20] NOT p_brand:\"Brand#7\""}}, "(p_name LIKE 'red%' OR p_name LIKE 'small%') AND p_size BETWEEN 5 AND 20 AND NOT contains(lower(p_brand), 'brand#7')"),
    "simple_query_string": ("part", "p_partkey", {"simple_query_string": {"query": "+widget -red", "fields": ["p_name"]}}, "contains(lower(p_name), 'widget') AND NOT contains(lower(p_name), 'red')"),
}


def _filter_query(name: str):
    source, key, query, _ = FILTERS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).where(dsl.to_filter(query, key)).select(key)

    run.__name__ = f"dsl_filter_{name}"
    return run


for _name, (_source, _key, _, _where) in FILTERS.items():
    R.add(f"SELECT {_key} FROM {_source} WHERE {_where}")(_filter_query(_name))


@R.add("SELECT o_orderkey, total FROM (SELECT o_orderkey, o_custkey, o_totalprice AS total FROM orders) WHERE o_custkey >= 100 AND o_custkey < 120 AND total > 200000")
def dsl_filter_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("who"), F.col("o_totalprice").alias("total")).alias("sale"))
    query = {"nested": {"path": "sale", "query": {"bool": {"must": [{"range": {"who": {"gte": 100, "lt": 120}}}, {"range": {"sale.total": {"gt": 200000}}}]}}}}
    return rows.where(dsl.to_filter(query)).select("o_orderkey", F.col("sale.total").alias("total"))


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 3")
def dsl_search_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = {"query": {"term": {"o_orderstatus": "F"}}, "sort": [{"o_totalprice": "desc"}], "from": 3, "size": 7, "_source": ["o_orderkey", "o_totalprice"]}
    return dsl.search(table(spark, sf_dir, "orders"), request, "o_orderkey")


@R.add("SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 25")
def dsl_search_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.search(table(spark, sf_dir, "orders"), {"search_after": 100, "size": 25, "_source": "o_orderkey"}, "o_orderkey")


def _agg(name: str, source: str, aggs: dict, oracle: str, finish, wanted: str = "a"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(dsl.aggregate(table(spark, sf_dir, source), aggs)[wanted])

    run.__name__ = f"dsl_agg_{name}"
    R.add(oracle)(run)


def _same(df: DataFrame) -> DataFrame:
    return df


def _rounded(digits: int, *keep: str):
    return lambda df: df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


_agg("terms", "part", {"a": {"terms": {"field": "p_brand", "size": 5}}}, "SELECT p_brand AS key, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", _same)
_agg("terms_with_metrics", "orders", {"a": {"terms": {"field": "o_orderpriority"}, "aggs": {"total": {"sum": {"field": "o_totalprice"}}, "who": {"cardinality": {"field": "o_custkey"}}}}}, "SELECT o_orderpriority AS key, count(*) AS doc_count, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS who FROM orders GROUP BY 1", lambda df: df.withColumn("total", F.round("total", 2)))
_agg("terms_of_terms", "orders", {"a": {"terms": {"field": "o_orderpriority"}, "aggs": {"b": {"terms": {"field": "o_orderstatus"}}}}}, "SELECT o_orderpriority AS a_key, o_orderstatus AS key, count(*) AS doc_count FROM orders GROUP BY 1, 2", _same, "a.b")
_agg("histogram", "part", {"a": {"histogram": {"field": "p_retailprice", "interval": 50}}}, "SELECT floor(p_retailprice / 50.0) * 50.0::DOUBLE AS key, count(*) AS doc_count FROM part GROUP BY 1", lambda df: df.withColumn("key", F.col("key").cast("double")))
_agg("date_histogram", "events", {"a": {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": {"v": {"avg": {"field": "value"}}}}}, "SELECT date_trunc('day', ts)::TIMESTAMP AS key, count(*) AS doc_count, round(avg(value), 6) AS v FROM events GROUP BY 1", lambda df: df.withColumns({"v": F.round("v", 6), "key": F.col("key").cast("timestamp_ntz")}))
_agg("range", "events", {"a": {"range": {"field": "value", "ranges": [{"to": 5}, {"from": 5, "to": 20}, {"from": 10}]}}}, "SELECT '*-5' AS key, count(*) AS doc_count FROM events WHERE value < 5 UNION ALL SELECT '5-20', count(*) FROM events WHERE value >= 5 AND value < 20 UNION ALL SELECT '10-*', count(*) FROM events WHERE value >= 10", _same)
_agg("filter", "events", {"a": {"filter": {"term": {"event_type": "click"}}, "aggs": {"m": {"max": {"field": "value"}}}}}, "SELECT count(*) AS doc_count, max(value) AS m FROM events WHERE event_type = 'click'", _same)
_agg("missing", "documents", {"a": {"missing": {"field": "text"}}}, "SELECT count(*) AS doc_count FROM documents WHERE text IS NULL", _same)
_agg("metrics", "part", {"mean": {"avg": {"field": "p_retailprice"}}, "total": {"sum": {"field": "p_size"}}, "least": {"min": {"field": "p_size"}}, "most": {"max": {"field": "p_size"}}, "n": {"value_count": {"field": "p_size"}}, "brands": {"cardinality": {"field": "p_brand"}}}, "SELECT round(avg(p_retailprice), 6) AS mean, sum(p_size)::BIGINT AS total, min(p_size) AS least, max(p_size) AS most, count(p_size) AS n, count(DISTINCT p_brand) AS brands FROM part", lambda df: df.withColumn("mean", F.round("mean", 6)), "metrics")
_agg("stats", "part", {"s": {"extended_stats": {"field": "p_retailprice"}}}, "SELECT count(p_retailprice) AS s_count, min(p_retailprice) AS s_min, max(p_retailprice) AS s_max, round(avg(p_retailprice), 4) AS s_avg, round(sum(p_retailprice), 4) AS s_sum, round(sum(p_retailprice * p_retailprice), 2) AS s_sum_of_squares, round(var_pop(p_retailprice), 4) AS s_variance, round(stddev_pop(p_retailprice), 4) AS s_std_deviation FROM part", lambda df: df.select("s_count", "s_min", "s_max", *[F.round(c, 4).alias(c) for c in ("s_avg", "s_sum", "s_variance", "s_std_deviation")], F.round("s_sum_of_squares", 2).alias("s_sum_of_squares")), "metrics")
_agg("percentiles", "events", {"p": {"percentiles": {"field": "value", "percents": [5, 50, 95], "exact": True}}}, "SELECT round(quantile_cont(value, 0.05), 6) AS p_p5, round(quantile_cont(value, 0.5), 6) AS p_p50, round(quantile_cont(value, 0.95), 6) AS p_p95 FROM events", _rounded(6), "metrics")
_agg("composite", "orders", {"a": {"composite": {"size": 6, "sources": [{"status": {"terms": {"field": "o_orderstatus", "order": "desc"}}}, {"priority": {"terms": {"field": "o_orderpriority"}}}], "after": {"status": "P", "priority": "2-HIGH"}}}}, "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS doc_count FROM orders WHERE o_orderstatus < 'P' OR (o_orderstatus = 'P' AND o_orderpriority > '2-HIGH') GROUP BY 1, 2 ORDER BY 1 DESC, 2 LIMIT 6", _same)
_agg("significant_terms", "part", {"a": {"significant_terms": {"field": "p_name", "foreground": {"term": {"p_type": "ECONOMY"}}, "size": 8}}}, """
    WITH g AS (SELECT p_name AS key, count(*) FILTER (WHERE p_type = 'ECONOMY') AS f, count(*) AS b FROM part GROUP BY 1), t AS (SELECT sum(f) AS tf, sum(b) AS tb FROM g)
    SELECT key, f AS doc_count, b AS bg_count, round((f / tf - b / tb) / (1 - b / tb) * ((f / tf) / (b / tb)), 6) AS score FROM g CROSS JOIN t WHERE f >= 3 AND f / tf > b / tb ORDER BY (f / tf - b / tb) / (1 - b / tb) * ((f / tf) / (b / tb)) DESC, key LIMIT 8""", lambda df: df.withColumn("score", F.round("score", 6)))  # fmt: skip
