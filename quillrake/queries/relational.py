"""Relational queries: scans and filters, aggregates, joins of every kind, windows, set operations, CTEs, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import Register, table

R = Register()

# Aggregates over one wide table, in the shape of a web-analytics benchmark.
R.sql("sql_q0_count", "SELECT count(*) AS n FROM lineitem")
R.sql("sql_q1_filtered_count", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag <> 'N'")
R.sql("sql_q2_several_aggregates", "SELECT round(sum(l_quantity), 2) AS total, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem")
R.sql("sql_q3_average", "SELECT round(avg(CAST(l_orderkey AS DOUBLE)), 3) AS mean FROM lineitem")
R.sql("sql_q4_distinct_users", "SELECT count(DISTINCT user_id) AS users FROM events")
R.sql("sql_q5_distinct_texts", "SELECT count(DISTINCT props) AS texts FROM events")
R.sql("sql_q6_first_and_last", "SELECT min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem")
R.sql("sql_q7_grouped", "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber <> 1 GROUP BY l_linenumber ORDER BY n DESC, l_linenumber")
R.sql("sql_q8_distinct_by_group", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type ORDER BY users DESC, event_type LIMIT 10")
R.sql("sql_q9_text_filter_by_group", "SELECT p_brand, count(*) AS n, min(p_retailprice) AS least FROM part WHERE p_name LIKE '%widget%' GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")

# Filters, from one key to nearly all rows.
R.sql("filter_f1_point", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 42")
R.sql("filter_f2_few", "SELECT count(*) AS n FROM lineitem WHERE l_quantity = 3")
R.sql("filter_f3_most", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 1")
R.sql("filter_f4_in_list", f"SELECT count(*) AS n FROM lineitem WHERE l_partkey IN ({', '.join(str(3 * i) for i in range(50))})")
R.sql("filter_f5_not_in_and_range", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (1, 2) AND l_quantity BETWEEN 10 AND 20")
R.sql("filter_f6_prefix", "SELECT count(*) AS n FROM part WHERE p_name LIKE 'red%'")
R.sql("filter_f7_substring", "SELECT count(*) AS n FROM documents WHERE text LIKE '%tion%'")
R.sql("filter_or_of_ranges", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45 OR (l_discount >= 0.05 AND l_tax < 0.02) GROUP BY l_returnflag")
R.sql("filter_null_logic", "SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS nulls, count(*) FILTER (WHERE NOT (n_chars > 500)) AS short FROM documents")


@R.add("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '2001-09-02'")
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(paid), 2).alias("sum_disc_price"),
        F.round(F.sum(paid * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


@R.add("""
    SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
    GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    o = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz '1998-03-15'")
    li = table(spark, sf_dir, "lineitem").where("l_shipdate > timestamp_ntz '1998-03-15'")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return rows.groupBy("l_orderkey", "o_orderdate", "o_orderpriority").agg(revenue).orderBy(F.col("revenue").desc(), "l_orderkey").limit(10)


@R.add("""
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name""")
def local_supplier_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier", "nation", "region")}
    first = t["region"].agg(F.min("r_name").alias("r_name"))
    here = t["region"].join(first, "r_name", "left_semi").join(t["nation"], F.col("r_regionkey") == F.col("n_regionkey"))
    sold = t["supplier"].join(here, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = t["lineitem"].join(sold, F.col("l_suppkey") == F.col("s_suppkey")).join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t["customer"], (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


R.sql("forecast_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
R.sql("returned_items", """
    SELECT c_custkey, c_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
R.sql("shipping_modes_by_case", """
    SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS low
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus""", """
    SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END)::BIGINT AS low
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus""")  # fmt: skip

# Joins.
JOINED = "SELECT c_nationkey, count(*) AS n, count(o_orderkey) AS orders FROM customer {} JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey GROUP BY c_nationkey"
for _how in ("INNER", "LEFT", "RIGHT", "FULL"):
    R.sql(f"join_{_how.lower()}", JOINED.format(_how))
R.sql("join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000", "SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON c_custkey = o_custkey")
R.sql("join_anti", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
R.sql("join_cross_of_dimensions", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b WHERE a.r_regionkey < b.r_regionkey")
R.sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
R.sql("join_non_equi", "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_nationkey > r_regionkey * 4 AND n_nationkey <= r_regionkey * 5 GROUP BY r_name")


@R.add("""
    SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE p_size = 7 GROUP BY l_suppkey, p_brand""")
def join_on_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few parts prune the large side: a runtime filter in place of index lookups per batch."""
    parts = table(spark, sf_dir, "part").where("p_size = 7").select("p_partkey", "p_brand")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))


@R.add("""
    SELECT e.event_id, e.user_id, p.event_id AS last_purchase, round(p.value, 2) AS purchase_value
    FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts
    WHERE e.event_type = 'click'""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillrake.streaming.windows import as_of_join

    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("last_purchase"), F.round("value", 2).alias("purchase_value"))
    return as_of_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "bought_at", ["last_purchase", "purchase_value"]).drop("ts")


# Grouping sets, windows, set operations, CTEs.
R.sql("group_rollup", "SELECT n_regionkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
R.sql("group_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
R.sql("group_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
R.sql("group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 15")
R.sql("aggregate_filters", "SELECT event_type, count(*) FILTER (WHERE value > 10) AS large, round(avg(value) FILTER (WHERE value <= 10), 6) AS small_mean, round(stddev_samp(value), 6) AS spread, round(var_pop(value), 6) AS variance FROM events GROUP BY event_type")
R.sql("aggregate_exact_percentiles", "SELECT event_type, round(percentile(value, 0.5), 6) AS p50, round(percentile(value, 0.95), 6) AS p95 FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")


@R.add("""
    SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quarter,
           lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    big = lambda c: c.cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", big(F.row_number().over(w)).alias("rn"), big(F.rank().over(w)).alias("rk"), big(F.dense_rank().over(w)).alias("dr"), big(F.ntile(4).over(w)).alias("quarter"),
        F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"),
    )


R.sql("window_frames", """
    SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3,
           round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS mean,
           first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order,
           count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS in_90_days
    FROM orders""")
R.sql("window_top_per_group", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) x WHERE rn <= 3")
R.sql("window_sessions_by_gap", """
    SELECT user_id, session, count(*) AS events, min(ts) AS first, max(ts) AS last FROM (
      SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL '2' HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
      FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) a) b
    GROUP BY user_id, session""", """
    SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS first, max(ts) AS last FROM (
      SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL '2' HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session
      FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) a) b
    GROUP BY ALL""")  # fmt: skip
for _op, _name in (("UNION", "union"), ("UNION ALL", "union_all"), ("INTERSECT", "intersect"), ("EXCEPT", "except"), ("INTERSECT ALL", "intersect_all"), ("EXCEPT ALL", "except_all")):
    R.sql(f"set_{_name}", f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 {_op} SELECT s_nationkey AS k FROM supplier")
R.sql("cte_chain", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), mean AS (SELECT avg(total) AS m FROM big) SELECT c_mktsegment, count(*) AS n FROM big CROSS JOIN mean JOIN customer ON o_custkey = c_custkey WHERE total > m GROUP BY c_mktsegment")
R.sql("cte_recursive", "WITH RECURSIVE s(d, n) AS (SELECT DATE '2024-01-01', 1 UNION ALL SELECT d + 1, n + 1 FROM s WHERE n < 30) SELECT d, count(event_id) AS events FROM s LEFT JOIN events ON CAST(ts AS DATE) = d GROUP BY d")
R.sql("subquery_exists", "SELECT count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
R.sql("subquery_scalar", "SELECT p_brand, count(*) AS n FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand) GROUP BY p_brand")
R.sql("subquery_not_in", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)")
R.sql("top_k_with_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
R.sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
R.sql("conditional_and_string_functions", """
    SELECT c_mktsegment, lower(c_mktsegment) AS low, substr(c_name, 1, 8) AS head, count(*) AS n, sum(coalesce(nullif(c_nationkey, 0), 100)) AS keys, round(sum(ln(abs(c_acctbal) + 1)), 4) AS logs,
           sum(CASE WHEN levenshtein(c_mktsegment, 'BUILDING') <= 5 THEN 1 ELSE 0 END) AS near, sum(CASE WHEN regexp_like(c_name, '0+7$') THEN 1 ELSE 0 END) AS sevens
    FROM customer GROUP BY c_mktsegment, lower(c_mktsegment), substr(c_name, 1, 8)""", """
    SELECT c_mktsegment, lower(c_mktsegment) AS low, substr(c_name, 1, 8) AS head, count(*) AS n, sum(coalesce(nullif(c_nationkey, 0), 100))::BIGINT AS keys, round(sum(ln(abs(c_acctbal) + 1)), 4) AS logs,
           sum(CASE WHEN levenshtein(c_mktsegment, 'BUILDING') <= 5 THEN 1 ELSE 0 END)::BIGINT AS near, sum(CASE WHEN regexp_matches(c_name, '0+7$') THEN 1 ELSE 0 END)::BIGINT AS sevens
    FROM customer GROUP BY ALL""")  # fmt: skip
R.sql("date_functions", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, min(date_diff(DAY, o_orderdate, TIMESTAMP_NTZ '2003-01-01')) AS least FROM orders GROUP BY date_trunc('month', o_orderdate)", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, min(date_diff('day', o_orderdate, TIMESTAMP '2003-01-01')) AS least FROM orders GROUP BY ALL")


@R.add("""
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P
    FROM orders GROUP BY o_orderpriority""")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@R.add("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)")
def sql_over_several_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement over aliased tables through the engine."""
    from quillrake.session import Engine

    engine = Engine(spark)
    sources = {"o": table(spark, sf_dir, "orders"), "l": table(spark, sf_dir, "lineitem")}
    return engine.sql_multi(sources, "SELECT 'orders' AS name, count(*) AS n FROM o UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT o_custkey, l_suppkey FROM o JOIN l ON o_orderkey = l_orderkey); -- a comment")
