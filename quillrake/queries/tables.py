"""Versioned tables, maintenance, sources and sinks, change feeds and windows, each as a query with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrake.plans.durable import new_path
from quillrake.session import Engine
from quillrake.sources import ingest, transforms
from quillrake.sources.table import Table
from quillrake.streaming import feed, windows

from .registry import Register, table

R = Register()


def _orders(spark: SparkSession, sf_dir: str, **options) -> Table:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return Table.from_dataframe(rows, new_path(spark, "orders"), **options)


_BASE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders"


@R.add(f"SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM ({_BASE} UNION ALL {_BASE} WHERE o_orderstatus = 'P') GROUP BY 1")
def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    t.append(t.df().where("o_orderstatus = 'P'"))
    return t.df().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add(f"{_BASE} WHERE o_orderstatus = 'F'")
def table_overwrite_and_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version before an overwrite is still there."""
    t = _orders(spark, sf_dir)
    before = t.version
    t.overwrite(t.df().where("o_orderstatus = 'F'"))
    kept = t.df()
    t.truncate()
    return kept.join(t.df(version=before).select("o_orderkey"), "o_orderkey", "left_semi").select(*t.columns)


@R.add(f"{_BASE} WHERE NOT (o_totalprice < 100000 AND o_orderstatus = 'O')")
def table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir, partition_by=["o_orderstatus"])
    t.delete("o_totalprice < 100000 AND o_orderstatus = 'O'")
    return t.df()


@R.add("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 400000 THEN round(o_totalprice * 0.9, 4) ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders")
def table_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    t.update({"o_orderstatus": "'X'", "o_totalprice": "round(o_totalprice * 0.9, 4)"}, "o_totalprice > 400000")
    return t.df()


_NEW = "SELECT o_orderkey + 10 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'P'"


@R.add(f"WITH s AS ({_NEW}) SELECT * FROM s UNION ALL {_BASE} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir, primary_key=["o_orderkey"])
    new = t.df().where("o_orderstatus = 'P'").withColumns({"o_orderkey": F.col("o_orderkey") + 10, "o_orderstatus": F.lit("N")})
    t.upsert(new)
    return t.df()


@R.add(f"""
    WITH s AS ({_NEW}) SELECT o.o_orderkey, o.o_custkey, CASE WHEN s.o_orderkey IS NOT NULL THEN 'M' WHEN o.o_orderstatus = 'F' THEN 'S' ELSE o.o_orderstatus END AS o_orderstatus,
      CASE WHEN s.o_orderkey IS NOT NULL THEN round(o.o_totalprice + s.o_totalprice, 2) ELSE o.o_totalprice END AS o_totalprice, o.o_orderdate
    FROM orders o LEFT JOIN s ON o.o_orderkey = s.o_orderkey WHERE NOT (s.o_orderkey IS NOT NULL AND s.o_totalprice > 300000)
    UNION ALL SELECT o_orderkey, o_custkey, 'I', 0.0, o_orderdate FROM s WHERE o_totalprice > 1000 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def sql_merge_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of clause, through SQL."""
    engine = Engine(spark, new_path(spark, "warehouse"))
    engine.tables["merged"] = t = _orders(spark, sf_dir)
    new = t.df().where("o_orderstatus = 'P'").withColumns({"o_orderkey": F.col("o_orderkey") + 10, "o_orderstatus": F.lit("N")})
    engine.register("fresh", new)
    engine.sql("""MERGE INTO merged AS o USING fresh AS s ON o.o_orderkey = s.o_orderkey
        WHEN MATCHED AND s.o_totalprice > 300000 THEN DELETE
        WHEN MATCHED THEN UPDATE SET o_orderstatus = 'M', o_totalprice = round(o.o_totalprice + s.o_totalprice, 2)
        WHEN NOT MATCHED AND s.o_totalprice > 1000 THEN INSERT (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate) VALUES (s.o_orderkey, s.o_custkey, 'I', 0.0, s.o_orderdate)
        WHEN NOT MATCHED BY SOURCE AND o.o_orderstatus = 'F' THEN UPDATE SET o_orderstatus = 'S'""")
    return engine.sql("SELECT * FROM merged")


@R.add("SELECT o_orderkey, o_totalprice AS price, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS grade FROM orders UNION ALL SELECT o_orderkey + 1000000, o_totalprice, 'Q', 5 FROM orders WHERE o_orderstatus = 'P'")
def table_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old files keep their columns: a new one with a default, a rename, a drop, a move."""
    t = _orders(spark, sf_dir)
    t.add_column("grade", "int", default=1)
    t.rename_column("o_totalprice", "price")
    t.drop_column("o_custkey")
    t.drop_column("o_orderdate")
    t.move_column("price", after="o_orderkey")
    t.append(t.df().where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 1000000).alias("o_orderkey"), "price", F.lit("Q").alias("o_orderstatus"), F.lit(5).alias("grade")))
    t.update({"grade": "2"}, "o_orderstatus = 'P'")
    return t.df()


@R.add("SELECT _change, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT 'delete' AS _change, o_totalprice FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'insert', o_totalprice + 1 FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    v = t.version
    t.update({"o_totalprice": "o_totalprice + 1"}, "o_orderstatus = 'P'")
    return t.changes(v).groupBy("_change").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add("SELECT 'batch' AS event_type, count(*) AS rows FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'commit', count(*) FROM orders WHERE o_orderstatus = 'O'")
def table_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through SQL: what happened since a version."""
    t = _orders(spark, sf_dir)
    v = t.version
    t.append(t.df().where("o_orderstatus = 'P'"))
    t.delete("o_orderstatus = 'O'")
    return feed.poll_events(t, since=v).select("event_type", "rows")


@R.add("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, 1 AS same FROM orders WHERE o_orderkey BETWEEN 100 AND 900 AND o_custkey <= 500")
def table_clustered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows laid out along a curve and read with file pruning are the same rows."""
    t = _orders(spark, sf_dir)
    want = t.row_count()
    t.cluster(["o_orderkey", "o_custkey"], files=8)
    pruned = t.explain_pruning({"o_orderkey": (100, 900)})["pruned"]
    t.compact(1 << 30)
    t.cluster(["o_orderkey", "o_custkey"], "hilbert", files=8)
    rows = t.df(ranges={"o_orderkey": (100, 900), "o_custkey": (None, 500)})
    same = int(t.row_count() == want and not t.verify() and pruned >= 0)
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("same", F.lit(same))


@R.add("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def table_rollback_and_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir)
    v = t.version
    branch = t.create_branch("trial")
    branch.truncate()
    t.refresh().delete("o_orderstatus = 'F'")
    t.rollback(v)
    return t.df().groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@R.add("SELECT l_returnflag, year(o_orderdate)::VARCHAR AS y, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def sql_ctas_partitioned_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDL through SQL: CREATE TABLE AS with partition transforms, INSERT, ALTER, time travel."""
    engine = Engine(spark, new_path(spark, "warehouse"))
    for n in ("orders", "lineitem"):
        engine.register(n, table(spark, sf_dir, n))
    engine.sql("CREATE TABLE lines PARTITIONED BY (years(o_orderdate), l_returnflag) AS SELECT l_orderkey, l_returnflag, o_orderdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'")
    engine.sql("INSERT INTO lines SELECT l_orderkey, l_returnflag, o_orderdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
    engine.sql("ALTER TABLE lines ADD COLUMN note TEXT")
    engine.sql("DELETE FROM lines")
    engine.sql("ALTER TABLE lines EXECUTE rollback_to_snapshot(3)")
    return engine.sql("SELECT l_returnflag, date_format(o_orderdate, 'yyyy') AS y, count(*) AS n FROM lines GROUP BY 1, 2")


@R.add("SELECT p_partkey, p_brand, p_retailprice, strftime(ts, '%Y-%m') AS month, p_partkey - p_partkey % 100 AS hundred, substr(p_brand, 1, 7) AS head FROM part JOIN events ON event_id = p_partkey")
def partition_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").join(table(spark, sf_dir, "events"), F.col("event_id") == F.col("p_partkey"))
    return rows.select("p_partkey", "p_brand", "p_retailprice", transforms.partition_value("ts", "month").alias("month"), transforms.partition_value("p_partkey", "truncate[100]", "bigint").alias("hundred"), transforms.partition_value("p_brand", "truncate[7]").alias("head"))


def _round_trip(format: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "customer")
        path = new_path(spark, format)
        ingest.export(rows, path, format)
        return ingest.read_files(spark, path, format, rows.schema if format != "parquet" else None)

    run.__name__ = f"source_{format}"
    return run


for _format in ("parquet", "csv", "json", "orc"):
    R.add("SELECT * FROM customer")(_round_trip(_format))


@R.add("SELECT * FROM customer")
def source_ingest_into_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with inferred types into a table, twice under one name: the second time nothing is new."""
    rows = table(spark, sf_dir, "customer")
    path = new_path(spark, "csv")
    ingest.export(rows, path, "csv")
    t = Table.create(spark, new_path(spark, "customers"), rows.schema)
    ingest.ingest(t, path, "csv", resume="load")
    ingest.ingest(t, path, "csv", resume="load")
    return t.df()


# Windows over event time.
@R.add("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.tumbling(table(spark, sf_dir, "events"), "ts", "6 hours", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@R.add("SELECT s AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS s FROM events) GROUP BY 1")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sliding(table(spark, sf_dir, "events"), "ts", "12 hours", "6 hours", [], [F.count("*").alias("n")])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@R.add("""
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (
      SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL '3 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k
      FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, k""")
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sessions(table(spark, sf_dir, "events"), "ts", "3 hours", ["user_id"], [F.count("*").alias("n")])
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@R.add("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL '1 day', max(ts) - INTERVAL '1 hour') FROM events) GROUP BY 1")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured Streaming with a watermark, in append mode: the windows that are closed."""
    t = Table.from_dataframe(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value"), new_path(spark, "events"))
    out = Table.create(spark, new_path(spark, "counts"), "window_start timestamp, n long")
    counted = windows.tumbling(feed.stream_appends(t), "ts", "1 day", [], [F.count("*").alias("n")], "1 hour").select("window_start", "n")
    query = feed.sink(out, new_path(spark, "checkpoint"), counted).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.refresh().df().select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@R.add("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_stateful_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of one row per key, merged into a table batch by batch."""
    t = Table.from_dataframe(table(spark, sf_dir, "events").select("event_type", "value"), new_path(spark, "events"))
    out = Table.create(spark, new_path(spark, "totals"), "event_type string, n long, total double", primary_key=["event_type"])
    totals = windows.running_totals(feed.stream_appends(t), "event_type", "value")
    query = feed.sink(out, new_path(spark, "checkpoint"), totals, keys=["event_type"]).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.refresh().df().withColumn("total", F.round("total", 4))
