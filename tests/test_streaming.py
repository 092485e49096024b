from pyspark.sql import functions as F

from quillrake.sources.table import Table
from quillrake.streaming import feed, windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_sink_writes_each_batch_once(spark, tmp_path):
    source = Table.from_dataframe(spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string"), f"file://{tmp_path}/in")
    out = Table.create(spark, f"file://{tmp_path}/out", "id int, s string", primary_key=["id"])

    def run():
        q = feed.sink(out, f"file://{tmp_path}/checkpoint", feed.stream_appends(source), keys=["id"]).trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(out.refresh().df())

    assert run() == [(1, "a"), (2, "b")]
    source.append(spark.createDataFrame([(2, "B"), (3, "c")], "id int, s string"))
    assert run() == [(1, "a"), (2, "B"), (3, "c")]
    before = out.version
    out.set_properties({"stream.sink": 99})  # as if batches up to 99 were in the table already
    source.append(spark.createDataFrame([(4, "d")], "id int, s string"))
    assert run() == [(1, "a"), (2, "B"), (3, "c")] and out.version == before + 1


def test_feed(spark, tmp_path):
    t = Table.from_dataframe(spark.createDataFrame([(1,), (2,)], "a int"), f"file://{tmp_path}/t")
    assert rows(feed.poll_events(t, timeout_ms=10)) == []
    t.append(spark.createDataFrame([(3,)], "a int"))
    t.delete("a = 1")
    assert rows(feed.poll_events(t, since=1)) == [(2, "batch", 1), (3, "commit", 1)]
    assert rows(feed.poll_events(t, "a = 3", since=1)) == [(2, "batch", 1)]
    assert [(v, rows(df)) for v, df in feed.subscribe(t, 1)] == [(2, [("insert", 3)]), (3, [("delete", 1)])]


def test_windows_over_late_rows(spark, tmp_path):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    df = spark.createDataFrame([("k", at(h)) for h in (0, 1, 5, 6, 7, 20)], "k string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r[1] for r in rows(windows.sessions(df, "ts", "2 hours", ["k"], [F.count("*").alias("n")]).select("session_start", "n"))] == [2, 3, 1]
    assert sorted(r["n"] for r in windows.sliding(df, "ts", "8 hours", "4 hours", [], [F.count("*").alias("n")]).collect()) == [1, 1, 2, 3, 5]
    assert windows.distinct_events(df, "ts", ["k"], "1 hour").count() == 1


def test_as_of_join(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "x", 1), (3, "y", 9)], "id int, k string, t int")
    b = spark.createDataFrame([("x", 5, "at"), ("x", 4, "before"), ("y", 10, "after")], "k string, u int, v string")
    assert rows(windows.as_of_join(a, b, "k", "t", "u", ["v"]).select("id", F.coalesce("v", F.lit("-")))) == [(1, "at"), (2, "-"), (3, "-")]


def test_streams_follow_commits_and_not_files(spark, tmp_path):
    t = Table.create(spark, f"file://{tmp_path}/t", "id long, at timestamp, day timestamp_ntz, v array<float>, s string", partition_by=["s"])
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS at", "timestamp_ntz'2024-01-01 10:00:00' AS day", "array(cast(id AS float), 0.5F) AS v", "cast(id % 2 AS string) AS s")
    t.append(rows(0, 4))
    t.append(rows(4, 6))
    t._write(rows(90, 95))  # written and never committed
    t.compact()
    t.delete("id = 1")
    t.create_branch("side").append(rows(50, 55))
    t.refresh().append(rows(6, 8))
    out = Table.create(spark, f"file://{tmp_path}/o", t.schema)
    feed.sink(out, f"file://{tmp_path}/c", feed.stream_appends(t)).trigger(availableNow=True).start().awaitTermination()
    got = out.refresh().df().orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in rows(0, 8).orderBy("id").collect()]
