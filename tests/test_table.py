"""Versioned tables: a random workload against a model, constraints, conflicts, history and maintenance."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillrake.sources import ingest, transforms
from quillrake.sources.table import Conflict, ConstraintError, Table

SCHEMA = "id int, name string, value double"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def t(spark, tmp_path):
    return Table.from_dataframe(make(spark, [(i, f"n{i}", float(i)) for i in range(6)]), f"file://{tmp_path}/t")


def test_random_workload_against_a_model(spark, tmp_path):
    r = random.Random(11)
    t = Table.create(spark, f"file://{tmp_path}/t", SCHEMA, primary_key=["id"])
    model, past = {}, {}
    for _ in range(14):
        step = r.choice(["append", "upsert", "delete", "update", "compact", "reopen", "rollback"])
        fresh = [(i, f"n{r.randrange(9)}", float(r.randrange(9))) for i in r.sample(range(30), 4)]
        if step == "append":
            fresh = [x for x in fresh if x[0] not in model]
            t.append(make(spark, fresh))
            model |= {x[0]: x for x in fresh}
        elif step == "upsert":
            t.upsert(make(spark, fresh))
            model |= {x[0]: x for x in fresh}
        elif step == "delete":
            v = float(r.randrange(9))
            assert t.delete(F.col("value") == v) == sum(x[2] == v for x in model.values())
            model = {k: x for k, x in model.items() if x[2] != v}
        elif step == "update":
            t.update({"value": "value + 1"}, "id % 2 = 0")
            model = {k: (x[0], x[1], x[2] + (k % 2 == 0)) for k, x in model.items()}
        elif step == "compact":
            t.compact()
        elif step == "reopen":
            t = Table(spark, t.path)
        elif past:
            v = r.choice(sorted(past))
            t.rollback(v)
            model = dict(past[v])
        past[t.version] = dict(model)
        assert rows(t.df()) == sorted(model.values())
    for v in r.sample(sorted(past), 3):
        assert rows(t.df(version=v)) == sorted(past[v].values())
    assert t.verify() == []


def test_constraints(spark, tmp_path):
    t = Table.create(spark, f"file://{tmp_path}/t", "id int, v array<float>", primary_key=["id"], properties={"vector_dimensions": {"v": 2}})
    df = lambda rows: spark.createDataFrame(rows, "id int, v array<float>")
    t.append(df([(1, [1.0, 2.0]), (2, None)]))
    for bad in ([(1, None)], [(3, None), (3, None)], [(None, None)], [(4, [1.0])]):
        with pytest.raises(ConstraintError):
            t.append(df(bad))
    t.set_not_null("id")
    assert t.row_count() == 2 and t.verify() == []
    with pytest.raises(ConstraintError):
        t.set_not_null("v")
    with pytest.raises(ValueError):
        t.append(df([(5, None)]).withColumn("zz", F.lit(1)))
    assert rows(t.lookup(2)) == [(2, None)]


def test_only_one_writer_wins(spark, t):
    other = Table(spark, t.path)
    t.append(make(spark, [(10, "a", 1.0)]))
    other.append(make(spark, [(11, "b", 1.0)]))  # appends are tried again on top
    assert other.row_count() == 8
    with pytest.raises(Conflict):
        t.delete("id = 1")
    assert t.refresh().delete("id = 1") == 1


def test_merge_with_null_keys_and_all_clauses(spark, t):
    t.append(make(spark, [(None, "null", 0.0)]))
    source = make(spark, [(1, "one", 10.0), (2, "two", -1.0), (50, "new", 5.0), (None, "other", 9.0)])
    got = t.merge(source, {"id": "id"}, matched=[("s.value < 0", "delete", None), (None, "update", {"name": "concat(t.name, s.name)"})], not_matched=[("s.id IS NOT NULL", None)], not_matched_by_source=[("t.id = 5", "delete", None), ("t.id = 4", "update", {"value": "t.value * 2"})])
    assert got == {"updated": 2, "deleted": 2, "inserted": 1}
    assert rows(t.df().na.fill(-1)) == [(-1, "null", 0.0), (0, "n0", 0.0), (1, "n1one", 1.0), (3, "n3", 3.0), (4, "n4", 8.0), (50, "new", 5.0)]


def test_null_conditions_keep_rows(spark, t):
    t.append(make(spark, [(7, None, None)]))
    assert t.delete("value < 100") == 6
    assert rows(t.df()) == [(7, None, None)]
    assert t.delete("id = 99") == 0


def test_evolution_reads_old_files(spark, t):
    t.add_column("extra", "string", default="old", first=True)
    t.rename_column("name", "label")
    t.change_type("id", "bigint")
    t.drop_column("value")
    t.add_column("value", "int")  # a name that was used before is a new column
    assert t.columns == ["extra", "id", "label", "value"]
    assert rows(t.df())[0] == ("old", 0, "n0", None)
    with pytest.raises(ValueError):
        t.change_type("id", "int")
    with pytest.raises(ValueError):
        t.add_column("id", "int")
    assert t.df(version=1).columns == ["id", "name", "value"]


def test_history_branches_and_time_travel(spark, t):
    v, then = t.version, time.time()
    branch = t.create_branch("b")
    branch.append(make(spark, [(99, "z", 9.0)]))
    assert branch.row_count() == 7 and t.refresh().row_count() == 6
    time.sleep(0.01)
    t.truncate()
    assert t.df(timestamp=then).count() == 6 == t.df(version=v).count()
    t.rollback(v)
    assert t.row_count() == 6 and [h["operation"] for h in t.history()][-1] == f"rollback to {v}"
    with pytest.raises(ValueError):
        t.df(timestamp=0.0)


def test_changes(spark, t):
    v = t.version
    t.append(make(spark, [(9, "x", 1.0)]))
    t.update({"value": "7.0"}, "id = 0")
    assert rows(t.changes(v)) == [("delete", 0, "n0", 0.0), ("insert", 0, "n0", 7.0), ("insert", 9, "x", 1.0)]


def test_expire_and_vacuum(spark, t):
    old = {f["path"] for f in t.state["files"]}
    t.overwrite(make(spark, [(1, "only", 1.0)]))
    assert not old & set(t.vacuum(0))  # an older version still names them; markers and files without rows may go
    assert t.df(version=1).count() == 6
    assert t.expire(1) == [0, 1]
    assert old <= set(t.vacuum(0))
    assert set(t.storage.files("data")) == {f["path"] for f in t.state["files"]}
    assert rows(t.df()) == [(1, "only", 1.0)] and t.verify() == []


def test_partitions_and_pruning(spark, tmp_path):
    df = spark.range(200).selectExpr("id", "timestamp_ntz '2024-01-01' + make_dt_interval(cast(id AS int)) AS ts", "cast(id % 3 AS string) AS k")
    t = Table.from_dataframe(df, f"file://{tmp_path}/t", partition_by=[("ts", "month"), "k", ("id", "bucket[2]")])
    assert rows(t.df()) == rows(df)
    assert t.explain_pruning({"id": (0, 5)})["pruned"] > 0
    assert t.df(ranges={"id": (3, 8)}).count() == 6
    t.set_partitioning([("id", "truncate[100]")])
    t.append(df.selectExpr("id + 200 AS id", "ts", "k"))
    assert t.df().count() == 400
    for curve in ("z-order", "hilbert", "linear"):
        t.cluster(["id", "ts"], curve, files=4)
        assert t.df().count() == 400 and t.statistics()["files"] <= 4
    with pytest.raises(ValueError):
        t.set_partitioning([("id", "nonsense")])


def test_hilbert_visits_neighbours(spark):
    df = spark.range(16).selectExpr("cast(id % 4 AS int) AS x", "cast(id div 4 AS int) AS y")
    placed = sorted((r["d"], r["x"], r["y"]) for r in df.select("x", "y", transforms.hilbert(df, ["x", "y"], 2).alias("d")).collect())
    assert [p[0] for p in placed] == list(range(16))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(placed, placed[1:]))


def test_indexes_never_change_an_answer(spark, tmp_path):
    r = random.Random(5)
    df = spark.createDataFrame([(i, [r.random() for _ in range(8)]) for i in range(300)], "id int, v array<float>")
    t = Table.from_dataframe(df, f"file://{tmp_path}/t")
    t.create_index("i", "ivf", "v", cells=6)
    q = [0.5] * 8
    exact = [x["id"] for x in t.vector_search("v", q, 10).collect()]
    assert [x["id"] for x in t.vector_search("v", q, 10, index="i", probes=6).collect()] == exact
    asked = [x["v"] for x in df.where("id % 30 = 0").collect()]
    recall = [len({x["id"] for x in t.vector_search("v", v, 10).collect()} & {x["id"] for x in t.vector_search("v", v, 10, index="i", probes=5).collect()}) / 10 for v in asked]
    assert sum(recall) / len(recall) >= 0.9
    t.delete("id < 5")
    assert t.index("i") is None
    assert all(x["id"] >= 5 for x in t.vector_search("v", q, 10, index="i").collect())
    with pytest.raises(ValueError):
        t.create_index("j", "nonsense", "v")


@pytest.mark.parametrize("format", ["csv", "json"])
def test_ingest_infers_types(spark, tmp_path, format):
    df = spark.createDataFrame([(1, "a,\"b\"", 1.5), (2, None, None)], "id int, s string, x double")
    ingest.export(df.coalesce(1), f"{tmp_path}/in", format)
    assert [r[0] for r in rows(ingest.read_files(spark, f"{tmp_path}/in", format).select("id"))] == [1, 2]
    assert dict(ingest.read_files(spark, f"{tmp_path}/in", format).dtypes)["x"] == "double"


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import ipc

    table = pa.table({"a": [1, 2, 3], "s": ["x", None, "z"]})
    for name, opener in (("f.arrow", ipc.new_file), ("s.arrow", ipc.new_stream)):
        with opener(str(tmp_path / name), table.schema) as out:
            out.write_table(table)
    assert rows(ingest.read_files(spark, str(tmp_path), "ipc").na.fill("")) == sorted([(1, "x"), (2, ""), (3, "z")] * 2)
    back = list(ingest.to_arrow_batches(ingest.from_arrow(spark, table)))
    assert sum(b.num_rows for b in back) == 3


def test_branches_are_named_by_their_versions(spark, tmp_path):
    t = Table.from_dataframe(spark.createDataFrame([(i,) for i in range(6)], "a long"), f"file://{tmp_path}/b")
    one, two = t.create_branch("one"), t.create_branch("two")
    one.delete("a = 0")
    two.delete("a > 3")
    t.refresh().delete("a = 5")
    two.refresh().append(spark.createDataFrame([(9,)], "a long"))
    read = lambda ref: sorted(r[0] for r in Table(spark, t.path, ref).df().collect())
    assert (read(None), read("one"), read("two")) == ([0, 1, 2, 3, 4], [1, 2, 3, 4, 5], [0, 1, 2, 3, 9])
    stale = Table(spark, t.path, "one")
    one.refresh().delete("a = 1")
    with pytest.raises(Conflict):
        stale.delete("a = 2")
    t.refresh().expire(1)
    assert (read(None), read("one"), read("two")) == ([0, 1, 2, 3, 4], [2, 3, 4, 5], [0, 1, 2, 3, 9])
    for bad in ("one", "main", "a/b"):
        with pytest.raises(ValueError):
            t.create_branch(bad)


def test_a_merge_that_breaks_the_key_leaves_no_version(spark, tmp_path):
    t = Table.from_dataframe(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string"), f"file://{tmp_path}/k", primary_key=["id"])
    versions = t.versions()
    source = spark.createDataFrame([("z", 2)], "v string, new long")
    with pytest.raises(ConstraintError):
        t.merge(source, {"v": "v"}, not_matched=[(None, {"id": F.col("s.new"), "v": F.col("s.v")})])
    assert t.versions() == versions and t.refresh().df().count() == 3
    twice = spark.createDataFrame([(7, "x"), (7, "y")], "id long, v string")
    with pytest.raises(ConstraintError):
        t.upsert(twice)
    assert t.versions() == versions


def test_a_merge_reads_only_files_that_may_match(spark, tmp_path):
    t = Table.create(spark, f"file://{tmp_path}/m", "id long, v string", primary_key=["id"])
    for lo in (0, 100, 200):
        t.append(spark.range(lo, lo + 10).selectExpr("id", "'old' AS v").coalesce(1))
    source = spark.createDataFrame([(105, "new"), (150, "new")], "id long, v string")
    assert len(t._overlapping(source, {"id": "id"})) == 1
    kept = {f["path"] for f in t.state["files"]} - {f["path"] for f in t._overlapping(source, {"id": "id"})}
    assert t.upsert(source) == {"updated": 1, "deleted": 0, "inserted": 1}
    assert kept <= {f["path"] for f in t.state["files"]} and t.df().count() == 31
    assert sorted(r["id"] for r in t.df().where("v = 'new'").collect()) == [105, 150]


def test_an_index_gives_the_scores_of_a_scan(spark, tmp_path):
    rows = [(1, "the red fox"), (2, "red red wine"), (3, None), (4, ""), (5, "a fox and the red hen"), (6, "green")]
    t = Table.from_dataframe(spark.createDataFrame(rows, "id long, text string"), f"file://{tmp_path}/w", primary_key=["id"])
    scores = lambda: sorted((r["id"], round(r["score"], 9)) for r in t.bm25("text", "red fox nowhere").collect())
    phrases = lambda: sorted(map(tuple, t.phrase_search("text", "the red").collect()))
    scanned = scores(), phrases()
    t.create_index("w", "bm25", "text")
    assert t._postings("text", None, "id", "standard") is not None
    assert (scores(), phrases()) == scanned and scanned[1] == [(1, 1), (5, 1)]
    t.append(spark.createDataFrame([(7, "red fox")], "id long, text string"))
    assert t._postings("text", None, "id", "standard") is None and len(scores()) == len(scanned[0]) + 1


def test_large_partitions_and_files_are_shared_out(spark, tmp_path, monkeypatch):
    """Rows of one partition value go to several tasks, and a file along a curve holds a bounded number of rows."""
    rows = spark.range(60_000, numPartitions=4).selectExpr("id", "'one' AS kind", "uuid() AS u")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        t = Table.from_dataframe(rows, str(tmp_path / "parts"), partition_by=["kind"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(t.state["files"]) > 2 and t.row_count() == 60_000 == t.df().select("id").distinct().count()
    monkeypatch.setattr("quillrake.sources.table.SORTED_ROWS", 10_000)
    t = Table.from_dataframe(rows, str(tmp_path / "curve"))
    t.cluster(["id"], "linear", files=2)
    assert len(t.state["files"]) >= 6 and t.row_count() == 60_000 and not t.verify()
