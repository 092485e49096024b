"""Documents, points, merge-on-read deletes, splits, mounts and entities."""

import json

import pytest

from quillrake.operators import documents
from quillrake.operators.graph import entities
from quillrake.sources.table import Table

SCHEMA = "id long, name string, x double, vector array<float>"
ROWS = [(1, "one", 1.0, [1.0, 0.0]), (2, "two", 2.0, [0.0, 1.0]), (3, "three", None, [0.9, 0.1]), (4, None, 4.0, [-1.0, 0.0])]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def t(spark, tmp_path):
    return Table.from_dataframe(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/t", primary_key=["id"])


def test_bulk(t):
    lines = [{"index": {"_id": 5}}, {"name": "five", "x": 5.0}, {"delete": {"_id": 1}}, {"update": {"_id": 2}}, {"doc": {"x": 20.0}}, {"update": {"_id": 2}}, {"doc": {"name": "zwei"}}, {"update": {"_id": 99}}, {"doc": {"x": 0.0}}, {"index": {"_id": 6}}, {"x": 6.0}, {"delete": {"_id": 6}}]
    got = documents.bulk(t, "\n".join(map(json.dumps, lines)))
    assert got == {"updated": 1, "deleted": 1, "inserted": 1}
    assert rows(t.df().select("id", "name", "x").na.fill("-").na.fill(-1.0)) == [(2, "zwei", 20.0), (3, "three", -1.0), (4, "-", 4.0), (5, "five", 5.0)]
    assert documents.bulk(t, "") == {"updated": 0, "deleted": 0, "inserted": 0}
    with pytest.raises(ValueError):
        documents.bulk(t, [("index", 7, {"zz": 1})])


def test_by_query(t, spark, tmp_path):
    assert documents.update_by_query(t, {"range": {"x": {"gte": 2}}}, {"name": "big"}) == 2
    assert documents.delete_by_query(t, {"term": {"name": "one"}}) == 1
    other = Table.create(spark, f"file://{tmp_path}/o", "id long, name string", primary_key=["id"])
    documents.reindex(t, other, {"term": {"name": "big"}})
    documents.reindex(t, other)
    assert rows(other.df().na.fill("")) == [(2, "big"), (3, "three"), (4, "big")]


def ids(df):
    return [r["id"] for r in df.collect()]


def test_points(t):
    p = documents.Points(t)
    assert ids(p.search([1, 0], 2)) == [1, 3] and p.search([1, 0], 1).first()["score"] == pytest.approx(1)
    assert ids(p.search([1, 0], 9, threshold=0.5)) == [1, 3]
    assert ids(p.search([1, 0], 9, {"must_not": [{"has_id": [1]}], "must": [{"key": "x", "range": {"gte": 2}}]})) == [2, 4]
    assert p.count({"should": [{"key": "name", "match": {"value": "one"}}, {"key": "name", "match": {"text": "TW"}}]}) == 2
    assert p.count({"must": [{"is_null": {"key": "name"}}]}) == 1 == p.count({"must": [{"is_empty": {"key": "x"}}]})
    assert p.count({"must": [{"key": "name", "match": {"except": ["one"]}}]}) == 2
    assert ids(p.scroll(2)) == [1, 2] and ids(p.scroll(2, after=2)) == [3, 4]
    assert ids(p.recommend([1], [4], k=1)) == [3] and ids(p.recommend([[0.0, 1.0]], k=1, strategy="best_score")) == [2]
    assert ids(p.discover(2, [(1, 4)], k=2)) == [3, 1]  # 2 is as near to 4 as to 1, so not on the positive side
    assert p.set_payload({"name": "n"}, {"must": [{"has_id": [2, 4]}]}) == 2 and p.delete_payload(["x"], {"must": [{"has_id": [2]}]}) == 1
    assert rows(p.retrieve([2]).select("name", "x")) == [("n", None)]
    p.clear_payload({"must": [{"has_id": [1]}]})
    assert rows(p.retrieve([1]).select("name", "x")) == [(None, None)]
    with pytest.raises(ValueError):
        p.count({"must": [{"key": "x"}]})


def test_merge_on_read(t, spark):
    files = {f["path"] for f in t.state["files"]}
    v = t.version
    t.delete_on_read("x < 2")
    t.delete_on_read(keys=spark.createDataFrame([("two",), (None,)], "name string"))
    assert {f["path"] for f in t.state["files"]} == files and ids(t.df()) == [3] and t.row_count() == 1
    t.append(spark.createDataFrame([(9, "two", 1.0, None)], SCHEMA))  # later rows are not what was deleted
    assert sorted(ids(t.df())) == [3, 9] and sorted(ids(t.df(version=v))) == [1, 2, 3, 4]
    assert sorted((r["_change"], r["id"]) for r in t.changes(v).collect()) == [("delete", 1), ("delete", 2), ("delete", 4), ("insert", 9)]
    t.update({"name": "'x'"}, "id = 3")
    t.compact()
    assert t.state["deletes"] == [] and sorted(ids(t.df())) == [3, 9] and t.verify() == []
    t.expire(1)
    t.vacuum(0)
    assert sorted(ids(t.df())) == [3, 9] and not t.storage.files("deletes")


def test_splits_cover_the_table(t):
    for i in range(3):
        t.append(t.df().where("id < 3").selectExpr(f"id + {10 * i + 10} AS id", "name", "x", "vector"))
    for most in (1, 3000, 1 << 30):
        parts = t.splits(most)
        assert sorted(i for s in parts for i in ids(t.read_split(s))) == sorted(ids(t.df()))


def test_mounted_files_are_followed(spark, tmp_path):
    out = f"file://{tmp_path}/files"
    spark.createDataFrame(ROWS[:2], SCHEMA).write.parquet(out)
    t = Table.mount(spark, out, f"file://{tmp_path}/t")
    assert sorted(ids(t.df())) == [1, 2]
    spark.createDataFrame(ROWS[2:], SCHEMA).write.mode("append").parquet(out)
    assert sorted(ids(t.df())) == [1, 2]
    t.sync()
    assert sorted(ids(t.df())) == [1, 2, 3, 4] and t.sync() == t.version


def test_entities(spark):
    nodes = spark.createDataFrame([(1, "Paris Hilton"), (2, "paris"), (3, "London"), (4, None)], "id long, title string")
    assert ids(entities.find_entities(nodes, "Paris")) == [2, 1]
    assert rows(entities.lookup_entities(nodes, [3, 9])) == [(3, "London")] and entities.lookup_entities(nodes, []).count() == 0
    edges = spark.createDataFrame([(5, 3, "same_as"), (3, 8, "same_as"), (1, 2, "knows")], "source long, target long, relation string")
    assert rows(entities.resolve_entities(edges)) == [(3, 3), (5, 3), (8, 3)]


def test_communities_keep_their_names(spark):
    import itertools

    pairs = [(a, b) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 4), 2)]
    e = lambda p: spark.createDataFrame(p, "source long, target long")
    before = entities.update_communities(e(pairs)).selectExpr("node", "community + 100 AS community")
    after = entities.update_communities(e(pairs + [(3, 4), (2, 4), (20, 21), (21, 22), (20, 22)]), before)
    names = dict(rows(after))
    assert {names[i] for i in range(5)} == {100} and {names[i] for i in range(10, 14)} == {110} and {names[i] for i in (20, 21, 22)} == {111}


def test_extracted_graph(spark):
    docs = spark.createDataFrame([(1, "a likes b"), (2, "B likes c"), (3, None)], "id long, text string")
    triples = entities.extract_graph(docs, "id", "text", lambda t: [tuple(t.split())])
    nodes, edges = entities.graph_of_triples(triples)
    assert nodes.count() == 3 and edges.count() == 2
    names = dict(rows(nodes.select("id", "title")))
    assert {(names[r["source"]], names[r["target"]]) for r in edges.collect()} == {("a", "B"), ("B", "c")}
