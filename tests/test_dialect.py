"""The SQL dialect: rewriting of statements, and commands through the engine."""

import pytest

from quillrake.plans import dialect
from quillrake.session import Engine


def out(sql, **kw):
    return dialect.rewrite(sql, **kw)[0]


@pytest.mark.parametrize("op, f", dialect.OPERATORS.items())
def test_operators(op, f):
    assert f"{f}(t.v, cast(array(1.0D, -2.0D) AS ARRAY<DOUBLE>))" in out(f"SELECT t.v {op} '[1,-2]' AS d FROM t")


def test_null_safe_equality_stays():
    assert "a <=> b" in out("SELECT a <=> b FROM t")
    assert "dist_cosine(a, b)" in out("SELECT a <=> b FROM t", vector_columns=["A"])


def test_operands_may_be_calls_casts_and_brackets():
    assert "dist_l2(f(a, (b)), cast(array(1.0D) AS ARRAY<DOUBLE>)) < 2" in out("SELECT * FROM t WHERE f(a, (b)) <-> '[1]'::vector(1) < 2")
    assert "dist_l1(x, y)" in out('SELECT "a" || \'<+>\', x <+> y -- z <+> q\nFROM t')


def test_strings_and_comments_are_not_looked_into():
    assert out("SELECT '-- a <-> b; c' AS s /* x <-> y */ FROM t;") == "SELECT '-- a <-> b; c' AS s FROM t"
    with pytest.raises(dialect.SqlError):
        out("SELECT 1; SELECT 2")
    with pytest.raises(dialect.SqlError):
        out("SELECT '\0'")
    with pytest.raises(dialect.SqlError):
        out("SELECT 'open")


def test_hints():
    sql, hints = dialect.rewrite("SELECT /*+ ef_search(40) probes(3) use_index(v) */ * FROM t")
    assert hints == {"ef_search": "40", "probes": "3", "use_index": "v"} and "/*" not in sql
    assert "/*+ BROADCAST(t) */" in out("SELECT /*+ BROADCAST(t) */ * FROM t")


def test_other_spellings():
    assert out("SELECT arrow_cast(x, 'UInt64'), make_array(1, 2), ARRAY[1, 2], EXTRACT(EPOCH FROM (a - b)) FROM t") == "SELECT cast(x AS BIGINT), array(1, 2), array(1, 2), timestampdiff(SECOND, b, a) FROM t"


def test_literals():
    assert dialect.sparse_literal("{1:0.5, 0:2}/4") == "named_struct('indices', array(0, 1), 'values', array(2.0D, 0.5D), 'dim', 4)"
    assert dialect.bit_literal("10") == "cast(array(1D, 0D) AS ARRAY<DOUBLE>)"
    with pytest.raises(dialect.SqlError):
        dialect.sparse_literal("[1]")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/warehouse")
    e.register("edges", spark.createDataFrame([(i, i + 1) for i in range(5)], "source long, target long"))
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_graph_functions_in_from(engine):
    assert rows(engine.sql("SELECT node, hop FROM graph_neighbors('edges', '0', 2, 'auto')")) == [(0, 0), (1, 1), (2, 2)]
    assert rows(engine.sql("SELECT * FROM shortest_path('edges', 1, 3, 'out_of_core')")) == [(1, 0), (2, 1), (3, 2)]
    assert rows(engine.sql("SELECT * FROM graph_subgraph('edges', '2', 1) WHERE source > 0")) == [(2, 3)]
    assert engine.sql("SELECT round(sum(rank), 6) FROM pagerank('edges', 0.85, 20)").first()[0] == 1.0
    assert len(rows(engine.sql("SELECT * FROM louvain('edges') l JOIN graph_all_shortest_paths('edges', 0, 2) p ON true"))) == 6


def test_graph_aggregates(engine):
    assert engine.sql("SELECT graph_shortest_path(source, target, 0, 3) AS p FROM edges").first()["p"] == [0, 1, 2, 3]
    assert engine.sql("SELECT graph_neighbors(source, target, 1, 2) FROM edges WHERE source < 4").first()[0] == [2, 3]
    assert engine.sql("SELECT graph_triangle_count(source, target) AS n FROM edges").first()["n"] == 0
    assert [tuple(x) for x in engine.sql("SELECT graph_connected_components(source, target) AS c FROM edges").first()["c"]] == [(i, 0) for i in range(6)]
    assert engine.sql("SELECT graph_jaccard_coefficient(source, target, 0, 1) AS j FROM edges").first()["j"] == 0


def test_definitions_and_changes(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, name TEXT NOT NULL, v vector(3), x DOUBLE[]) TBLPROPERTIES ('owner' = 'me')")
    assert engine.sql("INSERT INTO t SELECT 1, 'a', array(1.0, 2.0, 3.0), array(0.5) UNION ALL SELECT 2, 'b', NULL, NULL").first()[0] == 2
    engine.sql("INSERT INTO t (id, name) SELECT 3, 'c'")
    assert engine.sql("UPDATE t SET name = upper(name) WHERE id >= 2").first()[0] == 2
    assert engine.sql("DELETE FROM t WHERE id = 1").first()[0] == 1
    assert rows(engine.sql("SELECT id, name FROM t")) == [(2, "B"), (3, "C")]
    assert rows(engine.sql("SELECT id FROM t VERSION AS OF 1")) == [(1,), (2,)]
    engine.sql("ALTER TABLE t ADD COLUMN n INT DEFAULT 7 AFTER id")
    engine.sql("ALTER TABLE t RENAME COLUMN name TO label")
    engine.sql("ALTER TABLE t ALTER COLUMN n TYPE BIGINT")
    engine.sql("ALTER TABLE t DROP COLUMN x")
    assert [tuple(r) for r in engine.sql("DESCRIBE t").collect()] == [("id", "bigint"), ("n", "bigint"), ("label", "string"), ("v", "array<float>")]
    assert rows(engine.sql("SELECT id, n, label FROM t")) == [(2, 7, "B"), (3, 7, "C")]
    engine.sql("ALTER TABLE t EXECUTE compact")
    assert engine.sql("ALTER TABLE t EXECUTE verify_integrity").first()[0] == 0
    assert engine.sql("MSCK REPAIR TABLE t").first()[0] == 0
    engine.sql("CREATE INDEX i ON t (label) USING bm25")
    assert rows(engine.sql("SHOW INDEXES ON t")) == [("i", "bm25", "label", True)]
    engine.sql("TRUNCATE TABLE t")
    assert rows(engine.sql("SHOW INDEXES ON t")) == [("i", "bm25", "label", False)]
    assert "truncate" in {r["operation"] for r in engine.sql("SHOW HISTORY OF t").collect()}
    with pytest.raises(dialect.SqlError):
        engine.sql("CREATE TABLE bad (a WIBBLE)")
    engine.sql("DROP TABLE t")
    with pytest.raises(dialect.SqlError):
        engine.sql("DROP TABLE t")
    engine.sql("DROP TABLE IF EXISTS t")


def test_settings_schemas_and_policies(engine):
    engine.sql("SET default_index_algorithm = 'bloom'")
    assert engine.sql("SHOW default_index_algorithm").first()["value"] == "bloom"
    with pytest.raises(dialect.SqlError):
        engine.sql("SET nonsense = 1")
    engine.sql("CREATE SCHEMA s")
    engine.sql("CREATE TABLE s.t AS SELECT 1 AS a")
    assert rows(engine.sql("SELECT a FROM s.t")) == [(1,)]
    assert ("s", "t", "a", 1, "int") in rows(engine.sql("SELECT * FROM information_schema.columns"))
    engine.read_only.add("s")
    with pytest.raises(PermissionError):
        engine.sql("DELETE FROM s.t")
    assert engine.list_graph_tables() == ["edges"]


def test_every_action_and_index_kind(engine):
    from quillrake.plans import commands

    engine.sql("CREATE TABLE a AS SELECT id, cast(id % 3 AS string) AS s, array(cast(id AS float), 1.0F) AS embedding, concat('{\"k\": ', id, '}') AS j, id AS source, id + 1 AS target FROM range(20)")
    for kind in commands.INDEX_KINDS:
        column = "embedding" if commands.INDEX_KINDS[kind] == "ivf" else "j" if kind == "json_path" else "source, target" if kind == "csr_graph" else "s"
        options = " WITH (cells = 2)" if column == "embedding" else ""
        engine.sql(f"CREATE INDEX i_{kind} ON a USING {kind} ({column}){options}")
    t = engine.table("a")
    assert len(t.state["indexes"]) == len(commands.INDEX_KINDS) and all(t.index(n) for n in t.state["indexes"])
    assert [r["id"] for r in t.json_lookup("j", "$.k", "7", "i_json_path").collect()] == [7] == [r["id"] for r in t.json_lookup("j", "$.k", "7").collect()]
    assert rows(t.edges("i_csr_graph")) == rows(t.edges())
    engine.sql("INSERT INTO a SELECT 50, 'x', array(1.0F, 1.0F), '{}', 1, 1")
    assert engine.sql("ALTER TABLE a EXECUTE recover_indexes").first()[0] == len(commands.INDEX_KINDS)
    calls = {"rollback": "(2)", "rollback_to_snapshot": "(snapshot_id => 2)", "expire_snapshots": "(retention => 50)", "remove_orphan_files": "(older_than_ms => 0)", "rebuild_cluster_index": "(column => 'embedding', k => 2)", "cluster": "('id,source', 'hilbert')"}
    for action in commands.ACTIONS:
        assert engine.sql(f"ALTER TABLE a EXECUTE {action}{calls.get(action, '')}").count() == 1
    assert engine.sql("SELECT count(*) FROM a").first()[0] == 20
    for statement in ("OPTIMIZE TABLE a", "OPTIMIZE a ZORDER BY (id, source)", "VACUUM a RETAIN 1", "COMPACT a", "EXPLAIN SELECT * FROM a", "SHOW TABLES", "SHOW SCHEMAS", "SHOW ALL", "CREATE DATABASE d", "DROP DATABASE d", "TRUNCATE TABLE a"):
        engine.sql(statement)
    for bad in ("ALTER TABLE a EXECUTE nonsense", "ALTER TABLE a EXECUTE rollback", "CREATE INDEX i ON a USING nonsense (s)", "ALTER TABLE a WIBBLE", "DROP SCHEMA nowhere"):
        with pytest.raises(dialect.SqlError):
            engine.sql(bad)


def test_merge_errors(engine, spark):
    engine.sql("CREATE TABLE m AS SELECT 1 AS k, 'x' AS v")
    engine.register("s", spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"))
    with pytest.raises(ValueError, match="several source rows"):
        engine.sql("MERGE INTO m USING s ON m.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v")
    with pytest.raises(dialect.SqlError):
        engine.sql("MERGE INTO m USING s ON m.k > s.k WHEN MATCHED THEN DELETE")


def test_subscribe_events_in_from(engine):
    engine.sql("CREATE TABLE f AS SELECT 1 AS a")
    assert rows(engine.sql("SELECT * FROM subscribe_events('f', NULL, 10, 10, 0)")) == [(1, "batch", 1)]
