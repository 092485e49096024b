import __spark_entry__ as entry_point


def test_flagship_has_a_stable_schema(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["vec_id", "distance"]
    assert df.count() == 10


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_nothing_else_imports_the_training_data_operators():
    import pathlib

    root = pathlib.Path(entry_point.HERE) / "quillrake"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quillrake.llm" not in p.read_text() and "from .llm" not in p.read_text()
