import __spark_entry__ as entry


def test_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "flagged_pairs" in queries


def test_flagship(spark):
    assert entry.entry(spark).count() == 26


def test_core_knows_nothing_of_the_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "veridoc"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
