import __spark_entry__ as entry
from filingweave.plans import registry


def test_entry_and_names(spark):
    assert entry.entry(spark).limit(1).count() == 1
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.QUERIES) <= set(queries)


def test_core_queries_run(spark, sf):
    for name, query in registry.QUERIES.items():
        assert query(spark, sf).columns, name


def test_core_does_not_import_llm():
    import pathlib

    import filingweave

    root = pathlib.Path(filingweave.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "filingweave.llm" not in path.read_text()
