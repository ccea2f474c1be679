from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")


def shown(value):
    return str(value.replace(tzinfo=None)) if hasattr(value, "tzinfo") else repr(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(shown(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(data).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def names():
    from paperloom.plans import catalogue

    return sorted(catalogue.ORACLES)


@pytest.mark.parametrize("name", names())
def test_queries_give_what_their_sql_gives(spark, data, db, name):
    from paperloom.plans import catalogue

    df = catalogue.QUERIES[name](spark, data)
    found = db.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


def test_every_other_query_runs(spark, data):
    from paperloom.plans import catalogue

    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)):
        df = catalogue.QUERIES[name](spark, data)
        assert df.count() > 0, name
        assert len(set(df.columns)) == len(df.columns)


def test_entry(spark, data):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_the_core_does_not_know_the_llm_package():
    import ast

    root = Path(__file__).resolve().parent.parent / "paperloom"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n for n in names), path
