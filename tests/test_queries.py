"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import pytest

from graphloom.plans import driver_tables

from .conftest import DATA


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def same_rows(df, relation):
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    got = sorted(repr([plain(row[c]) for c in columns]) for row in df.collect())
    want = sorted(repr([plain(row[i]) for i in order]) for row in relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(driver_tables.QUERIES))
def test_query_matches_sql(spark, duck, name):
    same_rows(driver_tables.QUERIES[name](spark, str(DATA)), duck.sql(driver_tables.SQL[name]))


def test_entry(spark):
    import __spark_entry__

    assert sorted(__spark_entry__.entry(spark).columns) == ["degree", "id", "kind"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_know_the_optional_subpackage():
    from pathlib import Path

    root = Path(driver_tables.__file__).resolve().parent.parent
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert "llm" not in file.read_text(), file
