"""Every registered query against its SQL in DuckDB, on whole small tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from loregrid.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base(small):
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return found


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, base, small, name):
    found = registry.QUERIES[name](spark, small)
    columns = sorted(found.columns)
    rows = sorted(tuple(map(plain, r)) for r in found.select(*columns).collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = base.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_all_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_other_module_imports_the_optional_subpackage():
    from pathlib import Path

    package = Path(registry.__file__).parents[1]
    for path in package.rglob("*.py"):
        if "llm" not in path.relative_to(package).parts:
            assert not re.search(r"(?m)^\s*(?:from|import)\b.*\bllm\b", path.read_text()), path
