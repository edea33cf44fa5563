"""Every registered query that has SQL gives the rows of its SQL; every other runs with a stable schema."""

from __future__ import annotations

import pytest

import oracle
from ebbflow import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    frame = catalogue.queries()[name](spark, SF)
    columns, rows = oracle.rows_of(frame)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows and len(set(columns)) == len(columns)
        return
    expected_columns, expected = oracle.sql_rows(con, sql)
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_removable_parts(tmp_path):
    """The entry module imports, and its other queries are there, where corpus_pipeline.py and the subpackage are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "ebbflow", tmp_path / "ebbflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
    assert [int(v) for v in done.stdout.split()] == [len(catalogue.queries()), len(catalogue.oracle_sql())]
