"""Every registered query beside its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    base = duckdb.connect()
    for table in TABLES:
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return base


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    assert len(ours)
    if name in entry.oracle_sql():
        theirs = sql.execute(entry.oracle_sql()[name]).fetchdf()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows_of(ours) == rows_of(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_workers_need_no_installed_package(tmp_path):
    """A driver started elsewhere, whose Python workers cannot import the package."""
    import os
    import subprocess
    import sys

    script = tmp_path / "driver.py"
    script.write_text(
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('entry', {entry.__file__!r})\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "from quillvec.session import build_session\n"
        "spark = build_session('elsewhere', 2)\n"
        "print('rows', m.entry(spark).count(), m.queries()['answer_prompts'](spark, '" + SF + "').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 2369 40" in done.stdout, done.stderr[-2000:]
