"""Each query against its SQL in DuckDB at the smallest scale, and that the entry point stands without the optional parts."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from linkwright import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    own = duckdb.connect()
    for t in TABLES:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return own


def plain(value):
    if pd.isna(value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return round(float(value), 5) + 0.0 if isinstance(value, (int, float)) else value


def table(pdf):
    return sorted((tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    ours, theirs = catalog.queries()[name](spark, sf).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert table(ours) == table(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_stands_without_the_optional_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parents[1]
    shutil.copytree(root / "linkwright", tmp_path / "linkwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]
