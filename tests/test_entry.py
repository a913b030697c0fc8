"""The driver contract: every registered query equals its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import importlib.util
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tidewright import queries as own

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(columns: list[str], found: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([r[k] for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(name: str, spark: SparkSession, con: duckdb.DuckDBPyConnection) -> None:
    df = own.QUERIES[name](spark, SMALL)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in own.ORACLES:
        assert got
        return
    want = con.sql(own.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_entry(spark: SparkSession) -> None:
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(own.QUERIES) - set(own.ORACLES) == {"profile_approximate"}


@pytest.mark.skipif(importlib.util.find_spec("tidewright.llm") is None, reason="that subpackage was taken out")
def test_nothing_else_imports_the_training_data_operators() -> None:
    files = [p for p in (ROOT / "tidewright").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert not [p for p in files if "tidewright.llm" in p.read_text()]
    code = "import sys, tidewright.queries; sys.exit(any('tidewright.llm' in m for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
