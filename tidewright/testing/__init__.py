"""Builders, assertions, mocks and fixtures for tests of jobs."""

from __future__ import annotations

import random
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.testing import assertDataFrameEqual

from tidewright.job.session import active_fallback
from tidewright.sources.versioned import Schema, VersionedTable

#: Other names of types, beside Spark's own.
ALIASES = {"integer": "int", "long": "bigint", "short": "smallint"}


class DataFrameBuilder:
    """Rows for tests, step by step."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = active_fallback(spark)
        self.schema: T.StructType | None = None
        self.rows: list[list[Any]] = []

    def with_columns(self, **types: str) -> DataFrameBuilder:
        return self.with_schema(T.StructType([T.StructField(n, T.DataType.fromDDL(ALIASES.get(t, t))) for n, t in types.items()]))

    def with_schema(self, schema: T.StructType) -> DataFrameBuilder:
        self.schema = schema
        return self

    def with_rows(self, *rows: Sequence[Any]) -> DataFrameBuilder:
        self.rows += [list(r) for r in rows]
        return self

    def with_sequential(self, column: str, count: int, start: int = 1) -> DataFrameBuilder:
        """``count`` rows that number one column; the others are NULL."""
        names = self._known().names
        self.rows += [[start + k if n == column else None for n in names] for k in range(count)]
        return self

    def with_nulls(self, column: str, frequency: float, seed: int = 0) -> DataFrameBuilder:
        """NULL in a share of the rows so far."""
        at, chance = self._known().names.index(column), random.Random(seed)
        for row in self.rows:
            if chance.random() < frequency:
                row[at] = None
        return self

    def _known(self) -> T.StructType:
        if self.schema is None:
            raise ValueError("the builder has no schema yet")
        return self.schema

    def build(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r) for r in self.rows], self._known())


class TempTable:
    """A versioned table that is dropped at the end of a with block."""

    def __init__(self, schema: Schema, data: list | None = None, *, name: str | None = None, spark: SparkSession | None = None, **options: Any) -> None:  # noqa: ANN401
        self.schema, self.data, self.options = schema, data, options
        self.name, self.spark = name or f"tmp_{uuid.uuid4().hex[:12]}", spark

    def __enter__(self) -> VersionedTable:
        self.table = VersionedTable(self.name, self.schema, f"{tempfile.mkdtemp()}/{self.name}", spark=self.spark, **self.options)
        if self.data:
            self.table.write(self.table.spark.createDataFrame(self.data, self.table.schema), "overwrite")
        return self.table

    def __exit__(self, *exc: object) -> None:
        if hasattr(self, "table"):
            self.table.drop()


def assert_schema_equal(actual: T.StructType, expected: T.StructType, *, check_nullable: bool = False) -> None:
    """The same fields in the same order."""
    shape = lambda s: [(f.name, f.dataType.simpleString(), *([f.nullable] if check_nullable else [])) for f in s]
    if shape(actual) != shape(expected):
        raise AssertionError(f"schemas differ:\n  {shape(actual)}\n  {shape(expected)}")


def assert_frame_equal(actual: DataFrame, expected: DataFrame, *, check_order: bool = False, check_schema: bool = True, check_nullable: bool = False) -> None:
    """The same rows, in any order unless it counts."""
    if check_schema:
        assert_schema_equal(actual.schema, expected.schema, check_nullable=check_nullable)
    assertDataFrameEqual(actual, expected, checkRowOrder=check_order, ignoreNullable=True)


class _Secrets:
    def __init__(self) -> None:
        self.values: dict[tuple[str, str], str] = {}

    def put(self, scope: str, key: str, value: str) -> None:
        self.values[scope, key] = value

    def get(self, scope: str, key: str) -> str:
        if (scope, key) not in self.values:
            raise KeyError(f"no secret {scope}/{key}")
        return self.values[scope, key]


class _Fs:
    def __init__(self) -> None:
        self.calls: list[tuple[str, tuple]] = []

    def __getattr__(self, name: str):  # noqa: ANN204
        if name.startswith("__"):
            raise AttributeError(name)

        def call(*args: Any) -> Any:  # noqa: ANN401
            self.calls.append((name, args))
            return [] if name == "ls" else True

        return call


class MockDBUtils:
    """Secrets in memory, and a file system that records its calls."""

    def __init__(self) -> None:
        self.secrets, self.fs = _Secrets(), _Fs()


class MockDBUtilsModule:
    """What ``inject_dbutils`` takes."""

    def __init__(self) -> None:
        self.instance = MockDBUtils()

    def DBUtils(self, spark: SparkSession | None = None) -> MockDBUtils:  # noqa: N802
        return self.instance


@pytest.fixture(scope="session")
def spark_session() -> Iterator[SparkSession]:
    """One session for all tests."""
    spark = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark


@pytest.fixture
def spark_session_function(spark_session: SparkSession) -> Iterator[SparkSession]:
    """The session, without temporary views and tables after the test."""
    yield spark_session
    for t in spark_session.catalog.listTables():
        spark_session.catalog.dropTempView(t.name) if t.isTemporary else spark_session.sql(f"DROP TABLE IF EXISTS {t.name}")


@pytest.fixture(autouse=True)
def clear_env(monkeypatch: pytest.MonkeyPatch) -> None:
    """No environment name from outside."""
    for name in ("ENV", "ENVIRONMENT", "LOG_LEVEL"):
        monkeypatch.delenv(name, raising=False)


@pytest.fixture
def df_builder(spark_session: SparkSession) -> DataFrameBuilder:
    return DataFrameBuilder(spark_session)


@pytest.fixture
def temp_table(spark_session: SparkSession):  # noqa: ANN201
    """Makes temporary tables and drops them all at the end."""
    made: list[TempTable] = []

    def make(schema: Schema, data: list | None = None, **options: Any) -> VersionedTable:  # noqa: ANN401
        made.append(TempTable(schema, data, spark=spark_session, **options))
        return made[-1].__enter__()

    yield make
    for t in made:
        t.__exit__()
