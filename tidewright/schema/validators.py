"""Whether a table is as declared."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewright.job.session import active_fallback
from tidewright.sources.log import Log
from tidewright.sources.names import root_of
from tidewright.sources.versioned import VersionedTable


class MigrationError(RuntimeError):
    """A table or migration that isn't as it must be."""


@dataclass
class ValidationResult:
    table: str
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def is_valid(self) -> bool:
        return not self.errors

    def raise_if_invalid(self) -> None:
        if self.errors:
            raise MigrationError(f"{self.table}: " + "; ".join(self.errors))


def describe_table(name: str, *, spark: SparkSession | None = None) -> DataFrame:
    """(name, type, nullable, comment, is_partition) of the columns of a versioned table, or of a table or view of the
    session's catalog."""
    session = active_fallback(spark)
    if Log(session, root_of(session, name)).last() is not None:
        table = VersionedTable.open(name, spark=session)
        schema, partitions = table.schema, set(table.partition_columns())
    elif session.catalog.tableExists(name):
        schema = session.table(name).schema
        partitions = {c.name for c in session.catalog.listColumns(name) if c.isPartition}
    else:
        raise LookupError(f"there is no table {name}")
    rows = [(f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("comment"), f.name in partitions) for f in schema]
    return session.createDataFrame(rows, "name string, type string, nullable boolean, comment string, is_partition boolean")


class TableValidator:
    """Compares a table's columns, partition columns (as sets), location and generated columns with what is expected."""

    def __init__(
        self, table_name: str, *, expected_columns: Iterable[str] | None = None, expected_partition_columns: Iterable[str] | None = None,
        expected_location_contains: str | None = None, expected_generated_columns: Iterable[str] | None = None, spark: SparkSession | None = None,
    ) -> None:
        self.name, self.spark = table_name, active_fallback(spark)
        self.columns, self.partitions = expected_columns, expected_partition_columns
        self.location, self.generated = expected_location_contains, expected_generated_columns

    def validate(self) -> ValidationResult:
        out = ValidationResult(self.name)
        if Log(self.spark, root_of(self.spark, self.name)).last() is not None:
            table = VersionedTable.open(self.name, spark=self.spark)
            columns, partitions, location = table.schema.names, table.partition_columns(), table.location()
            generated = table._generated_names()
        elif self.spark.catalog.tableExists(self.name):
            columns, partitions, location, generated = self.spark.table(self.name).columns, self._catalog_partitions(), None, set()
        else:
            out.errors.append("the table does not exist")
            return out
        if self.columns is not None:
            wanted = set(self.columns)
            out.errors += [f"column {c} is missing" for c in sorted(wanted - set(columns))]
            out.warnings += [f"column {c} is not expected" for c in sorted(set(columns) - wanted)]
        if self.partitions is not None and set(self.partitions) != set(partitions):
            out.errors.append(f"partitioned by {sorted(partitions)}, not {sorted(self.partitions)}")
        if self.location is not None and self.location not in (location or ""):
            out.errors.append(f"the location {location} does not hold {self.location!r}")
        if self.generated is not None:
            out.errors += [f"generated column {c} is missing" for c in sorted(set(self.generated) - generated)]
        return out

    def _catalog_partitions(self) -> list[str]:
        return [c.name for c in self.spark.catalog.listColumns(self.name) if c.isPartition]
