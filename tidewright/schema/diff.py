"""Top-level differences of two schemas, graded by what they break."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnChange:
    column: str
    change_type: str
    old_value: str | None
    new_value: str | None
    severity: str


class SchemaDiff:
    """Changes from ``current`` to ``incoming``: added (info), removed and type_changed (breaking), nullable_changed
    (warning); each kind sorted by name. Names are compared with their case."""

    def __init__(self, current: T.StructType, incoming: T.StructType) -> None:
        self.current, self.incoming = current, incoming

    @classmethod
    def from_tables(cls, table: str, df: DataFrame) -> SchemaDiff:
        """A catalog table's schema against a frame's."""
        return cls(df.sparkSession.table(table).schema, df.schema)

    @cached_property
    def _found(self) -> list[ColumnChange]:
        old, new = ({f.name: f for f in s} for s in (self.current, self.incoming))
        kind = lambda f: f.dataType.simpleString()
        out = [ColumnChange(n, "added", None, kind(new[n]), "info") for n in sorted(new.keys() - old.keys())]
        out += [ColumnChange(n, "removed", kind(old[n]), None, "breaking") for n in sorted(old.keys() - new.keys())]
        for n in sorted(old.keys() & new.keys()):
            if old[n].dataType != new[n].dataType:
                out.append(ColumnChange(n, "type_changed", kind(old[n]), kind(new[n]), "breaking"))
            elif old[n].nullable != new[n].nullable:
                out.append(ColumnChange(n, "nullable_changed", str(old[n].nullable), str(new[n].nullable), "warning"))
        return out

    def changes(self) -> list[ColumnChange]:
        return list(self._found)

    def has_breaking_changes(self) -> bool:
        return any(c.severity == "breaking" for c in self._found)

    def summary(self) -> str:
        if not self._found:
            return "No schema changes detected."
        rows = [f"{c.column:<30}{c.change_type:<20}{c.old_value or '-':<24}{c.new_value or '-':<24}{c.severity}" for c in self._found]
        return "\n".join([f"{'column':<30}{'change':<20}{'old':<24}{'new':<24}severity", *rows])

    def to_df(self, spark: SparkSession) -> DataFrame:
        kind = "column string, change_type string, old_value string, new_value string, severity string"
        return spark.createDataFrame([(c.column, c.change_type, c.old_value, c.new_value, c.severity) for c in self._found], kind)
