"""Versioned tables on plain Parquet: append, overwrite, MERGE, history, restore, schema evolution, maintenance.

A version is a set of files below one data folder, so reads keep partition pruning and filter pushdown, older versions
stay readable, and readers never see half a commit. Appends that lose a race are tried again on the new version;
rewrites fail, since what they read has changed. Merges, deduplication and dimension updates rewrite only the files that
hold rows they change; the others stay as they are.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.job.metrics import MetricsSink, emit_event
from tidewright.job.session import active_fallback
from tidewright.plans import dedup as dedup_plans
from tidewright.plans import merge as plans
from tidewright.schema.diff import SchemaDiff
from tidewright.sources.log import CommitConflictError, Log, Version
from tidewright.sources.names import checked_name, forget, rename_root, root_of

Schema = T.StructType | dict[str, str]
#: Tries of a commit that may lose races.
ATTEMPTS = 20


@dataclass(frozen=True)
class GeneratedColumn:
    """A column that is computed on write."""

    name: str
    data_type: str
    expression: str
    comment: str | None = None


class SchemaGuardError(ValueError):
    """A frame that would remove columns or change types."""


def as_struct(schema: Schema) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    return T.StructType([T.StructField(n, T.DataType.fromDDL(t), True) for n, t in schema.items()])


class VersionedTable:
    """A named table; making the object creates the table if it isn't there."""

    def __init__(
        self, table_name: str, schema: Schema, location: str | None = None, partition_by: Sequence[str] | str | None = None,
        generated_columns: Sequence[GeneratedColumn] | None = None, spark: SparkSession | None = None,
    ) -> None:
        self.spark = active_fallback(spark)
        self.name, self.root = checked_name(table_name), root_of(self.spark, table_name, location)
        self.log = Log(self.spark, self.root)
        if not self.exists():
            generated = list(generated_columns or ())
            struct = as_struct(schema)
            for g in generated:
                if g.name not in struct.names:
                    struct = T.StructType([*struct.fields, T.StructField(g.name, T.DataType.fromDDL(g.data_type), True)])
            by = [partition_by] if isinstance(partition_by, str) else list(partition_by or ())
            if missing := [c for c in by if c not in struct.names]:
                raise ValueError(f"partition columns {missing} are not in the schema")
            first = Version(0, time.time(), "CREATE TABLE", struct.json(), by, {}, generated=[vars(g) for g in generated])
            try:
                self.log.commit(first)
            except CommitConflictError:
                pass  # another writer created it

    @classmethod
    def open(cls, table_name: str, location: str | None = None, spark: SparkSession | None = None) -> VersionedTable:
        """An existing table."""
        session = active_fallback(spark)
        if Log(session, root_of(session, table_name, location)).last() is None:
            raise LookupError(f"there is no table {table_name}")
        return cls(table_name, {}, location, spark=session)

    @classmethod
    def from_parquet(cls, *paths: str, table_name: str, schema: Schema, **options: Any) -> VersionedTable:
        """A table overwritten with Parquet files that are read with the declared schema."""
        table = cls(table_name, schema, **options)
        kept = [f for f in table.schema if f.name not in table._generated_names()]
        table.write(table.spark.read.schema(T.StructType(kept)).parquet(*paths), "overwrite")
        return table

    @classmethod
    def from_data(cls, data: list, *, table_name: str, schema: Schema, **options: Any) -> VersionedTable:
        """A table overwritten with rows: dicts or tuples."""
        table = cls(table_name, schema, **options)
        kept = T.StructType([f for f in table.schema if f.name not in table._generated_names()])
        table.write(table.spark.createDataFrame(data, kept), "overwrite")
        return table

    # --- reading

    @property
    def current(self) -> Version:
        last = self.log.last()
        if last is None:
            raise LookupError(f"there is no table {self.name}")
        return last

    @property
    def schema(self) -> T.StructType:
        return self.current.struct

    def exists(self) -> bool:
        return bool(self.log.numbers())

    def dataframe(self, version: int | None = None) -> DataFrame:
        """The table, or an older version of it."""
        v = self.current if version is None else self.log.read(version)
        return self._scan(v, v.files)

    def _scan(self, v: Version, names: Iterable[str], places: bool = False) -> DataFrame:
        """Rows of some files of a version; with ``places`` also the file and the row's number in it."""
        names = list(names)
        extra = [("_file", "file_path", "string"), ("_row", "row_index", "long")] if places else []
        if not names:
            return self.spark.createDataFrame([], T.StructType([*v.struct.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, _, t in extra)]))
        data = f"{self.root}/data"
        # one string crosses to the JVM, whatever the number of files
        jvm = self.spark.sparkContext._jvm
        paths = jvm.java.util.regex.Pattern.compile("\n").split("\n".join(f"{data}/{n}" for n in names))
        reader = self.spark.read.schema(v.struct).option("basePath", data)
        found = DataFrame(reader._jreader.parquet(paths), self.spark)
        return found.select(*(f"`{n}`" for n in v.struct.names), *(F.col(f"_metadata.{c}").alias(n) for n, c, _ in extra))

    def history(self, limit: int = 20) -> DataFrame:
        """Newest first: version, timestamp, operation, operation_parameters, operation_metrics, n_files."""
        rows = []
        for n in reversed(self.log.numbers()[-limit:] if limit else []):
            v = self.log.read(n)
            text = lambda d: {k: str(x) for k, x in d.items()}
            rows.append((v.version, datetime.fromtimestamp(v.timestamp, UTC), v.operation, text(v.parameters), text(v.operation_metrics), len(v.files)))
        kind = "version long, timestamp timestamp, operation string, operation_parameters map<string,string>, operation_metrics map<string,string>, n_files int"
        return self.spark.createDataFrame(rows, kind)

    def detail(self) -> DataFrame:
        row = (self.name, self.location(), self.partition_columns(), len(self.current.files), self.size_in_bytes(), dict(self.current.properties))
        return self.spark.createDataFrame([row], "name string, location string, partition_columns array<string>, num_files int, size_in_bytes long, properties map<string,string>")

    def location(self) -> str:
        return self.root

    def size_in_bytes(self) -> int:
        return sum(self.current.files.values())

    def partition_columns(self) -> list[str]:
        return list(self.current.partition_by)

    # --- writing

    def _generated_names(self) -> set[str]:
        return {g["name"] for g in self.current.generated}

    def _prepared(self, df: DataFrame, version: Version) -> DataFrame:
        """Generated columns computed or, if given, checked; columns in the table's order and types."""
        given = set(df.columns)
        for g in version.generated:
            value = F.expr(g["expression"]).cast(g["data_type"])
            if g["name"] in given:
                value = F.when(F.col(g["name"]).eqNullSafe(value), value).otherwise(
                    F.raise_error(F.lit(f"column {g['name']} is not {g['expression']}")).cast(g["data_type"])
                )
            df = df.withColumn(g["name"], value)
        return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in version.struct))

    def _store(self, df: DataFrame, version: Version, observe: dict[str, Any] | None = None) -> tuple[dict[str, int], dict[str, int]]:
        """Write rows to new files; gives the files and the observed numbers."""
        seen, folder = Observation(), f"_w={uuid.uuid4().hex}"
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in (observe or {}).items()))
        watched = watched.where(F.col(plans.ACTION) != "delete").drop(plans.ACTION) if plans.ACTION in df.columns else watched
        writer = watched.write.mode("append")
        # the folder looks like one more partition column to Spark, so files of all commits are read by one scan
        (writer.partitionBy(*version.partition_by) if version.partition_by else writer).parquet(f"{self.root}/data/{folder}")
        files = {f"{folder}/{name}": size for name, size in self.log.files.walk(f"{self.root}/data/{folder}")}
        return files, dict(seen.get)

    def write(self, df: DataFrame, mode: str = "append", *, schema_check: bool = True, merge_schema: bool = False, transaction: tuple[str, int] | None = None) -> int:
        """Append or overwrite; returns the version. A transaction (name, number) that is there already is skipped."""
        if mode not in ("append", "overwrite"):
            raise ValueError(f"mode is append or overwrite, not {mode!r}")
        now = self.current
        if transaction and now.transactions.get(transaction[0], -1) >= transaction[1]:
            return now.version
        if schema_check:
            diff = SchemaDiff(T.StructType([f for f in now.struct if f.name not in self._generated_names() or f.name in df.columns]), df.schema)
            if diff.has_breaking_changes():
                raise SchemaGuardError(f"{self.name} refuses the frame:\n{diff.summary()}")
        if merge_schema:
            new = [T.StructField(f.name, f.dataType, True) for f in df.schema if f.name not in now.struct.names]
            now = now if not new else now.next("ADD COLUMNS", schema=T.StructType([*now.struct.fields, *new]).json(), version=now.version)
        files, seen = self._store(self._prepared(df, now), now)
        extra = {"transactions": now.transactions | dict([transaction])} if transaction else {}
        return self._commit(now, "WRITE", files, seen, {"mode": mode}, replace_all=mode == "overwrite", retry=mode == "append", **extra)

    def _commit(
        self, base: Version, operation: str, files: dict[str, int], metrics: dict[str, int], parameters: dict[str, Any], *, replace_all: bool, retry: bool = False,
        replace: Iterable[str] = (), **extra: Any,
    ) -> int:
        """Add files to those of ``base``, less ``replace`` or all of them. With ``retry`` a lost race is tried again on the
        new version, ``ATTEMPTS`` times at most."""
        gone = set(replace)
        for attempt in range(ATTEMPTS):
            kept = {} if replace_all else {n: size for n, size in base.files.items() if n not in gone}
            try:
                return self.log.commit(base.next(operation, files=kept | files, operation_metrics=metrics, parameters=parameters, **extra)).version
            except CommitConflictError:
                now = self.current
                if not retry or now.schema != base.schema or attempt == ATTEMPTS - 1:
                    raise
                if now.version == base.version:  # its commit isn't to be seen yet
                    time.sleep(min(1.0, 0.01 * 2**attempt))
                base = now
                if "transactions" in extra:
                    extra["transactions"] = now.transactions | extra["transactions"]
        raise AssertionError("not reached")

    def rewrite(
        self, df: DataFrame, operation: str, parameters: dict[str, Any] | None = None, base: Version | None = None, replace: Iterable[str] | None = None
    ) -> dict[str, int]:
        """Replace all rows (or those of the files ``replace``) by those of ``df``, which may carry ``_action`` marks and may
        read this table."""
        base = base or self.current
        observe = {}
        if plans.ACTION in df.columns:
            observe = {f"rows_{n}": F.count_if(F.col(plans.ACTION) == a) for a, n in (("insert", "inserted"), ("update", "updated"), ("delete", "deleted"))}
            marks = df.select(plans.ACTION).schema
            ready = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in base.struct), *marks.names)
        else:
            ready = self._prepared(df, base)
        files, seen = self._store(ready, base, observe)
        self._commit(base, operation, files, seen, parameters or {}, replace_all=replace is None, replace=replace or ())
        return seen

    def _named(self, base: Version, found: DataFrame) -> list[str]:
        """Files of a version by the paths in the column ``_file``; as many rows at most as there are files."""
        return self._among(base, (r["_file"] for r in found.select("_file").distinct().collect()))

    def _among(self, base: Version, paths: Iterable[str]) -> list[str]:
        names = {unquote(x).rpartition("/data/")[2] for x in paths}
        return [n for n in base.files if n in names]

    def restore(self, version: int) -> int:
        """Make an older version current again, as a new version."""
        if version not in self.log.numbers():
            raise ValueError(f"{self.name} has no version {version}")
        old, now = self.log.read(version), self.current
        if gone := [n for n in old.files if n not in now.files and not self.log.files.exists(f"{self.root}/data/{n}")]:
            raise ValueError(f"{len(gone)} files of version {version} were vacuumed")
        changes = {"files": old.files, "schema": old.schema, "partition_by": old.partition_by, "generated": old.generated, "properties": old.properties}
        return self.log.commit(now.next("RESTORE", parameters={"version": version}, **changes)).version

    def restore_to_timestamp(self, when: datetime) -> int:
        """Restore the last version that was committed until ``when`` (naive times are UTC)."""
        at = (when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp()
        fitting = [n for n in self.log.numbers() if self.log.read(n).timestamp <= at]
        if not fitting:
            raise ValueError(f"{self.name} has no version from {when} or before")
        return self.restore(fitting[-1])

    def replace_data(self, replacement: str, recovery: str) -> None:
        """The table ``replacement`` takes this one's name; the old data go by the name ``recovery``."""
        new = root_of(self.spark, checked_name(replacement))
        rename_root(self.spark, recovery, self.root)
        rename_root(self.spark, self.name, new)
        forget(self.spark, replacement)
        self.root, self.log = new, Log(self.spark, new)

    def drop(self) -> None:
        self.log.files.delete(self.root)
        forget(self.spark, self.name)

    # --- merging

    def merge(self, source: DataFrame, *, metrics_sink: MetricsSink | None = None) -> MergeBuilder:
        return MergeBuilder(self, source, metrics_sink=metrics_sink)

    def upsert(self, source: DataFrame, keys: Sequence[str], *, update_columns: Sequence[str] | None = None, metrics_sink: MetricsSink | None = None) -> MergeResult:
        return self.merge(source, metrics_sink=metrics_sink).on(*keys).when_matched_update(update_columns).when_not_matched_insert().execute()

    def scd_type2(
        self, source: DataFrame, keys: Sequence[str], *, effective_date_col: str = "effective_date", end_date_col: str = "end_date", active_col: str = "is_active",
        as_of: datetime | None = None, reinsert: bool = True, only_changes: bool = False, metrics_sink: MetricsSink | None = None,
    ) -> MergeResult:
        """Expire active rows of the source's keys and insert the source's rows; see :func:`plans.merge.scd2_df`."""
        base, began = self.current, time.time()
        placed = self._scan(base, base.files, places=True)
        hit = placed.where(F.col(active_col)).join(source.select(*keys).distinct(), list(keys), "left_semi")
        names = self._named(base, hit)
        merged = plans.scd2_df(
            self._scan(base, names), source, keys, as_of=as_of, reinsert=reinsert, only_changes=only_changes, effective_date_col=effective_date_col,
            end_date_col=end_date_col, active_col=active_col,
        )
        seen = self.rewrite(merged, "SCD2", {"keys": list(keys)}, base, replace=names)
        return _merge_result(self, seen, began, metrics_sink)


@dataclass(frozen=True)
class MergeResult:
    rows_inserted: int
    rows_updated: int
    rows_deleted: int


def _merge_result(table: VersionedTable, seen: dict[str, int], began: float, sink: MetricsSink | None) -> MergeResult:
    result = MergeResult(*(seen.get(f"rows_{n}", 0) for n in ("inserted", "updated", "deleted")))
    metadata = {"rows_inserted": result.rows_inserted, "rows_updated": result.rows_updated, "rows_deleted": result.rows_deleted}
    emit_event(sink, "merge", "merge_complete", (time.time() - began) * 1000, result.rows_inserted + result.rows_updated, table.name, metadata)
    return result


class MergeBuilder:
    """Collects clauses; :meth:`execute` runs one plan and one commit."""

    def __init__(self, target: VersionedTable | str, source: DataFrame, spark: SparkSession | None = None, *, metrics_sink: MetricsSink | None = None) -> None:
        self.table = VersionedTable.open(target, spark=spark) if isinstance(target, str) else target
        self.source, self.sink = source, metrics_sink
        self.keys: list[str] = []
        self.condition: str | None = None
        self.clauses: list[plans.Clause] = []

    def on(self, *keys: str) -> MergeBuilder:
        self.keys = list(keys)
        return self

    def on_condition(self, condition: str) -> MergeBuilder:
        """Replaces the keys; ``target`` and ``source`` are the sides' names."""
        self.condition = condition
        return self

    def _with(self, clause: plans.Clause) -> MergeBuilder:
        self.clauses.append(clause)
        return self

    def when_matched_update(self, columns: Sequence[str] | None = None) -> MergeBuilder:
        return self._with(plans.Clause("update", columns))

    def when_matched_delete(self, condition: str | None = None) -> MergeBuilder:
        return self._with(plans.Clause("delete", condition=condition))

    def when_not_matched_insert(self, columns: Sequence[str] | None = None) -> MergeBuilder:
        return self._with(plans.Clause("insert", columns))

    def when_not_matched_by_source_delete(self, condition: str | None = None) -> MergeBuilder:
        return self._with(plans.Clause("orphan_delete", condition=condition))

    def when_matched_soft_delete(self, *, deleted_col: str = "is_deleted", deleted_at_col: str | None = "deleted_at", condition: str | None = None) -> MergeBuilder:
        return self._with(plans.soft_delete_clause(deleted_col, deleted_at_col, condition))

    def execute(self) -> MergeResult:
        if not self.keys and not self.condition:
            raise ValueError("name keys with on(), or a condition with on_condition()")
        if not self.clauses:
            raise ValueError("a merge needs a clause")
        table, began = self.table, time.time()
        base, on = table.current, self.condition or plans.key_condition(self.keys)
        source = self.source.persist()  # read by the search for files and by the merge
        try:
            found = plans.touched(table._scan(base, base.files, places=True), source, self.clauses, on, ["_file", "_row"], "_file").collect()
            if any(r["most"] > 1 for r in found) and not plans.deletes_only(self.clauses):
                raise plans.MergeConflictError(f"several source rows match one row of {table.name}")
            names = table._among(base, (r["_file"] for r in found))
            whole = len(names) == len(base.files)
            merged = plans.merge_df(
                table._scan(base, names), source, self.clauses, keys=self.keys, condition=self.condition, insert_against=None if whole else table._scan(base, base.files)
            )
            seen = table.rewrite(merged, "MERGE", {"clauses": [c.kind for c in self.clauses]}, base, replace=names)
        finally:
            source.unpersist()
        return _merge_result(table, seen, began, self.sink)


class TableAppender(VersionedTable):
    def append(self, df: DataFrame) -> int:
        return self.write(df, "append")


class TableOverwriter(VersionedTable):
    def overwrite(self, df: DataFrame) -> int:
        return self.write(df, "overwrite")


# --- deduplication --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class DedupResult:
    rows_removed: int
    rows_remaining: int


def _table(table: VersionedTable | str, spark: SparkSession | None) -> VersionedTable:
    return VersionedTable.open(table, spark=spark) if isinstance(table, str) else table


def _deduped(
    table: VersionedTable, groups: Callable[[DataFrame], DataFrame], columns: Sequence[str], plan: Callable[[DataFrame, DataFrame], DataFrame], operation: str,
    sink: MetricsSink | None,
) -> DedupResult:
    """Rewrite the files that hold rows of ``groups``; none, and nothing is committed."""
    began, base = time.time(), table.current
    total = table.dataframe(base.version).count()  # from file footers
    placed = table._scan(base, base.files, places=True)
    found = groups(placed).persist()
    try:
        same = F.lit(True)
        for c in columns:
            same = same & F.col(f"p.`{c}`").eqNullSafe(F.col(f"g.`{c}`"))
        names = table._named(base, placed.alias("p").join(found.alias("g"), same, "left_semi"))
        removed = 0
        if names:
            target = table._scan(base, names)
            before = target.count()
            removed = before - table.rewrite(plan(target, found), operation, base=base, replace=names)["rows"]
    finally:
        found.unpersist()
    result = DedupResult(removed, total - removed)
    emit_event(sink, "dedup", "dedup_complete", (time.time() - began) * 1000, result.rows_removed, table.name, {"rows_remaining": result.rows_remaining})
    return result


def kill_duplicates(table: VersionedTable | str, columns: Sequence[str], *, spark: SparkSession | None = None, metrics_sink: MetricsSink | None = None) -> DedupResult:
    """Remove all rows of groups that hold several; groups with a NULL stay."""
    columns = dedup_plans.named(columns, "columns")
    whole = lambda df: dedup_plans.repeated_keys(df.dropna(subset=columns), columns)
    return _deduped(_table(table, spark), whole, columns, lambda df, found: dedup_plans.kill_duplicates_df(df, columns, found), "KILL DUPLICATES", metrics_sink)


def drop_duplicates_pkey(
    table: VersionedTable | str, pkey: Sequence[str] | str, columns: Sequence[str], *, by_key: bool = False, spark: SparkSession | None = None,
    metrics_sink: MetricsSink | None = None,
) -> DedupResult:
    """Keep the row with the smallest key (of one column or several) of each group."""
    own = _table(table, spark)
    pkey, columns = dedup_plans.named(pkey, "primary key"), dedup_plans.named(columns, "columns")
    if by_key:  # rows of any file may share a key with one that goes
        began, base = time.time(), own.current
        target = own.dataframe(base.version)
        total = target.count()
        left = own.rewrite(dedup_plans.drop_duplicates_pkey_df(target, pkey, columns, by_key=True), "DROP DUPLICATES", base=base)["rows"]
        emit_event(metrics_sink, "dedup", "dedup_complete", (time.time() - began) * 1000, total - left, own.name, {"rows_remaining": left})
        return DedupResult(total - left, left)
    least = lambda df: dedup_plans.least_keys(df, pkey, columns)
    return _deduped(own, least, columns, lambda df, found: dedup_plans.drop_duplicates_pkey_df(df, pkey, columns, least=found), "DROP DUPLICATES", metrics_sink)


def append_without_duplicates(
    table: VersionedTable | str, df: DataFrame, keys: Sequence[str], *, spark: SparkSession | None = None, metrics_sink: MetricsSink | None = None
) -> int:
    """Append rows whose keys are new; returns their number. Where another writer commits meanwhile, the rows are looked
    for again in its version."""
    began, found = time.time(), _table(table, spark)
    keys = dedup_plans.named(keys, "keys")
    for attempt in range(ATTEMPTS):
        base = found.current
        new = dedup_plans.new_rows_df(found.dataframe(base.version), df, keys)
        files, seen = found._store(found._prepared(new, base), base)
        try:
            found._commit(base, "APPEND NEW", files, seen, {"keys": keys}, replace_all=False, retry=False)
            break
        except CommitConflictError:
            for n in files:
                found.log.files.delete(f"{found.root}/data/{n}")
            if attempt == ATTEMPTS - 1:
                raise
    emit_event(metrics_sink, "dedup", "dedup_complete", (time.time() - began) * 1000, seen["rows"], found.name, {"rows_inserted": seen["rows"]})
    return seen["rows"]


# --- maintenance ----------------------------------------------------------------------------------------------------

TARGET_FILE_BYTES = 128 << 20
#: Bits of each column in a Z-order value.
Z_BITS = 6


def _z_value(df: DataFrame, columns: Sequence[str]) -> Column:
    """Bits of the columns' ranks in turn. A rank is that of the value among ``1 << Z_BITS`` quantiles; of text, of its
    first seven bytes as a number."""
    numbers = []
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            head = F.rpad(F.substring(F.encode(F.col(f"`{c}`"), "UTF-8"), 1, 7), 7, F.lit(bytearray(1)))
            numbers.append(F.conv(F.hex(head), 16, 10).cast("double"))
        elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            numbers.append(F.col(f"`{c}`").cast("timestamp").cast("double"))
        else:
            numbers.append(F.col(f"`{c}`").cast("double"))
    steps = [k / (1 << Z_BITS) for k in range(1, 1 << Z_BITS)]
    row = df.agg(*(F.percentile_approx(n, steps, 10_000).alias(f"q{k}") for k, n in enumerate(numbers))).first()

    def rank_of(quantiles: list[float], value: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, quantiles)), lambda q: q < value))

    ranks = [rank_of(row[f"q{k}"] or [0.0], n) for k, n in enumerate(numbers)]
    out = F.lit(0).cast("long")
    for bit in reversed(range(Z_BITS)):
        for rank in ranks:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(F.coalesce(rank, F.lit(0)), bit).bitwiseAND(F.lit(1)).cast("long"))
    return out


def optimize_table(name: VersionedTable | str, *, zorder_by: Sequence[str] | str | None = None, spark: SparkSession | None = None) -> int:
    """Rewrite small files as fewer large ones; rows go along a Z-order curve of ``zorder_by`` (one column: in its order),
    so that filters on any of the columns skip files and row groups."""
    table = _table(name, spark)
    base = table.current
    n = max(1, round(table.size_in_bytes() / TARGET_FILE_BYTES))
    columns = [zorder_by] if isinstance(zorder_by, str) else list(zorder_by or ())
    if missing := [c for c in columns if c not in base.struct.names]:
        raise ValueError(f"columns {missing} are not in the schema")
    df = table.dataframe(base.version)
    if len(columns) == 1:
        df = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    elif columns:
        df = df.withColumn("_z", _z_value(df, columns)).repartitionByRange(n, "_z").sortWithinPartitions("_z").drop("_z")
    else:
        df = df.repartition(n)  # no key, so no partition value is hot
    files, seen = table._store(df, base)
    return table._commit(base, "OPTIMIZE", files, seen, {"zorder_by": columns}, replace_all=True)


def vacuum_table(name: VersionedTable | str, *, retention_hours: float = 168, spark: SparkSession | None = None) -> int:
    """Delete files that no version within the retention (nor the current one) names; returns their number."""
    table = _table(name, spark)
    numbers = table.log.numbers()
    oldest = time.time() - retention_hours * 3600
    kept: set[str] = set(table.current.files)
    for a, b in zip(numbers, numbers[1:], strict=False):
        if table.log.read(b).timestamp >= oldest:  # version a was current within the retention
            kept.update(table.log.read(a).files)
    stale = [n for n, _ in table.log.files.walk(f"{table.root}/data") if n not in kept]
    for n in stale:
        table.log.files.delete(f"{table.root}/data/{n}")
    return len(stale)


def analyze_table(name: VersionedTable | str, *, columns: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    """Row count and, for named columns, distinct and null counts; kept as table properties."""
    if isinstance(name, str) and Log(active_fallback(spark), root_of(active_fallback(spark), name)).last() is None:
        session = active_fallback(spark)
        session.sql(f"ANALYZE TABLE {checked_name(name)} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(f'`{c}`' for c in columns)}" if columns else ""))
        return {}
    table = _table(name, spark)
    wanted = {"stats.rows": F.count(F.lit(1))}
    for c in columns or ():
        wanted |= {f"stats.{c}.distinct": F.approx_count_distinct(c), f"stats.{c}.nulls": F.count_if(F.col(c).isNull())}
    row = table.dataframe().agg(*(v.alias(k) for k, v in wanted.items())).first()
    found = {k: str(row[k]) for k in wanted}
    base = table.current
    table.log.commit(base.next("ANALYZE", properties=base.properties | found))
    return found
