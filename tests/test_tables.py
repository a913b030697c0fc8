"""Versioned tables: writes, history, merges, evolution, maintenance, migrations, validation."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidewright.job.metrics import CompositeMetricsSink, MetricEvent, MetricsSink, TableMetricsSink
from tidewright.plans.merge import MergeConflictError
from tidewright.schema.alter import TableAlter
from tidewright.schema.diff import SchemaDiff
from tidewright.schema.migrations import MigrationRunner, MigrationStep
from tidewright.schema.validators import MigrationError, TableValidator
from tidewright.sources import versioned as v
from tidewright.sources.log import CommitConflictError
from tidewright.sources.maintenance import MaintenanceRunner

KIND = {"id": "int", "name": "string", "value": "int"}
ROWS = [(1, "a", 100), (2, "b", 200), (3, "c", 300)]


def content(table: v.VersionedTable) -> set:
    return {tuple(r) for r in table.dataframe().collect()}


class Sink(MetricsSink):
    def __init__(self) -> None:
        self.events: list[MetricEvent] = []

    def emit(self, event: MetricEvent) -> None:
        self.events.append(event)


def test_write_history_restore(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table(KIND)
    assert table.dataframe().count() == 0 and table.exists()
    first = table.write(spark.createDataFrame(ROWS, "id int, name string, value int"))
    time.sleep(0.01)
    between = datetime.now(UTC)
    time.sleep(0.01)
    table.write(table.dataframe().where("id = 1"), "overwrite")  # reads what it overwrites
    assert content(table) == {ROWS[0]} and table.dataframe(first).count() == 3
    table.restore(first)
    assert content(table) == set(ROWS)
    table.write(spark.createDataFrame([(9, "z", 1)], "id int, name string, value int"))
    table.restore_to_timestamp(between)
    assert content(table) == set(ROWS)
    ops = [(r["version"], r["operation"]) for r in table.history(3).collect()]
    assert ops == [(5, "RESTORE"), (4, "WRITE"), (3, "RESTORE")] and table.history(0).count() == 0
    with pytest.raises(ValueError):
        table.restore(77)
    with pytest.raises(ValueError):
        table.restore_to_timestamp(datetime(2000, 1, 1))
    detail = table.detail().first()
    assert detail["size_in_bytes"] == table.size_in_bytes() > 0 and detail["location"] == table.location()


def test_guards(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table(KIND, ROWS)
    for bad in (spark.createDataFrame([(1, "a")], "id int, name string"), spark.createDataFrame([("1", "a", 1)], "id string, name string, value int")):
        with pytest.raises(v.SchemaGuardError):
            table.write(bad)
    table.write(spark.createDataFrame([(4, "d", 1, "more")], "id int, name string, value int, extra string"))
    assert table.dataframe().columns == list(KIND)
    table.write(spark.createDataFrame([(5, "e", 1, "more")], "id int, name string, value int, extra string"), merge_schema=True)
    assert {r["extra"] for r in table.dataframe().collect()} == {None, "more"}
    with pytest.raises(ValueError):
        table.write(table.dataframe(), "ignore")
    for name in ("a;b", "a--b", "a/*b", ""):
        with pytest.raises(ValueError):
            v.VersionedTable(name, KIND, spark=spark)
    with pytest.raises(LookupError):
        v.VersionedTable.open("no_such_table", spark=spark)
    with pytest.raises(ValueError):
        temp_table(KIND, partition_by="gone")


def test_partitions_are_pruned(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table(KIND, ROWS, partition_by="name")
    plan = table.dataframe().where("name = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(name" in plan and table.partition_columns() == ["name"]


def test_generated(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table({"id": "int", "ts": "timestamp"}, generated_columns=[v.GeneratedColumn("day", "date", "CAST(ts AS DATE)")])
    ts = datetime(2024, 5, 6, 7)
    table.write(spark.createDataFrame([(1, ts)], "id int, ts timestamp"))
    assert str(table.dataframe().first()["day"]) == "2024-05-06"
    table.write(spark.createDataFrame([(2, ts, ts.date())], "id int, ts timestamp, day date"))
    with pytest.raises(Exception, match="is not CAST"):
        table.write(spark.createDataFrame([(3, ts, datetime(2000, 1, 1).date())], "id int, ts timestamp, day date"))
    assert table.dataframe().count() == 2


def test_a_lost_race_is_tried_again_for_appends_only(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table(KIND, ROWS)
    base = table.current
    table.write(spark.createDataFrame([(7, "g", 7)], "id int, name string, value int"))
    files, seen = table._store(spark.createDataFrame([(8, "h", 8)], "id int, name string, value int"), base)
    table._commit(base, "WRITE", files, seen, {}, replace_all=False, retry=True)
    assert table.dataframe().count() == 5
    with pytest.raises(CommitConflictError):
        table._commit(base, "MERGE", files, seen, {}, replace_all=True)


def test_transactions_are_written_once(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table(KIND)
    df = spark.createDataFrame(ROWS, "id int, name string, value int")
    for batch in (0, 0, 1, 0):
        table.write(df, transaction=("stream", batch))
    assert table.dataframe().count() == 6


def test_merges(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table, sink = temp_table(KIND, ROWS), Sink()
    source = spark.createDataFrame([(2, "B", 20), (4, "D", 40)], "id int, name string, value int")
    assert table.upsert(source, ["id"], metrics_sink=sink) == v.MergeResult(1, 1, 0)
    assert content(table) == {(1, "a", 100), (2, "B", 20), (3, "c", 300), (4, "D", 40)}
    assert (sink.events[0].event_type, sink.events[0].row_count) == ("merge_complete", 2)
    assert table.merge(source).on("id").when_matched_update(["value"]).when_not_matched_by_source_delete().execute() == v.MergeResult(0, 2, 2)
    with pytest.raises(ValueError):
        table.merge(source).when_matched_update().execute()
    with pytest.raises(ValueError):
        table.merge(source).on("id").execute()
    with pytest.raises(MergeConflictError):
        table.upsert(source.union(source), ["id"])
    assert table.merge(source.union(source)).on("id").when_matched_delete().execute().rows_deleted == 2
    assert v.MergeBuilder(table.name, source, spark).on("id").when_not_matched_insert().execute().rows_inserted == 2


def test_scd2(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    kind = "id int, name string, effective_date timestamp, end_date timestamp, is_active boolean"
    table = temp_table(T.StructType.fromDDL(kind), [(1, "a", datetime(2024, 1, 1), None, True)])
    result = table.scd_type2(spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string"), ["id"], as_of=datetime(2024, 2, 1))
    assert result == v.MergeResult(2, 1, 0)
    assert {(r["name"], r["is_active"]) for r in table.dataframe().collect()} == {("a", False), ("A", True), ("B", True)}


def test_dedup(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    data = [(1, "x", 1), (2, "x", 1), (3, "y", 2), (4, "x", 1), (5, "y", 2)]
    table, sink = temp_table(KIND, [*data, (6, "z", 9)]), Sink()
    assert v.drop_duplicates_pkey(table, "id", ["name", "value"], metrics_sink=sink) == v.DedupResult(3, 3)
    assert {r[0] for r in content(table)} == {1, 3, 6}
    table = temp_table(KIND, [*data[:4], (6, "z", 9)])
    assert v.kill_duplicates(table, ["name", "value"], metrics_sink=sink) == v.DedupResult(3, 2)
    new = spark.createDataFrame([(3, "other", 0), (7, "n", 0), (7, "m", 0)], "id int, name string, value int")
    assert v.append_without_duplicates(table, new, ["id"], metrics_sink=sink) == 2
    assert [e.event_type for e in sink.events] == ["dedup_complete"] * 3


def test_loading(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    spark.createDataFrame(ROWS, "id int, name string, value int").write.parquet(str(tmp_path / "in"))
    table = v.VersionedTable.from_parquet(str(tmp_path / "in"), table_name="loaded", schema=KIND, location=str(tmp_path / "loaded"), spark=spark)
    assert content(table) == set(ROWS)
    rows = [{"id": 1, "name": "q", "value": 2}]
    assert content(v.VersionedTable.from_data(rows, table_name="made", schema=KIND, location=str(tmp_path / "made"), spark=spark)) == {(1, "q", 2)}
    v.TableAppender("made", KIND, spark=spark).append(table.dataframe())
    assert v.VersionedTable.open("made", spark=spark).dataframe().count() == 4
    v.TableOverwriter("made", KIND, spark=spark).overwrite(table.dataframe())
    made = v.VersionedTable.open("made", spark=spark)
    made.replace_data("loaded", "recovered")
    assert made.location() == str(tmp_path / "loaded") and v.VersionedTable.open("recovered", spark=spark).location() == str(tmp_path / "made")


def test_alter(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table(KIND, ROWS)
    done = TableAlter(table).add_column("note", "string", after="id", comment="c").rename_column("name", "title").drop_column("value").set_property("owner", "me").apply()
    assert done == 4 and table.dataframe().columns == ["id", "note", "title"] and table.current.properties == {"owner": "me"}
    TableAlter(table).add_column("value", "int").apply()
    assert {r["value"] for r in table.dataframe().collect()} == {None}  # the old values don't return
    alter = TableAlter(table).set_property("a", "1").drop_column("gone").set_property("b", "2")
    with pytest.raises(ValueError):
        alter.apply()
    assert len(alter.queue) == 3 and "b" not in table.current.properties
    for bad in (lambda a: a.add_column("id", "int"), lambda a: a.add_column("x", "int", nullable=False), lambda a: a.add_column("x", "int", after="no"), lambda a: a.rename_column("no", "x")):
        with pytest.raises(ValueError):
            bad(TableAlter(table)).apply()


def test_maintenance(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table, sink = temp_table(KIND, ROWS), Sink()
    for k in range(3):
        table.write(spark.createDataFrame([(10 + k, "x", k)], "id int, name string, value int"))
    before = content(table)
    result = MaintenanceRunner(table.name, zorder_by=["id"], retention_hours=0, analyze_columns=["id"], metrics_sink=sink, spark=spark).run()
    assert (result.optimized, result.vacuumed, result.analyzed) == (True, True, True) and sink.events[0].event_type == "maintenance_complete"
    assert content(table) == before and len(table.current.files) == 1
    assert table.current.properties == {"stats.rows": "6", "stats.id.distinct": "6", "stats.id.nulls": "0"}
    with pytest.raises(ValueError, match="vacuumed"):
        table.restore(1)
    assert v.vacuum_table(table) == 0


def test_diff_and_validator(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    old = T.StructType.fromDDL("id int, name string, gone int")
    new = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType(), False), T.StructField("age", T.IntegerType())])
    diff = SchemaDiff(old, new)
    assert [(c.column, c.change_type, c.severity) for c in diff.changes()] == [
        ("age", "added", "info"), ("gone", "removed", "breaking"), ("id", "type_changed", "breaking"), ("name", "nullable_changed", "warning"),
    ]
    assert diff.has_breaking_changes() and "type_changed" in diff.summary() and SchemaDiff(old, old).summary() == "No schema changes detected."
    table = temp_table(KIND, partition_by=["name", "value"])
    check = lambda **k: TableValidator(table.name, spark=spark, **k).validate()
    good = check(expected_columns=["id", "name"], expected_partition_columns=["value", "name"], expected_location_contains=table.name)
    assert good.is_valid and good.warnings == ["column value is not expected"]
    bad = check(expected_columns=["x"], expected_partition_columns=["id"], expected_location_contains="elsewhere", expected_generated_columns=["g"])
    assert len(bad.errors) == 4
    with pytest.raises(MigrationError):
        bad.raise_if_invalid()
    assert TableValidator("never_made", spark=spark).validate().errors == ["the table does not exist"]


def test_migrations(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    ran: list[str] = []
    fail = {"on": True}

    def second(s: SparkSession) -> None:
        if fail["on"]:
            raise RuntimeError("not yet")
        ran.append("002")

    runner = MigrationRunner("m_history", spark=spark, location=str(tmp_path / "h"))
    runner.register(MigrationStep("002", "second", second), MigrationStep("001", "first", lambda s: ran.append("001")), MigrationStep("003", "third", lambda s: ran.append("003")))
    with pytest.raises(ValueError):
        runner.register(MigrationStep("001", "again", second))
    assert runner.run(dry_run=True).applied == ["001", "002", "003"] and ran == []
    result = runner.run()
    assert (result.applied, result.failed) == (["001"], "002") and [s.version for s in runner.pending()] == ["002", "003"]
    fail["on"] = False
    assert runner.run().applied == ["002", "003"] and ran == ["001", "002", "003"] and runner.run().skipped == ["001", "002", "003"]
    blocked = runner.register(MigrationStep("004", "no", lambda s: None, pre_validate=lambda s: False))
    with pytest.raises(MigrationError):
        blocked.run()
    assert runner.history_df().where("NOT success").first()["error_message"] == "RuntimeError: not yet"


def test_metrics_table(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    sink = TableMetricsSink("metrics", spark=spark, buffer_size=2, location=str(tmp_path / "m"))
    both = CompositeMetricsSink(sink, other := Sink())
    for k in range(3):
        both.emit(MetricEvent("job", "x", datetime.now(UTC), duration_ms=k, row_count=k, metadata={"k": k}))
    assert sink.table.dataframe().count() == 2 and len(sink.buffer) == 1 and len(other.events) == 3
    both.flush()
    assert {r["metadata"] for r in sink.table.dataframe().collect()} == {'{"k": 0}', '{"k": 1}', '{"k": 2}'}


def test_merge_clauses_with_repeated_source_keys(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    kind = "id int, name string, value int"
    twice = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "n", 9), (9, "m", 9)], kind)

    def after(build) -> list:  # noqa: ANN001
        table = temp_table(KIND, ROWS)
        build(table.merge(twice)).execute()
        return sorted(tuple(r) for r in table.dataframe().collect())

    assert after(lambda m: m.on("id").when_not_matched_by_source_delete()) == [(1, "a", 100)]
    assert after(lambda m: m.on("id").when_not_matched_by_source_delete("target.value > 250")) == [(1, "a", 100), (2, "b", 200)]
    assert after(lambda m: m.on("id").when_not_matched_insert().when_not_matched_by_source_delete()) == [(1, "a", 100), (9, "m", 9), (9, "n", 9)]
    assert after(lambda m: m.on("id").when_matched_delete().when_not_matched_insert()) == [(2, "b", 200), (3, "c", 300), (9, "m", 9), (9, "n", 9)]
    assert after(lambda m: m.on("id").when_matched_delete("source.name = 'y'")) == [(2, "b", 200), (3, "c", 300)]
    assert after(lambda m: m.on("id").when_matched_delete("source.name = 'z'").when_not_matched_by_source_delete()) == [(1, "a", 100)]
    for build in (
        lambda m: m.on("id").when_matched_update(), lambda m: m.on_condition("target.id = source.id").when_matched_update(),
        lambda m: m.on("id").when_matched_soft_delete(deleted_col="value", deleted_at_col=None), lambda m: m.on("id").when_matched_delete("source.value > 0"),
        lambda m: m.on("id").when_matched_update().when_not_matched_insert(),
    ):
        table = temp_table(KIND, ROWS)
        with pytest.raises(MergeConflictError):
            build(table.merge(twice)).execute()
        assert content(table) == set(ROWS) and table.current.version == 1


def test_only_touched_files_are_rewritten(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table(KIND)
    rows = spark.range(1000).selectExpr("CAST(id AS INT) AS id", "CAST(id % 7 AS STRING) AS name", "CAST(id AS INT) AS value")
    table.write(rows.repartitionByRange(100, "id"))
    before = set(table.current.files)
    assert len(before) > 90
    table.upsert(spark.createDataFrame([(500, "new", 1)], "id int, name string, value int"), ["id"])
    assert len(before - set(table.current.files)) == 1 and len(set(table.current.files) - before) == 1
    assert table.dataframe().count() == 1000 and table.dataframe().where("name = 'new'").count() == 1
    before, version = set(table.current.files), table.current.version
    assert v.kill_duplicates(table, ["id"]) == v.DedupResult(0, 1000) and table.current.version == version
    table.write(spark.createDataFrame([(3, "copy", 0)], "id int, name string, value int"))
    assert v.drop_duplicates_pkey(table, ["value", "name"], ["id"]) == v.DedupResult(1, 1000)
    assert len(before - set(table.current.files)) == 1 and table.dataframe().where("id = 3").first()["name"] == "copy"


def test_the_log_keeps_changes_and_whole_sets(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table(KIND)
    df = spark.createDataFrame(ROWS[:1], "id int, name string, value int").coalesce(1)
    for _ in range(24):
        table.write(df)
    steps = {n: json.loads(table.log.files.read(table.log._name(n))) for n in table.log.numbers()}
    assert [n for n, x in steps.items() if "files" in x] == [0, 1, 20] and len(steps[22]["add"]) == 1
    other = v.VersionedTable.open(table.name, spark=spark)
    assert other.dataframe().count() == 24 and other.dataframe(7).count() == 7
    other.restore(3)
    assert table.dataframe().count() == 3


def test_a_dead_writer_blocks_nobody(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table(KIND, ROWS)
    name = table.log._name(table.current.version + 1)
    table.log.files.put(f"{name}.lock", "")
    table.log.files.put(f"{name}.dead.tmp", "half")
    began = time.time()
    table.write(spark.createDataFrame([(7, "g", 7)], "id int, name string, value int"))
    assert table.dataframe().count() == 4 and time.time() - began < 20


def test_append_new_sees_a_commit_in_between(temp_table, spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:  # noqa: ANN001
    table, new = temp_table(KIND, ROWS), spark.createDataFrame([(7, "g", 7), (8, "h", 8)], "id int, name string, value int")
    store, raced = table._store, []

    def slow(*args, **named):  # noqa: ANN002, ANN003, ANN202
        out = store(*args, **named)
        if not raced:
            raced.append(v.VersionedTable.open(table.name, spark=spark).write(new.where("id = 7")))
        return out

    monkeypatch.setattr(table, "_store", slow)
    assert v.append_without_duplicates(table, new, ["id"]) == 1
    assert sorted(r["id"] for r in table.dataframe().collect()) == [1, 2, 3, 7, 8]


def test_names_outlive_the_process(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    from tidewright.sources import names

    a, b = temp_table(KIND, ROWS), temp_table(KIND, ROWS[:1])
    a.replace_data(b.name, f"{a.name}_old")
    assert names.root_of(spark, a.name) == b.location() and v.VersionedTable.open(a.name, spark=spark).dataframe().count() == 1
    assert v.VersionedTable.open(f"{a.name}_old", spark=spark).dataframe().count() == 3
    assert not [n for n in vars(names) if n.startswith("_R")]  # nothing is kept in the process


def test_z_order_keeps_near_values_together(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    table = temp_table({"a": "int", "b": "string", "c": "date"})
    df = spark.range(4000).selectExpr("CAST(id * 7919 % 4000 AS INT) AS a", "CAST(id * 104729 % 4000 AS STRING) AS b", "date_add(DATE'2024-01-01', CAST(id % 300 AS INT)) AS c")
    table.write(df)
    monkey = v.TARGET_FILE_BYTES
    try:
        v.TARGET_FILE_BYTES = max(1, table.size_in_bytes() // 16)
        v.optimize_table(table, zorder_by=["a", "b"])
    finally:
        v.TARGET_FILE_BYTES = monkey
    assert len(table.current.files) > 8 and table.dataframe().exceptAll(df).isEmpty()
    placed = table._scan(table.current, table.current.files, places=True)
    spread = [r[1] for r in placed.groupBy("_file").agg({"a": "max"}).collect()], [r[1] for r in placed.groupBy("_file").agg({"a": "min"}).collect()]
    assert sum(x - y for x, y in zip(*spread, strict=True)) / len(spread[0]) < 2600  # of 4,000
    with pytest.raises(ValueError):
        v.optimize_table(table, zorder_by=["gone"])


def test_partition_values_of_all_kinds(temp_table, spark: SparkSession) -> None:  # noqa: ANN001
    odd = ["a b", "x/y", "p=q", "50%", "é", None, "data", "a:b"]
    table = temp_table(KIND, partition_by="name")
    df = spark.createDataFrame([(k, n, k) for k, n in enumerate(odd)], "id int, name string, value int").coalesce(1)
    table.write(df)
    table.write(df.withColumn("id", df["id"] + 100))
    before = set(table.current.files)
    result = table.upsert(spark.createDataFrame([(k, n, -k) for k, n in enumerate(odd) if k], "id int, name string, value int"), ["id"])
    assert result == v.MergeResult(0, 7, 0) and len(before - set(table.current.files)) == 7
    assert {(r["id"], r["name"]) for r in table.dataframe().collect()} == {(k + x, n) for k, n in enumerate(odd) for x in (0, 100)}
    assert {r["value"] for r in table.dataframe().where("id < 100").collect()} == {-k for k in range(8)}
    assert v.drop_duplicates_pkey(table, "id", ["name"]) == v.DedupResult(8, 8)
