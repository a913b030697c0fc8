"""Registered queries over tables, checks, streams and jobs: each runs an operator on the tables and returns what came of
it as a small table, with SQL that says what must come of it."""

from __future__ import annotations

import io
import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.durations import parse_duration_ms
from tidewright.job.config import CatalogSchema, Environment, JobConfig, UnityConfig
from tidewright.job.logs import configure_logging
from tidewright.job.metrics import CompositeMetricsSink, LoggingMetricsSink, MetricEvent, MetricsSink, TableMetricsSink
from tidewright.job.retry import RetryConfig, retry
from tidewright.job.secrets import HadoopFiles
from tidewright.job.session import active_fallback, get_active, get_or_create_local_session
from tidewright.job.workflow import Workflow
from tidewright.operators import quality as q
from tidewright.operators import validation as val
from tidewright.operators.filters import Filter, FilterPipeline, WhereFilter
from tidewright.plans import lint as linter
from tidewright.plans.merge import MergeConflictError
from tidewright.registry import AS_OF, read, registered, scratch
from tidewright.schema.alter import TableAlter
from tidewright.schema.diff import SchemaDiff
from tidewright.schema.migrations import MigrationRunner, MigrationStep
from tidewright.schema.validators import MigrationError, TableValidator, describe_table
from tidewright.sources import versioned as v
from tidewright.sources.log import CommitConflictError
from tidewright.sources.maintenance import MaintenanceRunner
from tidewright.sources.names import checked_name
from tidewright.streaming.batches import BatchContext, BatchLogger
from tidewright.streaming.checkpoint import CheckpointManager, check_compatibility, diagnose_checkpoint, remember_schema
from tidewright.streaming.observe import QueryProgressObserver, StreamingHealthCheck
from tidewright.streaming.reader import CircuitBreakerError, StreamingTableReader


def values(rows: list[tuple], *names: str) -> str:
    """SQL of a literal table."""
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({', '.join(names)})"


def outcome(call: Callable[[], Any]) -> str:
    """The name of the error that a call raises, or "none"."""
    try:
        call()
    except Exception as e:  # noqa: BLE001
        return type(e).__name__
    return "none"


def fresh(spark: SparkSession, like: DataFrame, **options: Any) -> v.VersionedTable:  # noqa: ANN401
    name = f"q_{uuid.uuid4().hex[:12]}"
    return v.VersionedTable(name, like.schema, f"{scratch(spark)}/{name}", spark=spark, **options)


class Kept(MetricsSink):
    """Events in a list."""

    def __init__(self) -> None:
        self.events: list[MetricEvent] = []
        self.flushed = 0

    def emit(self, event: MetricEvent) -> None:
        self.events.append(event)

    def flush(self) -> None:
        self.flushed += 1


@contextmanager
def lines(name: str) -> Iterator[list[dict]]:
    """JSON lines that a logger gets meanwhile."""
    out: list[dict] = []
    stream = io.StringIO()
    handler, log = logging.StreamHandler(stream), logging.getLogger(name)
    handler.setFormatter(logging.Formatter("%(message)s"))
    level, passes = log.level, log.propagate
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    log.propagate = False
    try:
        yield out
    finally:
        log.removeHandler(handler)
        log.setLevel(level)
        log.propagate = passes
        out += [json.loads(x) for x in stream.getvalue().splitlines()]


# --- merges and deduplication of tables ------------------------------------------------------------------------------


@registered("SELECT c_custkey AS id, c_acctbal AS bal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def merge_orphan_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows stand twice: target rows without one go, the others stay once, and new keys come in as often as they
    stand."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    table = fresh(spark, c)
    table.write(c.where("id % 2 = 0 OR id % 5 = 0"))
    source = c.where("id % 2 = 0 OR id % 3 = 0")
    table.merge(source.where("id % 2 = 0").unionByName(source)).on("id").when_not_matched_by_source_delete().execute()
    table.merge(source).on("id").when_not_matched_insert().execute()
    return table.dataframe()


@registered(values([("keys", "MergeConflictError"), ("condition", "MergeConflictError"), ("conditional clause that holds once", "none"), ("plain delete", "none")], "merge", "error"))
def merge_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    twice = n.where("n_nationkey < 3").unionByName(n.where("n_nationkey < 3").withColumn("n_name", F.lit("other")))

    def tried(build: Callable[[v.MergeBuilder], v.MergeBuilder]) -> str:
        table = fresh(spark, n)
        table.write(n)
        return outcome(build(table.merge(twice)).execute)

    rows = [
        ("keys", tried(lambda m: m.on("n_nationkey").when_matched_update())),
        ("condition", tried(lambda m: m.on_condition("target.n_nationkey = source.n_nationkey AND target.n_nationkey >= 0").when_matched_update())),
        ("conditional clause that holds once", tried(lambda m: m.on("n_nationkey").when_matched_soft_delete(condition="source.n_name = 'other'"))),
        ("plain delete", tried(lambda m: m.on("n_nationkey").when_matched_delete())),
    ]
    assert MergeConflictError.__name__ == "MergeConflictError"
    return spark.createDataFrame(rows, "merge string, error string")


@registered("SELECT count(*) AS rows_in_table, count(*) FILTER (WHERE o_orderkey % 1000 = 1) > 0 AS has_changes, 1 AS files_rewritten, 10 AS files_before FROM orders")
def merge_rewrites_touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert of the rows of one file leaves the other files as they are."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    table = fresh(spark, o)
    table.write(o.repartitionByRange(10, "o_orderkey"))
    before = set(table.current.files)
    least = o.agg(F.min("o_orderkey").alias("o_orderkey"))
    table.upsert(least.withColumn("o_totalprice", F.lit(-1.0)), ["o_orderkey"])
    after = set(table.current.files)
    changed = table.dataframe().where("o_totalprice = -1").count()
    return table.dataframe().agg(
        F.count(F.lit(1)).alias("rows_in_table"), F.lit(changed == 1).alias("has_changes"), F.lit(len(before - after)).alias("files_rewritten"), F.lit(len(before)).alias("files_before")
    )


@registered("SELECT (SELECT count(*) FROM nation WHERE n_nationkey >= 5) AS rows_inserted, (SELECT count(*) FROM nation WHERE n_nationkey < 5) AS rows_updated, 0 AS rows_deleted, "
            "'merge_complete' AS event_type, (SELECT count(*) FROM nation) AS row_count")  # fmt: skip
def merge_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, sink = read(spark, sf_dir, "nation"), Kept()
    table = fresh(spark, n)
    table.write(n.where("n_nationkey < 5"))
    r = table.upsert(n, ["n_nationkey"], metrics_sink=sink)
    rows = [(r.rows_inserted, r.rows_updated, r.rows_deleted, sink.events[0].event_type, sink.events[0].row_count)]
    return spark.createDataFrame(rows, "rows_inserted long, rows_updated long, rows_deleted int, event_type string, row_count long")


@registered("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY role, turn ORDER BY conv_id, turn) = 1")
def drop_duplicates_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    table = fresh(spark, rows)
    table.write(rows)
    v.drop_duplicates_pkey(table, ["conv_id", "turn"], ["role", "turn"])
    return table.dataframe()


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name || '!' FROM nation WHERE n_nationkey >= 10")
def table_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    table = fresh(spark, n)
    table.write(n.where("n_nationkey < 10"))
    v.append_without_duplicates(table, n.withColumn("n_name", F.concat("n_name", F.lit("!"))), ["n_nationkey"])
    return table.dataframe()


@registered("WITH k AS (SELECT count(*) AS n, count(*) FILTER (WHERE c = 1) AS alone FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)) "
            "SELECT 'dedup_complete' AS event_type, (SELECT count(*) FROM lineitem) - alone AS removed, alone AS remaining FROM k")  # fmt: skip
def dedup_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sink = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), Kept()
    table = fresh(spark, rows)
    table.write(rows)
    r = v.kill_duplicates(table, ["l_orderkey", "l_linenumber"], metrics_sink=sink)
    return spark.createDataFrame([(sink.events[0].event_type, sink.events[0].row_count, r.rows_remaining)], "event_type string, removed long, remaining long")


@registered(values([("kill_duplicates", "ValueError"), ("drop_duplicates_pkey", "ValueError"), ("empty columns", "ValueError"), ("append_without_duplicates", "ValueError"), ("merge without keys", "ValueError")], "call", "error"))
def dedup_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    table = fresh(spark, n)
    rows = [
        ("kill_duplicates", outcome(lambda: v.kill_duplicates(table, []))),
        ("drop_duplicates_pkey", outcome(lambda: v.drop_duplicates_pkey(table, [], ["n_name"]))),
        ("empty columns", outcome(lambda: v.drop_duplicates_pkey(table, "n_nationkey", []))),
        ("append_without_duplicates", outcome(lambda: v.append_without_duplicates(table, n, []))),
        ("merge without keys", outcome(lambda: table.merge(n).when_matched_update().execute())),
    ]
    return spark.createDataFrame(rows, "call string, error string")


# --- sources, sinks, maintenance -------------------------------------------------------------------------------------


@registered("SELECT * FROM nation")
def load_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, schema = f"q_{uuid.uuid4().hex[:12]}", read(spark, sf_dir, "nation").schema
    return v.VersionedTable.from_parquet(f"{sf_dir}/nation.parquet", table_name=name, schema=schema, location=f"{scratch(spark)}/{name}", spark=spark).dataframe()


@registered("SELECT * FROM region")
def load_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, name = read(spark, sf_dir, "region"), f"q_{uuid.uuid4().hex[:12]}"
    rows = [tuple(x) for x in r.collect()]  # five rows
    return v.VersionedTable.from_data(rows, table_name=name, schema=r.schema, location=f"{scratch(spark)}/{name}", spark=spark).dataframe()


@registered("SELECT 'n_regionkey' AS partitioned_by, count(DISTINCT n_regionkey) AS num_files, true AS has_size FROM nation")
def table_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    table = fresh(spark, n, partition_by="n_regionkey")
    table.write(n.coalesce(1))
    return table.detail().select(F.array_join("partition_columns", ",").alias("partitioned_by"), F.col("num_files").cast("long").alias("num_files"), (F.col("size_in_bytes") > 0).alias("has_size"))


@registered(values([("view", "r_regionkey", "int"), ("view", "r_name", "string"), ("table", "r_regionkey", "int"), ("table", "r_name", "string")], "kind", "name", "type"))
def table_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, view = read(spark, sf_dir, "region"), f"q_{uuid.uuid4().hex[:12]}"
    table = fresh(spark, r)
    r.createOrReplaceTempView(view)
    found = [describe_table(n, spark=spark).select(F.lit(kind).alias("kind"), "name", "type") for kind, n in (("view", view), ("table", table.name))]
    out = found[0].unionByName(found[1])
    spark.catalog.dropTempView(view)
    return out


@registered("SELECT 'before' AS step, false AS there, 0 AS n UNION ALL SELECT 'made', true, 0 UNION ALL SELECT 'appended', true, 2 * count(*) FROM region "
            "UNION ALL SELECT 'overwritten', true, count(*) FROM region WHERE r_regionkey < 2 UNION ALL SELECT 'dropped', false, 0")  # fmt: skip
def table_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, name = read(spark, sf_dir, "region"), f"q_{uuid.uuid4().hex[:12]}"
    place = f"{scratch(spark)}/{name}"
    there = lambda: outcome(lambda: v.VersionedTable.open(name, place, spark=spark)) == "none"
    rows = [("before", there(), 0)]
    table = v.TableAppender(name, r.schema, place, spark=spark)
    rows.append(("made", table.exists(), table.dataframe().count()))
    table.append(r)
    table.append(r)
    rows.append(("appended", there(), table.dataframe().count()))
    v.TableOverwriter(name, r.schema, place, spark=spark).overwrite(r.where("r_regionkey < 2"))
    rows.append(("overwritten", there(), table.dataframe().count()))
    table.drop()
    rows.append(("dropped", table.exists(), 0))
    return spark.createDataFrame(rows, "step string, there boolean, n long")


_NAMES = [("gold.orders", True), ("orders", True), ("a;b", False), ("a--b", False), ("a/*b", False), ("a*/b", False), ("", False)]


@registered(values(_NAMES, "name", "accepted"))
def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, outcome(lambda n=n: checked_name(n)) == "none") for n, _ in _NAMES], "name string, accepted boolean")


@registered("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20")
def restore_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    table = fresh(spark, n)
    table.write(n.where("n_nationkey < 20"))
    time.sleep(0.02)
    when = datetime.now(UTC)
    time.sleep(0.02)
    table.write(n.where("n_nationkey < 3"), "overwrite")
    table.restore_to_timestamp(when)
    return table.dataframe()


@registered("SELECT 'current' AS name, count(*) AS n FROM nation UNION ALL SELECT 'recovered', count(*) FROM region UNION ALL SELECT 'opened again', count(*) FROM nation")
def table_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    old, new, saved = fresh(spark, r), fresh(spark, n), f"q_{uuid.uuid4().hex[:12]}"
    old.write(r)
    new.write(n)
    old.replace_data(new.name, saved)
    found = {"current": old, "recovered": v.VersionedTable.open(saved, spark=spark), "opened again": v.VersionedTable.open(old.name, spark=spark)}
    return spark.createDataFrame([(k, t.dataframe().count()) for k, t in found.items()], "name string, n long")


@registered("SELECT count(*) AS n, 1 AS files_after, true AS fewer, 0 AS stale_before, true AS vacuumed FROM customer")
def optimize_and_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    table = fresh(spark, c)
    table.write(c.repartition(6))
    before = len(table.current.files)
    v.optimize_table(table, zorder_by=["c_nationkey", "c_mktsegment", "c_acctbal"])
    kept = v.vacuum_table(table)  # the old version is still within the retention
    gone = v.vacuum_table(table, retention_hours=0)
    after = len(table.current.files)
    return table.dataframe().agg(
        F.count(F.lit(1)).alias("n"), F.lit(after).alias("files_after"), F.lit(after < before).alias("fewer"), F.lit(kept).alias("stale_before"), F.lit(gone == before).alias("vacuumed")
    )


@registered("SELECT count(*) AS n, count(*) - count(CASE WHEN n_nationkey % 4 <> 0 THEN n_name END) AS nulls FROM nation")
def table_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")))
    table = fresh(spark, n)
    table.write(n)
    v.analyze_table(table, columns=["n_name"])
    found = table.current.properties
    return spark.createDataFrame([(int(found["stats.rows"]), int(found["stats.n_name.nulls"]))], "n long, nulls long")


@registered(values([("OPTIMIZE", "maintenance_complete", True, True, False)], "operation", "event_type", "optimized", "vacuumed", "analyzed"))
def maintenance_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, sink = read(spark, sf_dir, "nation"), Kept()
    table = fresh(spark, n)
    table.write(n.repartition(3))
    r = MaintenanceRunner(table.name, analyze=False, spark=spark, metrics_sink=sink).run()
    return spark.createDataFrame([(table.current.operation, sink.events[0].event_type, r.optimized, r.vacuumed, r.analyzed)], "operation string, event_type string, optimized boolean, vacuumed boolean, analyzed boolean")


@registered("SELECT n_nationkey, CAST(NULL AS VARCHAR) AS note, n_name AS title FROM nation")
def table_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    table = fresh(spark, n)
    table.write(n)
    TableAlter(table).add_column("note", "string", after="n_nationkey").rename_column("n_name", "title").drop_column("n_regionkey").apply()
    return table.dataframe()


@registered(values([("ValueError", 3, "1", None)], "error", "still_queued", "a", "b"))
def table_alter_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second change fails: the first stays, the third doesn't run, the queue is kept."""
    table = fresh(spark, read(spark, sf_dir, "nation"))
    alter = TableAlter(table).set_property("a", "1").drop_column("gone").set_property("b", "2")
    error = outcome(alter.apply)
    found = table.current.properties
    return spark.createDataFrame([(error, len(alter.queue), found.get("a"), found.get("b"))], "error string, still_queued int, a string, b string")


@registered("SELECT 'etl' AS job_name, 'loaded' AS event_type, count(*) AS row_count, 1.5::DOUBLE AS duration_ms, '{\"table\": \"nation\"}' AS metadata FROM nation")
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"q_{uuid.uuid4().hex[:12]}"
    sink = TableMetricsSink(name, spark=spark, location=f"{scratch(spark)}/{name}")
    sink.emit(MetricEvent("etl", "loaded", datetime(2024, 1, 1, tzinfo=UTC), 1.5, read(spark, sf_dir, "nation").count(), metadata={"table": "nation"}))
    sink.flush()
    return sink.table.dataframe().select("job_name", "event_type", "row_count", "duration_ms", "metadata")


@registered(values([("/base/gold_orders__Loader", False, False)], "path", "there", "after_reset"))
def checkpoint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch(spark)
    manager = CheckpointManager(place, spark=spark)
    path = manager.path_for("gold.orders", "Loader")
    there = manager.exists(path)
    remember_schema(path, read(spark, sf_dir, "region").schema, spark=spark)
    manager.reset(path)
    manager.reset(path)
    return spark.createDataFrame([(path.replace(place, "/base"), there, manager.exists(path))], "path string, there boolean, after_reset boolean")


@registered(values([("made", ""), ("copied", "part"), ("moved", ""), ("removed", "")], "step", "names"))
def remote_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, place = HadoopFiles(spark), scratch(spark)
    files.mkdirs(f"{place}/a")
    rows = [("made", ",".join(files.ls(f"{place}/a")))]
    files.cp(f"{sf_dir}/region.parquet", f"{place}/a/part")
    rows.append(("copied", ",".join(files.ls(f"{place}/a"))))
    files.mv(f"{place}/a/part", f"{place}/b/part")
    rows.append(("moved", ",".join(files.ls(f"{place}/a"))))
    files.rm(f"{place}/b")
    rows.append(("removed", ",".join(files.ls(f"{place}/b"))))
    return spark.createDataFrame(rows, "step string, names string")


@registered(values([(1, "CommitConflictError", 2)], "appended_after_lost_race", "rewrite", "versions_after"))
def commit_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append that lost a race is tried again; a rewrite fails."""
    r = read(spark, sf_dir, "region")
    table = fresh(spark, r)
    base = table.current
    table.write(r.where("r_regionkey = 0"))
    files, seen = table._store(r.where("r_regionkey = 1"), base)
    table._commit(base, "WRITE", files, seen, {}, replace_all=False, retry=True)
    rewrite = outcome(lambda: table._commit(base, "MERGE", files, seen, {}, replace_all=True))
    assert CommitConflictError.__name__ == "CommitConflictError"
    return spark.createDataFrame([(table.dataframe().where("r_regionkey = 1").count(), rewrite, table.current.version)], "appended_after_lost_race int, rewrite string, versions_after int")


# --- filters, quality ------------------------------------------------------------------------------------------------


@registered("SELECT DISTINCT event_type FROM events WHERE value > 20")
def custom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Types(Filter):
        def apply(self, df: DataFrame) -> DataFrame:
            return df.select("event_type").distinct()

    return FilterPipeline([WhereFilter("value > 20"), Types()])(read(spark, sf_dir, "events"))


@registered("SELECT column_name, true AS near FROM (DESCRIBE SELECT * FROM lineitem)")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of distinct counts lie within a tenth of the exact ones."""
    rows = read(spark, sf_dir, "lineitem")
    a = q.profile_df(rows).select("name", F.col("distinct_count").alias("a"))
    b = q.profile_df(rows, exact=True).select("name", F.col("distinct_count").alias("b"))
    return a.join(b, "name").select(F.col("name").alias("column_name"), (F.abs(F.col("a") - F.col("b")) <= F.col("b") * 0.1).alias("near"))


@registered("SELECT n_name, rank FROM (SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS rank FROM nation)")
def ordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in order on the driver, as the schema tools sort them; 25 rows."""
    names = sorted(r["n_name"] for r in read(spark, sf_dir, "nation").collect())
    return spark.createDataFrame([(n, k) for k, n in enumerate(names, 1)], "n_name string, rank int")


@registered(values([("raise", "none"), ("warn", "none"), ("quarantine", "ValueError"), ("other", "ValueError")], "on_fail", "error"))
def gate_construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(x, outcome(lambda x=x: q.QualityGate(q.NotNull("a"), on_fail=x))) for x in ("raise", "warn", "quarantine", "other")]
    return spark.createDataFrame(rows, "on_fail string, error string")


@registered("SELECT 'raise' AS mode, 'QualityError' AS error, 0 AS kept, 0 AS quarantined UNION ALL SELECT 'warn', 'none', count(*), 0 FROM events "
            "UNION ALL SELECT 'quarantine', 'none', count(*) FILTER (WHERE NOT coalesce(value > 50, false)), count(*) FILTER (WHERE value > 50) FROM events")  # fmt: skip
def gate_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, bad, rows = read(spark, sf_dir, "events"), [], []
    for mode in ("raise", "warn", "quarantine"):
        gate = q.QualityGate(q.InRange("value", max_val=50), on_fail=mode, quarantine_handler=lambda df: bad.append(df.count()))
        kept: list[int] = []
        error = outcome(lambda gate=gate, kept=kept: kept.append(gate.enforce(e).count()))
        rows.append((mode, error, sum(kept), sum(bad)))
    return spark.createDataFrame(rows, "mode string, error string, kept long, quarantined long")


@registered("SELECT '[PASS] not_null(event_id) (0/' || count(*) || ' failing)' AS line FROM events UNION ALL "
            "SELECT '[FAIL] long_types (' || count(*) FILTER (WHERE length(event_type) > 5) || '/' || count(*) || ' failing)' FROM events UNION ALL SELECT 'Overall: FAIL'")  # fmt: skip
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's text, with an expectation of one's own in it."""

    class Short(q.Expectation):
        def failing_condition(self) -> Column:
            return F.length("event_type") > 5

        def validate(self, df: DataFrame) -> q.ExpectationResult:
            row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(self.failing_condition()).alias("bad")).first()
            return q.ExpectationResult("long_types", row["bad"] == 0, row["n"], row["bad"])

    text = q.QualityGate(q.NotNull("event_id"), Short()).check(read(spark, sf_dir, "events")).summary()
    found = [(x.replace(q.NotNull("event_id").name, "not_null(event_id)"),) for x in text.splitlines()]
    return spark.createDataFrame(found, "line string")


@registered("SELECT 'rows: ' || count(*) AS head, 2 + 3 AS n_lines FROM nation")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = q.profile(read(spark, sf_dir, "nation")).summary().splitlines()
    return spark.createDataFrame([(text[0], len(text))], "head string, n_lines int")


# --- validation, schemas ---------------------------------------------------------------------------------------------

_VALIDATIONS = [
    ("presence", "none", ""), ("presence of others", "DataFrameMissingColumnError", "x,y"), ("absence", "none", ""), ("absence of own", "DataFrameProhibitedColumnError", "r_name"),
    ("schema", "none", ""), ("other schema", "DataFrameSchemaError", "r_name,z"), ("input", "none", ""), ("input without column", "DataFrameMissingColumnError", "x"),
    ("input that is no frame", "TypeError", ""), ("output", "none", ""), ("output with column", "DataFrameProhibitedColumnError", "r_name"), ("output that is no frame", "TypeError", ""),
]


@registered(values(_VALIDATIONS, "call", "error", "fields"))
def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region")
    own, other = r.schema, T.StructType.fromDDL("r_regionkey int, r_name int, z string")

    @val.validate_input(required_columns=["r_name"])
    def takes(df: DataFrame) -> DataFrame:
        return df

    @val.validate_input(required_columns=["x"], df_arg="df")
    def takes_other(df: DataFrame) -> DataFrame:
        return df

    @val.validate_output(required_columns=["r_name"])
    def gives(df: Any) -> Any:  # noqa: ANN401
        return df

    calls = {
        "presence": lambda: val.validate_presence_of_columns(r, ["r_name"]), "presence of others": lambda: val.validate_presence_of_columns(r, ["r_name", "x", "y"]),
        "absence": lambda: val.validate_absence_of_columns(r, ["x"]), "absence of own": lambda: val.validate_absence_of_columns(r, ["x", "r_name"]),
        "schema": lambda: val.validate_schema(r, own), "other schema": lambda: val.validate_schema(r, other), "input": lambda: takes(r),
        "input without column": lambda: takes_other(df=r), "input that is no frame": lambda: takes(5), "output": lambda: gives(r),
        "output with column": lambda: val.validate_output(prohibited_columns=["r_name"])(lambda: r)(), "output that is no frame": lambda: gives("text"),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, "none", ""))
        except (ValueError, TypeError) as e:
            assert isinstance(e, TypeError | val.DataFrameValidationError)
            found = getattr(e, "missing_columns", getattr(e, "prohibited_columns", [f.name for f in getattr(e, "missing_fields", [])]))
            rows.append((name, type(e).__name__, ",".join(found)))
    return spark.createDataFrame(rows, "call string, error string, fields string")


@registered(values([("same", False, "No schema changes detected."), ("added", False, "2 lines"), ("removed", True, "2 lines")], "change", "breaking", "summary"))
def schema_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region")
    changes = {"same": r, "added": r.withColumn("x", F.lit(1)), "removed": r.drop("r_name")}
    rows = []
    for name, df in changes.items():
        diff = SchemaDiff(r.schema, df.schema)
        text = diff.summary().strip()
        found = [x for x in text.splitlines() if x.strip() and not set(x.strip()) <= set("-= ")]
        rows.append((name, diff.has_breaking_changes(), text if len(found) == 1 else f"{len(found)} lines"))
    return spark.createDataFrame(rows, "change string, breaking boolean, summary string")


@registered(values([("as expected", 0, 0, "none"), ("other columns", 1, 1, "MigrationError"), ("other partitions", 1, 0, "MigrationError"), ("no table", 1, 0, "MigrationError")], "case_", "errors", "warnings", "raised"))
def table_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    table = fresh(spark, n, partition_by="n_name")
    cases = {
        "as expected": TableValidator(table.name, expected_columns=["n_nationkey", "n_name"], expected_partition_columns=["n_name"], expected_location_contains=table.name, spark=spark),
        "other columns": TableValidator(table.name, expected_columns=["n_nationkey", "x"], spark=spark),
        "other partitions": TableValidator(table.name, expected_partition_columns=["n_nationkey"], spark=spark),
        "no table": TableValidator("q_none", spark=spark),
    }
    assert MigrationError.__name__ == "MigrationError"
    rows = [(k, len(r.errors), len(r.warnings), outcome(r.raise_if_invalid)) for k, r in ((k, c.validate()) for k, c in cases.items())]
    return spark.createDataFrame(rows, "case_ string, errors int, warnings int, raised string")


@registered(values([("dry run", "001,002", None, ""), ("run", "001", "002", "001"), ("again", "", "002", "001"), ("refused", "MigrationError", None, "001"), ("twice", "ValueError", None, "001")], "step", "applied", "failed", "done"))
def migration_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runner = MigrationRunner(f"q_{uuid.uuid4().hex[:12]}", spark=spark, location=scratch(spark))
    runner.register(MigrationStep("001", "first", lambda s: None), MigrationStep("002", "fails", lambda s: 1 / 0))
    rows = []
    for name, dry in (("dry run", True), ("run", False), ("again", False)):
        r = runner.run(dry_run=dry)
        rows.append((name, ",".join(r.applied), r.failed, ",".join(runner.applied())))
    other = MigrationRunner(runner.history.name, spark=spark).register(MigrationStep("000", "refused", lambda s: None, pre_validate=lambda s: False))
    rows.append(("refused", outcome(other.run), None, ",".join(other.applied())))
    rows.append(("twice", outcome(lambda: runner.register(MigrationStep("001", "again", lambda s: None))), None, ",".join(runner.applied())))
    return spark.createDataFrame(rows, "step string, applied string, failed string, done string")


# --- streams ---------------------------------------------------------------------------------------------------------


class _Copy(StreamingTableReader):
    """Appends the batches to ``table``, or fails as ``failing`` says."""

    table: v.VersionedTable | None = None
    failing: Callable[[int], bool] = staticmethod(lambda n: False)

    def process_batch(self, df: DataFrame, batch_id: int) -> None:
        if self.failing(batch_id):
            raise RuntimeError("refused")
        if self.table is not None:
            self.append_once(self.table, df, batch_id)


def _stream(spark: SparkSession, sf_dir: str, **options: Any) -> _Copy:  # noqa: ANN401
    schema = read(spark, sf_dir, "events").schema
    return _Copy(f"{sf_dir}/events.parquet*", schema=schema, checkpoint_location=f"{scratch(spark)}/checkpoint", spark=spark, **options)


@registered(values([("before", "missing", None, 0), ("after", "healthy", 0, 1)], "step", "state", "last_batch", "n_offsets"))
def checkpoint_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir)
    path, rows = f"{stream.checkpoint}/query", []
    for at in ("before", "after"):
        found = diagnose_checkpoint(path, spark=spark)
        n = len([x for x in CheckpointManager(stream.checkpoint, spark=spark).info(path).offsets if "logOffset" in x]) if at == "after" else 0
        rows.append((at, found.state.value, found.last_batch_id, n))
        if at == "before":
            stream.run_available()
    return spark.createDataFrame(rows, "step string, state string, last_batch int, n_offsets int")


@registered(values([("unknown", True, 0), ("same", True, 0), ("wider", True, 1), ("narrower", False, 1)], "schema_", "compatible", "changes"))
def checkpoint_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, place = read(spark, sf_dir, "region"), f"{scratch(spark)}/checkpoint"
    rows = [("unknown", check_compatibility(place, r.schema, spark=spark))]
    remember_schema(place, r.schema, spark=spark)
    for name, df in (("same", r), ("wider", r.withColumn("x", F.lit(None).cast("int"))), ("narrower", r.drop("r_name"))):
        rows.append((name, check_compatibility(place, df.schema, spark=spark)))
    return spark.createDataFrame([(n, x.compatible, len(x.changes)) for n, x in rows], "schema_ string, compatible boolean, changes int")


@registered(values([("explicit", "/here"), ("manager", "/base/a_b___Copy"), ("none", "ValueError")], "given", "checkpoint"))
def stream_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("explicit", _Copy("a.b", checkpoint_location="/here", spark=spark).checkpoint), ("manager", _Copy("a.b", checkpoint_manager=CheckpointManager("/base", spark=spark), spark=spark).checkpoint)]
    rows.append(("none", outcome(lambda: _Copy("a.b", spark=spark))))
    return spark.createDataFrame(rows, "given string, checkpoint string")


@registered("SELECT 0 AS batch, 'none' AS error, 1 AS failures, count(*) AS dead FROM region UNION ALL SELECT 1, 'none', 0, count(*) FROM region "
            "UNION ALL SELECT 2, 'none', 1, 2 * count(*) FROM region UNION ALL SELECT 3, 'CircuitBreakerError', 2, 3 * count(*) FROM region")  # fmt: skip
def stream_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches 0, 2 and 3 fail; the second failure in a row opens the breaker, after its rows are kept."""
    r, dead, place = read(spark, sf_dir, "region"), f"q_{uuid.uuid4().hex[:12]}", scratch(spark)
    kept = v.VersionedTable(dead, r.schema, f"{place}/{dead}", spark=spark)
    stream = _Copy("regions", checkpoint_location=f"{place}/checkpoint", dead_letter_table=dead, max_consecutive_failures=2, spark=spark)
    stream.failing = lambda n: n != 1
    rows = []
    for batch in range(4):
        error = outcome(lambda batch=batch: stream.handle(r, batch))
        rows.append((batch, error, stream.failures, kept.dataframe().count()))
    assert CircuitBreakerError.__name__ == "CircuitBreakerError"
    return spark.createDataFrame(rows, "batch int, error string, failures int, dead long")


@registered(values([("stop before start", "ValueError", False), ("started", "none", True), ("stopped", "none", False)], "step", "error", "active"))
def stream_start_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _stream(spark, sf_dir)
    rows = [("stop before start", outcome(stream.stop), stream.is_active)]
    error = outcome(stream.start)
    rows.append(("started", error, stream.is_active))
    rows.append(("stopped", outcome(lambda: stream.stop(60)), stream.is_active))
    return spark.createDataFrame(rows, "step string, error string, active boolean")


@registered("SELECT 'query_progress' AS event_type, count(*) AS n_rows FROM events")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink, stream = Kept(), _stream(spark, sf_dir)
    observer = QueryProgressObserver(metrics_sink=sink).attach(spark)
    try:
        stream.run_available()
        own = str(stream.query.id)
        for _ in range(100):
            if any(p.query_id == own for p in observer.history()):
                break
            time.sleep(0.1)
    finally:
        observer.detach()
    n = sum(p.num_input_rows for p in observer.history() if p.query_id == own)
    return spark.createDataFrame([(sink.events[0].event_type, n)], "event_type string, n_rows long")


_HEALTH = [
    ("no progress yet", "HEALTHY", "active:HEALTHY,progress:HEALTHY"), ("no progress", "UNHEALTHY", "active:HEALTHY,progress:UNHEALTHY"),
    ("good", "HEALTHY", "active:HEALTHY,progress:HEALTHY,batch_duration:HEALTHY,processing_rate:HEALTHY"),
    ("slow", "DEGRADED", "active:HEALTHY,progress:HEALTHY,batch_duration:DEGRADED,processing_rate:DEGRADED"),
    ("stale", "UNHEALTHY", "active:HEALTHY,progress:UNHEALTHY,batch_duration:DEGRADED,processing_rate:DEGRADED"), ("stopped", "UNHEALTHY", "active:UNHEALTHY"),
]


@registered(values(_HEALTH, "step", "status", "checks"))
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock, query = {"t": 0.0}, SimpleNamespace(isActive=True, lastProgress=None)
    check = StreamingHealthCheck(query, max_batch_duration_ms=100, min_processing_rate=5, stale_after=10, clock=lambda: clock["t"])
    good, slow = {"batchId": 1, "batchDuration": 50, "processedRowsPerSecond": 9}, {"batchId": 2, "batchDuration": "250 ms", "processedRowsPerSecond": 1}
    rows = []
    for (at, _, _), (t, active, progress) in zip(_HEALTH, [(0, True, None), (11, True, None), (11, True, good), (12, True, slow), (30, True, slow), (30, False, slow)], strict=True):
        clock["t"], query.isActive, query.lastProgress = t, active, progress
        r = check.evaluate()
        rows.append((at, r.status.name, ",".join(f"{d.check}:{d.status.name}" for d in r.details)))
    return spark.createDataFrame(rows, "step string, status string, checks string")


@registered(values([("batch_start", None, None), ("batch_complete", 5, None), ("batch_error", None, 2000), ("batch_skip", None, 500), ("batch_dlq", 7, None)], "event", "row_count", "cut_at"))
def batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, context = BatchLogger("tidewright.q_batches"), BatchContext(3, "events")
    with lines("tidewright.q_batches") as found:
        log.start(context)
        log.complete(context, 5)
        log.error(context, "e" * 3000)
        log.skip(context, "s" * 3000)
        log.dlq(context, 7, "dead")
    assert {x["correlation_id"] for x in found} == {context.correlation_id} and len(context.correlation_id) == 12
    rows = [(x["event"], x.get("row_count"), len(x.get("error", x.get("reason", ""))) or None) for x in found]
    return spark.createDataFrame(rows, "event string, row_count int, cut_at int")


_DURATIONS = [("250 ms", 250), ("1 s", 1000), ("2 m", 120_000), ("1.5 s", 0), ("", 0), ("soon", 0)]


@registered(values(_DURATIONS, "value", "ms"))
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x, parse_duration_ms(x)) for x, _ in _DURATIONS], "value string, ms int")


@registered("SELECT 'first' AS run, 'none' AS error, count(*) AS n FROM region UNION ALL SELECT 'after an append', 'none', count(*) + 1 FROM region UNION ALL SELECT 'after optimize', 'none', count(*) + 1 FROM region "
            "UNION ALL SELECT 'after an upsert', 'ChangedRowsError', count(*) + 1 FROM region UNION ALL SELECT 'passing over it', 'none', count(*) + 2 FROM region")  # fmt: skip
def stream_versioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over a versioned table that is appended to, compacted and changed meanwhile."""
    r, place = read(spark, sf_dir, "region"), scratch(spark)
    source, target, rows = fresh(spark, r), fresh(spark, r), []

    def run(name: str, **options: str) -> None:
        stream = _Copy(source.name, source_format="versioned", checkpoint_location=f"{place}/versions", read_options=options, spark=spark)
        stream.table = target
        rows.append((name, outcome(stream.run_available), target.dataframe().count()))

    one = r.where("r_regionkey = 0").withColumn("r_regionkey", F.lit(100))
    source.write(r)
    run("first")
    source.write(one)
    run("after an append")
    v.optimize_table(source)
    run("after optimize")
    source.upsert(one, ["r_regionkey"])
    source.write(one)
    run("after an upsert")
    run("passing over it", skipChangeCommits="true")
    return spark.createDataFrame(rows, "run string, error string, n long")


# --- jobs ------------------------------------------------------------------------------------------------------------


@registered("SELECT 0 AS n, 'job_start' AS event_type, CAST(NULL AS BIGINT) AS row_count UNION ALL SELECT 1, 'quality_check', count(*) FROM orders UNION ALL SELECT 2, 'loaded', count(*) FROM orders "
            "UNION ALL SELECT 3, 'quality_check', count(*) FROM orders UNION ALL SELECT 4, 'loaded', count(*) FROM orders UNION ALL SELECT 5, 'job_complete', NULL")  # fmt: skip
def workflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first try fails after its work and is repeated for the same logical time."""
    sink, other, times = Kept(), Kept(), []

    class Job(Workflow):
        def run(self) -> None:
            times.append(self.execution_time)
            orders = self.quality_check(read(self.spark, sf_dir, "orders"), q.QualityGate(q.NotNull("o_orderkey")), table_name="orders")
            self.emit_metric("loaded", row_count=orders.count())
            if len(times) == 1:
                raise ConnectionError("once")

    level = logging.getLogger().level
    job = Job(spark=spark, log_level="ERROR", metrics=CompositeMetricsSink(sink, other), retry_config=RetryConfig(base_delay=0.01))
    assert job.execution_time is None
    job.execute(AS_OF)
    logging.getLogger().setLevel(level)
    assert times == [AS_OF, AS_OF] and sink.events == other.events and sink.flushed == other.flushed == 1
    return spark.createDataFrame([(k, e.event_type, e.row_count) for k, e in enumerate(sink.events)], "n int, event_type string, row_count long")


@registered(values([("QualityError", "job_start,quality_check,job_failed", "QualityError")], "error", "events", "recorded"))
def workflow_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = Kept()

    class Job(Workflow):
        def run(self) -> None:
            self.quality_check(read(self.spark, sf_dir, "orders"), q.QualityGate(q.InRange("o_totalprice", max_val=0)))

    level = logging.getLogger().level
    error = outcome(Job(spark=spark, log_level="ERROR", metrics=sink).execute)
    logging.getLogger().setLevel(level)
    return spark.createDataFrame([(error, ",".join(e.event_type for e in sink.events), sink.events[-1].metadata["error_type"])], "error string, events string, recorded string")


@registered(values([("ConnectionError twice", 3, "none"), ("TimeoutError always", 3, "TimeoutError"), ("ValueError", 1, "ValueError")], "case_", "calls", "error"))
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tried(errors: list[type[Exception] | None]) -> tuple[int, str]:
        calls: list[int] = []

        @retry(RetryConfig(max_attempts=3, base_delay=0.001))
        def work() -> None:
            calls.append(1)
            if (error := errors[len(calls) - 1]) is not None:
                raise error("no")

        logging.getLogger("tidewright.job.retry").setLevel(logging.ERROR)
        return (lambda e: (len(calls), e))(outcome(work))

    cases = {"ConnectionError twice": [ConnectionError, ConnectionError, None], "TimeoutError always": [TimeoutError] * 3, "ValueError": [ValueError]}
    return spark.createDataFrame([(k, *tried(x)) for k, x in cases.items()], "case_ string, calls int, error string")


@registered("SELECT 'loaded' AS event_type, count(*) AS row_count, 'etl' AS job_name FROM region")
def metrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    with lines("tidewright.metrics") as found:
        LoggingMetricsSink().emit(MetricEvent("etl", "loaded", datetime(2024, 1, 1, tzinfo=UTC), row_count=read(spark, sf_dir, "region").count()))
    return spark.createDataFrame([(x["event_type"], x["row_count"], x["job_name"]) for x in found], "event_type string, row_count long, job_name string")


_CONFIGS = [
    ("job", "x.orders"), ("job without", "KeyError"), ("secret without scope", "ValueError"), ("unity", "shop_prod.gold.orders"), ("unity without schema", "ValueError"),
    ("unity of other schema", "KeyError"), ("catalog", "gold.orders"), ("catalog alias", "gold.orders_v2"), ("catalog without", "AttributeError"),
]


@registered(values(_CONFIGS, "asked", "answer"))
def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    job, unity = JobConfig({"orders": "x.orders"}), UnityConfig(catalog_prefix="shop", schemas=["gold"], env=Environment.PROD)
    schema = CatalogSchema("gold", ["orders"], {"latest": "orders_v2"})
    calls = [
        lambda: job.table("orders"), lambda: job.table("none"), lambda: job.secret("k"), lambda: unity.table("gold.orders"), lambda: unity.table("orders"),
        lambda: unity.table("silver.x"), lambda: schema.orders, lambda: schema.latest, lambda: schema.nothing,
    ]
    rows = []
    for (name, _), call in zip(_CONFIGS, calls, strict=True):
        error = outcome(call)
        rows.append((name, call() if error == "none" else error))
    return spark.createDataFrame(rows, "asked string, answer string")


@registered(values([("active", True), ("given", True), ("made", True)], "session", "same"))
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = lambda s: s.sparkContext is spark.sparkContext
    rows = [("active", same(get_active())), ("given", active_fallback(spark) is spark), ("made", same(get_or_create_local_session()))]
    return spark.createDataFrame(rows, "session string, same boolean")


@registered(values([("given", "WARNING", "ERROR"), ("default", "INFO", "ERROR")], "set_by", "level", "gateway"))
def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, rows = logging.getLogger(), []
    level, handlers = root.level, list(root.handlers)
    for name, value in (("given", "warning"), ("default", "INFO")):
        configure_logging(value)
        rows.append((name, logging.getLevelName(root.level), logging.getLevelName(logging.getLogger("py4j").level)))
    root.handlers[:] = handlers
    root.setLevel(level)
    return spark.createDataFrame(rows, "set_by string, level string, gateway string")


_LINT = [
    ("cross join", "CARTESIAN_PRODUCT", "ERROR"), ("theta join", "BROADCAST_NESTED_LOOP", "WARNING"), ("no filter", "FULL_TABLE_SCAN", "INFO"), ("merge join", "BROADCAST_CANDIDATE", "INFO"),
    ("wide", "EXCESSIVE_COLUMNS", "WARNING"), ("deep", "DEEP_PLAN", "WARNING"), ("collected", "COLLECT_SAFETY", "WARNING"), ("filtered", "none", "none"),
]


@registered(values(_LINT, "plan", "rule", "severity"))
def lint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans are only looked at, never run."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    keyed = n.where("n_nationkey > 0").hint("merge").join(r.where("r_regionkey > 0"), n["n_regionkey"] == r["r_regionkey"])
    deep = r.where("r_regionkey > 0").select(F.col("r_regionkey").alias("k"))
    for _ in range(80):
        deep = deep.union(r.where("r_regionkey > 0").select(F.col("r_regionkey").alias("k"))).repartition(2)
    frames = {
        "cross join": n.where("n_nationkey > 0").crossJoin(r.where("r_regionkey > 0")), "theta join": n.where("n_nationkey > 0").join(F.broadcast(r.where("r_regionkey > 0")), F.expr("n_regionkey < r_regionkey"), "left"),
        "no filter": n, "merge join": keyed, "wide": n.where("n_nationkey > 0").select("*", *(F.lit(k).alias(f"c{k}") for k in range(500))), "deep": deep, "filtered": n.where("n_nationkey > 0"),
    }
    rows = []
    for plan, rule, _ in _LINT:
        found = [linter.check_collect_safety(n, max_bytes=1)] if plan == "collected" else linter.lint(frames[plan]).warnings
        hit = [w for w in found if w is not None and w.rule == rule]
        rows.append((plan, hit[0].rule if hit else "none" if not found else found[0].rule, hit[0].severity.value if hit else "none"))
    return spark.createDataFrame(rows, "plan string, rule string, severity string")


@registered("SELECT (SELECT count(*) FROM nation) AS n_inserted, true AS same_rows, true AS same_schema, 'AssertionError' AS other_rows, 'AssertionError' AS other_schema, false AS there_after")
def test_kit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame builder, temporary table and assertions; the kit needs pytest."""
    from tidewright.testing import DataFrameBuilder, TempTable, assert_frame_equal, assert_schema_equal

    built = DataFrameBuilder(spark).with_columns(id="int", name="string").with_sequential("id", read(spark, sf_dir, "nation").count()).build()
    with TempTable(built.schema, [tuple(r) for r in built.collect()], spark=spark) as table:
        n = table.dataframe().count()
        same = outcome(lambda: assert_frame_equal(table.dataframe(), built)) == "none"
    kept = outcome(lambda: assert_schema_equal(built.schema, built.schema)) == "none"
    other = outcome(lambda: assert_frame_equal(built, built.where("id > 3"), check_schema=False))
    less = outcome(lambda: assert_schema_equal(built.schema, built.drop("name").schema))
    other = "AssertionError" if issubclass(_kind(lambda: assert_frame_equal(built, built.where("id > 3"), check_schema=False)), AssertionError) else other
    return spark.createDataFrame([(n, same, kept, other, less, table.exists())], "n_inserted long, same_rows boolean, same_schema boolean, other_rows string, other_schema string, there_after boolean")


def _kind(call: Callable[[], Any]) -> type:
    try:
        call()
    except Exception as e:  # noqa: BLE001
        return type(e)
    return type(None)


@registered(values([("fetched", "v"), ("without provider", "RuntimeError"), ("files", "mv,cp,ls")], "call", "answer"))
def injected_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and files through mocks; what was injected before comes back after."""
    from tidewright.job import secrets
    from tidewright.testing import MockDBUtilsModule

    before, files = secrets.SecretFetcher.dbutils, dict(secrets._FILES)
    try:
        secrets.SecretFetcher.dbutils = None
        rows = [("without provider", outcome(lambda: secrets.SecretFetcher.fetch_secret("s", "k")))]
        module = MockDBUtilsModule()
        secrets.inject_dbutils(module)
        module.instance.secrets.put("s", "k", "v")
        rows.append(("fetched", JobConfig(secret_scope="s").secret("k")))
        secrets.mv("/a", "/b")
        secrets.copy_from_remote("/a", "/b")
        secrets.ls("/")
        rows.append(("files", ",".join(c[0] for c in module.instance.fs.calls)))
    finally:
        secrets.SecretFetcher.dbutils = before
        secrets._FILES.clear()
        secrets._FILES.update(files)
    return spark.createDataFrame(rows, "call string, answer string")


@registered("SELECT count(*) AS total_rows, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-30 00:00:00') AS failing_rows, false AS passed FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00'")
def freshness_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "events").where(F.col("ts") < F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz"))
    return q.evaluate(old, [q.FreshnessExpectation("ts", timedelta(days=2), as_of=AS_OF)]).to_df(old).select("total_rows", "failing_rows", "passed")
