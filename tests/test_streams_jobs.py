"""Streams, checkpoints, health, workflow, configuration, retry, secrets."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewright.functions.durations import parse_duration_ms
from tidewright.job import secrets as files
from tidewright.job.config import CatalogSchema, Environment, JobConfig, UnityConfig, environment
from tidewright.job.metrics import LoggingMetricsSink, MetricEvent, MetricsSink
from tidewright.job.retry import RetryConfig, retry
from tidewright.job.session import active_fallback, get_active
from tidewright.job.workflow import Workflow
from tidewright.operators.filters import WhereFilter
from tidewright.operators.quality import NotNull, QualityError, QualityGate
from tidewright.sources.versioned import VersionedTable
from tidewright.streaming.checkpoint import CheckpointManager, CheckpointState, check_compatibility, diagnose_checkpoint, remember_schema
from tidewright.streaming.observe import HealthStatus, QueryProgressObserver, StreamingHealthCheck
from tidewright.streaming.reader import CircuitBreakerError, StreamingTableReader, StreamingTrigger
from tidewright.testing import DataFrameBuilder, MockDBUtilsModule

KIND = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


class Sink(MetricsSink):
    def __init__(self) -> None:
        self.events: list[MetricEvent] = []
        self.flushed = 0

    def emit(self, event: MetricEvent) -> None:
        self.events.append(event)

    def flush(self) -> None:
        self.flushed += 1


@pytest.fixture
def place(spark: SparkSession, tmp_path):  # noqa: ANN001, ANN201
    for k in range(3):
        spark.createDataFrame([(2 * k, "a"), (2 * k + 1, "b")], KIND).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    return tmp_path


def reader(place, process, **options):  # noqa: ANN001, ANN003, ANN201
    class Reader(StreamingTableReader):
        def process_batch(self, df: DataFrame, batch_id: int) -> None:
            process(self, df, batch_id)

    return Reader(str(place / "in"), schema=KIND, checkpoint_location=str(place / "cp"), read_options={"maxFilesPerTrigger": "1"}, **options)


def test_stream_filters_and_appends_once(place, spark: SparkSession, caplog) -> None:  # noqa: ANN001
    table, sink = VersionedTable("out_s", KIND, str(place / "out")), Sink()

    def twice(self, df, batch) -> None:  # noqa: ANN001
        self.append_once(table, df, batch)
        self.append_once(table, df, batch)

    stream = reader(place, twice, row_filter=WhereFilter("id > 1 AND id < 5"), metrics_sink=sink)
    stream.run_available()
    assert sorted(r["id"] for r in table.dataframe().collect()) == [2, 3, 4] and not stream.is_active
    assert [e.row_count for e in sink.events] == [2, 1] and {e.event_type for e in sink.events} == {"batch_complete"}
    assert diagnose_checkpoint(f"{place}/cp/query").state is CheckpointState.HEALTHY
    info = CheckpointManager(str(place)).info(f"{place}/cp/query")
    assert info.last_batch_id == 2 and info.offsets and info.size_bytes > 0


def test_dead_letters_and_breaker(place, spark: SparkSession) -> None:  # noqa: ANN001
    def refuse(self, df, batch) -> None:  # noqa: ANN001
        raise RuntimeError("refused")

    VersionedTable("dead_s", KIND, str(place / "dead"))
    reader(place, refuse, dead_letter_table="dead_s").run_available()
    dead = VersionedTable.open("dead_s").dataframe()
    assert dead.count() == 6 and dead.where("_dlq_error_message LIKE '%refused%' AND _dlq_error_timestamp IS NOT NULL").select("_dlq_batch_id").distinct().count() == 3
    stream = reader(place, refuse, dead_letter_table="dead_s", max_consecutive_failures=2)
    df = spark.createDataFrame([(1, "a")], KIND)
    stream.handle(df, 7)
    with pytest.raises(CircuitBreakerError):
        stream.handle(df, 8)
    with pytest.raises(RuntimeError, match="refused"):
        reader(place, refuse).handle(df, 0)


def test_stream_set_up(place) -> None:  # noqa: ANN001
    nothing = lambda self, df, batch: None
    stream = reader(place, nothing)
    assert stream.trigger == {"processingTime": "10 seconds"} and StreamingTrigger.MINUTES_5.value == {"processingTime": "5 minutes"}
    with pytest.raises(ValueError):
        stream.stop()

    class Reader(StreamingTableReader):
        def process_batch(self, df: DataFrame, batch_id: int) -> None:
            pass

    with pytest.raises(ValueError):
        Reader("a.b")
    assert Reader("a.b", checkpoint_manager=CheckpointManager("/base/")).checkpoint == "/base/a_b__Reader"


def test_progress_is_observed(place, spark: SparkSession) -> None:  # noqa: ANN001
    sink, seen = Sink(), []
    observer = QueryProgressObserver(max_history=2, metrics_sink=sink, on_progress=seen.append).attach()
    try:
        reader(place, lambda self, df, batch: None).run_available()
        for _ in range(100):
            if len(seen) >= 3:
                break
            time.sleep(0.1)
    finally:
        observer.detach()
    assert len(observer.history()) == 2 and observer.latest().batch_id == 2 and len(observer.history(1)) == 1
    assert sink.events[0].event_type == "query_progress" and seen[0].num_input_rows == 2


def test_health() -> None:
    clock = {"t": 0.0}
    query = SimpleNamespace(isActive=True, lastProgress=None)
    check = StreamingHealthCheck(query, max_batch_duration_ms=100, min_processing_rate=5, stale_after=10, clock=lambda: clock["t"])
    assert check.evaluate().status is HealthStatus.HEALTHY
    clock["t"] = 11
    assert check.evaluate().status is HealthStatus.UNHEALTHY
    query.lastProgress = {"batchId": 1, "batchDuration": 50, "processedRowsPerSecond": 9}
    assert check.evaluate().status is HealthStatus.HEALTHY
    query.lastProgress = {"batchId": 2, "batchDuration": "250 ms", "processedRowsPerSecond": 1}
    assert len(check.evaluate().reasons) == 2
    clock["t"] = 30
    assert check.evaluate().status is HealthStatus.UNHEALTHY
    query.isActive = False
    assert check.evaluate().reasons == ["the query is not running"]


def checkpoint(folder, offsets, commits, metadata=True) -> str:  # noqa: ANN001, FBT002
    for name, numbers in (("offsets", offsets), ("commits", commits)):
        (folder / name).mkdir(parents=True, exist_ok=True)
        for n in numbers:
            (folder / name / str(n)).write_text("{}")
    if metadata:
        (folder / "metadata").write_text("{}")
    return str(folder)


def test_diagnosis(tmp_path, spark: SparkSession) -> None:  # noqa: ANN001
    state = lambda name, *a, **k: diagnose_checkpoint(checkpoint(tmp_path / name, *a, **k)).state
    assert state("ok", [0, 1], [0, 1]) is state("running", [0, 1, 2], [0, 1]) is CheckpointState.HEALTHY
    assert state("orphans", [0], [0, 1]) is state("gaps", [0, 2], [0, 2]) is CheckpointState.CORRUPTED
    assert state("pending", [0, 1, 2], [0]) is state("bare", [0], [0], metadata=False) is CheckpointState.DEGRADED
    assert diagnose_checkpoint(str(tmp_path / "none")).state is CheckpointState.MISSING
    manager = CheckpointManager(str(tmp_path))
    manager.reset(str(tmp_path / "ok"))
    manager.reset(str(tmp_path / "ok"))
    assert not manager.exists(str(tmp_path / "ok"))
    with pytest.raises(FileNotFoundError):
        manager.info(str(tmp_path / "ok"))


def test_compatibility(tmp_path, spark: SparkSession) -> None:  # noqa: ANN001
    place = str(tmp_path / "cp")
    assert check_compatibility(place, KIND).compatible
    remember_schema(place, KIND)
    assert check_compatibility(place, T.StructType([*KIND.fields, T.StructField("x", T.IntegerType())])).compatible
    found = check_compatibility(place, T.StructType.fromDDL("id string"))
    assert not found.compatible and len(found.changes) == 2 and "new checkpoint" in found.recommendation


@pytest.mark.parametrize(("value", "want"), [(5, 5), ("250 ms", 250), ("1 s", 1000), ("2 m", 120_000), ("1.5 s", 0), (None, 0), (2.5, 0), (True, 0)])
def test_durations(value, want) -> None:  # noqa: ANN001
    assert parse_duration_ms(value) == want


# --- jobs


def test_workflow(spark: SparkSession) -> None:
    sink, tries = Sink(), []

    class Job(Workflow):
        def run(self) -> None:
            tries.append(self.execution_time)
            df = self.spark.createDataFrame([(1, None), (2, "b")], KIND)
            self.quality_check(df, QualityGate(NotNull("id")), table_name="t")
            if len(tries) == 1:
                raise ConnectionError("once")

    at = datetime(2024, 1, 1, tzinfo=UTC)
    job = Job(config=JobConfig({}, spark_configs={"spark.sql.ansi.enabled": "true"}), metrics=sink, retry_config=RetryConfig(base_delay=0.01))
    assert job.execution_time is None
    job.execute(at)
    assert tries == [at, at] and [e.event_type for e in sink.events] == ["job_start", "quality_check", "quality_check", "job_complete"] and sink.flushed == 1
    assert sink.events[1].metadata == {"passed": True, "failed": []}

    class Bad(Workflow):
        def run(self) -> None:
            self.quality_check(self.spark.createDataFrame([(None, "b")], KIND), QualityGate(NotNull("id")))

    with pytest.raises(QualityError):
        Bad(metrics=sink).execute()
    assert sink.events[-1].event_type == "job_failed" and sink.events[-1].metadata["error_type"] == "QualityError" and sink.flushed == 2


def test_retry() -> None:
    calls = []

    @retry(RetryConfig(max_attempts=3, base_delay=0.05, max_delay=0.06))
    def flaky(error: type[Exception]) -> None:
        calls.append(time.time())
        raise error("no")

    with pytest.raises(TimeoutError):
        flaky(TimeoutError)
    assert len(calls) == 3 and calls[2] - calls[0] >= 0.1
    calls.clear()
    with pytest.raises(ValueError):
        flaky(ValueError)
    assert len(calls) == 1 and RetryConfig(base_delay=1, max_delay=3).delay(5) == 3
    with pytest.raises(ValueError):
        RetryConfig(max_attempts=0)


def test_config(monkeypatch: pytest.MonkeyPatch, spark: SparkSession) -> None:
    assert environment() is Environment.DEV
    monkeypatch.setenv("ENVIRONMENT", "staging")
    assert environment() is Environment.STAGING
    monkeypatch.setenv("ENV", "PROD")
    assert JobConfig.from_env(tables={"a": "x.y"}).env is Environment.PROD
    unity = UnityConfig(catalog_prefix="shop", schemas=["gold"])
    assert unity.table("gold.orders") == "shop_prod.gold.orders"
    for bad, error in (("orders", ValueError), ("a.b.c", ValueError), ("silver.x", KeyError)):
        with pytest.raises(error):
            unity.table(bad)
    monkeypatch.setenv("ENV", "moon")
    assert environment() is Environment.DEV
    with pytest.raises(KeyError, match="there are"):
        JobConfig({"a": "b"}).table("c")
    with pytest.raises(ValueError):
        JobConfig().secret("k")
    schema = CatalogSchema("gold", ["orders"], {"latest": "orders_v2"})
    assert (schema.orders, schema.latest) == ("gold.orders", "gold.orders_v2")
    with pytest.raises(AttributeError, match="there are"):
        schema.nothing  # noqa: B018
    assert get_active() is active_fallback() and active_fallback(spark) is spark


def test_secrets_and_files(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, tmp_path) -> None:  # noqa: ANN001
    monkeypatch.setattr(files.SecretFetcher, "dbutils", None)
    monkeypatch.setattr(files, "_FILES", {})
    with pytest.raises(RuntimeError):
        files.SecretFetcher.fetch_secret("s", "k")
    with pytest.raises(RuntimeError):
        files.ls("/")
    module = MockDBUtilsModule()
    files.inject_dbutils(module)
    module.instance.secrets.put("s", "k", "v")
    assert JobConfig(secret_scope="s").secret("k") == "v"
    files.mv("/a", "/b")
    files.copy_from_remote("/a", "/b", recurse=True)
    assert files.ls("/") == [] and module.instance.fs.calls[:2] == [("mv", ("/a", "/b", False)), ("cp", ("/a", "/b", True))]
    hadoop = files.HadoopFiles()
    (tmp_path / "f").write_text("x")
    assert hadoop.mkdirs(f"{tmp_path}/d") and hadoop.cp(f"{tmp_path}/f", f"{tmp_path}/d/g") and hadoop.ls(f"{tmp_path}/d") == ["g"]
    assert hadoop.mv(f"{tmp_path}/d/g", f"{tmp_path}/e/h") and hadoop.rm(f"{tmp_path}/e")


def test_logging_sink(caplog: pytest.LogCaptureFixture) -> None:
    with caplog.at_level("INFO"):
        LoggingMetricsSink().emit(MetricEvent("j", "x", datetime(2024, 1, 1, tzinfo=UTC)))
    assert json.loads(caplog.messages[-1])["event_type"] == "x"


def test_builder(df_builder: DataFrameBuilder) -> None:
    df = df_builder.with_columns(id="integer", name="string", amount="decimal(5,2)").with_sequential("id", 40).with_rows((99, "x", None)).with_nulls("id", 0.5, seed=1).build()
    assert df.count() == 41 and 5 < df.where("id IS NULL").count() < 36
    with pytest.raises(ValueError):
        DataFrameBuilder().with_sequential("id", 1)
