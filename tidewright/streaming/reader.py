"""Streams as micro-batches with a row filter, dead letters and a circuit breaker.

A batch is persisted once and counted once, so the source and the filter are not evaluated again for every action.
Dead letters and appends of :meth:`StreamingTableReader.append_once` are committed with (query, batch) in the table's
log, so a batch that is run again after a failure is written once.
"""

from __future__ import annotations

import time
import traceback
from abc import ABC, abstractmethod
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewright.job.metrics import MetricsSink, emit_event
from tidewright.job.session import active_fallback
from tidewright.operators.filters import Filter
from tidewright.sources.log import Files
from tidewright.sources.versioned import VersionedTable
from tidewright.streaming.batches import BatchContext, BatchLogger
from tidewright.streaming.checkpoint import CheckpointManager, remember_schema


class StreamingTrigger(Enum):
    SECONDS_10 = {"processingTime": "10 seconds"}
    SECONDS_30 = {"processingTime": "30 seconds"}
    MINUTE_1 = {"processingTime": "1 minute"}
    MINUTES_5 = {"processingTime": "5 minutes"}
    MINUTES_10 = {"processingTime": "10 minutes"}
    AVAILABLE_NOW = {"availableNow": True}


class CircuitBreakerError(RuntimeError):
    """Too many batches failed in a row."""


class ChangedRowsError(RuntimeError):
    """A version of a streamed table took rows away or changed them."""


#: Operations that rewrite files but no rows.
SAME_ROWS = ("OPTIMIZE", "RENAME COLUMN", "ADD COLUMN")


DLQ_COLUMNS = ("_dlq_error_message", "_dlq_error_timestamp", "_dlq_batch_id")


class DeadLetters:
    """A versioned table of failed batches; columns that are new to it are added."""

    def __init__(self, table: str, *, spark: SparkSession | None = None, location: str | None = None) -> None:
        self.name, self.spark, self.place = table, active_fallback(spark), location

    def write(self, df: DataFrame, batch_id: int, error: str, stream: str) -> None:
        marked = df.withColumns(
            dict(zip(DLQ_COLUMNS, (F.lit(error), F.current_timestamp(), F.lit(batch_id).cast("long")), strict=True))
        )
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in marked.schema])
        table = VersionedTable(self.name, nullable, self.place, spark=self.spark)
        table.write(marked, schema_check=False, merge_schema=True, transaction=(f"dlq:{stream}", batch_id))


class StreamingTableReader(ABC):
    """A stream over a table or files; subclasses define :meth:`process_batch`.

    With ``source_format="versioned"`` the source is a versioned table and each of its versions a batch: the rows of the
    files that it added. Rewrites that keep the rows are passed over; versions that changed or took rows raise
    :class:`ChangedRowsError`, or are passed over with the option ``skipChangeCommits``. The checkpoint holds the last
    version that was processed; :meth:`run_available` goes on from there.
    """

    def __init__(
        self, source: str, *, source_format: str = "parquet", trigger: StreamingTrigger | dict[str, Any] = StreamingTrigger.SECONDS_10,
        checkpoint_location: str | None = None, checkpoint_manager: CheckpointManager | None = None, row_filter: Filter | None = None,
        read_options: dict[str, str] | None = None, schema: T.StructType | str | None = None, dead_letter_table: str | None = None,
        max_consecutive_failures: int | None = None, metrics_sink: MetricsSink | None = None, spark: SparkSession | None = None,
    ) -> None:
        self.spark = active_fallback(spark)
        if checkpoint_location is None:
            if checkpoint_manager is None:
                raise ValueError("a stream needs a checkpoint_location or a checkpoint_manager")
            checkpoint_location = checkpoint_manager.path_for(source, type(self).__name__)
        if max_consecutive_failures is not None and max_consecutive_failures < 1:
            raise ValueError("max_consecutive_failures is 1 or more")
        self.source, self.format, self.checkpoint = source, source_format, checkpoint_location
        self.trigger = trigger.value if isinstance(trigger, StreamingTrigger) else dict(trigger)
        self.filter, self.options, self.schema = row_filter, read_options or {}, schema
        self.dead_letters = DeadLetters(dead_letter_table, spark=self.spark) if dead_letter_table else None
        self.limit, self.sink, self.failures = max_consecutive_failures, metrics_sink, 0
        self.logger = BatchLogger()
        self._query: StreamingQuery | None = None

    @abstractmethod
    def process_batch(self, df: DataFrame, batch_id: int) -> None:
        """Handle the filtered rows of one batch."""

    def append_once(self, table: VersionedTable, df: DataFrame, batch_id: int) -> None:
        """Append a batch's rows; running the batch again changes nothing."""
        table.write(df, transaction=(self.checkpoint, batch_id))

    def read_stream(self) -> DataFrame:
        reader = self.spark.readStream.format(self.format).options(**self.options)
        if self.schema is not None:
            reader = reader.schema(self.schema)
        by_name = self.format in ("delta", "table")
        return reader.table(self.source) if by_name else reader.load(self.source)

    def handle(self, df: DataFrame, batch_id: int) -> None:
        """One micro-batch, as foreachBatch calls it."""
        context = BatchContext(batch_id, self.source)
        kept = (self.filter(df) if self.filter else df).persist()
        try:
            rows = kept.count()
            if not rows:
                self.logger.skip(context, "no rows")
                return
            self.logger.start(context)
            try:
                self.process_batch(kept, batch_id)
            except Exception as e:
                self._failed(kept, rows, context, e)
                return
            self.failures = 0
            self.logger.complete(context, rows)
            emit_event(self.sink, type(self).__name__, "batch_complete", context.elapsed_ms(), rows, self.source, {"correlation_id": context.correlation_id}, batch_id)
        finally:
            kept.unpersist()

    def _failed(self, df: DataFrame, rows: int, context: BatchContext, error: Exception) -> None:
        self.failures += 1
        self.logger.error(context, error)
        if self.dead_letters is not None:
            text = "".join(traceback.format_exception(error))
            self.dead_letters.write(df, context.batch_id, text, self.checkpoint)
            self.logger.dlq(context, rows, self.dead_letters.name)
        if self.limit is not None and self.failures >= self.limit:
            raise CircuitBreakerError(f"{self.failures} batches in a row failed") from error
        if self.dead_letters is None:
            raise error

    def start(self) -> StreamingQuery:
        if self.format == "versioned":
            raise ValueError("a stream over a versioned table runs by run_available()")
        stream = self.read_stream()
        remember_schema(self.checkpoint, stream.schema, spark=self.spark)
        writer = stream.writeStream.foreachBatch(self.handle).trigger(**self.trigger)
        self._query = writer.option("checkpointLocation", f"{self.checkpoint}/query").start()
        return self._query

    def stop(self, timeout: float | None = None) -> None:
        query = self.query
        query.stop()
        query.awaitTermination(timeout) if timeout is not None else query.awaitTermination()

    @property
    def query(self) -> StreamingQuery:
        if self._query is None:
            raise ValueError("the stream was not started")
        return self._query

    @property
    def is_active(self) -> bool:
        return self._query is not None and self._query.isActive

    def _run_versions(self) -> None:
        """Batches of the versions after the last one that was processed."""
        table = VersionedTable.open(self.source, spark=self.spark)
        files, place = Files(self.spark, self.checkpoint), f"{self.checkpoint}/version"
        done = int(files.read(place)) if files.exists(place) else -1
        skip = str(self.options.get("skipChangeCommits", "false")).lower() == "true"
        for n in (n for n in table.log.numbers() if n > done):
            now, before = table.log.read(n), table.log.read(n - 1).files if n else {}
            gone = [f for f in before if f not in now.files]
            if gone and now.operation not in SAME_ROWS and not skip:
                raise ChangedRowsError(f"version {n} of {table.name} ({now.operation}) is no append")
            added = [f for f in now.files if f not in before]
            if added and not gone:
                self.handle(table._scan(now, added), n)
            files.put(place, str(n))

    def run_available(self, timeout: float = 300) -> None:
        """Process what is there and end."""
        if self.format == "versioned":
            self._run_versions()
            return
        self.trigger = StreamingTrigger.AVAILABLE_NOW.value
        began, query = time.time(), self.start()
        if not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError(f"the stream took more than {time.time() - began:.0f} s")
