"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes A-Z -> a-z, everything else unchanged
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: as ASCII_LOWER, and every ASCII byte that is no letter or digit becomes a space
ALNUM_LOWER = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
#: Rows of an Arrow batch handed to Python, where the session has Spark's default of ten times as many; texts may be long,
#: and the JVM holds a batch of each direction, too.
BATCH_ROWS, DEFAULT_ROWS = 1000, "10000"
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What workers are told: memory that they free goes back to the system.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(found)
        found = f"file://{found}"
    return found.rstrip("/")


#: What :func:`written` has written within each open :func:`temporary`.
_OPEN: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what :func:`written` writes meanwhile, but for tables that are :func:`kept`. Whatever is to be
    read of it must have been read by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """A written table that outlives the :func:`temporary` around it."""
    path = getattr(df, "tidewright_path", None)
    for paths in _OPEN:
        if path in paths:
            paths.remove(path)
    return df


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright-{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidewright_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`written` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "tidewright_path", None)
    if path:
        _delete(df.sparkSession, path)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of ``BATCH_ROWS``, whose Python workers can import this package where it lies beside the
    job's files."""
    root = str(Path(__file__).resolve().parents[2])
    conf, env = df.sparkSession.conf, df.sparkSession.sparkContext.environment
    if conf.get(_ROWS_SETTING, DEFAULT_ROWS) == DEFAULT_ROWS:
        conf.set(_ROWS_SETTING, BATCH_ROWS)
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *known]))
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch, sliced so that Python holds a bounded number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                yield fn(batch.slice(k, BATCH_ROWS))

    return arrow_map(df, run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text, under fixed names, whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def with_rest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`keyed`, with all other columns in a struct ``rest`` that passes through Python untouched."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(None).cast("int").alias("_none"))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))


def restored(df: DataFrame, like: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``like`` again, from doc_id, text and rest; a column n_chars follows the text."""
    cols = []
    for name, kind in like.dtypes:
        if name == id_col:
            c = F.col("doc_id")
        elif name == text_col:
            c = F.col("text")
        else:
            c = F.length("text") if name == "n_chars" else F.col("rest").getField(name)
        cols.append(c.cast(kind).alias(name))
    return df.select(*cols)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def fold_of(doc_id: int, n: int) -> int:
    """:func:`fold` on the driver."""
    return zlib.crc32(str(doc_id).encode()) % n


def single_thread() -> None:
    """Keep BLAS of a Python worker to the one core its task owns."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")


def small_or_shuffled(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint for ``df`` (cheap to read again, such as one from :func:`written`) if it has at most ``limit``
    rows; else Spark's joins shuffle it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Rows of a key that one task may always join, keys with more of them that may be broadcast, and rows of a side that may.
HOT_ROWS, HOT_KEYS, FEW_ROWS = 200, 50_000, 50_000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``left``, of at most ``total`` rows, with ``right``: one row a key, with its rows in ``left`` as ``n``.

    Keys with more than ``HOT_ROWS`` rows, and more than ``total / HOT_KEYS`` of them, are joined by a broadcast. There
    are at most ``HOT_KEYS`` such keys, so its size is bounded whatever the data; no task of the shuffle join for the
    others gets a key of more rows than that. Where ``left`` has at most ``FEW_ROWS`` rows, so do the keys that matter, and
    all of them are broadcast.
    """
    if total <= FEW_ROWS:
        return left.join(F.broadcast(right), keys)
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = right.where(F.col("n") > most)
    return left.join(F.broadcast(hot), keys).unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col("n") <= most), keys))
