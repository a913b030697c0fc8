"""The Spark session in use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_active() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("there is no active Spark session")
    return found


def active_fallback(spark: SparkSession | None = None) -> SparkSession:
    """The given session or the active one."""
    return spark if spark is not None else get_active()


def get_or_create_local_session(app_name: str = "tidewright", **conf: str) -> SparkSession:
    """A session on this machine's cores."""
    builder = SparkSession.builder.master("local[*]").appName(app_name).config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
