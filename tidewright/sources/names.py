"""Table names: a guard against SQL in them, and a small catalog from names to folders, kept in the warehouse."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

from tidewright.sources.log import Files

_BAD = re.compile(r"--|;|/\*|\*/")


def checked_name(name: str) -> str:
    """The name, if it holds nothing that ends or comments a statement."""
    if not name or _BAD.search(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def _default(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/")
    return os.path.join(base, *name.split(".")) + ".versioned"


def _pointer(spark: SparkSession, name: str) -> str:
    """A small file beside the default folder that says where a table of this name really is."""
    return f"{_default(spark, name)}.location"


def root_of(spark: SparkSession, name: str, location: str | None = None) -> str:
    """Folder of a table: its location, the one that is registered for the name, or one below the warehouse.

    Registered locations are files in the warehouse, so they hold for other sessions and after a restart.
    """
    checked_name(name)
    if location:
        rename_root(spark, name, location.rstrip("/"))
        return location.rstrip("/")
    default, pointer = _default(spark, name), _pointer(spark, name)
    files = Files(spark, default)
    return files.read(pointer) if files.exists(pointer) else default


def rename_root(spark: SparkSession, name: str, root: str) -> None:
    """From now on the name stands for the folder."""
    pointer = _pointer(spark, checked_name(name))
    files = Files(spark, pointer)
    if not files.exists(pointer) or files.read(pointer) != root:
        files.put(pointer, root)


def forget(spark: SparkSession, name: str) -> None:
    files = Files(spark, _default(spark, name))
    if files.exists(_pointer(spark, name)):
        files.delete(_pointer(spark, name))
