"""Column renames and text transforms: one projection each, all names changed at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _renamed(df: DataFrame, rename: Callable[[str], str]) -> DataFrame:
    return df.toDF(*(rename(c) for c in df.columns))


def snake_case(name: str) -> str:
    """``orderId`` -> ``order_id``; runs of other signs become one underscore; acronyms stay together."""
    parted = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
    return "_".join(filter(None, re.split(r"[^a-z0-9]+", parted)))


def snake_case_columns(df: DataFrame) -> DataFrame:
    """All column names in snake case."""
    return _renamed(df, snake_case)


def prefix_columns(df: DataFrame, prefix: str, *, exclude: Iterable[str] | None = None) -> DataFrame:
    """``prefix`` before every name that isn't excluded."""
    kept = set(exclude or ())
    return _renamed(df, lambda c: c if c in kept else prefix + c)


def suffix_columns(df: DataFrame, suffix: str, *, exclude: Iterable[str] | None = None) -> DataFrame:
    """``suffix`` behind every name that isn't excluded."""
    kept = set(exclude or ())
    return _renamed(df, lambda c: c if c in kept else c + suffix)


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = []
    for field in schema:
        at = (*path, field.name)
        out += _leaves(field.dataType, at) if isinstance(field.dataType, T.StructType) else [at]
    return out


def flatten_struct(df: DataFrame, *, separator: str = "_") -> DataFrame:
    """Nested structs as top-level columns, depth first; arrays and maps are leaves."""
    paths = _leaves(df.schema)
    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in paths))


def collapsed(column: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def single_space(df: DataFrame, *columns: str) -> DataFrame:
    """:func:`collapsed` for the named columns."""
    return df.withColumns({c: collapsed(F.col(f"`{c}`")) for c in columns}) if columns else df


def trim_all(df: DataFrame) -> DataFrame:
    """Spaces go from both ends of every string column."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.trim(F.col(f"`{c}`")) for c in text}) if text else df
