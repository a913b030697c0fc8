"""Schema checks on frames and on the inputs and outputs of functions; none of them runs a job."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class DataFrameValidationError(ValueError):
    """A frame that isn't as demanded."""


class DataFrameMissingColumnError(DataFrameValidationError):
    def __init__(self, missing_columns: list[str], present: Iterable[str] = ()) -> None:
        self.missing_columns = missing_columns
        super().__init__(f"missing columns {missing_columns}; there are {list(present)}")


class DataFrameProhibitedColumnError(DataFrameValidationError):
    def __init__(self, prohibited_columns: list[str]) -> None:
        self.prohibited_columns = prohibited_columns
        super().__init__(f"prohibited columns {prohibited_columns}")


class DataFrameSchemaError(DataFrameValidationError):
    def __init__(self, missing_fields: list[Any]) -> None:
        self.missing_fields = missing_fields
        super().__init__("fields that don't match: " + "; ".join(map(str, missing_fields)))


def validate_presence_of_columns(df: DataFrame, required: Iterable[str]) -> None:
    if gone := [c for c in required if c not in df.columns]:
        raise DataFrameMissingColumnError(gone, df.columns)


def validate_absence_of_columns(df: DataFrame, prohibited: Iterable[str]) -> None:
    if found := [c for c in prohibited if c in df.columns]:
        raise DataFrameProhibitedColumnError(found)


def validate_schema(df: DataFrame, expected: T.StructType, *, ignore_nullable: bool = False) -> None:
    """Every expected field must be there with its type (and nullability); other columns don't matter."""
    have = {f.name: f for f in df.schema}
    fits = lambda f, g: f.dataType == g.dataType and (ignore_nullable or f.nullable == g.nullable)
    if wrong := [f for f in expected if f.name not in have or not fits(f, have[f.name])]:
        raise DataFrameSchemaError(wrong)


def _checked(df: Any, where: str, required: Iterable[str] | None, prohibited: Iterable[str] | None, schema: T.StructType | None, ignore_nullable: bool) -> None:  # noqa: ANN401
    if not isinstance(df, DataFrame):
        raise TypeError(f"{where} is {type(df).__name__}, not a DataFrame")
    if required:
        validate_presence_of_columns(df, required)
    if prohibited:
        validate_absence_of_columns(df, prohibited)
    if schema is not None:
        validate_schema(df, schema, ignore_nullable=ignore_nullable)


def validate_input(
    *, required_columns: Iterable[str] | None = None, prohibited_columns: Iterable[str] | None = None, schema: T.StructType | None = None,
    ignore_nullable: bool = False, df_arg: int | str = 0,
) -> Callable:
    """Check one argument, by position or name, however it is passed."""

    def decorate(fn: Callable) -> Callable:
        signature = inspect.signature(fn)

        @functools.wraps(fn)
        def call(*args: Any, **named: Any) -> Any:  # noqa: ANN401
            bound = signature.bind(*args, **named).arguments
            names = list(signature.parameters)
            name = names[df_arg] if isinstance(df_arg, int) and df_arg < len(names) else df_arg
            if name not in bound:
                raise TypeError(f"{fn.__name__} got no argument {df_arg!r}")
            _checked(bound[name], f"argument {name!r} of {fn.__name__}", required_columns, prohibited_columns, schema, ignore_nullable)
            return fn(*args, **named)

        return call

    return decorate


def validate_output(
    *, required_columns: Iterable[str] | None = None, prohibited_columns: Iterable[str] | None = None, schema: T.StructType | None = None,
    ignore_nullable: bool = False,
) -> Callable:
    """Check what a function returns."""

    def decorate(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def call(*args: Any, **named: Any) -> Any:  # noqa: ANN401
            out = fn(*args, **named)
            _checked(out, f"the result of {fn.__name__}", required_columns, prohibited_columns, schema, ignore_nullable)
            return out

        return call

    return decorate
