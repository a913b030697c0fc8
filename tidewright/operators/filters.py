"""Composable row and column filters; a pipeline of them is one lazy plan."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable

from pyspark.sql import DataFrame


class Filter(ABC):
    """Anything that takes a DataFrame to a DataFrame of the same rows or fewer."""

    @abstractmethod
    def apply(self, df: DataFrame) -> DataFrame:
        """The filtered frame."""

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


class FilterPipeline(Filter):
    """Filters in order; without any it changes nothing."""

    def __init__(self, filters: Iterable[Filter] | None = None) -> None:
        self.filters = list(filters or ())

    def add(self, item: Filter) -> FilterPipeline:
        self.filters.append(item)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for item in self.filters:
            df = df.transform(item)
        return df

    def __len__(self) -> int:
        return len(self.filters)


class DropDuplicates(Filter):
    """One row of each group of equal rows, or of equal values in ``subset``."""

    def __init__(self, subset: list[str] | None = None) -> None:
        self.subset = subset

    def apply(self, df: DataFrame) -> DataFrame:
        return df.dropDuplicates(self.subset) if self.subset else df.dropDuplicates()


class WhereFilter(Filter):
    """Rows for which a SQL condition is true."""

    def __init__(self, condition: str) -> None:
        self.condition = condition

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition)


class ColumnFilter(Filter):
    """The named columns, in that order."""

    def __init__(self, columns: list[str]) -> None:
        if not columns:
            raise ValueError("a column filter needs at least one column")
        self.columns = list(columns)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)
