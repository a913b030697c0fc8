"""Row deduplication as pure plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(columns: Sequence[str] | str, what: str) -> list[str]:
    """The columns as a list; none is an error."""
    out = [columns] if isinstance(columns, str) else list(columns or ())
    if not out or not all(out):
        raise ValueError(f"{what} must name a column")
    return out


def repeated_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key tuples of several rows; aggregated, so a group that holds a third of the rows is no single task."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def kill_duplicates_df(df: DataFrame, columns: Sequence[str], repeated: DataFrame | None = None) -> DataFrame:
    """Without *all* rows of any group that holds several; groups with a NULL stay."""
    columns = named(columns, "columns")
    return df.join(repeated_keys(df, columns) if repeated is None else repeated, columns, "left_anti").select(*df.columns)


def _order(pkey: Sequence[str]) -> Column:
    """Keys as one value that sorts like them, NULL first."""
    return F.struct(*(x for c in pkey for x in (F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`"))))


def least_keys(df: DataFrame, pkey: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(columns, _least, _n) of the groups of several rows: the smallest key and the number of rows."""
    return df.groupBy(*columns).agg(F.min(_order(pkey)).alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")


def drop_duplicates_pkey_df(
    df: DataFrame, pkey: Sequence[str] | str, columns: Sequence[str], *, by_key: bool = False, least: DataFrame | None = None
) -> DataFrame:
    """Of each group only the row with the smallest key (of one column or several, NULL first). ``by_key`` removes rows by
    their key, so a key that isn't unique takes its other rows along. Several rows of a group may share the smallest
    key: one of them stays.

    The smallest keys are aggregated and joined, so no group is gathered in one task.
    """
    pkey, columns = named(pkey, "primary key"), named(columns, "columns")
    least = least_keys(df, pkey, columns) if least is None else least
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"d.`{c}`").eqNullSafe(F.col(f"l.`{c}`"))
    marked = df.withColumn("_key", _order(pkey)).alias("d").join(least.alias("l"), same, "left")
    first = F.col("l._least").isNull() | (F.col("d._key") == F.col("l._least"))
    rows = marked.select(*(F.col(f"d.`{c}`") for c in df.columns), first.alias("_first"), F.col("l._n").alias("_n"))
    if by_key:
        extra = rows.where("_n IS NOT NULL")
        # all rows of a group but one go by their key: where the smallest key stands twice, it goes, too
        ties = extra.where("_first").groupBy(*columns, *(c for c in pkey if c not in columns)).agg(F.count(F.lit(1)).alias("_ties")).where("_ties > 1")
        gone = extra.where("NOT _first").select(*pkey).union(ties.select(*pkey)).distinct()
        return df.join(gone, pkey, "left_anti").select(*df.columns)
    lone, several = rows.where("_n IS NULL"), rows.where("_n IS NOT NULL AND _first")
    kept = several.dropDuplicates(list(dict.fromkeys([*columns, *pkey])))
    return lone.select(*df.columns).unionByName(kept.select(*df.columns))


def new_rows_df(target: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys the target doesn't hold; NULL keys are always new."""
    keys = named(keys, "keys")
    return df.join(target.select(*keys), keys, "left_anti").select(*df.columns)
