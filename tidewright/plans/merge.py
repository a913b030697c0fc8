"""MERGE, upsert and SCD type 2 as pure plans: frames in, a frame out, no storage.

A merge's result has the target's columns and ``_action`` (keep, update, insert, delete). Keys that are equal join by
hash or sort; NULL keys never match. Clauses apply in call order, the first that holds wins.

A target row stands in the result once, however many source rows have its key: whether it has any is asked of the
distinct keys, and only source rows for which a clause of matched rows holds are joined to it. If several do, the merge
is ambiguous and :func:`touched` tells the caller; a plain delete alone bears it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTION = "_action"


class MergeConflictError(ValueError):
    """Several source rows match a row that one of them is to change."""


@dataclass
class Clause:
    """One WHEN clause: kind is update, delete, soft_delete, insert or orphan_delete."""

    kind: str
    columns: Sequence[str] | None = None
    condition: str | None = None
    assign: dict[str, Column] = field(default_factory=dict)


def key_condition(keys: Sequence[str]) -> str:
    return " AND ".join(f"target.`{k}` = source.`{k}`" for k in keys)


def _chosen(clauses: Sequence[Clause], kinds: tuple[str, ...]) -> Column:
    """Number of the first clause of these kinds whose condition holds."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(clauses))):
        c = clauses[k]
        if c.kind in kinds:
            holds = F.coalesce(F.expr(c.condition), F.lit(False)) if c.condition else F.lit(True)
            out = F.when(holds, F.lit(k)).otherwise(out)
    return out


MATCHED = ("update", "delete", "soft_delete")


def firing(clauses: Sequence[Clause]) -> Column | None:
    """Whether some clause of matched rows holds; none if there is no such clause."""
    conditions = [F.coalesce(F.expr(c.condition), F.lit(False)) if c.condition else F.lit(True) for c in clauses if c.kind in MATCHED]
    if not conditions:
        return None
    if any(c.kind in MATCHED and not c.condition for c in clauses):
        return F.lit(True)
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def deletes_only(clauses: Sequence[Clause]) -> bool:
    """Matched rows are deleted whatever the source row is, so several of them do no harm."""
    matched = [c for c in clauses if c.kind in MATCHED]
    return bool(matched) and matched[0].kind == "delete" and matched[0].condition is None


def touched(target: DataFrame, source: DataFrame, clauses: Sequence[Clause], on: str, row: Sequence[str], group: str) -> DataFrame:
    """(group, most): the groups (files) that hold target rows which a clause changes, and the largest number of source
    rows that would change one row of it. ``row`` names the columns that tell the target's rows apart."""
    t, s = target.alias("target"), source.alias("source")
    out = None
    fire = firing(clauses)
    if fire is not None:
        hits = t.join(s, F.expr(on) & fire).groupBy(*(F.col(f"target.`{c}`") for c in row)).agg(F.count(F.lit(1)).alias("_n"))
        out = hits.groupBy(group).agg(F.max("_n").alias("most"))
    orphans = [c for c in clauses if c.kind == "orphan_delete"]
    if orphans:
        holds = F.lit(False)
        for c in orphans:
            holds = holds | (F.coalesce(F.expr(c.condition), F.lit(False)) if c.condition else F.lit(True))
        lone = t.join(s, F.expr(on), "left_anti").alias("target").where(holds).select(group).distinct().withColumn("most", F.lit(1).cast("long"))
        out = lone if out is None else out.unionByName(lone).groupBy(group).agg(F.max("most").alias("most"))
    return target.select(group).where("false").withColumn("most", F.lit(0).cast("long")) if out is None else out


def merge_df(
    target: DataFrame, source: DataFrame, clauses: Sequence[Clause], *, keys: Sequence[str] | None = None, condition: str | None = None,
    insert_against: DataFrame | None = None,
) -> DataFrame:
    """Rows of the merged table, deleted ones included, marked by ``_action``.

    Only inserts need no more than an anti join; unconditional changes of matched rows a left join of the target; those
    and inserts a full outer join. ``insert_against`` is the whole target where ``target`` is part of it. Of several
    source rows that change one target row each gives a row: the caller asks :func:`touched` first.
    """
    if not keys and not condition:
        raise ValueError("a merge needs keys or a condition")
    on = condition or key_condition(keys)
    names = target.columns
    inserts = [c for c in clauses if c.kind == "insert"]
    orphans = [c for c in clauses if c.kind == "orphan_delete"]
    fire = firing(clauses)
    t, s = target.alias("target"), source.alias("source")
    whole = (target if insert_against is None else insert_against).alias("target")

    def with_new(rows: DataFrame) -> DataFrame:
        if not inserts:
            return rows
        new, taken = s.join(whole, F.expr(on), "left_anti").alias("source"), F.lit(False)
        for c in inserts:  # the first that holds wins
            holds = F.coalesce(F.expr(c.condition), F.lit(False)) if c.condition else F.lit(True)
            rows = rows.unionByName(_inserted(new.where(holds & ~taken), target, c))
            taken = taken | holds
        return rows

    if fire is None and not orphans:
        return with_new(target.withColumn(ACTION, F.lit("keep")))
    if fire is None or deletes_only(clauses):
        # nothing of the source's values is wanted
        matched = "delete" if fire is not None else "keep"
        has = t.join(s, F.expr(on), "left_semi").withColumn(ACTION, F.lit(matched))
        lone = t.join(s, F.expr(on), "left_anti").alias("target")
        return with_new(has.unionByName(lone.withColumn(ACTION, _orphaned(orphans))))
    always = any(c.kind in MATCHED and not c.condition for c in clauses)
    marked_t, marked_s = target.withColumn("_in_target", F.lit(True)).alias("target"), source.withColumn("_in_source", F.lit(True)).alias("source")
    together = always and bool(inserts) and insert_against is None
    joined = marked_t.join(marked_s, F.expr(on) if always else F.expr(on) & fire, "full_outer" if together else "left_outer")
    if orphans and not always:
        # a row whose source rows fire no clause is no orphan
        known = t.join(s, F.expr(on), "left_anti").withColumn("_lone", F.lit(True)).withColumn("_in_target", F.lit(True)).alias("target")
        rest = t.join(s, F.expr(on), "left_semi").withColumn("_lone", F.lit(False)).withColumn("_in_target", F.lit(True)).alias("target")
        joined = known.unionByName(rest).alias("target").join(marked_s, F.expr(on) & fire, "left_outer")
        orphan = F.col("target._lone")
    else:
        orphan = F.col("source._in_source").isNull() if always else F.lit(False)
    both = F.col("target._in_target").isNotNull() & F.col("source._in_source").isNotNull()
    fresh = F.col("target._in_target").isNull()
    pick = (
        F.when(both, _chosen(clauses, MATCHED))
        .when(fresh, _chosen(clauses, ("insert",)))
        .when(orphan, _chosen(clauses, ("orphan_delete",)))
    )
    verbs = {"update": "update", "soft_delete": "update", "delete": "delete", "orphan_delete": "delete", "insert": "insert"}
    action = F.lit("keep")
    values = {n: F.col(f"target.`{n}`") for n in names}
    for k, c in enumerate(clauses):
        here = F.col("_pick") == k
        action = F.when(here, F.lit(verbs[c.kind])).otherwise(action)
        if c.kind in ("update", "insert"):
            listed = list(c.columns or [n for n in names if n in source.columns])
            new = {n: F.col(f"source.`{n}`") for n in listed if n in source.columns and n in names}
            for n in names:
                if n in new:
                    values[n] = F.when(here, new[n].cast(target.schema[n].dataType)).otherwise(values[n])
        elif c.kind == "soft_delete":
            for n, value in c.assign.items():
                if n in values:
                    values[n] = F.when(here, value.cast(target.schema[n].dataType)).otherwise(values[n])
    out = joined.withColumn("_pick", pick)
    out = out.select(*(v.alias(n) for n, v in values.items()), action.alias(ACTION), fresh.alias("_fresh"), F.col("_pick"))
    # source rows that no insert clause takes
    out = out.where(~(F.col("_fresh") & F.col("_pick").isNull())).drop("_fresh", "_pick")
    return out if together else with_new(out)


def _orphaned(orphans: Sequence[Clause]) -> Column:
    """The action on a target row without a source row."""
    out = F.lit("keep")
    for c in orphans:
        out = F.when(F.coalesce(F.expr(c.condition), F.lit(False)), F.lit("delete")).otherwise(out) if c.condition else F.lit("delete")
    return out


def _inserted(rows: DataFrame, target: DataFrame, clause: Clause) -> DataFrame:
    listed = set(clause.columns or rows.columns)
    return rows.select(
        *((F.col(f"`{f.name}`") if f.name in rows.columns and f.name in listed else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema),
        F.lit("insert").alias(ACTION),
    )


def upsert_df(target: DataFrame, source: DataFrame, keys: Sequence[str], update_columns: Sequence[str] | None = None) -> DataFrame:
    return merge_df(target, source, [Clause("update", update_columns), Clause("insert")], keys=keys)


def soft_delete_clause(deleted_col: str | None = "is_deleted", deleted_at_col: str | None = "deleted_at", condition: str | None = None, as_of: datetime | None = None) -> Clause:
    """Mark matched rows as deleted; without a time column only the mark is set."""
    if deleted_col == "" or deleted_at_col == "" or deleted_col is None:
        raise ValueError("soft delete needs a name for its mark, and one or None for its time")
    assign = {deleted_col: F.lit(True)}
    if deleted_at_col is not None:
        assign[deleted_at_col] = F.lit(as_of) if as_of else F.current_timestamp()
    return Clause("soft_delete", condition=condition, assign=assign)


def scd2_df(
    target: DataFrame, source: DataFrame, keys: Sequence[str], *, as_of: datetime | None = None, reinsert: bool = True, only_changes: bool = False,
    effective_date_col: str = "effective_date", end_date_col: str = "end_date", active_col: str = "is_active",
) -> DataFrame:
    """Slowly changing dimension: active rows of the source's keys expire, and the source's rows become active.

    ``reinsert=False`` leaves out new versions of keys that expire in this run: they only expire. ``only_changes`` keeps
    active rows that equal the source's.
    """
    now = F.lit(as_of) if as_of else F.current_timestamp()
    values = [c for c in source.columns if c in target.columns and c not in keys]
    order = target.columns
    active = target.where(F.col(active_col))
    if only_changes:
        same = active.join(source.dropDuplicates(list(keys)).select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values)), list(keys), "inner")
        equal = F.lit(True)
        for c in values:
            equal = equal & F.col(c).eqNullSafe(F.col(f"_new_{c}"))
        source = source.join(same.where(equal).select(*keys), list(keys), "left_anti")
    touched = source.select(*keys, F.lit(True).alias("_hit")).distinct()
    joined = target.join(touched, list(keys), "left")
    expire = F.col("_hit").isNotNull() & F.coalesce(F.col(active_col), F.lit(False))
    kept = joined.withColumns(
        {
            ACTION: F.when(expire, "update").otherwise("keep"),
            end_date_col: F.when(expire, now.cast(target.schema[end_date_col].dataType)).otherwise(F.col(end_date_col)),
            active_col: F.when(expire, F.lit(False)).otherwise(F.col(active_col)),
        }
    ).select(*order, ACTION)
    fresh = source if reinsert else source.join(active.select(*keys).distinct(), list(keys), "left_anti")
    stage = {effective_date_col: now, end_date_col: F.lit(None), active_col: F.lit(True)}
    new = fresh.select(
        *((stage.get(f.name, F.col(f"`{f.name}`") if f.name in source.columns else F.lit(None))).cast(f.dataType).alias(f.name) for f in target.schema),
        F.lit("insert").alias(ACTION),
    )
    return kept.unionByName(new)


def merge_counts(merged: DataFrame) -> DataFrame:
    """One row: rows_inserted, rows_updated, rows_deleted."""
    return merged.agg(*(F.count_if(F.col(ACTION) == a).alias(f"rows_{a}{'d' if a.endswith('e') else 'ed'}") for a in ("insert", "update", "delete")))


def surviving(merged: DataFrame) -> DataFrame:
    return merged.where(F.col(ACTION) != "delete").drop(ACTION)
