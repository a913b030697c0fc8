"""Merge and dedup plans, against plain Python, with NULL keys and repeated rows."""

from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from tidewright.plans import dedup, merge

KIND = "id int, name string, value int"
keys = st.one_of(st.none(), st.integers(0, 6))
rows = st.lists(st.tuples(keys, st.sampled_from("abc"), st.one_of(st.none(), st.integers(0, 3))), max_size=8)
quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def found(df) -> list:  # noqa: ANN001
    return sorted((tuple(r) for r in df.collect()), key=str)


@given(rows, rows)
@quick
def test_upsert(spark: SparkSession, target: list, source: list) -> None:
    source = list({r[0]: r for r in source if r[0] is not None}.values()) + [r for r in source if r[0] is None]
    t, s = spark.createDataFrame(target, KIND), spark.createDataFrame(source, KIND)
    new = {r[0]: r for r in source if r[0] is not None}
    have = {r[0] for r in target if r[0] is not None}
    want = [new.get(r[0], r) if r[0] is not None else r for r in target] + [r for r in source if r[0] not in have]
    assert found(merge.surviving(merge.upsert_df(t, s, ["id"]))) == sorted(want, key=str)


@given(rows)
@quick
def test_dedup(spark: SparkSession, data: list) -> None:
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "pk int, " + KIND)
    groups: dict = {}
    for k, r in enumerate(data):
        groups.setdefault(r, []).append(k)
    alone = [k for r, g in groups.items() for k in g if len(g) == 1 or None in r]
    assert sorted(r["pk"] for r in dedup.kill_duplicates_df(df, ["id", "name", "value"]).collect()) == sorted(alone)
    assert sorted(r["pk"] for r in dedup.drop_duplicates_pkey_df(df, "pk", ["id", "name", "value"]).collect()) == sorted(min(g) for g in groups.values())


def test_pkey_modes(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (None, "c"), (3, "c")], "pk int, g string")
    assert found(dedup.drop_duplicates_pkey_df(df, "pk", ["g"])) == sorted([(1, "a"), (2, "b"), (None, "c")], key=str)
    assert found(dedup.drop_duplicates_pkey_df(df, "pk", ["g"], by_key=True)) == sorted([(1, "a"), (None, "c")], key=str)


@pytest.fixture
def sides(spark: SparkSession):  # noqa: ANN201
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "n", 0)], KIND)
    source = spark.createDataFrame([(2, "B", 20), (3, "C", 30), (4, "D", 40), (None, "N", 9)], KIND)
    return target, source


def test_clauses(sides) -> None:  # noqa: ANN001
    C = merge.Clause
    run = lambda *c, **k: found(merge.surviving(merge.merge_df(*sides, list(c), **({"keys": ["id"]} | k))))
    assert run(C("insert", ["id"])) == sorted([(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "n", 0), (4, None, None), (None, None, None)], key=str)
    assert run(C("delete")) == sorted([(1, "a", 1), (None, "n", 0)], key=str)
    assert run(C("delete", condition="source.value > 25"), C("update", ["name"])) == sorted([(1, "a", 1), (2, "B", 2), (None, "n", 0)], key=str)
    assert run(C("update"), C("orphan_delete", condition="target.value > 0")) == sorted([(2, "B", 20), (3, "C", 30), (None, "n", 0)], key=str)
    assert run(C("update"), condition="target.id = source.id AND target.value < 3") == sorted([(1, "a", 1), (2, "B", 20), (3, "c", 3), (None, "n", 0)], key=str)
    assert run(C("insert", condition="value > 20")) == sorted([(1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "n", 0), (4, "D", 40)], key=str)
    with pytest.raises(ValueError):
        merge.merge_df(*sides, [C("update")])
    marks = {r["_action"]: r["count"] for r in merge.merge_df(*sides, [C("update"), C("insert")], keys=["id"]).groupBy("_action").count().collect()}
    assert marks == {"keep": 2, "update": 2, "insert": 2}


def test_soft_delete(sides, spark: SparkSession) -> None:  # noqa: ANN001
    t = sides[0].selectExpr("*", "false AS is_deleted", "CAST(NULL AS timestamp) AS deleted_at")
    out = merge.surviving(merge.merge_df(t, sides[1], [merge.soft_delete_clause(as_of=datetime(2024, 1, 1))], keys=["id"]))
    assert {r["id"]: r["is_deleted"] for r in out.collect()} == {1: False, 2: True, 3: True, None: False}
    assert list(merge.soft_delete_clause(deleted_at_col=None).assign) == ["is_deleted"]
    with pytest.raises(ValueError):
        merge.soft_delete_clause("")


def test_scd2(spark: SparkSession) -> None:
    day, now = datetime(2024, 1, 1), datetime(2024, 2, 1)
    kind = "id int, name string, effective_date timestamp, end_date timestamp, is_active boolean"
    target = spark.createDataFrame([(1, "a", day, None, True), (2, "b", day, None, True), (2, "old", day, day, False)], kind)
    source = spark.createDataFrame([(2, "B"), (3, "C")], "id int, name string")
    run = lambda **k: {(r["id"], r["name"]): (r["end_date"], r["is_active"]) for r in merge.surviving(merge.scd2_df(target, source, ["id"], as_of=now, **k)).collect()}
    assert run() == {(1, "a"): (None, True), (2, "b"): (now, False), (2, "old"): (day, False), (2, "B"): (None, True), (3, "C"): (None, True)}
    assert set(run(reinsert=False)) == {(1, "a"), (2, "b"), (2, "old"), (3, "C")}
    same = merge.scd2_df(target, source.union(spark.createDataFrame([(1, "a")], source.schema)), ["id"], as_of=now, only_changes=True)
    assert {r["name"]: r["is_active"] for r in merge.surviving(same).where("id = 1").collect()} == {"a": True}


def test_keys_of_several_columns(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, 5, "a"), (1, 4, "a"), (None, 9, "a"), (2, 1, "b"), (2, 1, "b")], "p int, q int, g string")
    assert found(dedup.drop_duplicates_pkey_df(df, ["p", "q"], ["g"])) == sorted([(None, 9, "a"), (2, 1, "b")], key=str)
    for bad in (lambda: dedup.kill_duplicates_df(df, []), lambda: dedup.drop_duplicates_pkey_df(df, [], ["g"]), lambda: dedup.drop_duplicates_pkey_df(df, "p", []), lambda: dedup.new_rows_df(df, df, [])):
        with pytest.raises(ValueError):
            bad()


def test_exports() -> None:
    import tidewright

    assert all(getattr(tidewright, n) is not None for n in tidewright.__all__) and "VersionedTable" in dir(tidewright)
    with pytest.raises(AttributeError):
        tidewright.nothing  # noqa: B018
