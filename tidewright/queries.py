"""Registered queries over the library's own operators, each with its DuckDB equivalent where there is one.

Every query runs over its whole tables. NULLs and duplicates that the tables lack are made from keys, alike in both.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import quality as q
from tidewright.operators import transforms as t
from tidewright.operators.filters import ColumnFilter, DropDuplicates, FilterPipeline, WhereFilter
from tidewright.plans import dedup, merge
from tidewright.registry import AS_OF, ORACLES, QUERIES, read, registered, scratch
from tidewright.schema.alter import TableAlter
from tidewright.schema.diff import SchemaDiff
from tidewright.schema.migrations import MigrationRunner, MigrationStep
from tidewright.sources import versioned as v
from tidewright.streaming.reader import StreamingTableReader


# --- filters and projections ----------------------------------------------------------------------------------------


@registered("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'")
def where_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WhereFilter("o_totalprice > 1000 AND o_orderstatus = 'O'")(read(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey", "o_totalprice")


@registered("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def column_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ColumnFilter(["o_orderkey", "o_orderdate", "o_totalprice"])(read(spark, sf_dir, "orders"))


@registered("SELECT DISTINCT user_id, event_type FROM events")
def drop_duplicates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DropDuplicates()(read(spark, sf_dir, "events").select("user_id", "event_type"))


@registered("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def drop_duplicates_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DropDuplicates(["l_orderkey", "l_linenumber"])(read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber")


@registered("SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 1000")
def filter_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = FilterPipeline([WhereFilter("o_totalprice > 1000"), ColumnFilter(["o_custkey", "o_orderstatus"])]).add(DropDuplicates())
    return steps(read(spark, sf_dir, "orders"))


@registered("SELECT c_custkey AS cust_key, c_name AS full_name, c_acctbal AS acct_bal FROM customer")
def snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return t.snake_case_columns(c.select(F.col("c_custkey").alias("custKey"), F.col("c_name").alias("full-Name"), F.col("c_acctbal").alias("acct  Bal")))


@registered("SELECT n_nationkey, n_name AS x_n_name, n_regionkey AS x_n_regionkey FROM nation")
def prefix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.prefix_columns(read(spark, sf_dir, "nation"), "x_", exclude=["n_nationkey"])


@registered("SELECT n_nationkey, n_name AS n_name_x, n_regionkey AS n_regionkey_x FROM nation")
def suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.suffix_columns(read(spark, sf_dir, "nation"), "_x", exclude=["n_nationkey"])


@registered("SELECT event_id, user_id AS who_user_id, event_type AS who_what_event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS props_k FROM events")
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    nested = e.select("event_id", F.struct("user_id", F.struct("event_type").alias("what")).alias("who"), F.from_json("props", "k int").alias("props"))
    return t.flatten_struct(nested)


@registered(r"SELECT p_partkey, trim(regexp_replace('  ' || replace(p_name, ' ', '   ') || chr(9), '\s+', ' ', 'g')) AS p_name FROM part")
def single_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit("\t")).alias("p_name"))
    return t.single_space(p, "p_name")


@registered("SELECT p_partkey, trim(p_name) AS p_name, trim(p_brand) AS p_brand FROM part")
def trim_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"), F.concat("p_brand", F.lit("   ")).alias("p_brand"))
    return t.trim_all(p)


# --- deduplication --------------------------------------------------------------------------------------------------


@registered("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def kill_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return dedup.kill_duplicates_df(rows, ["l_orderkey", "l_linenumber"])


@registered("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def drop_duplicates_pkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_duplicates_pkey_df(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", ["user_id", "event_type"])


@registered(
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 "
    "UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderkey % 2 <> 0"
)
def append_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    target = orders.where("o_orderkey % 2 = 0")
    return target.unionByName(dedup.new_rows_df(target, orders.withColumn("o_totalprice", -F.col("o_totalprice")), ["o_orderkey"]))


# --- merges: target = customers whose key isn't divisible by 3, source = even keys with other balances ----------------

_SIDES = """WITH t AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0),
s AS (SELECT c_custkey AS id, c_name || '!' AS name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0) """


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    other = c.where("id % 2 = 0").withColumns({"name": F.concat("name", F.lit("!")), "bal": F.col("bal") + 1})
    return c.where("id % 3 <> 0"), other


def _merged(spark: SparkSession, sf_dir: str, *clauses: merge.Clause, condition: str | None = None) -> DataFrame:
    target, source = _sides(spark, sf_dir)
    return merge.surviving(merge.merge_df(target, source, list(clauses), keys=["id"], condition=condition))


@registered(_SIDES + "SELECT coalesce(s.id, t.id) AS id, coalesce(s.name, t.name) AS name, coalesce(s.bal, t.bal) AS bal FROM t FULL JOIN s ON t.id = s.id")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.Clause("update"), merge.Clause("insert"))


@registered(_SIDES + "SELECT t.id, t.name, coalesce(s.bal, t.bal) AS bal FROM t LEFT JOIN s ON t.id = s.id")
def merge_update_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.Clause("update", ["bal"]))


@registered(_SIDES + "SELECT * FROM t UNION ALL SELECT id, name, NULL FROM s WHERE id NOT IN (SELECT id FROM t)")
def merge_insert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.Clause("insert", ["id", "name"]))


@registered(_SIDES + "SELECT t.* FROM t WHERE id NOT IN (SELECT id FROM s)")
def merge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.Clause("delete"))


@registered(_SIDES + "SELECT t.id, coalesce(s.name, t.name) AS name, coalesce(s.bal, t.bal) AS bal FROM t LEFT JOIN s ON t.id = s.id WHERE s.id IS NULL OR NOT (s.bal > 5000)")
def merge_delete_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.Clause("delete", condition="source.bal > 5000"), merge.Clause("update"))


@registered(_SIDES + "SELECT t.id, s.name, s.bal FROM t JOIN s ON t.id = s.id")
def merge_by_source_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.Clause("update"), merge.Clause("orphan_delete"))


@registered(_SIDES + "SELECT t.*, s.id IS NOT NULL AS is_deleted, CASE WHEN s.id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS deleted_at FROM t LEFT JOIN s ON t.id = s.id")
def merge_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _sides(spark, sf_dir)
    target = target.withColumns({"is_deleted": F.lit(False), "deleted_at": F.lit(None).cast("timestamp_ntz")})
    return merge.surviving(merge.merge_df(target, source, [merge.soft_delete_clause(as_of=AS_OF)], keys=["id"]))


@registered(_SIDES + "SELECT t.id, coalesce(s.name, t.name) AS name, coalesce(s.bal, t.bal) AS bal FROM t LEFT JOIN s ON t.id = s.id AND t.bal > 0")
def merge_on_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.Clause("update"), condition="target.id = source.id AND target.bal > 0")


@registered(
    _SIDES + "SELECT (SELECT count(*) FROM s WHERE id NOT IN (SELECT id FROM t)) AS rows_inserted, "
    "(SELECT count(*) FROM t JOIN s ON t.id = s.id) AS rows_updated, (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM s)) AS rows_deleted"
)
def merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _sides(spark, sf_dir)
    clauses = [merge.Clause("update"), merge.Clause("insert"), merge.Clause("orphan_delete")]
    return merge.merge_counts(merge.merge_df(target, source, clauses, keys=["id"]))


_DIM = """WITH t AS (SELECT c_custkey AS id, c_mktsegment AS segment, TIMESTAMP '2024-01-01 00:00:00' AS effective_date,
  CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS end_date, c_custkey % 5 <> 0 AS is_active FROM customer WHERE c_custkey % 3 <> 0),
s AS (SELECT c_custkey AS id, c_mktsegment || '!' AS segment FROM customer WHERE c_custkey % 2 = 0),
kept AS (SELECT id, segment, effective_date, CASE WHEN is_active AND id IN (SELECT id FROM s) THEN TIMESTAMP '2024-02-01 00:00:00' ELSE end_date END AS end_date,
  is_active AND id NOT IN (SELECT id FROM s) AS is_active FROM t)
SELECT * FROM kept UNION ALL SELECT id, segment, TIMESTAMP '2024-02-01 00:00:00', NULL, true FROM s """


def _dimension(spark: SparkSession, sf_dir: str, *, reinsert: bool) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    ended = F.when(F.col("id") % 5 == 0, F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz"))
    target = c.where("id % 3 <> 0").select("id", "segment", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("effective_date"), ended.alias("end_date"), (F.col("id") % 5 != 0).alias("is_active"))
    source = c.where("id % 2 = 0").withColumn("segment", F.concat("segment", F.lit("!")))
    return merge.surviving(merge.scd2_df(target, source, ["id"], as_of=AS_OF, reinsert=reinsert))


@registered(_DIM)
def scd2_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dimension(spark, sf_dir, reinsert=True)


@registered(_DIM + "WHERE id NOT IN (SELECT id FROM t WHERE is_active)")
def scd2_expire_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dimension(spark, sf_dir, reinsert=False)


# --- quality --------------------------------------------------------------------------------------------------------

_EVENTS = """WITH e AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events) """


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"),
    )


EXPECTATIONS: dict[str, tuple[q.Expectation, str]] = {
    "q_not_null": (q.NotNull("event_type", "value"), "count(*) FILTER (WHERE event_type IS NULL OR value IS NULL)"),
    "q_in_range": (q.InRange("value", min_val=1.0, max_val=50.0), "count(*) FILTER (WHERE value < 1 OR value > 50)"),
    "q_unique": (q.Unique("user_id", "event_type"), "count(*) - count(DISTINCT (user_id, event_type))"),
    "q_row_count": (q.RowCount(min_count=1, max_count=10**12), "0"),
    "q_regex": (q.MatchesRegex("event_type", "^[a-z]+$"), "count(*) FILTER (WHERE NOT regexp_matches(event_type, '^[a-z]+$'))"),
    "q_column_exists": (q.ColumnExists("event_id", "gone"), "1"),
    "q_freshness": (q.FreshnessExpectation("ts", timedelta(days=10), as_of=AS_OF), "count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-22 00:00:00')"),
}
_PASSED = {"q_row_count": "true", "q_column_exists": "false", "q_freshness": "max(ts) >= TIMESTAMP '2024-01-22 00:00:00'"}


def _report_sql(name: str) -> str:
    expectation, failing = EXPECTATIONS[name]
    title = expectation.name.replace("'", "''")
    return f"SELECT '{title}' AS expectation, {_PASSED.get(name, f'({failing}) = 0')} AS passed, count(*) AS total_rows, CAST({failing} AS BIGINT) AS failing_rows FROM e"


def _single(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _events(spark, sf_dir)
        return q.evaluate(df, [EXPECTATIONS[name][0]]).to_df(df)

    QUERIES[name], ORACLES[name] = run, _EVENTS + _report_sql(name)


for _name in EXPECTATIONS:
    _single(_name)


@registered(_EVENTS + " UNION ALL ".join(map(_report_sql, EXPECTATIONS)))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir)
    return q.evaluate(df, [e for e, _ in EXPECTATIONS.values()]).to_df(df)


_BAD = "event_type IS NULL OR value > 50"


@registered(_EVENTS + f"SELECT event_id, event_type, value FROM e WHERE {_BAD}")
def quarantine_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.split_quarantine(_events(spark, sf_dir), [q.NotNull("event_type"), q.InRange("value", max_val=50.0)])[0].select("event_id", "event_type", "value")


@registered(_EVENTS + f"SELECT event_id, event_type, value FROM e WHERE NOT coalesce({_BAD}, false)")
def quarantine_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.split_quarantine(_events(spark, sf_dir), [q.NotNull("event_type"), q.InRange("value", max_val=50.0)])[1].select("event_id", "event_type", "value")


_PROFILED = (("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True), ("c_mktsegment", "string", False))


def _profile_sql(column: str, kind: str, number: bool) -> str:
    text = lambda f: f"CAST({f}({column}) AS VARCHAR)"
    mean = f"avg(CAST({column} AS DOUBLE))" if number else "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT '{column}' AS name, '{kind}' AS dtype, count(*) AS row_count, count(*) - count({column}) AS null_count, count(DISTINCT {column}) AS distinct_count, "
        f"{text('min')} AS min_val, {text('max')} AS max_val, round({mean}, 6) AS mean FROM c"
    )


@registered(
    "WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey END AS c_nationkey, c_mktsegment FROM customer) "
    + " UNION ALL ".join(_profile_sql(*p) for p in _PROFILED)
)
def profile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 13 != 0, F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment")
    return q.profile_df(c, exact=True).withColumn("mean", F.round("mean", 6))


@registered()
def profile_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts are estimates, so there is no SQL equal."""
    return q.profile_df(read(spark, sf_dir, "lineitem"))


@registered("SELECT * FROM (VALUES ('o_comment', 'added', NULL, 'string', 'info'), ('o_orderpriority', 'removed', 'string', NULL, 'breaking'), "
            "('o_totalprice', 'type_changed', 'double', 'decimal(12,2)', 'breaking')) AS v(\"column\", change_type, old_value, new_value, severity)")  # fmt: skip
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "orders")
    new = old.drop("o_orderpriority").withColumns({"o_totalprice": F.col("o_totalprice").cast("decimal(12,2)"), "o_comment": F.lit(None).cast("string")})
    return SchemaDiff(old.schema, new.schema).to_df(spark)


# --- versioned tables -----------------------------------------------------------------------------------------------


def _table(spark: SparkSession, like: DataFrame, **options: object) -> v.VersionedTable:
    name = f"q_{uuid.uuid4().hex[:12]}"
    return v.VersionedTable(name, like.schema, f"{scratch(spark)}/{name}", spark=spark, **options)


@registered("SELECT event_id, ts, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def generated_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    table = _table(spark, e, partition_by="event_type", generated_columns=[v.GeneratedColumn("day", "date", "CAST(ts AS DATE)")])
    table.write(e)
    return table.dataframe().withColumn("day", F.col("day").cast("string"))


@registered("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = _table(spark, o, partition_by="o_orderstatus")
    table.write(o)
    table.write(table.dataframe().where("o_totalprice > 100000"), "overwrite")
    return table.dataframe()


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def restore_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    table = _table(spark, n)
    first = table.write(n)
    table.write(n.where("n_nationkey < 3"), "overwrite")
    v.optimize_table(table, zorder_by="n_nationkey")
    table.restore(first)
    return table.dataframe()


@registered("SELECT * FROM (VALUES (0, 'CREATE TABLE', 0), (1, 'WRITE', 25), (2, 'MERGE', 25), (3, 'ADD COLUMN', 0), (4, 'RESTORE', 0)) AS v(version, operation, n_rows)")
def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    table = _table(spark, n)
    table.write(n)
    table.upsert(n.where("n_nationkey < 5").withColumn("n_name", F.upper("n_name")), ["n_nationkey"])
    TableAlter(table).add_column("n_note", "string").apply()
    table.restore(2)
    rows = F.coalesce(F.try_element_at("operation_metrics", F.lit("rows")).cast("int"), F.lit(0))
    return table.history().select(F.col("version").cast("int").alias("version"), "operation", rows.alias("n_rows"))


@registered(_SIDES + "SELECT coalesce(s.id, t.id) AS id, coalesce(s.name, t.name) AS name, coalesce(s.bal, t.bal) AS bal, CAST(NULL AS VARCHAR) AS note FROM t FULL JOIN s ON t.id = s.id")
def table_upsert_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _sides(spark, sf_dir)
    table = _table(spark, target)
    table.write(target)
    table.upsert(source, ["id"])
    TableAlter(table).add_column("note", "string").rename_column("name", "title").rename_column("title", "name").apply()
    return table.dataframe()


@registered("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def table_kill_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    table = _table(spark, rows)
    table.write(rows)
    v.kill_duplicates(table, ["l_orderkey", "l_linenumber"])
    return table.dataframe()


@registered("SELECT * FROM (VALUES ('001', true), ('002', true), ('003', false)) AS v(version, success)")
def migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, read(spark, sf_dir, "region"))
    place = scratch(spark)
    runner = MigrationRunner(f"q_{uuid.uuid4().hex[:12]}", spark=spark, location=place)
    runner.register(MigrationStep("002", "note", lambda s: TableAlter(table).add_column("note", "string").apply()))
    runner.register(MigrationStep("001", "load", lambda s: table.write(read(s, sf_dir, "region"))))
    runner.register(MigrationStep("003", "fails its check", lambda s: None, post_validate=lambda s: False))
    runner.run()
    return runner.history_df().select("version", "success")


# --- pipelines ------------------------------------------------------------------------------------------------------


@registered(
    "SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / (count(*) * 100.0::DOUBLE) AS avg_price, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) AS done_rate, "
    "max(o_orderdate) AS last_order, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2024-02-01') AS days_since FROM "
    "(SELECT DISTINCT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate FROM orders WHERE o_totalprice > 1000) GROUP BY o_custkey"
)
def feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, then a gate, then features a customer: the flagship query."""
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate"]
    orders = FilterPipeline([ColumnFilter(columns), WhereFilter("o_totalprice > 1000"), DropDuplicates(["o_orderkey"])])(read(spark, sf_dir, "orders"))
    orders = q.QualityGate(q.NotNull("o_custkey"), q.InRange("o_totalprice", min_val=0), on_fail="raise").enforce(orders)
    return orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / (F.count(F.lit(1)) * 100.0)).alias("avg_price"),
        (F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("done_rate"), F.max("o_orderdate").alias("last_order"),
        F.datediff(F.lit(AS_OF.date()), F.max("o_orderdate").cast("date")).cast("long").alias("days_since"),
    )


@registered("SELECT l_orderkey AS order_id, l_partkey AS part_id, CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS price, round(l_extendedprice * (1 - l_discount), 4) AS net, "
            "strftime(l_shipdate, '%Y-%m-%d') AS ship_day FROM lineitem WHERE l_quantity > 0")  # fmt: skip
def bronze_to_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = WhereFilter("l_quantity > 0")(read(spark, sf_dir, "lineitem"))
    return rows.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"),
    )


@registered("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# --- streams --------------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, *, condition: str | None = None, fail: bool = False) -> DataFrame:
    """The events as a stream into a table; with ``fail`` all batches go to the dead letters."""
    events = read(spark, sf_dir, "events")
    folder, name = scratch(spark), f"q_{uuid.uuid4().hex[:12]}"
    table = v.VersionedTable(name, events.schema, f"{folder}/{name}", spark=spark)
    dead = f"{name}_dead"
    dead_table = v.VersionedTable(dead, events.schema, f"{folder}/{dead}", spark=spark)

    class Copy(StreamingTableReader):
        def process_batch(self, df: DataFrame, batch_id: int) -> None:
            if fail:
                raise RuntimeError("refused")
            self.append_once(table, df, batch_id)

    stream = Copy(
        f"{sf_dir}/events.parquet*", schema=events.schema, checkpoint_location=f"{folder}/checkpoint", row_filter=WhereFilter(condition) if condition else None,
        dead_letter_table=dead, spark=spark,
    )
    stream.run_available()
    return dead_table.dataframe().where("_dlq_error_message IS NOT NULL") if fail else table.dataframe()


_STREAM_SQL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


@registered(_STREAM_SQL)
def stream_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir)


@registered(_STREAM_SQL + " WHERE value > 20")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, condition="value > 20")


@registered("SELECT event_id, event_type, 0 AS _dlq_batch_id FROM events")
def stream_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, fail=True).select("event_id", "event_type", F.col("_dlq_batch_id").cast("int").alias("_dlq_batch_id"))


