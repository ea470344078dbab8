"""One query for each capability, over the star schema, with the same result in DuckDB's SQL.

A query is the engine's own SQL; where DuckDB reads it alike, it is its own oracle.  Scripts
that change tables work on copies that the session registers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

_GROUP = "count(*) AS n, sum(l_linenumber) AS lines, min(l_quantity) AS low, max(l_quantity) AS high"

#: name: engine's SQL, or (engine's SQL, DuckDB's SQL)
SELECTS: dict[str, str | tuple[str, str]] = {
    "flagship": (
        "SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS n, sum(l.l_linenumber) AS lines, min(l.l_shipdate) AS first_ship, max(l.l_extendedprice - l.l_discount) AS top "
        "FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey "
        "WHERE l.l_quantity > 10 AND o.o_orderstatus <> 'P' GROUP BY c.c_mktsegment, o.o_orderpriority ORDER BY count(*) DESC, c.c_mktsegment, o.o_orderpriority LIMIT 10 + 10"
    ),
    "scan_all": "SELECT * FROM region",
    "scan_wide": "SELECT * FROM orders",
    "project_reorder": "SELECT n_name, n_nationkey FROM nation",
    "wildcard_qualified": "SELECT r.*, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "alias_output": "SELECT n_name AS name, n_nationkey key_ FROM nation",
    "case_insensitive": "SELECT N_NAME AS n_name FROM nation WHERE Nation.n_NAME > 'G'",
    "arith_add_sub": "SELECT l_orderkey, l_linenumber, l_extendedprice - l_discount AS net, l_linenumber + 1 AS next_line, l_orderkey - l_linenumber AS wide FROM lineitem",
    "arith_literals": "SELECT n_nationkey + 2 - 1 AS a, (n_nationkey - 3) - (2 - 1) AS b, n_nationkey + 0.5 AS c FROM nation",
    "negate": "SELECT c_custkey, -c_acctbal AS neg, -(-c_nationkey) AS same FROM customer",
    "cmp_eq": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "cmp_ne": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "cmp_lt": "SELECT p_partkey, p_size FROM part WHERE p_size < 10",
    "cmp_le": "SELECT p_partkey FROM part WHERE p_size <= 10",
    "cmp_gt": "SELECT c_custkey FROM customer WHERE c_mktsegment > 'BUILDING'",
    "cmp_ge": "SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0",
    "cmp_mixed": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > l_linenumber AND l_orderkey < l_partkey",
    "cmp_boolean": "SELECT p_partkey FROM part WHERE (p_size > 5) = (p_retailprice > 1000)",
    "cmp_output": "SELECT p_partkey, p_size > 25 AS large FROM part",
    "logic_and_or_not": "SELECT p_partkey FROM part WHERE p_size > 10 AND NOT (p_size > 40 OR p_retailprice < 950)",
    "logic_kleene": (
        "SELECT o.o_orderkey, l.l_quantity > 25 AND o.o_totalprice > 0 AS a, l.l_quantity > 25 OR o.o_totalprice > 0 AS b, NOT l.l_quantity > 25 AS c "
        "FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey"
    ),
    "is_null": "SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL",
    "is_not_null": "SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NOT NULL",
    "null_literal": ("SELECT r_regionkey, r_regionkey + NULL AS a, r_name = NULL AS b, NULL IS NULL AS c FROM region", "SELECT r_regionkey, NULL::INT AS a, NULL::BOOLEAN AS b, true AS c FROM region"),
    "filter_null_drops": ("SELECT r_regionkey FROM region WHERE r_regionkey > NULL", "SELECT r_regionkey FROM region WHERE false"),
    "join_inner": "SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_inner_filter": "SELECT c_name, o_orderkey FROM customer INNER JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal WHERE c_mktsegment = 'BUILDING'",
    "join_composite": (
        "SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS part_a, b.l_partkey AS part_b FROM lineitem a JOIN lineitem b "
        "ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"
    ),
    "join_left": "SELECT o.o_orderkey, l.l_partkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey",
    "join_left_docs": "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "join_theta": "SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey < c.c_nationkey AND s.s_acctbal > c.c_acctbal",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_three_way": (
        "SELECT c.c_name, o.o_orderkey, l.l_linenumber, l.l_quantity FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey "
        "JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 45"
    ),
    "join_const_pred": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_nationkey = 7",
    "join_left_const": "SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey = 99",
    "join_self_alias": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_widening": "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_custkey = n.n_nationkey",
    "agg_global": "SELECT count(*) AS n, sum(l_linenumber) AS lines, min(l_quantity) AS low, max(l_extendedprice) AS high FROM lineitem",
    "agg_empty": "SELECT count(*) AS n, count(l_partkey) AS m, sum(l_linenumber) AS lines, min(l_quantity) AS low, max(l_returnflag) AS flag FROM lineitem WHERE l_quantity < 0",
    "agg_group": f"SELECT l_returnflag, {_GROUP} FROM lineitem GROUP BY l_returnflag",
    "agg_group_multi": f"SELECT l_returnflag, l_linestatus, {_GROUP} FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_group_only": "SELECT c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment",
    "agg_group_expr": "SELECT l_linenumber + 1 AS next_line, count(*) AS n FROM lineitem GROUP BY l_linenumber + 1",
    "agg_group_bool": "SELECT p_size > 25 AS large, count(*) AS n FROM part GROUP BY p_size > 25",
    "agg_expr": "SELECT p_brand, max(p_size) - min(p_size) AS spread, count(p_name) + 1 AS n FROM part GROUP BY p_brand",
    "agg_dup": "SELECT o_orderstatus, sum(o_custkey) AS a, sum(o_custkey) AS b FROM orders GROUP BY o_orderstatus",
    "agg_over_join": "SELECT n.n_name, count(*) AS customers, max(c.c_acctbal) AS top FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "agg_count_null": "SELECT o.o_orderstatus, count(*) AS n, count(l.l_orderkey) AS matched FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus",
    "agg_null_group": "SELECT l.l_returnflag, count(*) AS n FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY l.l_returnflag",
    "agg_min_max_string": "SELECT min(p_name) AS low, max(p_name) AS high, min(p_brand) AS brand FROM part",
    "agg_order_by": "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 5",
    "sort_asc": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey",
    "sort_desc": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey",
    "sort_multi": "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size ASC, p_partkey",
    "sort_default_nulls": (
        "SELECT o.o_orderkey, l.l_quantity FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_linenumber = 1 ORDER BY l.l_quantity DESC, o.o_orderkey, l.l_partkey LIMIT 300",
        "SELECT o.o_orderkey, l.l_quantity FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_linenumber = 1 ORDER BY l.l_quantity DESC NULLS FIRST, o.o_orderkey, l.l_partkey LIMIT 300",
    ),
    "sort_nulls_first": "SELECT o.o_orderkey, l.l_quantity FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_linenumber = 1 ORDER BY l.l_quantity ASC NULLS FIRST, o.o_orderkey, l.l_partkey LIMIT 300",
    "sort_nulls_last": "SELECT o.o_orderkey, l.l_quantity FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_linenumber = 1 ORDER BY l.l_quantity DESC NULLS LAST, o.o_orderkey, l.l_partkey LIMIT 300",
    "sort_nonprojected": "SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey",
    "sort_expression": "SELECT p_partkey FROM part ORDER BY p_size - p_retailprice, p_partkey",
    "limit_expr": "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 2 + 3",
    "limit_zero": "SELECT n_nationkey FROM nation LIMIT 0",
    "limit_null": "SELECT n_nationkey FROM nation LIMIT NULL",
    "limit_oversize": "SELECT n_nationkey FROM nation LIMIT 1000",
    "top_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "pass_through_types": "SELECT event_id, ts, event_type FROM events WHERE event_type = 'click' ORDER BY ts, event_id",
}

#: name: statements before, the final SELECT, and DuckDB's SQL for its rows
SCRIPTS: dict[str, tuple[list[str], str, str]] = {
    "values": (
        ["CREATE TABLE t (a INT, b VARCHAR(8), c DOUBLE, d BOOLEAN)", "INSERT INTO t VALUES (1, 'one', 1, true), (-2, 'two', 0.5, false), (3 + 4, NULL, NULL, NULL)"],
        "SELECT * FROM t", "SELECT * FROM (VALUES (1, 'one', 1.0::DOUBLE, true), (-2, 'two', 0.5, false), (7, NULL, NULL, NULL)) v(a, b, c, d)",
    ),
    "insert_values": (
        ["INSERT INTO region VALUES (100, 'NORTH'), (101, 'SÜD🥰')"],
        "SELECT * FROM region", "SELECT * FROM region UNION ALL VALUES (100, 'NORTH'), (101, 'SÜD🥰')",
    ),
    "insert_select": (
        ["CREATE TABLE big (k BIGINT, name VARCHAR(64), price DOUBLE)", "INSERT INTO big SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 30"],
        "SELECT * FROM big", "SELECT p_partkey AS k, p_name AS name, p_retailprice AS price FROM part WHERE p_size > 30",
    ),
    "insert_select_self": (
        ["INSERT INTO nation SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1"],
        "SELECT * FROM nation", "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1",
    ),
    "insert_partial_cols": (
        ["CREATE TABLE t (a INT, b VARCHAR(32), c BIGINT)", "INSERT INTO t (b, a) SELECT n_name, n_nationkey FROM nation", "INSERT INTO t (c) VALUES (5)"],
        "SELECT * FROM t", "SELECT n_nationkey AS a, n_name AS b, NULL::BIGINT AS c FROM nation UNION ALL SELECT NULL, NULL, 5",
    ),
    "update_where": (
        ["UPDATE nation SET n_name = 'RENAMED' WHERE n_regionkey = 2"],
        "SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation",
    ),
    "update_self": (
        ["UPDATE supplier SET s_acctbal = s_acctbal + s_nationkey, s_nationkey = s_nationkey + 1 WHERE s_acctbal > 0"],
        "SELECT * FROM supplier",
        "SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey, CASE WHEN s_acctbal > 0 THEN s_acctbal + s_nationkey ELSE s_acctbal END AS s_acctbal FROM supplier",
    ),
    "update_all": (["UPDATE region SET r_regionkey = -r_regionkey"], "SELECT * FROM region", "SELECT -r_regionkey AS r_regionkey, r_name FROM region"),
    "update_none": (["UPDATE region SET r_name = 'x' WHERE r_regionkey > 1000"], "SELECT * FROM region", "SELECT * FROM region"),
    "delete_where": (
        ["DELETE FROM customer WHERE c_acctbal < 0 OR c_nationkey = 3"],
        "SELECT * FROM customer", "SELECT * FROM customer WHERE NOT coalesce(c_acctbal < 0 OR c_nationkey = 3, false)",
    ),
    "delete_all": (["DELETE FROM region"], "SELECT * FROM region", "SELECT * FROM region WHERE false"),
    "delete_null_keeps": (
        ["CREATE TABLE t (a INT)", "INSERT INTO t VALUES (1), (NULL), (3)", "DELETE FROM t WHERE a > 1"],
        "SELECT * FROM t", "SELECT * FROM (VALUES (1), (NULL)) v(a)",
    ),
    "delete_reinsert": (
        ["DELETE FROM region WHERE r_regionkey > 1", "INSERT INTO region SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 22"],
        "SELECT * FROM region", "SELECT * FROM region WHERE r_regionkey <= 1 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 22",
    ),
    "index_and_key": (
        ["CREATE TABLE k (tenant INT, id INT, item VARCHAR(16), PRIMARY KEY (tenant, id))", "INSERT INTO k VALUES (1, 1, 'a'), (1, 1, 'b'), (2, 1, 'c')", "CREATE INDEX k_id ON k (id)"],
        "SELECT k.item, n.n_name FROM k JOIN nation n ON k.id = n.n_nationkey", "SELECT v.item, n.n_name FROM (VALUES (1, 'a'), (1, 'b'), (1, 'c')) v(id, item) JOIN nation n ON v.id = n.n_nationkey",
    ),
}


def session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    s.register_parquet(sf_dir, *TABLES)
    return s


def _needed(s: Session, spark: SparkSession, sf_dir: str, statements: list[str]) -> Session:
    words = set(" ".join(statements).lower().replace(",", " ").replace("(", " ").split())
    s.register_parquet(sf_dir, *(t for t in TABLES if t in words))
    return s


def _select(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _needed(Session(spark), spark, sf_dir, [text]).select(text)


def _script(statements: list[str], text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _needed(Session(spark), spark, sf_dir, [*statements, text])
    for statement in statements:
        s.sql(statement)
    return s.select(text)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that each kind of change reports."""
    s = _needed(Session(spark), spark, sf_dir, ["nation", "region"])
    done = [s.sql(x).frame for x in ("INSERT INTO region SELECT n_nationkey, n_name FROM nation", "UPDATE region SET r_name = 'x' WHERE r_regionkey < 5", "DELETE FROM region WHERE r_regionkey < 5")]
    return done[0].selectExpr("'insert' AS change", "__insert_rows AS n").union(done[1].selectExpr("'update'", "__update_rows")).union(done[2].selectExpr("'delete'", "__delete_rows"))


def _explain(spark: SparkSession, sf_dir: str, raw: bool) -> DataFrame:
    return _needed(Session(spark), spark, sf_dir, ["orders"]).sql(f"EXPLAIN {'(RAW) ' if raw else ''}SELECT o_orderkey FROM orders WHERE o_totalprice > 1000").frame


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: partial(_select, q if isinstance(q, str) else q[0]) for name, q in SELECTS.items()}
    found |= {name: partial(_script, before, text) for name, (before, text, _) in SCRIPTS.items()}
    return found | {"change_counts": _counts, "explain_plan": partial(_explain, raw=False), "explain_raw": partial(_explain, raw=True)}


def oracle_sql() -> dict[str, str]:
    found = {name: _widened(q) if isinstance(q, str) else q[1] for name, q in SELECTS.items()}
    found |= {name: oracle for name, (_, _, oracle) in SCRIPTS.items()}
    n = "(SELECT count(*) FROM {} WHERE {} < 5)"
    low = f"({n.format('region', 'r_regionkey')} + {n.format('nation', 'n_nationkey')})::INT"
    return found | {"change_counts": f"SELECT 'insert' AS change, (SELECT count(*) FROM nation)::BIGINT AS n UNION ALL SELECT 'update', {low} UNION ALL SELECT 'delete', {low}"}


def _widened(sql: str) -> str:
    """DuckDB sums whole numbers as 128-bit ones."""
    import re

    return re.sub(r"(sum\([^)]*\))", r"(\1)::BIGINT", sql)
