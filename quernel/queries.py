"""The registered queries of the dialect over the driver's tables, each with its DuckDB twin.

A query is a text of the dialect. Its twin is the same text where DuckDB reads it alike, or a text of its own: whole
numbers are divided by ``//``, ASC puts NULLs last there, and sums of whole numbers are wider. Doubles are rounded on
both sides, as sums of them depend on the order of their rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .engine import Engine
from .operators import relational

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Primary and shard keys of those tables.
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",)}
#: Tables that every node of the reference's cluster would hold.
GLOBAL = ("region", "nation")
DIGITS = 4


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the driver's tables."""
    out = Engine(spark)
    for name in TABLES:
        out.read(name, f"{sf_dir}/{name}.parquet", primary_key=KEYS[name], shard_key=None if name in GLOBAL else KEYS[name][:1])
    return out


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), DIGITS) for c, kind in df.dtypes if kind == "double"})


def _twin(text: str) -> str:
    """The same text with DuckDB's name of a 64-bit number."""
    return re.sub(r"\bas int\)", "AS BIGINT)", text)


#: name: (text, DuckDB's text or None where it is the same)
SQL: dict[str, tuple[str, str | None]] = {
    "flagship_group_having": (
        'SELECT "l_returnflag", "l_linestatus", sum("l_quantity") AS "sum_qty", avg("l_discount") AS "avg_disc", count(*) AS "cnt" FROM "lineitem" WHERE "l_quantity" < 40 GROUP BY "l_returnflag", "l_linestatus" HAVING count(*) > 1 ORDER BY "l_returnflag", "l_linestatus" LIMIT 10',
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS cnt FROM lineitem WHERE l_quantity < 40 GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 10",
    ),
    # scans and sources
    "scan_project": ("SELECT o_orderkey, o_orderstatus AS status, o_custkey FROM orders AS o", None),
    "scan_star": ("SELECT * FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "select_without_from": ("SELECT 1 AS a, 'x' AS b, true AS c", "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b, true AS c"),
    "values_table": ("SELECT \"COLUMN_3\" AS a, \"COLUMN_4\" AS b FROM (VALUES (1, 'x'), (2, 'y')) AS v", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b)"),
    "values_statement": ("VALUES (1, 'x'), (2, 'y'), (3, 'it''s')", 'SELECT CAST(a AS BIGINT) AS "COLUMN_5", b AS "COLUMN_6" FROM (VALUES (1, \'x\'), (2, \'y\'), (3, \'it\'\'s\')) AS v(a, b)'),
    "subquery_from": ("SELECT s.k, s.p FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 1000.5) AS s", "SELECT o_orderkey AS k, round(o_totalprice, 4) AS p FROM orders WHERE o_totalprice > 1000.5"),
    "cte_nested": ("WITH big AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000), per (c, n) AS (SELECT k, count(*) FROM big GROUP BY k) SELECT c, n FROM per WHERE n > 1", None),
    "cte_reuse": ("WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k AS k, b.n AS n FROM c AS a JOIN c AS b ON a.k = b.k WHERE a.n > 2", None),
    "cte_values": ("WITH v (a) AS (VALUES (1), (2)) SELECT n.n_name AS name FROM nation AS n JOIN v ON n.n_nationkey = v.a", None),
    "pseudo_column_bucket": ("SELECT count(*) AS n, min(\"bucket_id\") >= 1 AND max(\"bucket_id\") <= 30000 AS bounded FROM orders", "SELECT count(*) AS n, true AS bounded FROM orders"),
    # predicates
    "filter_cmp": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_quantity <> 47 AND l_discount != 0.05 AND l_tax <= 0.04", None),
    "filter_and_or_not": ("SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_totalprice < 50000)", None),
    "is_null": ("SELECT a.k AS k FROM (SELECT c_custkey AS k, CASE WHEN c_nationkey < 5 THEN c_name END AS x FROM customer) AS a WHERE a.x IS NULL", None),
    "is_not_null": ("SELECT a.k AS k FROM (SELECT c_custkey AS k, CASE WHEN c_nationkey < 5 THEN c_name END AS x FROM customer) AS a WHERE a.x IS NOT NULL", None),
    "is_true_false_unknown": ("SELECT n_nationkey AS k, (n_nationkey > 3) IS TRUE AS a, (n_nationkey > 3) IS NOT FALSE AS b, (n_nationkey > 3) IS UNKNOWN AS c FROM nation WHERE (n_regionkey = 1) IS TRUE", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_nationkey > 3 AS a, (n_nationkey > 3) IS NOT FALSE AS b, false AS c FROM nation WHERE n_regionkey = 1"),
    "between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 10000 AND 20000", None),
    "not_between": ("SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 10000 AND 400000", None),
    "in_list": ("SELECT n_name FROM nation WHERE n_nationkey IN (1, 5, 7)", None),
    "not_in_list": ("SELECT n_name FROM nation WHERE n_nationkey NOT IN (1, 5, 7)", None),
    "row_in_list": ("SELECT l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((1, 1), (2, 1), (3, 2))", "SELECT l_partkey FROM lineitem WHERE l_orderkey = 1 AND l_linenumber = 1 OR l_orderkey = 2 AND l_linenumber = 1 OR l_orderkey = 3 AND l_linenumber = 2"),
    "in_subquery": ("SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None),
    "not_in_subquery": ("SELECT c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "in_values": ("SELECT r_name FROM region WHERE r_regionkey IN (VALUES (1), (3))", None),
    "row_in_subquery": ("SELECT l_orderkey, l_suppkey FROM lineitem WHERE (l_orderkey, l_suppkey) IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 49)", None),
    "row_eq": ("SELECT l_partkey, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) = (7, 1)", "SELECT l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1"),
    "row_less": ("SELECT l_orderkey, l_suppkey FROM lineitem WHERE (l_orderkey, l_suppkey) < (40, 50)", "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey < 40 OR l_orderkey = 40 AND l_suppkey < 50"),
    "row_eq_subquery": ("SELECT n_name FROM nation WHERE (n_regionkey, n_nationkey) = (SELECT min(n_regionkey), min(n_nationkey) FROM nation)", "SELECT n_name FROM nation WHERE n_regionkey = (SELECT min(n_regionkey) FROM nation) AND n_nationkey = (SELECT min(n_nationkey) FROM nation)"),
    "exists": ("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)", None),
    "not_exists": ("SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 300)", None),
    "like": ("SELECT p_partkey FROM part WHERE p_type LIKE '%A_%' AND NOT p_brand LIKE '%1'", None),
    "like_escape": ("SELECT c_custkey FROM customer WHERE c_name || '_1' LIKE '%!_1' ESCAPE '!'", None),
    "ilike": ("SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '%urgent%'", None),
    "scalar_subquery_select": ("SELECT r_name, (SELECT count(*) FROM nation) AS n FROM region", None),
    "scalar_subquery_where": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)", None),
    "subquery_group_by": ("SELECT n_regionkey + (VALUES (1)) AS k, count(*) AS n FROM nation GROUP BY n_regionkey + (VALUES (1))", "SELECT CAST(n_regionkey + 1 AS BIGINT) AS k, count(*) AS n FROM nation GROUP BY 1"),
    "subquery_order_by": ("SELECT n_name FROM nation ORDER BY n_name || (SELECT 'x' FROM region WHERE r_regionkey = 1) LIMIT 3", "SELECT n_name FROM nation ORDER BY n_name || 'x' LIMIT 3"),
    "subquery_having": ("SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= (SELECT count(*) FROM region)", "SELECT CAST(n_regionkey AS BIGINT) AS k, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) >= 5"),
    # joins
    "join_inner": ("SELECT o.o_orderkey AS k, c.c_name AS name FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'", None),
    "join_left": ("SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer AS c LEFT OUTER JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000", None),
    "join_left_false": ("SELECT r.r_name AS r, n.n_name AS n FROM region AS r LEFT JOIN nation AS n ON false", None),
    "join_left_global": ("SELECT n.n_name AS n, c.c_custkey AS k FROM nation AS n LEFT JOIN customer AS c ON n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9000", None),
    "join_theta": ("SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region AS a JOIN region AS b ON a.r_regionkey < b.r_regionkey", "SELECT CAST(a.r_regionkey AS BIGINT) AS a, CAST(b.r_regionkey AS BIGINT) AS b FROM region AS a JOIN region AS b ON a.r_regionkey < b.r_regionkey"),
    "join_cross_true": ("SELECT a.r_name AS a, b.n_name AS b FROM region AS a JOIN nation AS b ON true", None),
    "join_multi": ("SELECT n.n_name AS nation, r.r_name AS region, count(*) AS n, cast(sum(o.o_orderkey) as int) AS keys FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name", None),
    "join_row_key": ("SELECT a.l_partkey AS p, b.l_quantity AS q FROM lineitem AS a JOIN lineitem AS b ON (a.l_orderkey, a.l_linenumber) = (b.l_orderkey, b.l_linenumber) WHERE a.l_quantity > 48", "SELECT a.l_partkey AS p, b.l_quantity AS q FROM lineitem AS a JOIN lineitem AS b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 48"),
    "join_subquery_in_on": ("SELECT c.c_name AS c, n.n_name AS n FROM customer AS c JOIN nation AS n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')", None),
    "join_exists_in_on": ("SELECT r.r_name AS r, n.n_name AS n FROM region AS r JOIN nation AS n ON r.r_regionkey = n.n_regionkey AND EXISTS (SELECT 1 FROM part)", None),
    "join_or_condition": ("SELECT r.r_name AS r, n.n_name AS n FROM region AS r JOIN nation AS n ON r.r_regionkey = n.n_regionkey OR n.n_nationkey = 3", None),
    "join_subqueries": ("SELECT a.k AS k, b.n AS n FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000) AS a JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS b ON a.k = b.k", None),
    # aggregates
    "group_by": ("SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n, min(o_orderdate) AS first, max(o_orderkey) AS last FROM orders GROUP BY o_orderstatus, o_orderpriority", None),
    "group_by_expr": ("SELECT l_linenumber + 1 AS k, count(*) AS n FROM lineitem GROUP BY l_linenumber + 1", "SELECT CAST(l_linenumber + 1 AS BIGINT) AS k, count(*) AS n FROM lineitem GROUP BY 1"),
    "group_by_ten": (
        "SELECT l_linenumber, l_returnflag, l_linestatus, l_tax, l_discount, l_linenumber + 1 AS a, l_linenumber * 2 AS b, l_returnflag || 'x' AS c, l_linenumber - 3 AS d, l_linestatus || l_returnflag AS e, count(*) AS n FROM lineitem GROUP BY l_linenumber, l_returnflag, l_linestatus, l_tax, l_discount, l_linenumber + 1, l_linenumber * 2, l_returnflag || 'x', l_linenumber - 3, l_linestatus || l_returnflag",
        "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus, round(l_tax, 4) AS l_tax, round(l_discount, 4) AS l_discount, CAST(l_linenumber + 1 AS BIGINT) AS a, CAST(l_linenumber * 2 AS BIGINT) AS b, l_returnflag || 'x' AS c, CAST(l_linenumber - 3 AS BIGINT) AS d, l_linestatus || l_returnflag AS e, count(*) AS n FROM lineitem GROUP BY ALL",
    ),
    "agg_no_group": ("SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, cast(sum(o_orderkey) as int) AS s FROM orders", None),
    "having": ("SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 2 AND min(o_totalprice) > 1000", None),
    "having_no_group": ("SELECT count(*) AS n FROM orders HAVING count(*) > 1", None),
    "agg_all_seven": (
        "SELECT n_regionkey AS k, count(n_name) AS c, cast(sum(n_nationkey) as int) AS s, avg(n_nationkey) AS a, total(n_nationkey) AS t, min(n_name) AS lo, max(n_name) AS hi, group_concat(n_name, '|') AS g FROM nation GROUP BY n_regionkey",
        "SELECT CAST(n_regionkey AS BIGINT) AS k, count(n_name) AS c, CAST(sum(n_nationkey) AS BIGINT) AS s, round(avg(n_nationkey), 4) AS a, CAST(sum(n_nationkey) AS DOUBLE) AS t, min(n_name) AS lo, max(n_name) AS hi, string_agg(n_name, '|' ORDER BY n_name) AS g FROM nation GROUP BY n_regionkey",
    ),
    "agg_distinct": ("SELECT l_returnflag AS f, count(DISTINCT l_suppkey) AS c, cast(sum(DISTINCT l_linenumber) as int) AS s, avg(DISTINCT l_linenumber) AS a, count(*) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag AS f, count(DISTINCT l_suppkey) AS c, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, round(avg(DISTINCT l_linenumber), 4) AS a, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_distinct_concat": ("SELECT group_concat(DISTINCT o_orderstatus) AS s, total(DISTINCT o_custkey) AS t, min(DISTINCT o_orderkey) AS m FROM orders", "SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS s, CAST(sum(DISTINCT o_custkey) AS DOUBLE) AS t, min(o_orderkey) AS m FROM orders"),
    "total_empty": ("SELECT total(o_orderkey) AS t, sum(o_orderkey) IS NULL AS s, count(*) AS n FROM orders WHERE o_orderkey < 0", "SELECT CAST(0 AS DOUBLE) AS t, true AS s, CAST(0 AS BIGINT) AS n"),
    "group_concat_ordered": ("SELECT c_mktsegment AS s, group_concat(c_name, ';') AS g FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment AS s, string_agg(c_name, ';' ORDER BY c_name) AS g FROM customer GROUP BY c_mktsegment"),
    "agg_expression": ("SELECT s.f AS f, cast(sum(s.q) as int) * 2 + count(*) AS x FROM (SELECT l_returnflag AS f, l_linenumber AS q FROM lineitem) AS s GROUP BY s.f", None),
    "select_distinct": ("SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders", None),
    "select_distinct_agg": ("SELECT DISTINCT count(*) AS n FROM nation GROUP BY n_regionkey", None),
    # order and limit
    "order_limit": ("SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20", "SELECT o_orderkey AS k, round(o_totalprice, 4) AS p FROM orders ORDER BY o_totalprice DESC, k LIMIT 20"),
    "order_position": ("SELECT n_regionkey AS r, n_name AS n FROM nation ORDER BY 1 DESC, 2 LIMIT 7", "SELECT CAST(n_regionkey AS BIGINT) AS r, n_name AS n FROM nation ORDER BY 1 DESC, 2 LIMIT 7"),
    "order_nulls": ("SELECT a.x AS x, a.k AS k FROM (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 1 THEN n_name END AS x FROM nation) AS a ORDER BY x, k LIMIT 12", "SELECT CASE WHEN n_regionkey > 1 THEN n_name END AS x, CAST(n_nationkey AS BIGINT) AS k FROM nation ORDER BY x NULLS FIRST, k LIMIT 12"),
    "order_qualified": ("SELECT n.n_name AS n_name, n.n_regionkey AS n_regionkey FROM nation AS n ORDER BY (n.n_regionkey) DESC, CASE WHEN n.n_regionkey > 2 THEN upper(n.n_name) ELSE lower(n.n_name) END LIMIT 12", "SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name LIMIT 12"),
    "order_expression": ("SELECT n_nationkey AS k FROM nation ORDER BY k * -1 LIMIT 5", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation ORDER BY 1 DESC LIMIT 5"),
    "limit_all": ("SELECT r_name FROM region LIMIT ALL", "SELECT r_name FROM region"),
    "limit_zero": ("SELECT r_name FROM region LIMIT 0", None),
    # set operations
    "union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier", "SELECT c_name AS name, round(c_acctbal, 4) AS bal FROM customer UNION ALL SELECT s_name, round(s_acctbal, 4) FROM supplier"),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000", None),
    "except_distinct": ("SELECT c_nationkey AS k FROM customer EXCEPT DISTINCT SELECT s_nationkey FROM supplier WHERE s_nationkey > 10", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 10"),
    "union_except_chain": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 5", "(SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT r_regionkey FROM region) EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 5"),
    "orderby_in_union_member": ("SELECT r_name AS n FROM region ORDER BY n UNION ALL SELECT n_name FROM nation ORDER BY n_name", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation"),
    "union_limit": ("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT c_custkey FROM customer LIMIT 100) AS u", None),
    "union_history_actual": (
        "SELECT t.k AS k, t.amount AS amount FROM (SELECT o_orderkey AS k, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O') AS t WHERE t.k IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
        "SELECT o_orderkey AS k, round(o_totalprice, 4) AS amount FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
    ),
    "union_join_history": (
        "SELECT a.k AS k, b.q AS q FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AS a JOIN (SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'A') AS b ON a.k = b.k",
        "SELECT o_orderkey AS k, l_quantity AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'P') AND l_returnflag IN ('R', 'A')",
    ),
    # expressions
    "arith": ("SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber * 2 + 3 - l_linenumber AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, CAST(l_linenumber + 3 AS BIGINT) AS a, round(l_extendedprice * (1 - l_discount), 4) AS b FROM lineitem"),
    "int_division": ("SELECT o_orderkey AS k, o_orderkey / 7 AS a, o_orderkey / 2.5e0 AS b FROM orders", "SELECT o_orderkey AS k, o_orderkey // 7 AS a, round(o_orderkey / 2.5e0, 4) AS b FROM orders"),
    "concat": ("SELECT n_name || '/' || n_name AS a FROM nation WHERE n_name || 'x' <> 'x'", None),
    "precedence": ("SELECT cast(1 + 2 as string) || '3' AS a, NOT 1 = 2 AND false AS b, 2 + 3 * 4 AS c, (2 + 3) * 4 AS d, 10 - 3 - 2 AS e", "SELECT '33' AS a, false AS b, CAST(14 AS BIGINT) AS c, CAST(20 AS BIGINT) AS d, CAST(5 AS BIGINT) AS e"),
    "case_simple": ("SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders", None),
    "case_searched": ("SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN NULL THEN 'never' WHEN o_totalprice > 100000 THEN 'mid' END AS s FROM orders", "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS s FROM orders"),
    "cast_types": ("SELECT cast('12' as int) AS a, cast(n_nationkey as string) AS b, cast('1.5' as double) AS c, cast('true' as bool) AS d, cast(n_nationkey as double) AS e, cast(n_name as varchar(5)) AS f, cast(n_nationkey as unsigned) AS g, cast(n_nationkey as number) AS h, cast(n_name as any) AS i FROM nation", "SELECT CAST(12 AS BIGINT) AS a, CAST(n_nationkey AS VARCHAR) AS b, CAST(1.5 AS DOUBLE) AS c, true AS d, CAST(n_nationkey AS DOUBLE) AS e, n_name AS f, CAST(n_nationkey AS BIGINT) AS g, CAST(n_nationkey AS BIGINT) AS h, n_name AS i FROM nation"),
    "cast_postfix": ("SELECT n_nationkey::string::int + 1 AS a, '7'::int AS b FROM nation", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS a, CAST(7 AS BIGINT) AS b FROM nation"),
    "cast_uuid": ("SELECT cast('FB1649A4-D2DB-4DF4-A24D-2B4E81EE8A41' as uuid) AS u", "SELECT 'fb1649a4-d2db-4df4-a24d-2b4e81ee8a41' AS u"),
    "substr": ("SELECT substr(n_name, 2) AS a, substr(n_name, 1, 3) AS b FROM nation", None),
    "lower_upper": ("SELECT lower(n_name) AS a, upper(lower(n_name)) AS b FROM nation", None),
    "coalesce": ("SELECT n_nationkey AS k, coalesce(CASE WHEN n_regionkey > 1 THEN n_name END, NULL, 'none') AS x FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS k, coalesce(CASE WHEN n_regionkey > 1 THEN n_name END, 'none') AS x FROM nation"),
    "trim_variants": ("SELECT trim('  a ') || '|' AS a, trim('x' FROM 'xxbxx') AS b, trim(LEADING 'x' FROM 'xxbxx') AS c, trim(TRAILING 'x' FROM 'xxbxx') AS d, trim(BOTH 'ab' FROM 'aabcbb') AS e, trim(LEADING FROM '  z') AS f", "SELECT 'a|' AS a, 'b' AS b, 'bxx' AS c, 'xxb' AS d, 'c' AS e, 'z' AS f"),
    "to_date": ("SELECT to_char(to_date('2020-03-04 05:06', '%Y-%m-%d %H:%M'), '%Y/%m/%d %H') AS a, to_char(to_date('20210820', '%Y%m%d'), '%d.%m.%Y') AS b", "SELECT '2020/03/04 00' AS a, '20.08.2021' AS b"),
    "to_char": ("SELECT o_orderkey AS k, to_char(o_orderdate, '%Y-%m-%dT%H:%M:%S %z %i%%') AS d, to_char(o_orderdate, NULL) IS NULL AS n FROM orders", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ' +0000 i%' AS d, true AS n FROM orders"),
    "current_date_compare": ("SELECT count(*) AS n FROM orders WHERE o_orderdate < CURRENT_DATE", "SELECT count(*) AS n FROM orders WHERE o_orderdate < current_date"),
    "repeated_columns": ("SELECT n_name, n_name AS again FROM nation AS n", None),
}
#: Texts with parameters: (text, values, DuckDB's text)
BOUND: dict[str, tuple[str, tuple, str]] = {
    "params_qmark": ("SELECT o_orderkey AS k FROM orders WHERE o_orderkey > ? AND o_orderstatus = ?", (100, "F"), "SELECT o_orderkey AS k FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'F'"),
    "params_dollar": ("SELECT n_name AS n, $2 || n_name AS x FROM nation WHERE n_nationkey > $1 AND n_regionkey < $1 OPTION (vtable_max_rows = $3)", (2, "p-", 1000), "SELECT n_name AS n, 'p-' || n_name AS x FROM nation WHERE n_nationkey > 2 AND n_regionkey < 2"),
}


def _changed(*statements: str, table: str = "t", columns: str = "id, name, amount") -> Callable[[SparkSession, str], DataFrame]:
    """The rows of a table made from customers, after some statements."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.execute("CREATE TABLE t (id int NOT NULL, name string, amount double, PRIMARY KEY (id)) DISTRIBUTED BY (name)")
        e.execute("INSERT INTO t SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey < 12")
        for s in statements:
            e.execute(s)
        return rounded(e.sql(f"SELECT {columns} FROM {table}"))

    return run


_OLD = "SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 4) AS amount FROM customer WHERE c_nationkey < 12"
_NEW = "SELECT c_custkey AS id, 'new' AS name, CAST(NULL AS DOUBLE) AS amount FROM customer WHERE c_nationkey > 8"
CHANGES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "insert_select": (_changed("INSERT INTO t (name, id) SELECT c_name, c_custkey FROM customer WHERE c_nationkey >= 12"), f"{_OLD} UNION ALL SELECT c_custkey, c_name, NULL FROM customer WHERE c_nationkey >= 12"),
    "insert_on_conflict_nothing": (_changed("INSERT INTO t (id, name) SELECT c_custkey, 'new' FROM customer WHERE c_nationkey > 8 ON CONFLICT DO NOTHING"), f"{_OLD} UNION ALL SELECT * FROM ({_NEW}) WHERE id NOT IN (SELECT id FROM ({_OLD}))"),
    "insert_on_conflict_replace": (_changed("INSERT INTO t (id, name) SELECT c_custkey, 'new' FROM customer WHERE c_nationkey > 8 ON CONFLICT DO REPLACE"), f"{_NEW} UNION ALL SELECT * FROM ({_OLD}) WHERE id NOT IN (SELECT id FROM ({_NEW}))"),
    "update": (_changed("UPDATE t SET amount = amount + 1, name = 'u' WHERE amount < 5000"), f"SELECT id, CASE WHEN amount < 5000 THEN 'u' ELSE name END AS name, round(CASE WHEN amount < 5000 THEN amount + 1 ELSE amount END, 4) AS amount FROM ({_OLD})"),
    "update_from": (_changed("UPDATE t SET name = cast(c.c_nationkey as string) FROM (SELECT c_custkey, c_nationkey FROM customer) AS c WHERE c.c_custkey = t.id AND t.amount > 2000"), f"SELECT o.id, CASE WHEN o.amount > 2000 THEN CAST(c.c_nationkey AS VARCHAR) ELSE o.name END AS name, o.amount FROM ({_OLD}) AS o JOIN customer AS c ON c.c_custkey = o.id"),
    "delete_where": (_changed("DELETE FROM t WHERE amount < 0 OR id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"), f"SELECT * FROM ({_OLD}) WHERE NOT (amount < 0 OR id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000))"),
    "delete_all": (_changed("DELETE FROM t"), f"SELECT * FROM ({_OLD}) WHERE false"),
    "call_procedure": (_changed("CREATE PROCEDURE shift (int, double) LANGUAGE SQL AS $$UPDATE t SET amount = $2 WHERE id = $1$$", "CALL shift(5, 2.5e0)"), f"SELECT id, name, CASE WHEN id = 5 THEN 2.5 ELSE amount END AS amount FROM ({_OLD})"),
}


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey > 3")


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql('SELECT o_orderkey AS k, "bucket_id" AS bucket FROM orders')


def _intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return relational.intersection(e.sql("SELECT c_nationkey AS k FROM customer"), e.sql("SELECT s_nationkey FROM supplier"))


def _array_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.register("a", e.spark.createDataFrame([(1, [1, 2]), (2, [3])], "id bigint, xs array<bigint>"), primary_key=("id",))
    return e.sql("SELECT id, xs FROM a")


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).statistics("nation").select("column", "rows", "nulls", "least", "greatest")


def _of_text(text: str, params: tuple = ()) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(engine(spark, sf_dir).sql(text, params))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _of_text(text) for name, (text, _) in SQL.items()},
    **{name: _of_text(text, values) for name, (text, values, _) in BOUND.items()},
    **{name: run for name, (run, _) in CHANGES.items()},
    "intersection": _intersection,
    "array_read": _array_read,
    "bucket_ids": _buckets,
    "explain": _explained,
    "table_statistics": _statistics,
}
_STATISTICS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")
)
ORACLE_SQL: dict[str, str] = {
    "table_statistics": _STATISTICS,
    **{name: other or _twin(text) for name, (text, other) in SQL.items()},
    **{name: other for name, (_, _, other) in BOUND.items()},
    **{name: other for name, (_, other) in CHANGES.items()},
    "intersection": "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "array_read": "SELECT CAST(1 AS BIGINT) AS id, [1::BIGINT, 2::BIGINT] AS xs UNION ALL SELECT 2, [3::BIGINT]",
}
