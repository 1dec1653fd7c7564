"""Named queries over the star schema, each with an equivalent DuckDB statement.

Keys begin with the ID of the operator they show.  ``{t}`` in a dialect query stands for the
folder of the tables.  Doubles that are summed are rounded in both engines, as the order of
summation differs.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.dialect import inspect
from millrace.dialect.grammar import parse
from millrace.engine import Engine
from millrace.errors import QueryError
from millrace.sinks import csvlines, jsonl
from millrace.sources.schema_info import schema_table

FLAGSHIP = """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 6) AS avg_disc
FROM 'lineitem.parquet' WHERE l_discount > 0.02 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""

#: key: (dialect, DuckDB); a DuckDB text of None is the dialect text with table names in place of files.
PAIRS: dict[str, tuple[str, str | None]] = {
    "s1_scan": ("SELECT * FROM 'region.parquet'", None),
    "s2_full_scan_pruned": ("SELECT o_orderkey, o_totalprice FROM 'orders.parquet' WHERE o_totalprice > 100000", None),
    "s3_columns": ("SELECT * FROM 'nation.parquet' LIMIT 0", None),
    "s7_table_resolution": ("WITH nation AS (SELECT r_name FROM 'region.parquet') SELECT r_name FROM nation", "SELECT r_name FROM region"),
    "s8_from_subquery": ("SELECT k, n FROM (SELECT n_regionkey AS k, COUNT(*) AS n FROM 'nation.parquet' GROUP BY n_regionkey) AS x WHERE n > 4", None),
    "s9_alias": ("SELECT * FROM 'region.parquet' r", 'SELECT r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM region'),
    "p1_select_list": ("SELECT n_name, n_regionkey FROM 'nation.parquet'", None),
    "p2_star_and_more": ("SELECT *, UPPER(r_name) AS up FROM 'region.parquet'", None),
    "p3_column": ("SELECT p_name FROM 'part.parquet' WHERE p_size = 10", None),
    "p4_qualified": ("SELECT n.n_name, n.n_regionkey AS rk FROM 'nation.parquet' AS n", 'SELECT n_name AS "n.n_name", n_regionkey AS rk FROM nation'),
    "p5_aliases": ("SELECT n_name AS a, n_nationkey b FROM 'nation.parquet'", "SELECT n_name AS a, n_nationkey AS b FROM nation"),
    "p6_literals": ("SELECT 'x' AS s, 7 AS i, 2.5 AS d, true AS t, r_name FROM 'region.parquet'", "SELECT 'x' AS s, CAST(7 AS INTEGER) AS i, CAST(2.5 AS DOUBLE) AS d, true AS t, r_name FROM region"),
    "p7_calls": ("SELECT LOWER(REPLACE(n_name, 'A', 'o')) AS x FROM 'nation.parquet'", None),
    "p8_case": (
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 END AS done FROM 'orders.parquet'",
        None,
    ),
    "p11_default_names": (
        "SELECT UPPER(r_name), 1, CASE WHEN r_regionkey = 0 THEN 'a' ELSE 'b' END FROM 'region.parquet'",
        "SELECT upper(r_name) AS \"UPPER\", CAST(1 AS INTEGER) AS literal_1, CASE WHEN r_regionkey = 0 THEN 'a' ELSE 'b' END AS col_2 FROM region",
    ),
    "f1_where": ("SELECT c_custkey FROM 'customer.parquet' WHERE c_acctbal < 0", None),
    "f2_comparisons": ("SELECT l_orderkey, l_linenumber FROM 'lineitem.parquet' WHERE l_quantity >= 45 AND l_discount <= 0.05 AND l_tax < 0.04 AND l_returnflag != 'N' AND l_linestatus = 'F'", None),
    "f3_column_to_column": ("SELECT l_orderkey, l_linenumber FROM 'lineitem.parquet' WHERE l_tax > l_discount", None),
    "f4_and_or": ("SELECT p_partkey FROM 'part.parquet' WHERE p_size < 5 OR p_size > 45 AND NOT (p_retailprice > 1000)", None),
    "f5_in": ("SELECT o_orderkey FROM 'orders.parquet' WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')", None),
    "f6_like": ("SELECT p_partkey, p_name FROM 'part.parquet' WHERE p_type LIKE '%BRASS%' OR p_name LIKE '_a%' OR p_type NOT LIKE '%E%'", None),
    "f7_between": ("SELECT l_orderkey, l_linenumber FROM 'lineitem.parquet' WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.03 AND 0.08", None),
    "f8_is_null": (
        "SELECT d.doc_id AS doc_id FROM 'documents.parquet' d LEFT JOIN 'labels.parquet' l ON d.doc_id = l.doc_id WHERE l.quality IS NULL AND d.text IS NOT NULL",
        "SELECT d.doc_id AS doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL AND d.text IS NOT NULL",
    ),
    "f11_two_valued_null": (
        "SELECT d.doc_id AS doc_id FROM 'documents.parquet' d LEFT JOIN 'labels.parquet' l ON d.doc_id = l.doc_id WHERE l.quality != 1 AND l.toxic NOT IN (1) AND NOT (l.quality > 5)",
        "SELECT d.doc_id AS doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS DISTINCT FROM 1 AND NOT coalesce(l.toxic IN (1), false) AND NOT coalesce(l.quality > 5, false)",
    ),
    "j1_inner": (
        "SELECT c.c_name AS name, o.o_orderkey AS k FROM 'customer.parquet' c JOIN 'orders.parquet' o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000",
        "SELECT c.c_name AS name, o.o_orderkey AS k FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000",
    ),
    "j2_left": (
        "SELECT d.doc_id AS id, l.toxic AS toxic FROM 'documents.parquet' d LEFT JOIN 'labels.parquet' l ON d.doc_id = l.doc_id",
        "SELECT d.doc_id AS id, l.toxic AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "j3_right": (
        "SELECT l.quality AS q, d.doc_id AS id FROM 'labels.parquet' l RIGHT OUTER JOIN 'documents.parquet' d ON d.doc_id = l.doc_id",
        "SELECT l.quality AS q, d.doc_id AS id FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id",
    ),
    "j4_full": (
        "SELECT a.n_name AS a, b.s_name AS b FROM (SELECT * FROM 'nation.parquet' WHERE n_nationkey < 12) a FULL JOIN (SELECT * FROM 'supplier.parquet' WHERE s_nationkey > 8) b ON a.n_nationkey = b.s_nationkey",
        "SELECT a.n_name AS a, b.s_name AS b FROM (SELECT * FROM nation WHERE n_nationkey < 12) a FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 8) b ON a.n_nationkey = b.s_nationkey",
    ),
    "j5_cross": ("SELECT r_name, n_name FROM 'region.parquet' CROSS JOIN 'nation.parquet'", None),
    "j6_theta": (
        "SELECT s.s_suppkey AS s, n.n_nationkey AS n FROM 'supplier.parquet' s JOIN 'nation.parquet' n ON s.s_nationkey < n.n_nationkey AND n.n_regionkey = 1",
        "SELECT s.s_suppkey AS s, n.n_nationkey AS n FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey AND n.n_regionkey = 1",
    ),
    "j7_chain": (
        "SELECT r.r_name AS region, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice), 2) AS price FROM 'region.parquet' r JOIN 'nation.parquet' n ON r.r_regionkey = n.n_regionkey JOIN 'customer.parquet' c ON c.c_nationkey = n.n_nationkey JOIN 'orders.parquet' o ON o.o_custkey = c.c_custkey JOIN 'lineitem.parquet' l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name",
        "SELECT r.r_name AS region, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice), 2) AS price FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name",
    ),
    "j8_join_subquery_and_cte": (
        "WITH big AS (SELECT o_custkey AS k, COUNT(*) AS n FROM 'orders.parquet' GROUP BY o_custkey) SELECT c.c_name AS name, b.n AS n, x.n_name AS nation FROM big b JOIN 'customer.parquet' c ON c.c_custkey = b.k JOIN (SELECT n_nationkey, n_name FROM 'nation.parquet') x ON x.n_nationkey = c.c_nationkey WHERE b.n > 15",
        "WITH big AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c.c_name AS name, b.n AS n, x.n_name AS nation FROM big b JOIN customer c ON c.c_custkey = b.k JOIN nation x ON x.n_nationkey = c.c_nationkey WHERE b.n > 15",
    ),
    "j9_null_keys_join": (
        "SELECT COUNT(*) AS n FROM (SELECT NULLIF(n_regionkey, 1) AS k FROM 'nation.parquet') a JOIN (SELECT NULLIF(r_regionkey, 1) AS k FROM 'region.parquet') b ON a.k = b.k",
        "SELECT COUNT(*) AS n FROM (SELECT nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 1) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k",
    ),
    "j11_self_join": (
        "SELECT a.n_name AS a, b.n_name AS b FROM 'nation.parquet' a JOIN 'nation.parquet' b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "a1_group_by": ("SELECT l_returnflag, l_shipdate, COUNT(*) AS n FROM 'lineitem.parquet' GROUP BY l_returnflag, l_shipdate", None),
    "a2_global": ("SELECT COUNT(*) AS n, SUM(p_size) AS s FROM 'part.parquet' WHERE p_size > 1000", "SELECT COUNT(*) AS n, SUM(CAST(p_size AS DOUBLE)) AS s FROM part WHERE p_size > 1000"),
    "a4_count_column": (
        "SELECT COUNT(l.quality) AS q, COUNT(*) AS n FROM 'documents.parquet' d LEFT JOIN 'labels.parquet' l ON d.doc_id = l.doc_id",
        "SELECT COUNT(l.quality) AS q, COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "a5_sum": ("SELECT o_orderstatus, ROUND(SUM(o_totalprice), 1) AS s FROM 'orders.parquet' GROUP BY o_orderstatus", None),
    "a6_avg": ("SELECT p_brand, ROUND(AVG(p_retailprice), 4) AS a FROM 'part.parquet' GROUP BY p_brand", None),
    "a7_a8_min_max": (
        "SELECT c_mktsegment, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi, MIN(c_nationkey) AS k, MAX(c_name) AS name FROM 'customer.parquet' GROUP BY c_mktsegment",
        "SELECT c_mktsegment, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi, CAST(MIN(c_nationkey) AS DOUBLE) AS k, MAX(c_name) AS name FROM customer GROUP BY c_mktsegment",
    ),
    "a9_having": ("SELECT o_custkey, COUNT(*) AS n FROM 'orders.parquet' GROUP BY o_custkey HAVING n > 12 AND SUM(o_totalprice) > 1000000", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 1000000"),
    "a10_group_without_aggregates": ("SELECT event_type FROM 'events.parquet' GROUP BY event_type", None),
    "a11_aggregate_of_expression": ("SELECT c_nationkey, ROUND(SUM(ABS(c_acctbal)), 2) AS s FROM 'customer.parquet' GROUP BY c_nationkey", None),
    "a12_expression_over_keys": ("SELECT UPPER(lang) AS l, COUNT(*) * 2 AS twice FROM 'documents.parquet' GROUP BY lang", None),
    "w1_w3_rankings": (
        "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS r, DENSE_RANK() OVER (PARTITION BY user_id ORDER BY event_type DESC) AS dr FROM 'events.parquet'",
        None,
    ),
    "w4_ntile": ("SELECT event_id, NTILE(4) OVER (PARTITION BY event_type ORDER BY event_id) AS q FROM 'events.parquet'", None),
    "w5_w7_values": (
        "SELECT event_id, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, LAST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l, NTH_VALUE(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n2 FROM 'events.parquet'",
        "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    ),
    "w8_w9_lag_lead": (
        "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, LEAD(event_id, 2, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM 'events.parquet'",
        None,
    ),
    "w10_w11_multi_key": ("SELECT l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM 'lineitem.parquet'", None),
    "w12_frames": (
        "SELECT event_id, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f, LAST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS l FROM 'events.parquet'",
        None,
    ),
    "w15_aggregate_over": ("SELECT event_id, COUNT(*) OVER (PARTITION BY user_id) AS n, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS run FROM 'events.parquet'", None),
    "o1_order_by": ("SELECT s_suppkey, s_acctbal FROM 'supplier.parquet' ORDER BY s_nationkey DESC, s_suppkey", None),
    "o2_limit": ("SELECT n_name FROM 'nation.parquet' ORDER BY n_name LIMIT 7", None),
    "o3_offset": ("SELECT n_name FROM 'nation.parquet' ORDER BY n_name LIMIT 5 OFFSET 10", None),
    "o4_top_k": ("SELECT o_orderkey, o_totalprice FROM 'orders.parquet' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "o1_null_placement": (
        "SELECT d.doc_id AS id, l.quality AS q FROM 'documents.parquet' d LEFT JOIN 'labels.parquet' l ON d.doc_id = l.doc_id ORDER BY q, id",
        "SELECT d.doc_id AS id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY q NULLS FIRST, id",
    ),
    "d1_distinct": ("SELECT DISTINCT lang, source FROM 'documents.parquet' ORDER BY lang, source", None),
    "q1_cte_chain": (
        "WITH a AS (SELECT o_custkey AS k, o_totalprice AS p FROM 'orders.parquet' WHERE o_orderstatus = 'O'), b AS (SELECT k, MAX(p) AS top FROM a GROUP BY k) SELECT COUNT(*) AS n, ROUND(AVG(top), 3) AS a FROM b",
        "WITH a AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT k, MAX(p) AS top FROM a GROUP BY k) SELECT COUNT(*) AS n, ROUND(AVG(top), 3) AS a FROM b",
    ),
    "q2_shadowed_cte": (
        "WITH a AS (SELECT r_name AS x FROM 'region.parquet') SELECT x FROM (WITH a AS (SELECT n_name AS x FROM 'nation.parquet') SELECT x FROM a) t",
        "SELECT n_name AS x FROM nation",
    ),
    "q3_exists": (
        "SELECT c_custkey FROM 'customer.parquet' c WHERE EXISTS (SELECT o_orderkey FROM 'orders.parquet' o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 350000)",
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 350000)",
    ),
    "q3_not_exists": (
        "SELECT r_name FROM 'region.parquet' WHERE NOT EXISTS (SELECT n_name FROM 'nation.parquet' WHERE n_nationkey > 1000)",
        None,
    ),
    "q4_in_subquery": ("SELECT c_name FROM 'customer.parquet' WHERE c_custkey IN (SELECT o_custkey FROM 'orders.parquet' WHERE o_totalprice > 350000)", None),
    "q4_not_in_subquery": (
        "SELECT d.doc_id AS id FROM 'documents.parquet' d WHERE d.doc_id NOT IN (SELECT NULLIF(doc_id, 1) AS k FROM 'labels.parquet')",
        "SELECT doc_id AS id FROM documents WHERE NOT coalesce(doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS DISTINCT FROM 1), false)",
    ),
    "q5_scalar_subquery": ("SELECT n_name, (SELECT MAX(r_name) AS m FROM 'region.parquet') AS top FROM 'nation.parquet'", None),
    "q5_scalar_in_where": ("SELECT p_partkey FROM 'part.parquet' WHERE p_retailprice > (SELECT AVG(p_retailprice) AS a FROM 'part.parquet')", None),
    "q7_subquery_under_or": (
        "SELECT c_custkey FROM 'customer.parquet' WHERE c_acctbal > 9900 OR c_custkey IN (SELECT o_custkey FROM 'orders.parquet' WHERE o_totalprice > 380000)",
        None,
    ),
    "fs1_fs2_case_functions": ("SELECT UPPER(n_name) AS u, LOWER(n_name) AS l FROM 'nation.parquet'", None),
    "fs3_concat": ("SELECT CONCAT(n_name, '-', n_nationkey) AS c FROM 'nation.parquet'", None),
    "fs4_length_bytes": ("SELECT doc_id, LENGTH(text) AS n FROM 'documents.parquet'", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents"),
    "fs5_fs7_trims": (
        "SELECT TRIM(CONCAT('  ', n_name, ' ')) AS t, LTRIM(CONCAT('  ', n_name)) AS l, RTRIM(CONCAT(n_name, '  ')) AS r FROM 'nation.parquet'",
        None,
    ),
    "fs8_substring": ("SELECT SUBSTRING(p_name, 2, 3) AS a, SUBSTRING(p_name, 0, 2) AS b, SUBSTRING(p_name, 4) AS c FROM 'part.parquet'", "SELECT substring(p_name, 2, 3) AS a, substring(p_name, 1, 2) AS b, substring(p_name, 4) AS c FROM part"),
    "fs9_replace": ("SELECT REPLACE(p_type, 'BRASS', 'x') AS r FROM 'part.parquet'", None),
    "fs10_split": ("SELECT o_orderkey, TO_STRING(SPLIT(o_orderpriority, '-')) AS s FROM 'orders.parquet'", "SELECT o_orderkey, '[' || array_to_string(string_split(o_orderpriority, '-'), ', ') || ']' AS s FROM orders"),
    "fs11_reverse": ("SELECT REVERSE(n_name) AS r FROM 'nation.parquet'", None),
    "fs12_fs14_tests": ("SELECT CONTAINS(n_name, 'AN') AS c, STARTS_WITH(n_name, 'A') AS s, ENDS_WITH(n_name, 'A') AS e FROM 'nation.parquet'", "SELECT contains(n_name, 'AN') AS c, starts_with(n_name, 'A') AS s, ends_with(n_name, 'A') AS e FROM nation"),
    "fs15_repeat": ("SELECT REPEAT(r_name, 3) AS r FROM 'region.parquet'", None),
    "fm1_abs": ("SELECT ABS(c_acctbal) AS a FROM 'customer.parquet'", None),
    "fm2_round": ("SELECT c_custkey, ROUND(c_acctbal) AS r, ROUND(c_acctbal, 1) AS r1 FROM 'customer.parquet'", None),
    "fm3_fm4_floor_ceil": ("SELECT FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c FROM 'customer.parquet'", None),
    "fm5_mod": ("SELECT MOD(o_orderkey, 7) AS m FROM 'orders.parquet'", "SELECT CAST(o_orderkey % 7 AS DOUBLE) AS m FROM orders"),
    "fm6_sqrt": ("SELECT SQRT(p_size) AS s FROM 'part.parquet'", "SELECT sqrt(CAST(p_size AS DOUBLE)) AS s FROM part"),
    "fm7_pow": ("SELECT POW(p_size, 2) AS s FROM 'part.parquet'", "SELECT pow(CAST(p_size AS DOUBLE), 2) AS s FROM part"),
    "fm8_sign": ("SELECT SIGN(c_acctbal) AS s FROM 'customer.parquet'", "SELECT CAST(sign(c_acctbal) AS DOUBLE) AS s FROM customer"),
    "fm9_trunc": ("SELECT TRUNC(c_acctbal) AS t FROM 'customer.parquet'", "SELECT trunc(c_acctbal) AS t FROM customer"),
    "fm10_random": ("SELECT r_name, RANDOM() >= 0 AND RANDOM() < 1 AS ok FROM 'region.parquet'", "SELECT r_name, true AS ok FROM region"),
    "fm11_fm12_min_max": ("SELECT MIN(l_tax, l_discount) AS lo, MAX(l_tax, l_discount) AS hi FROM 'lineitem.parquet'", "SELECT least(l_tax, l_discount) AS lo, greatest(l_tax, l_discount) AS hi FROM lineitem"),
    "fd1_fd3_now": ("SELECT r_name, LENGTH(CURRENT_DATE()) AS d, LENGTH(CURRENT_TIME()) AS t, LENGTH(NOW()) > 18 AS n FROM 'region.parquet'", "SELECT r_name, CAST(10 AS BIGINT) AS d, CAST(8 AS BIGINT) AS t, true AS n FROM region"),
    "fd4_date_trunc": (
        "SELECT o_orderkey, DATE_TRUNC('month', o_orderdate) AS m, DATE_TRUNC('YEAR', o_orderdate) AS y FROM 'orders.parquet'",
        "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS m, strftime(date_trunc('year', o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS y FROM orders",
    ),
    "fd5_date_part": (
        "SELECT event_id, DATE_PART('hour', ts) AS h, DATE_PART('second', ts) AS s FROM 'events.parquet'",
        "SELECT event_id, CAST(date_part('hour', ts) AS BIGINT) AS h, CAST(floor(date_part('second', ts)) AS BIGINT) AS s FROM events",
    ),
    "fd6_date_add": (
        "SELECT o_orderkey, DATE_ADD(TO_DATE(o_orderdate), 1, 'month') AS m, DATE_ADD(TO_DATE(o_orderdate), 3, 'hour') AS h FROM 'orders.parquet'",
        "SELECT o_orderkey, strftime(CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + CAST(day(o_orderdate) - 1 AS INTEGER), '%Y-%m-%dT00:00:00Z') AS m, strftime(date_trunc('day', o_orderdate) + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS h FROM orders",
    ),
    "fd7_date_sub": (
        "SELECT o_orderkey, DATE_SUB(o_orderdate, 10, 'day') AS d FROM 'orders.parquet'",
        "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 10 DAY, '%Y-%m-%dT%H:%M:%SZ') AS d FROM orders",
    ),
    "fd8_date_diff": (
        "SELECT l_orderkey, l_linenumber, DATE_DIFF(l_shipdate, '1995-01-01T12:00:00') AS d FROM 'lineitem.parquet'",
        "SELECT l_orderkey, l_linenumber, CAST(floor((epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1995-01-01 12:00:00')) / 86400000000.0) AS BIGINT) AS d FROM lineitem",
    ),
    "fd9_fd10_year_month": ("SELECT YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, COUNT(*) AS n FROM 'orders.parquet' GROUP BY YEAR(o_orderdate), MONTH(o_orderdate)", None),
    "fc1_cast": ("SELECT CAST(o_orderkey, 'string') AS s, CAST('12.5', 'number') AS n FROM 'orders.parquet'", "SELECT CAST(o_orderkey AS VARCHAR) AS s, CAST(12.5 AS DOUBLE) AS n FROM orders"),
    "fc2_try_cast": ("SELECT TRY_CAST(o_orderpriority, 'number') AS bad, TRY_CAST('7', 'number') AS good FROM 'orders.parquet'", "SELECT CAST(NULL AS DOUBLE) AS bad, CAST(7 AS DOUBLE) AS good FROM orders"),
    "fc3_fc5_to": (
        "SELECT TO_STRING(o_orderkey) AS s, TO_NUMBER('3') AS n, TO_DATE(o_orderdate) AS d FROM 'orders.parquet'",
        "SELECT CAST(o_orderkey AS VARCHAR) AS s, CAST(3 AS DOUBLE) AS n, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders",
    ),
    "fx1_fx2_null_functions": ("SELECT COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS c, NULLIF(o_orderstatus, 'O') AS n FROM 'orders.parquet'", None),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).sql(FLAGSHIP)


def _dialect(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sf_dir).sql(text)


def _by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(spark, sf_dir).sql("SELECT _file, COUNT(*) AS n FROM 're*.parquet' GROUP BY _file")
    return df.select(F.element_at(F.split("_file", "/"), -1).alias("file"), "n")


def _custom_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, sf_dir)
    engine.register_function("INITIALS", lambda s: F.substring(s, 1, 2))
    return engine.sql("SELECT n_name, initials(n_name) AS i FROM 'nation.parquet'")


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.lines(Engine(spark, sf_dir).sql("SELECT r_regionkey, r_name FROM 'region.parquet'"))


def _csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csvlines.lines(Engine(spark, sf_dir).sql("SELECT c_custkey, c_name, c_mktsegment, CONCAT('=', c_name) AS formula FROM 'customer.parquet'"))


def _command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(spark, ["-q", "SELECT n_name FROM nation.parquet ORDER BY n_name", "-limit", "3", os.path.join(sf_dir, "nation.parquet")])


def _programmatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace import api

    df = Engine(spark, sf_dir).table("supplier.parquet")
    kept = api.apply_filter(df, "s_acctbal > 0 AND s_nationkey IN (1, 2, 3)")
    return api.apply_limit_offset(api.apply_order_by(api.apply_select_list(kept, "s_suppkey, ROUND(s_acctbal) AS bal"), "bal DESC, s_suppkey"), 5, 1)


def _schema_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(spark, ["--schema", "-f", "csv", os.path.join(sf_dir, "nation.parquet")])


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in each output format, by formatters of one protocol, and the complaint about an unknown one."""
    file = os.path.join(sf_dir, "region.parquet")
    out = None
    for name in ("json", "jsonl", "csv", "xml"):
        part = _printed(spark, ["-q", "SELECT r_name FROM region.parquet", "-f", name, file]).select(F.lit(name).alias("format"), "line")
        out = part if out is None else out.unionByName(part)
    return out


def _printed(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """What the command line prints, its errors included."""
    from millrace.__main__ import main

    out = io.StringIO()
    main(arguments, spark=spark, out=out, err=out)
    return spark.createDataFrame([(line,) for line in out.getvalue().splitlines()], "line string")


def _complaints(queries: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    """How each query is refused: the kind of error, or none."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = []
        for name, text in queries.items():
            try:
                Engine(spark, sf_dir).sql(text)
                rows.append((name, "none"))
            except QueryError as e:
                rows.append((name, type(e).__name__))
        return spark.createDataFrame(rows, "query string, error string")

    return run


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of its queries use window functions, and where they have subqueries."""
    texts = {
        "plain": "SELECT n_name FROM nation.parquet WHERE n_regionkey = 1",
        "window": "SELECT ROW_NUMBER() OVER (ORDER BY n_name) AS i FROM nation.parquet",
        "where": "SELECT n_name FROM nation.parquet WHERE n_regionkey IN (SELECT r_regionkey FROM region.parquet)",
        "select": "SELECT (SELECT MAX(r_regionkey) FROM region.parquet) AS m FROM nation.parquet",
    }
    rows = [(k, inspect.has_window_function(q), inspect.has_subquery_in_where(q), inspect.has_subquery_in_select(q)) for k, q in ((k, parse(t)) for k, t in texts.items())]
    return spark.createDataFrame(rows, "query string, windows boolean, in_where boolean, in_select boolean")


def _values(columns: str, rows: list[tuple]) -> str:
    """A statement that gives fixed rows."""
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper()
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({columns})"


_LIMITED = {
    "bytes": "SELECT n_name FROM nation.parquet WHERE n_name = '" + "x" * (1 << 20) + "'",
    "tokens": "SELECT n_name FROM nation.parquet WHERE n_regionkey IN (" + ", ".join(["1"] * 600) + ")",
    "depth": "SELECT n_name FROM nation.parquet WHERE " + "(" * 120 + "n_regionkey = 1" + ")" * 120,
    "column": "SELECT " + "c" * 300 + " FROM nation.parquet",
    "table": "SELECT n_name FROM '" + "t" * 5000 + "'",
    "within": "SELECT n_name FROM nation.parquet WHERE n_regionkey IN (" + ", ".join(["1"] * 400) + ")",
}
_WINDOWS = {
    "no over": "SELECT ROW_NUMBER() AS i FROM nation.parquet",
    "rank without over": "SELECT n_name, RANK() FROM nation.parquet",
    "named window": "SELECT ROW_NUMBER() OVER w AS i FROM nation.parquet WINDOW w AS (ORDER BY n_name)",
    "over": "SELECT ROW_NUMBER() OVER (ORDER BY n_name) AS i FROM nation.parquet",
}

CODE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "flagship": (flagship, None),
    "s5_s6_a14_glob_by_file": (_by_file, "SELECT 'region.parquet' AS file, COUNT(*) AS n FROM region"),
    "s10_schema": (
        lambda spark, sf_dir: schema_table(spark, f"{sf_dir}/embeddings.parquet").unionByName(schema_table(spark, f"{sf_dir}/nation.parquet")),
        _values(
            "name, type, physical_type, logical_type, required, optional, repeated",
            [
                ("vec_id", "INT64", "INT64", "", False, True, False),
                ("embedding", "FLOAT32", "FLOAT", "", False, False, True),
                ("label", "INT32", "INT32", "", False, True, False),
                ("n_nationkey", "INT32", "INT32", "", False, True, False),
                ("n_name", "STRING", "BYTE_ARRAY", "STRING", False, True, False),
                ("n_regionkey", "INT32", "INT32", "", False, True, False),
            ],
        ),
    ),
    "k2_json_lines": (_json_lines, "SELECT '{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}' AS line FROM region"),
    "k3_k5_csv_lines": (_csv_lines, "SELECT c_custkey || ',' || c_mktsegment || ',' || c_name || ',''=' || c_name AS line FROM (SELECT * FROM customer)"),
    "u1_u3_custom_function": (_custom_function, "SELECT n_name, substr(n_name, 1, 2) AS i FROM nation"),
    "u5_library_calls": (_programmatic, "SELECT s_suppkey, round(s_acctbal) AS bal FROM supplier WHERE s_acctbal > 0 AND s_nationkey IN (1, 2, 3) ORDER BY bal DESC, s_suppkey LIMIT 5 OFFSET 1"),
    "s14_schema_mode": (
        _schema_mode,
        _values("line", [("logical_type,name,optional,physical_type,repeated,required,type",), (",n_nationkey,true,INT32,false,false,INT32",), ("STRING,n_name,true,BYTE_ARRAY,false,false,STRING",), (",n_regionkey,true,INT32,false,false,INT32",)]),
    ),
    "k1_k6_formats": (
        _formats,
        "SELECT f AS format, '{\"r_name\":\"' || r_name || '\"}' AS line FROM region, (VALUES ('json'), ('jsonl')) AS t(f) UNION ALL SELECT 'csv', r_name FROM region "
        "UNION ALL SELECT 'csv', 'r_name' UNION ALL SELECT 'xml', 'Error: unsupported format: xml; use json, jsonl or csv'",
    ),
    "w13_over_is_needed": (_complaints(_WINDOWS), _values("query, error", [(k, "none" if k == "over" else "SyntaxProblem") for k in _WINDOWS])),
    "w14_questions": (_questions, _values("query, windows, in_where, in_select", [("plain", False, False, False), ("window", True, False, False), ("where", False, True, False), ("select", False, False, True)])),
    "u6_limits": (_complaints(_LIMITED), _values("query, error", [(k, "none" if k == "within" else "LimitProblem") for k in _LIMITED])),
    "u7_command_line": (_command_line, "SELECT '{\"n_name\":\"' || n_name || '\"}' AS line FROM nation ORDER BY n_name LIMIT 3"),
}


def _as_oracle(text: str) -> str:
    import re

    return re.sub(r"'(\w+)\.parquet'", r"\1", text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in CODE.items()} | {k: _dialect(text) for k, (text, _) in PAIRS.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: sql for k, (_, sql) in CODE.items() if sql} | {k: sql or _as_oracle(text) for k, (text, sql) in PAIRS.items()}
    return out | {"flagship": _as_oracle(FLAGSHIP)}
