"""Set operations, subqueries and common table expressions."""

from __future__ import annotations

from quillstone.plans.registry import both, pair

both("set_union_all", "SELECT s_name AS name, s_nationkey AS nation FROM {supplier} UNION ALL SELECT c_name AS name, c_nationkey AS nation FROM {customer}", "supplier", "customer")
both("set_union", "SELECT s_nationkey AS nation FROM {supplier} UNION SELECT c_nationkey AS nation FROM {customer}", "supplier", "customer")
both("set_intersect", "SELECT s_nationkey AS nation FROM {supplier} INTERSECT SELECT c_nationkey AS nation FROM {customer} WHERE c_acctbal > 5000", "supplier", "customer")
both("set_intersect_all", "SELECT s_nationkey AS nation FROM {supplier} INTERSECT ALL SELECT c_nationkey AS nation FROM {customer} WHERE c_acctbal > 9000", "supplier", "customer")
both("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey AS k FROM {orders} WHERE o_totalprice > 300000", "customer", "orders")
both("set_except_all", "SELECT c_nationkey AS nation FROM {customer} EXCEPT ALL SELECT s_nationkey AS nation FROM {supplier}", "customer", "supplier")
both(
    "cte",
    "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 1000000) SELECT c_name, round(total, 2) AS total FROM top JOIN {customer} ON o_custkey = c_custkey",
    "orders",
    "customer",
)
both("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
both("subq_scalar", "SELECT c_custkey, c_acctbal FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM {customer})", "customer")
both("subq_in", "SELECT s_suppkey, s_name FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)", "supplier", "nation")
both("subq_exists", "SELECT p_partkey FROM {part} p WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)", "part", "lineitem")
both("subq_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.8 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", "orders")
both("values_inline", "SELECT name, age FROM (VALUES ('Alice', 30), ('Bob', 25), ('Charlie', 35)) AS t(name, age) WHERE age >= 30")
pair(
    "distinct_on",
    "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn = 1",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "orders",
)
pair(
    "pivot",
    "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM {lineitem}) PIVOT (CAST(sum(l_quantity) AS BIGINT) FOR l_linestatus IN ('F' AS f, 'O' AS o))",
    "SELECT l_returnflag, CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS f, CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS o FROM lineitem GROUP BY l_returnflag",
    "lineitem",
)
pair(
    "unpivot",
    "SELECT doc_id, name, value FROM (SELECT doc_id, quality, toxic FROM {labels}) UNPIVOT INCLUDE NULLS (value FOR name IN (quality, toxic))",
    "SELECT doc_id, name, value FROM (SELECT doc_id, quality, toxic FROM labels) UNPIVOT INCLUDE NULLS (value FOR name IN (quality, toxic))",
    "labels",
)
pair("select_except", "SELECT * EXCEPT (c_name, c_acctbal) FROM {customer}", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer", "customer")
pair("select_replace", "SELECT * EXCEPT (r_name), upper(r_name) AS r_name FROM {region}", "SELECT * REPLACE (upper(r_name) AS r_name) FROM region", "region")
