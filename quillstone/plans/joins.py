"""Joins across collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.joins import asof_join, band_join
from quillstone.plans.registry import both, query
from quillstone.plans.tables import table

both("join_left_group", "SELECT c_custkey, c_name, count(o_orderkey) AS order_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey, c_name", "customer", "orders")
both("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > 200000", "orders", "customer")
both("join_right", "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey AND o_totalprice > 300000", "orders", "customer")
both(
    "join_full",
    """SELECT s.s_suppkey, c.c_custkey, coalesce(s.s_nationkey, c.c_nationkey) AS nationkey
       FROM {supplier} s FULL OUTER JOIN {customer} c ON s.s_suppkey = c.c_custkey AND s.s_acctbal < c.c_acctbal""",
    "supplier",
    "customer",
)
both("join_semi", "SELECT c_custkey, c_mktsegment FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)", "customer", "orders")
both("join_anti", "SELECT c_custkey, c_mktsegment FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)", "customer", "orders")
both("join_theta", "SELECT r.r_name, n.n_name FROM {region} r JOIN {nation} n ON r.r_regionkey < n.n_regionkey", "region", "nation")
both(
    "join_self",
    "SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key, a.s_nationkey AS nationkey FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "supplier",
)
both(
    "join_lateral",
    """SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM {customer} c,
       LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t""",
    "customer",
    "orders",
)
both(
    "join_using",
    "SELECT k, s_name, c_name FROM (SELECT s_suppkey AS k, s_name FROM {supplier}) s JOIN (SELECT c_custkey AS k, c_name FROM {customer}) c USING (k)",
    "supplier",
    "customer",
)
both(
    "join_natural",
    "SELECT nationkey, n_name, s_name FROM (SELECT n_nationkey AS nationkey, n_name FROM {nation}) n NATURAL JOIN (SELECT s_nationkey AS nationkey, s_name FROM {supplier}) s",
    "nation",
    "supplier",
)
both(
    "join_broadcast_hint",
    "SELECT /*+ BROADCAST(n) */ s_suppkey, n_name FROM {supplier} s JOIN {nation} n ON s_nationkey = n_nationkey",
    "supplier",
    "nation",
)
both(
    "join_star",
    """SELECT r_name, n_name, count(*) AS line_count, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
       GROUP BY r_name, n_name""",
    "lineitem",
    "supplier",
    "nation",
    "region",
)


@query(
    "join_range",
    """WITH b AS (SELECT p_partkey AS band_id, p_retailprice AS lo, p_retailprice + 25 AS hi FROM part)
       SELECT o_orderkey, band_id FROM orders JOIN b ON o_totalprice / 100 >= lo AND o_totalprice / 100 < hi""",
)
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("point"))
    bands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("band_id"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 25).alias("hi"))
    return band_join(points, bands, "point", "lo", "hi", width=25.0).select("o_orderkey", "band_id")


@query(
    "join_asof",
    """WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
            v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
       SELECT p.event_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    purchases = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return asof_join(purchases, views, by=["user_id"], on="ts", value=["view_id"]).select("event_id", "view_id")
