"""Aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.registry import both, pair, query
from quillstone.plans.tables import table

both("agg_count", "SELECT count(*) AS n FROM {lineitem}", "lineitem")
both("agg_avg", "SELECT round(avg(l_quantity), 6) AS avg_quantity, round(avg(l_extendedprice), 4) AS avg_price FROM {lineitem}", "lineitem")
both("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS avg_quantity FROM {lineitem} GROUP BY l_returnflag, l_linestatus", "lineitem")
both("agg_sum_order", "SELECT l_shipmode_key, revenue FROM (SELECT l_linenumber AS l_shipmode_key, round(sum(l_extendedprice * l_quantity), 0) AS revenue FROM {lineitem} GROUP BY l_linenumber) ORDER BY revenue DESC", "lineitem")
both("agg_multikey", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderstatus, o_orderpriority", "orders")
both("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 14", "orders")
both("agg_minmax", "SELECT c_mktsegment, min(c_acctbal) AS least, max(c_acctbal) AS most, min(c_name) AS first_name FROM {customer} GROUP BY c_mktsegment", "customer")
both("agg_distinct", "SELECT DISTINCT p_brand, p_size FROM {part}", "part")
both("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag", "lineitem")
both("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM {orders} GROUP BY o_orderpriority", "orders")
both(
    "agg_rollup",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g1, CAST(grouping(o_orderpriority) AS BIGINT) AS g2 FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "orders",
)
both("agg_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} WHERE c_nationkey < 6 GROUP BY CUBE (c_mktsegment, c_nationkey)", "customer")
both("agg_grouping_sets", "SELECT p_brand, p_size, count(*) AS n, max(p_retailprice) AS most FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_size), ())", "part")
both(
    "agg_stats",
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 8) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r,
       round(covar_samp(l_quantity, l_tax), 6) AS cs FROM {lineitem} GROUP BY l_returnflag""",
    "lineitem",
)
pair(
    "agg_quantile",
    "SELECT o_orderstatus, round(median(o_totalprice), 4) AS med, round(percentile(o_totalprice, 0.9), 4) AS p90 FROM {orders} GROUP BY o_orderstatus",
    "SELECT o_orderstatus, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus",
    "orders",
)
pair("agg_approx_distinct", "SELECT l_returnflag, approx_count_distinct(l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag", None, "lineitem")
pair(
    "agg_approx_distinct_error",
    "SELECT l_returnflag, abs(approx_count_distinct(l_partkey, 0.02) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS close FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag",
    "lineitem",
)
pair(
    "agg_first_last",
    "SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, any_value(o_custkey) AS any_key FROM {orders} GROUP BY o_custkey",
    "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS last_order, any_value(o_custkey) AS any_key FROM orders GROUP BY o_custkey",
    "orders",
)
pair(
    "agg_list",
    "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey",
    "nation",
)
pair(
    "agg_string",
    "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    "nation",
)
pair(
    "agg_argmax",
    "SELECT c_nationkey, max_by(c_name, struct(c_acctbal, c_custkey)) AS richest, min_by(c_name, struct(c_acctbal, c_custkey)) AS poorest FROM {customer} GROUP BY c_nationkey",
    "SELECT c_nationkey, arg_max(c_name, (c_acctbal, c_custkey)) AS richest, arg_min(c_name, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey",
    "customer",
)
both(
    "agg_bool",
    "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_totalprice > 400000) AS any_huge, bit_or(CAST(o_custkey AS INT)) AS bits, bit_xor(CAST(o_orderkey AS INT)) AS mixed FROM {orders} GROUP BY o_orderpriority",
    "orders",
)
both("agg_mode", "SELECT mode(o_orderstatus) AS status FROM (SELECT o_orderstatus FROM {orders} WHERE o_orderkey > 0)", "orders")
both("agg_group_all", "SELECT p_brand, p_type, count(*) AS n FROM {part} GROUP BY ALL", "part")
both("agg_share", "SELECT toxic, n, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 6) AS share FROM (SELECT toxic, count(*) AS n FROM {labels} GROUP BY toxic)", "labels")
both("agg_count_if", "SELECT c_nationkey, CAST(count_if(c_acctbal < 0) AS BIGINT) AS debtors, count(c_acctbal) AS n FROM {customer} GROUP BY c_nationkey", "customer")


@query("agg_dict", "SELECT c_mktsegment, round(avg(c_acctbal), 2) AS mean_balance, max(c_custkey) AS last_key, count(*) AS n FROM customer GROUP BY c_mktsegment")
def agg_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg({"c_acctbal": "avg", "c_custkey": "max", "*": "count"})
    return grouped.select("c_mktsegment", F.round("avg(c_acctbal)", 2).alias("mean_balance"), F.col("max(c_custkey)").alias("last_key"), F.col("count(1)").alias("n"))


@query(
    "agg_pivot",
    """SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS o,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS p FROM orders GROUP BY o_orderpriority""",
)
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.na.fill(0).select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))
