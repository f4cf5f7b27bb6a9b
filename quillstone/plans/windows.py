"""Window functions."""

from __future__ import annotations

from quillstone.plans.registry import both, pair

both("win_row_number", "SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_name) AS BIGINT) AS rn FROM {nation}", "nation")
both("win_rank", "SELECT s_suppkey, s_nationkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS BIGINT) AS rk FROM {supplier}", "supplier")
pair(
    "win_topk_group",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn <= 3",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
    "orders",
)
both(
    "win_rank_family",
    """SELECT c_custkey, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS quarter
       FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""",
    "customer",
)
both(
    "win_lag_lead",
    "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS before, lead(o_orderkey, 2) OVER w AS later, lag(o_orderkey, 1, CAST(-1 AS BIGINT)) OVER w AS before_or FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "orders",
)
both(
    "win_first_last",
    """SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key, nth_value(o_orderkey, 2) OVER w AS second_key
       FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "orders",
)
both("win_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM {orders}", "orders")
both("win_moving", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM {events}", "events")
both("win_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM {part}", "part")
both("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS last_day FROM {events}", "events")
both("win_partition_share", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER w, 8) AS share, count(*) OVER w AS n FROM {supplier} WINDOW w AS (PARTITION BY s_nationkey)", "supplier")
