"""Sort, limit, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.registry import both, query
from quillstone.plans.tables import table

both("sort_multi", "SELECT c_custkey, c_nationkey, c_acctbal FROM {customer} ORDER BY c_nationkey ASC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey", "customer")
both("limit_n", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_orderkey LIMIT 25", "orders")
both("sort_offset", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_orderkey LIMIT 20 OFFSET 40", "orders")
both("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "orders")


@query("sample_rows")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling is the feature here: a tenth of the rows by a seeded draw."""
    return table(spark, sf_dir, "lineitem").sample(0.1, seed=7).select("l_orderkey", "l_linenumber")


@query("sample_bounds", "SELECT true AS near, 0::BIGINT AS foreign_rows")
def sample_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample's size is near its share, and all its rows are the table's."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    picked = sample_rows(spark, sf_dir)
    foreign = picked.join(rows, ["l_orderkey", "l_linenumber"], "left_anti").agg(F.count("*").alias("foreign_rows"))
    total, some = rows.agg(F.count("*").alias("total")), picked.agg(F.count("*").alias("some"))
    return total.join(some).join(foreign).select((F.abs(F.col("some") - F.col("total") * 0.1) <= 5 * F.sqrt(F.col("total") * 0.09)).alias("near"), "foreign_rows")
