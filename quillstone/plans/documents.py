"""Queries over document collections: scans, predicates, datasets, SQL entry points and schemas.

Most build their documents from a table in place (`of`); those marked as stored write collections in the shared folder
first, so that they read what the store reads.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import layout
from quillstone import sql as qsql
from quillstone.functions import structural
from quillstone.operators.dataset import IterableDataset, MapDataset
from quillstone.operators.latest import latest, merge, with_positions
from quillstone.operators.predicate import And, Eq, Exists, Matches, NotExists, Or, Predicate, field, projection
from quillstone.plans.registry import query
from quillstone.plans.tables import shared_folder, table
from quillstone.store import Root

# Building blocks


def of(df: DataFrame, id_column: str) -> DataFrame:
    """Documents of a table: _id, doc, _raw and _ord. to_json leaves nulls out, so a null column is an absent field."""
    raw = F.to_json(F.struct(*df.columns))
    return df.select(F.col(id_column).cast("string").alias("_id"), raw.alias("_raw"), F.col(id_column).alias("_ord")).withColumn("doc", F.parse_json("_raw"))


def stored(spark: SparkSession, **tables: tuple[DataFrame, str]) -> Root:
    """A root in the shared folder with a collection for each (table, id column)."""
    root = Root(spark, shared_folder(spark))
    for name, (df, id_column) in tables.items():
        root.collection(name).write(df, id_column)
    return root


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(table(spark, sf_dir, "customer"), "c_custkey")


def _dataset(spark: SparkSession, sf_dir: str) -> MapDataset:
    return MapDataset(with_positions(of(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey"), ["_ord"]))


def register(name: str, oracle: str | None = None) -> Callable:
    def keep(fn: Callable) -> Callable:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
            return fn(spark, sf_dir)

        query(name, oracle)(run)
        return fn

    return keep


def _name() -> Column:
    return field("c_name", "string").alias("c_name")


def _key() -> Column:
    return field("c_custkey", "bigint").alias("c_custkey")


# Scans


@register("scan_filter_project", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def scan_filter_project(spark, sf_dir):
    return _customers(spark, sf_dir).where(And([Eq("c_mktsegment", "BUILDING"), Eq("c_nationkey", 7)]).column()).select(_key(), _name())


@register("scan_all", "SELECT CAST(p_partkey AS VARCHAR) AS _id, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def scan_all(spark, sf_dir):
    docs = stored(spark, part=(table(spark, sf_dir, "part"), "p_partkey")).collection("part").documents()
    return docs.select("_id", field("p_name", "string").alias("p_name"), field("p_size", "bigint").alias("p_size"))


@register("scan_raw", """SELECT '{"_id":"' || r_regionkey || '","r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS _raw FROM region""")
def scan_raw(spark, sf_dir):
    return stored(spark, region=(table(spark, sf_dir, "region"), "r_regionkey")).collection("region").scan_raw()


@register("scan_predicate", "SELECT CAST(s_suppkey AS VARCHAR) AS _id, s_name FROM supplier WHERE s_nationkey = 3")
def scan_predicate(spark, sf_dir):
    return of(table(spark, sf_dir, "supplier"), "s_suppkey").where(Matches({"s_nationkey": 3}).column()).select("_id", field("s_name", "string").alias("s_name"))


@register("scan_fields", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def scan_fields(spark, sf_dir):
    picked = of(table(spark, sf_dir, "nation"), "n_nationkey").select("_id", *projection(["n_name", "n_regionkey"]))
    return picked.select("_id", F.col("n_name").cast("string").alias("n_name"), F.col("n_regionkey").cast("bigint").alias("n_regionkey"))


@register("scan_with_ids", "SELECT CAST(r_regionkey AS VARCHAR) AS _id, '{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}' AS doc FROM region")
def scan_with_ids(spark, sf_dir):
    return of(table(spark, sf_dir, "region"), "r_regionkey").select("_id", F.to_json("doc").alias("doc"))


@register("read_columns", "SELECT p_brand, p_retailprice FROM part")
def read_columns(spark, sf_dir):
    docs = of(table(spark, sf_dir, "part"), "p_partkey")
    return docs.select(field("p_brand", "string").alias("p_brand"), field("p_retailprice", "double").alias("p_retailprice"))


@register("sql_register", "SELECT n_name, n_regionkey::BIGINT AS n_regionkey, CAST(n_nationkey AS VARCHAR) AS _id FROM nation WHERE n_regionkey > 1")
def sql_register(spark, sf_dir):
    root = stored(spark, nation=(table(spark, sf_dir, "nation"), "n_nationkey"))
    return qsql.Session(root).register("nation").query("SELECT n_name, n_regionkey, _id FROM nation WHERE n_regionkey > 1")


@register("read_tvf", "SELECT r_name, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM region")
def read_tvf(spark, sf_dir):
    root = stored(spark, region=(table(spark, sf_dir, "region"), "r_regionkey"))
    return qsql.Session(root).query(f"SELECT r_name, r_regionkey FROM read_collection('{root.path}', 'region')")


@register("read_tvf_join", "SELECT r_name, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def read_tvf_join(spark, sf_dir):
    root = stored(spark, region=(table(spark, sf_dir, "region"), "r_regionkey"), nation=(table(spark, sf_dir, "nation"), "n_nationkey"))
    text = f"SELECT r_name, count(*) AS nations FROM read_collection('{root.path}', 'region') r JOIN read_collection('{root.path}', 'nation') n ON r.r_regionkey = n.n_regionkey GROUP BY r_name"
    return qsql.Session(root).query(text)


@register("scan_limit", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 15")
def scan_limit(spark, sf_dir):
    return _customers(spark, sf_dir).orderBy("_ord").limit(15).select(_key(), _name())


@register("merge_collections", "SELECT 'a_' || r_regionkey AS _id, r_name, NULL::VARCHAR AS n_name FROM region UNION ALL SELECT 'b_' || n_nationkey, NULL, n_name FROM nation")
def merge_collections(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.concat(F.lit("a_"), "r_regionkey").alias("_id"), "r_name")
    b = table(spark, sf_dir, "nation").select(F.concat(F.lit("b_"), "n_nationkey").alias("_id"), "n_name")
    return a.unionByName(b, allowMissingColumns=True)


@register("etl_filter_transform", "SELECT CAST(event_id AS VARCHAR) AS _id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(value * 2, 6) AS doubled FROM events WHERE event_type = 'purchase'")
def etl_filter_transform(spark, sf_dir):
    docs = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("doc", F.parse_json("props"))
    return docs.select(F.col("event_id").cast("string").alias("_id"), "user_id", field("k", "bigint").alias("k"), F.round(F.col("value") * 2, 6).alias("doubled"))


# Points and mutation


@register("get_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def get_by_id(spark, sf_dir):
    return _customers(spark, sf_dir).where("_id = '42'").select(_key(), _name())


@register("multi_get", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8, 13, 21, 34, 55, 89, 144)")
def multi_get(spark, sf_dir):
    wanted = spark.createDataFrame([(str(i),) for i in (3, 5, 8, 13, 21, 34, 55, 89, 144, 10**9)], "_id string")
    return _customers(spark, sf_dir).join(wanted, "_id", "left_semi").select(_key(), _name())


@register("get_at", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 17")
def get_at(spark, sf_dir):
    return _customers(spark, sf_dir).orderBy("_ord").offset(17).limit(1).select(_key(), _name())


@register("exists_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def exists_semi(spark, sf_dir):
    orders, wanted = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return orders.join(wanted, orders["o_custkey"] == wanted["c_custkey"], "left_semi").select("o_orderkey")


@register("delete_anti", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name FROM nation WHERE n_regionkey <> 2")
def delete_anti(spark, sf_dir):
    nations = stored(spark, nation=(table(spark, sf_dir, "nation"), "n_nationkey")).collection("nation")
    nations.delete_where({"n_regionkey": 2})
    return nations.documents().select("_id", field("n_name", "string").alias("n_name"))


@register("latest_wins", "SELECT CAST(user_id AS VARCHAR) AS _id, arg_max(event_id, event_id) AS newest, min(event_id) AS first_seen FROM events GROUP BY user_id")
def latest_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    raw = F.to_json(F.struct("event_id", "event_type", "value"))
    versions = events.select(F.col("user_id").cast("string").alias("_id"), F.parse_json(raw).alias("doc"), raw.alias("_raw"), F.lit("put").alias("_kind"), F.col("event_id").alias("_ord"))
    return latest(versions, deletes=False).select("_id", field("event_id", "bigint").alias("newest"), F.col("_ord").alias("first_seen"))


@register("upsert_merge", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert_merge(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(0).alias("version"))
    changes = base.where("c_custkey % 10 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"), F.lit(1).alias("version"))
    return merge(base, changes, "c_custkey", "version").select("c_custkey", "c_mktsegment")


@register("count_docs", "SELECT count(*) AS n FROM conversations")
def count_docs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return of(rows.withColumn("key", F.concat_ws("-", "conv_id", "turn")), "key").agg(F.count("*").alias("n"))


@register("list_ids", "SELECT CAST(s_suppkey AS VARCHAR) AS _id, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier")
def list_ids(spark, sf_dir):
    return with_positions(of(table(spark, sf_dir, "supplier"), "s_suppkey"), ["_ord"]).select("_id", F.col("_pos").alias("pos"))


# Predicates and paths


_SPARSE = "(SELECT doc_id, quality, CASE WHEN doc_id % 3 <> 0 THEN toxic END AS toxic FROM labels) AS labels"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of labels; every third lacks toxic."""
    return of(table(spark, sf_dir, "labels").withColumn("toxic", F.when(F.col("doc_id") % 3 != 0, F.col("toxic"))), "doc_id")


def _predicate(name: str, oracle: str, predicate: Predicate) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _labels(spark, sf_dir).where(predicate.column()).select("_id")

    register(name, f"SELECT CAST(doc_id AS VARCHAR) AS _id FROM {_SPARSE} WHERE {oracle}")(run)


_predicate("pred_eq", "quality = 1", Eq("quality", 1))
_predicate("pred_exists", "toxic IS NOT NULL", Exists("toxic"))
_predicate("pred_not_exists", "toxic IS NULL", NotExists("toxic"))
_predicate("pred_and", "quality = 1 AND toxic = 1", And([Eq("quality", 1.0), Eq("toxic", 1)]))
_predicate("pred_or", "quality = 0 OR toxic = 1", Or([Eq("quality", 0), Eq("toxic", 1)]))
_predicate("pred_dict", "quality = 1 AND toxic IS NULL", Matches({"quality": 1, "toxic": None}))
_predicate("pred_empty_and", "true", And([]))


@register("project_nested", "SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS _id, role, CAST(length(text) AS BIGINT) AS n FROM conversations")
def project_nested(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    nested = rows.select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.struct(F.struct("role", F.length("text").alias("n")).alias("inner")).alias("outer"))
    picked = of(nested, "key").select("_id", *projection(["outer.inner.role", "outer.inner.n"]))
    return picked.select("_id", F.col("role").cast("string").alias("role"), F.col("n").cast("bigint").alias("n"))


@register("filter_expr", "SELECT CAST(p_partkey AS VARCHAR) AS _id FROM part WHERE p_size > 40 AND p_retailprice < 1000")
def filter_expr(spark, sf_dir):
    return of(table(spark, sf_dir, "part"), "p_partkey").where((field("p_size", "int") > 40) & (field("p_retailprice", "double") < 1000)).select("_id")


@register("sql_where", "SELECT c_name FROM customer WHERE c_acctbal >= 9000 AND c_mktsegment = 'MACHINERY'")
def sql_where(spark, sf_dir):
    session = qsql.Session(Root(spark, tempfile.mkdtemp(prefix="quillstone-"), "r")).register_df("data", table(spark, sf_dir, "customer"))
    return session.query("SELECT c_name FROM data WHERE c_acctbal >= 9000 AND c_mktsegment = 'MACHINERY'")


@register("canonical_json", """SELECT CAST(r_regionkey AS VARCHAR) AS _id, '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' AS text FROM region""")
def canonical_json(spark, sf_dir):
    return of(table(spark, sf_dir, "region"), "r_regionkey").select("_id", structural.canonical_json("_raw").alias("text"))


# Datasets


@register("ds_slice", "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) AS pos FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) WHERE p >= 10 AND p < 60 AND (p - 10) % 5 = 0")
def ds_slice(spark, sf_dir):
    return _dataset(spark, sf_dir).slice(slice(10, 60, 5)).df.select(_key(), F.col("_pos").alias("pos"))


@register("ds_select", "SELECT c_custkey, new AS pos FROM (VALUES (0, 5), (1, 2), (2, 5), (3, 99)) AS w(new, old) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) ON p = old")
def ds_select(spark, sf_dir):
    return _dataset(spark, sf_dir).select([5, 2, 5, 99]).df.select(_key(), F.col("_pos").cast("int").alias("pos"))


@register("ds_shuffle", "SELECT c_custkey FROM customer")
def ds_shuffle(spark, sf_dir):
    return _dataset(spark, sf_dir).shuffle(7).df.select(_key())


@register("ds_map", "SELECT CAST(c_custkey AS VARCHAR) AS _id, upper(c_name) AS name, c_nationkey * 10 AS score FROM customer")
def ds_map(spark, sf_dir):
    return _dataset(spark, sf_dir).with_columns(name=F.upper(field("c_name", "string")), score=field("c_nationkey", "int") * 10).drop("_pos")


@register("ds_map_python", "SELECT CAST(c_custkey AS VARCHAR) AS _id, upper(c_name) AS name FROM customer")
def ds_map_python(spark, sf_dir):
    return _dataset(spark, sf_dir).map(lambda d: {"name": d["c_name"].upper()}).df.select("_id", field("name", "string").alias("name"))


@register("ds_filter", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_nationkey = 4")
def ds_filter(spark, sf_dir):
    return _dataset(spark, sf_dir).filter({"c_nationkey": 4}).df.select(_key(), F.col("_pos").alias("pos"))


@register("ds_take", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 12")
def ds_take(spark, sf_dir):
    return _dataset(spark, sf_dir).take(12).df.select(_key())


@register("ds_skip", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
def ds_skip(spark, sf_dir):
    return _dataset(spark, sf_dir).skip(100).df.select(_key())


@register("ds_batch", "SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 64 AS batch, c_custkey FROM customer")
def ds_batch(spark, sf_dir):
    rows = _dataset(spark, sf_dir).batches(64)
    return rows.select("batch", F.explode("docs").alias("d")).select("batch", F.get_json_object("d", "$.c_custkey").cast("bigint").alias("c_custkey"))


@register("ds_features", "SELECT * FROM (VALUES ('c_custkey', 'int64'), ('c_name', 'string'), ('c_nationkey', 'int64')) AS t(name, kind)")
def ds_features(spark, sf_dir):
    return spark.createDataFrame(sorted(_dataset(spark, sf_dir).features.items()), "name string, kind string")


@register("ds_split", "SELECT part, n FROM (SELECT round(count(*) * 0.7)::BIGINT AS a, round(count(*) * 0.15)::BIGINT AS b, count(*) AS c FROM customer), LATERAL (VALUES ('train', a), ('val', b), ('test', c - a - b)) AS t(part, n)")
def ds_split(spark, sf_dir):
    parts = _dataset(spark, sf_dir).split(0.7, 0.15, 0.15, seed=1)
    train, val, test = (p.df.select(F.lit(n).alias("part")) for p, n in zip(parts, ("train", "val", "test"), strict=True))
    return train.union(val).union(test).groupBy("part").agg(F.count("*").alias("n"))


@register("ds_chain", "SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer WHERE c_nationkey < 5")
def ds_chain(spark, sf_dir):
    chain = _dataset(spark, sf_dir).filter(field("c_nationkey", "int") < 5).shuffle(3).skip(0)
    return chain.df.agg(F.count("*").alias("n"), F.count_distinct(field("c_nationkey", "int")).alias("nations"))


@register("explode_count", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY word")
def explode_count(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"))


@register("array_contains_filter", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING list_contains(list(role), 'system')")
def array_contains_filter(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return talks.where(F.array_contains("roles", "system")).select("conv_id")


def _iterable(spark: SparkSession, sf_dir: str) -> IterableDataset:
    return IterableDataset(of(table(spark, sf_dir, "supplier"), "s_suppkey"))


@register("iter_filter_map", "SELECT upper(s_name) AS name FROM supplier WHERE s_nationkey = 6")
def iter_filter_map(spark, sf_dir):
    plan = IterableDataset(of(table(spark, sf_dir, "supplier"), "s_suppkey"), compat=True).map(lambda d: {"name": d["s_name"].upper()}).filter({"s_nationkey": 6})
    return plan.df().select(field("name", "string").alias("name"))


@register("iter_take", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 9")
def iter_take(spark, sf_dir):
    return _iterable(spark, sf_dir).take(9).df().select(field("s_suppkey", "bigint").alias("s_suppkey"))


@register("iter_skip", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 30")
def iter_skip(spark, sf_dir):
    return _iterable(spark, sf_dir).skip(30).df().select(field("s_suppkey", "bigint").alias("s_suppkey"))


@register("iter_shuffle", "SELECT s_suppkey FROM supplier")
def iter_shuffle(spark, sf_dir):
    """The distributed form of a shuffle buffer: a seeded order within each partition."""
    docs = of(table(spark, sf_dir, "supplier"), "s_suppkey")
    return docs.sortWithinPartitions(F.xxhash64("_id", F.lit(5))).select(field("s_suppkey", "bigint").alias("s_suppkey"))


# SQL entry points


def _orders(spark: SparkSession, sf_dir: str) -> qsql.Session:
    root = Root(spark, shared_folder(spark), "r")
    return qsql.Session(root).register_df("data", table(spark, sf_dir, "orders")).register_df("customers", table(spark, sf_dir, "customer"))


@register("sql_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def sql_params(spark, sf_dir):
    return _orders(spark, sf_dir).query("SELECT o_orderkey, o_totalprice FROM data WHERE o_totalprice > ? AND o_orderstatus = ?", [100000, "F"])


@register("sql_count", "SELECT count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%'")
def sql_count(spark, sf_dir):
    return _orders(spark, sf_dir).query("SELECT count(*) AS n FROM data WHERE o_orderpriority LIKE '1%'")


@register("sql_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def sql_qualify(spark, sf_dir):
    return _orders(spark, sf_dir).query("SELECT o_custkey, o_orderkey FROM data QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")


@register("sql_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def sql_distinct_on(spark, sf_dir):
    return _orders(spark, sf_dir).query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM data WHERE o_orderstatus <> 'P' ORDER BY o_custkey, o_totalprice DESC, o_orderkey")


@register("sql_cte_scope", "WITH data AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT count(*) AS n, round(min(o_totalprice), 2) AS least FROM data")
def sql_cte_scope(spark, sf_dir):
    return _orders(spark, sf_dir).query("WITH data AS (SELECT * FROM data WHERE o_totalprice > 100000) SELECT count(*) AS n, round(min(o_totalprice), 2) AS least FROM data")


_NESTED = """WITH newest AS (SELECT o_custkey, o_orderkey, o_totalprice FROM {data} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1)
  SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM newest JOIN (SELECT DISTINCT ON (c_nationkey, c_mktsegment) c_custkey, c_mktsegment FROM {customers} ORDER BY c_nationkey, c_mktsegment, c_custkey) c
  ON o_custkey = c_custkey GROUP BY c_mktsegment"""


@register("sql_qualify_nested", _NESTED.format(data="orders", customers="customer"))
def sql_qualify_nested(spark, sf_dir):
    return _orders(spark, sf_dir).query(_NESTED.format(data="data", customers="customers"))


_SIDES = """SELECT o_custkey AS k, o_orderkey AS v FROM {data} QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 1
  UNION ALL SELECT c_nationkey AS k, c_custkey AS v FROM {customers} QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1"""


@register("sql_qualify_union", _SIDES.format(data="orders", customers="customer"))
def sql_qualify_union(spark, sf_dir):
    return _orders(spark, sf_dir).query(_SIDES.format(data="data", customers="customers"))


# Stores: what is written, changed and read back


@register("store_write_read", "SELECT CAST(s_suppkey AS VARCHAR) AS _id, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def store_write_read(spark, sf_dir):
    root = stored(spark, supplier=(table(spark, sf_dir, "supplier"), "s_suppkey"))
    return root.collection("supplier").typed().select("_id", "s_name", "s_nationkey")


@register("store_put_many", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, CASE WHEN n_regionkey = 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 3")
def store_put_many(spark, sf_dir):
    nation = stored(spark, nation=(table(spark, sf_dir, "nation"), "n_nationkey")).collection("nation")
    rows = table(spark, sf_dir, "nation").collect()  # 25 rows by definition of the table
    nation.put_many((str(r["n_nationkey"]), {"n_name": r["n_name"].upper() + "!", "n_regionkey": 2}) for r in rows if r["n_regionkey"] == 2)
    for r in rows:
        if r["n_regionkey"] == 3:
            nation.delete(str(r["n_nationkey"]))
    nation.flush()
    return nation.documents().select("_id", field("n_name", "string").alias("n_name"))


@register("store_delete_where", "SELECT CAST(c_custkey AS VARCHAR) AS _id FROM customer WHERE c_mktsegment <> 'BUILDING'")
def store_delete_where(spark, sf_dir):
    customers = stored(spark, customer=(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")).collection("customer")
    customers.delete_where(Eq("c_mktsegment", "BUILDING"))
    return customers.ids()


@register("store_compact", "SELECT CAST(s_suppkey AS VARCHAR) AS _id, s_acctbal + CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS s_acctbal, 1::BIGINT AS batches FROM supplier")
def store_compact(spark, sf_dir):
    narrow = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    supplier = stored(spark, supplier=(narrow, "s_suppkey")).collection("supplier")
    supplier.write(narrow.where("s_acctbal < 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), "s_suppkey")
    supplier.compact()
    return supplier.documents().select("_id", field("s_acctbal", "double").alias("s_acctbal"), F.lit(supplier.stats()["batches"]).cast("long").alias("batches"))


@register("store_validate", "SELECT count(*) AS documents, true AS ok FROM part")
def store_validate(spark, sf_dir):
    found = stored(spark, part=(table(spark, sf_dir, "part"), "p_partkey")).collection("part").validate()
    return spark.createDataFrame([(found["documents"], found["ok"])], "documents bigint, ok boolean")


@register("store_schemas", "SELECT count(*) AS count, 1::BIGINT AS schemas FROM customer")
def store_schemas(spark, sf_dir):
    customers = stored(spark, customer=(table(spark, sf_dir, "customer"), "c_custkey")).collection("customer")
    return customers.schemas().agg(F.sum("count").alias("count"), F.count("*").alias("schemas"))


@register("store_saved_schemas", "SELECT count(*) AS count, true AS known FROM supplier")
def store_saved_schemas(spark, sf_dir):
    supplier = stored(spark, supplier=(table(spark, sf_dir, "supplier"), "s_suppkey")).collection("supplier")
    saved = supplier.save_schemas()
    known = supplier.schema(saved.first()["schema_id"]) is not None
    return saved.agg(F.sum("count").alias("count")).withColumn("known", F.lit(known))


@register("store_blobs", """SELECT CAST(sum(strlen('{"_id":"' || r_regionkey || '","r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') + 1) AS BIGINT) AS bytes FROM region""")
def store_blobs(spark, sf_dir):
    blobs = stored(spark, region=(table(spark, sf_dir, "region"), "r_regionkey")).collection("region").blobs()
    return blobs.agg(F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@register("query_sink", "SELECT CAST(c_nationkey AS VARCHAR) AS _id, count(*) AS n FROM customer GROUP BY c_nationkey")
def query_sink(spark, sf_dir):
    root = stored(spark)
    session = qsql.Session(root).register_df("data", table(spark, sf_dir, "customer"))
    session.export("SELECT c_nationkey AS nation, count(*) AS n FROM data GROUP BY c_nationkey", "counts", "nation")
    return root.collection("counts").documents().select("_id", field("n", "bigint").alias("n"))


@register("data_source_read", "SELECT r_name, CAST(r_regionkey AS BIGINT) AS r_regionkey, CAST(r_regionkey AS VARCHAR) AS _id FROM region WHERE r_regionkey IN (1, 3)")
def data_source_read(spark, sf_dir):
    from quillstone.sources import datasource

    root = stored(spark, region=(table(spark, sf_dir, "region"), "r_regionkey"))
    datasource.register(spark)
    return spark.read.format("quillstone").options(root=root.path, collection="region").load().where("_id IN ('1', '3')").select("r_name", "r_regionkey", "_id")


@register("dataset_predicate_udf", "SELECT c_custkey, c_name FROM customer WHERE length(c_name) + c_nationkey > 30")
def dataset_predicate_udf(spark, sf_dir):
    return _dataset(spark, sf_dir).filter(lambda d: len(d["c_name"]) + d["c_nationkey"] > 30).df.select(_key(), _name())


@register("aggregate_helper", "SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY p_brand")
def aggregate_helper(spark, sf_dir):
    root = stored(spark, part=(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_partkey"))
    return qsql.aggregate(root, "part", "p_brand", "round(sum(p_retailprice), 2) AS total")


@register("count_where", "SELECT count(*) AS n FROM supplier WHERE s_acctbal > 5000")
def count_where(spark, sf_dir):
    root = stored(spark, supplier=(table(spark, sf_dir, "supplier"), "s_suppkey"))
    return spark.createDataFrame([(qsql.count_where(root, "supplier", "s_acctbal > 5000"),)], "n bigint")


@register("cross_collection", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def cross_collection(spark, sf_dir):
    return _orders(spark, sf_dir).query("SELECT c.c_mktsegment, count(*) AS n FROM data o JOIN customers c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")


# Schemas and statistics

_LABEL_SHAPE = """'{' || array_to_string(list_filter([CASE WHEN doc_id IS NOT NULL THEN '"doc_id":"integer"' END, CASE WHEN quality IS NOT NULL THEN '"quality":"integer"' END,
  CASE WHEN toxic IS NOT NULL THEN '"toxic":"integer"' END], lambda x: x IS NOT NULL), ',') || '}'"""


@register("schema_extract", f"SELECT CAST(doc_id AS VARCHAR) AS _id, {_LABEL_SHAPE} AS shape FROM {_SPARSE}")
def schema_extract(spark, sf_dir):
    return _labels(spark, sf_dir).select("_id", structural.structure_text("_raw").alias("shape"))


@register("schema_id", f"SELECT CAST(doc_id AS VARCHAR) AS _id, sha256({_LABEL_SHAPE}) AS schema_id FROM {_SPARSE}")
def schema_id(spark, sf_dir):
    return _labels(spark, sf_dir).select("_id", structural.schema_id(F.col("_raw")).alias("schema_id"))


@register("schema_counts", f"SELECT sha256({_LABEL_SHAPE}) AS schema_id, {_LABEL_SHAPE} AS schema, count(*) AS count FROM {_SPARSE} GROUP BY ALL")
def schema_counts(spark, sf_dir):
    return structural.schema_counts(_labels(spark, sf_dir))


@register("strict_violations", f"""SELECT CAST(doc_id AS VARCHAR) AS _id FROM {_SPARSE} WHERE {_LABEL_SHAPE} <> '{{"doc_id":"integer","quality":"integer","toxic":"integer"}}'""")
def strict_violations(spark, sf_dir):
    wanted = structural.schema_id_of({"doc_id": 1, "quality": 1, "toxic": 1})
    return _labels(spark, sf_dir).where(structural.schema_id(F.col("_raw")) != wanted).select("_id")


@register("collection_stats", "SELECT count(*) AS documents, CAST(sum(strlen('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}')) AS BIGINT) AS bytes, 1::BIGINT AS schemas FROM region")
def collection_stats(spark, sf_dir):
    docs = of(table(spark, sf_dir, "region"), "r_regionkey")
    return docs.agg(F.count("*").alias("documents"), F.sum(F.octet_length("_raw")).alias("bytes"), F.count_distinct(structural.structure_text("_raw")).alias("schemas"))


@register("id_validation", r"SELECT page_id, regexp_matches(url, '^[\p{L}\p{N}_-][\p{L}\p{N}_.-]*$') AND NOT contains(url, '..') AS valid, regexp_matches(page_id || '.v2', '^[\p{L}\p{N}_-][\p{L}\p{N}_.-]*$') AS named FROM pages")
def id_validation(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", layout.valid_id(F.col("url")).alias("valid"), layout.valid_id(F.concat("page_id", F.lit(".v2"))).alias("named"))


# Sinks, imports and streams

_NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


def _nations(root: Root, name: str = "nation") -> DataFrame:
    return root.collection(name).typed().select("_id", "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"))


@register("put_lines", _NATION)
def put_lines(spark, sf_dir):
    root = stored(spark)
    lines = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("_id"), "n_name", "n_regionkey")))
    root.collection("nation").put_lines("\n".join(r[0] for r in lines.collect()))  # 25 rows by definition of the table
    return _nations(root)


@register("collection_mapping", f"SELECT _id, CASE WHEN _id = '3' THEN 'three' ELSE n_name END AS n_name, n_regionkey FROM ({_NATION}) WHERE _id <> '7'")
def collection_mapping(spark, sf_dir):
    root = stored(spark, nation=(table(spark, sf_dir, "nation"), "n_nationkey"))
    nation = root.collection("nation")
    nation["3"] = {**nation["3"], "n_name": "three"}
    del nation["7"]
    nation.flush()
    return _nations(root)


@register("arrow_sink", _NATION)
def arrow_sink(spark, sf_dir):
    from quillstone import interop

    root = stored(spark)
    interop.write_arrow(root, table(spark, sf_dir, "nation").toArrow(), "nation", "n_nationkey")
    return _nations(root)


@register("pandas_sink", _NATION)
def pandas_sink(spark, sf_dir):
    from quillstone import interop

    root = stored(spark)
    interop.write_pandas(root, table(spark, sf_dir, "nation").toPandas(), "nation", "n_nationkey")
    return spark.createDataFrame(interop.read_pandas(root, "nation", ["_id", "n_name", "n_regionkey"]))


@register("table_copy", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name FROM customer WHERE c_nationkey < 5")
def table_copy(spark, sf_dir):
    root, view = stored(spark), f"customer_{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").createOrReplaceTempView(view)
    try:
        qsql.copy_to(root, f"SELECT * FROM {view} WHERE c_nationkey < 5", "customer", "c_custkey")
    finally:
        spark.catalog.dropTempView(view)
    return root.collection("customer").documents().select("_id", _name())


@register("csv_export_import", "SELECT CAST(s_suppkey AS VARCHAR) AS _id, s_name, s_acctbal FROM supplier")
def csv_export_import(spark, sf_dir):
    from quillstone import interop

    root, path = stored(spark, supplier=(table(spark, sf_dir, "supplier"), "s_suppkey")), shared_folder(spark)
    interop.export_table(root.collection("supplier"), path, "csv")
    rows = spark.read.csv(path, header=True, schema=root.collection("supplier").typed(json_strings=True).schema)
    interop.import_table(root, rows, "again", "_id")
    return root.collection("again").typed().select("_id", "s_name", "s_acctbal")


@register("json_export_import", _NATION)
def json_export_import(spark, sf_dir):
    from quillstone import interop

    root, path = stored(spark, nation=(table(spark, sf_dir, "nation"), "n_nationkey")), f"{shared_folder(spark)}.json"
    interop.export_json(root.collection("nation"), path)
    interop.import_json(root, path, "again")
    return _nations(root, "again")


@register("stream_sink", _NATION)
def stream_sink(spark, sf_dir):
    from quillstone.streaming.collections import write_stream

    nation, root = table(spark, sf_dir, "nation"), stored(spark)
    stream = spark.readStream.schema(nation.schema).parquet(f"{sf_dir.rstrip('/')}/nation.parque[t]")
    running = write_stream(stream, root.collection("nation"), "n_nationkey", shared_folder(spark))
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return _nations(root)


@register("stream_changes", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, 'put' AS _kind, n_name FROM nation UNION ALL SELECT '7', 'delete', NULL")
def stream_changes(spark, sf_dir):
    from quillstone.streaming.collections import read_changes

    nation = stored(spark, nation=(table(spark, sf_dir, "nation"), "n_nationkey")).collection("nation")
    nation.delete("7")
    nation.flush()
    changes = read_changes(nation).select("_id", "_kind", field("n_name", "string").alias("n_name"))
    path = shared_folder(spark)
    changes.writeStream.format("parquet").option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(changes.schema).parquet(path)
