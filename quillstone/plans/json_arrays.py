"""JSON, arrays, maps, structs and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.vectors import cosine
from quillstone.plans.registry import pair, query
from quillstone.plans.tables import table

pair(
    "json_extract",
    "SELECT event_id, get_json_object(props, '$.k') AS k, CAST(variant_get(parse_json(props), '$.k', 'int') AS BIGINT) AS k_int FROM {events}",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_int FROM events",
    "events",
)
pair(
    "json_keys",
    "SELECT event_id, array_join(json_object_keys(props), ',') AS names FROM {events}",
    "SELECT event_id, array_to_string(json_keys(props), ',') AS names FROM events",
    "events",
)
pair(
    "json_filter_agg",
    "SELECT event_type, count(*) AS n, sum(k) AS total FROM (SELECT event_type, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}) WHERE k >= 50 GROUP BY event_type",
    "SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 50 GROUP BY event_type",
    "events",
)
pair(
    "json_roundtrip",
    "SELECT event_id, CAST(get_json_object(to_json(from_json(props, 'k BIGINT')), '$.k') AS BIGINT) AS k FROM {events}",
    "SELECT event_id, CAST(json_extract_string(to_json(json(props)), '$.k') AS BIGINT) AS k FROM events",
    "events",
)
pair(
    "json_path_get",
    "SELECT event_id, variant_get(parse_json(concat('{{\"a\":{{\"b\":', props, '}}}}')), '$.a.b.k', 'bigint') AS k FROM {events}",
    "SELECT event_id, CAST(json_extract_string(concat('{\"a\":{\"b\":', props, '}}'), '$.a.b.k') AS BIGINT) AS k FROM events",
    "events",
)
pair(
    "arr_basic",
    "SELECT vec_id, size(embedding) AS n, CAST(embedding[0] AS DOUBLE) AS first, CAST(element_at(embedding, -1) AS DOUBLE) AS last, array_contains(slice(embedding, 1, 3), embedding[1]) AS has, CAST(array_max(embedding) AS DOUBLE) AS most FROM {embeddings}",
    "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last, list_contains(embedding[1:3], embedding[2]) AS has, CAST(list_max(embedding) AS DOUBLE) AS most FROM embeddings",
    "embeddings",
)
pair(
    "arr_explode",
    "SELECT vec_id, CAST(pos AS BIGINT) AS pos, CAST(x AS DOUBLE) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, x WHERE pos < 4",
    "SELECT vec_id, CAST(pos - 1 AS BIGINT) AS pos, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) WHERE pos <= 4",
    "embeddings",
)
pair(
    "arr_hof",
    "SELECT vec_id, size(filter(embedding, x -> x > 0)) AS positive, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * 2), 0D, (a, x) -> a + x), 4) AS doubled FROM {embeddings}",
    "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 4) AS doubled FROM embeddings",
    "embeddings",
)
pair(
    "map_basic",
    "SELECT c_custkey, element_at(m, 'segment') AS segment, array_join(sort_array(map_keys(m)), ',') AS names, CAST(cardinality(m) AS BIGINT) AS n FROM (SELECT c_custkey, map_from_arrays(array('segment', 'name'), array(c_mktsegment, c_name)) AS m FROM {customer})",
    "SELECT c_custkey, m['segment'] AS segment, array_to_string(list_sort(map_keys(m)), ',') AS names, CAST(cardinality(m) AS BIGINT) AS n FROM (SELECT c_custkey, map(['segment', 'name'], [c_mktsegment, c_name]) AS m FROM customer)",
    "customer",
)
pair(
    "struct_access",
    "SELECT s.key AS k, s.inner.label AS label FROM (SELECT named_struct('key', s_suppkey, 'inner', named_struct('label', s_name)) AS s FROM {supplier})",
    "SELECT s.key AS k, s.inner.label AS label FROM (SELECT struct_pack(key := s_suppkey, inner := struct_pack(label := s_name)) AS s FROM supplier)",
    "supplier",
)
pair(
    "conversation_turns",
    "SELECT conv_id, count(*) AS turns, array_join(transform(array_sort(collect_list(struct(turn, role))), x -> x.role), '>') AS roles FROM {conversations} GROUP BY conv_id",
    "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id",
    "conversations",
)


@query(
    "vec_cosine_topk",
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
       SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, vec_id LIMIT 10""",
)
def vec_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").select("embedding").first()
    scored = vectors.select("vec_id", cosine(F.col("embedding"), F.array(*[F.lit(x) for x in (one[0] if one else [])])).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("similarity"))
