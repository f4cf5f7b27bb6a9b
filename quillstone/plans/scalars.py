"""Scalar functions."""

from __future__ import annotations

from quillstone.plans.registry import both, pair

both(
    "str_basic",
    """SELECT c_custkey, c_name || '/' || c_mktsegment AS joined, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS n, substr(c_name, 3, 5) AS part,
       replace(c_name, '0', '_') AS rep, reverse(c_mktsegment) AS rev, trim('  x ') AS t, starts_with_flag FROM (SELECT *, c_name LIKE 'C%1' AS starts_with_flag FROM {customer})""",
    "customer",
)
pair(
    "str_split",
    "SELECT p_partkey, split_part(p_type, ' ', 1) AS first_word, CAST(size(split(p_type, ' ')) AS BIGINT) AS words, concat_ws('-', p_brand, p_type) AS cw, levenshtein(p_brand, p_type) AS lev FROM {part}",
    "SELECT p_partkey, split_part(p_type, ' ', 1) AS first_word, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS words, concat_ws('-', p_brand, p_type) AS cw, CAST(levenshtein(p_brand, p_type) AS INT) AS lev FROM part",
    "part",
)
pair(
    "str_pad",
    "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 12, '*') AS r, repeat('ab', 3) AS rep, CAST(instr(n_name, 'A') AS BIGINT) AS at, initcap('hello world') AS cap FROM {nation}",
    "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 12, '*') AS r, repeat('ab', 3) AS rep, CAST(instr(n_name, 'A') AS BIGINT) AS at, 'Hello World' AS cap FROM nation",
    "nation",
)
pair(
    "str_regex",
    r"SELECT page_id, url RLIKE '^https' AS secure, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#') AS masked FROM {pages}",
    r"SELECT page_id, regexp_matches(url, '^https') AS secure, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked FROM pages",
    "pages",
)
pair(
    "math_basic",
    """SELECT p_partkey, round(p_retailprice, 1) AS r, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, abs(p_size - 25) AS a, round(power(p_size, 2), 4) AS sq,
       round(sqrt(p_size), 8) AS s, round(ln(p_retailprice), 8) AS l, p_size % 7 AS m, CAST(p_size div 4 AS BIGINT) AS d, greatest(p_size, 10) AS g FROM {part}""",
    """SELECT p_partkey, round(p_retailprice, 1) AS r, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, abs(p_size - 25) AS a, round(power(p_size, 2), 4) AS sq,
       round(sqrt(p_size), 8) AS s, round(ln(p_retailprice), 8) AS l, p_size % 7 AS m, CAST(p_size // 4 AS BIGINT) AS d, greatest(p_size, 10) AS g FROM part""",
    "part",
)
pair(
    "date_parts",
    "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(dayofweek(o_orderdate) - 1 AS BIGINT) AS dow, CAST(quarter(o_orderdate) AS BIGINT) AS q, date_format(o_orderdate, 'yyyy-MM-dd') AS iso FROM {orders}",
    "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) AS dow, quarter(o_orderdate) AS q, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
    "orders",
)
pair(
    "date_trunc_month",
    "SELECT date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM-dd') AS month, count(*) AS n FROM {orders} GROUP BY 1",
    "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS n FROM orders GROUP BY 1",
    "orders",
)
pair(
    "date_diff",
    "SELECT l_orderkey, l_linenumber, CAST(datediff(l_shipdate, o_orderdate) AS BIGINT) AS days, date_format(o_orderdate + INTERVAL '10' DAY, 'yyyy-MM-dd') AS due FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS due FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "lineitem",
    "orders",
)
both("cond_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS tier, if(c_nationkey > 12, 1, 0) AS half FROM {customer}", "customer")
both("cond_coalesce", "SELECT doc_id, coalesce(toxic, -1) AS toxic_or, nullif(quality, 0) AS quality_or_null, least(quality, toxic) AS lo FROM {labels}", "labels")
both("cast_try", "SELECT event_id, try_cast(event_type AS INT) AS bad, try_cast(CAST(user_id AS STRING) AS BIGINT) AS good, CAST(value AS INT) IS NOT NULL AS whole FROM {events}", "events")
pair(
    "hash_md5_sha",
    "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM {documents}",
    "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents",
    "documents",
)
