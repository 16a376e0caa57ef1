"""Relational building blocks as queries: one SQL text per inventory row that Spark and DuckDB both run.

Names begin with the inventory row they cover. Where the dialects differ, ORACLE_ONLY holds DuckDB's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL: dict[str, str] = {
    # Projections and filters
    "b02_clipped_score": "SELECT c_custkey, round(greatest(-1.0, least(1.0, (coalesce(c_acctbal, 0) * 0.0002 + c_nationkey * -0.01) / 2)), 6) AS score FROM customer",
    "b03_predicates": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%' AND l_discount IS NOT NULL AND l_shipdate >= TIMESTAMP '1994-01-01 00:00:00'",
    "b04_time_grid": "SELECT event_id, event_type FROM events WHERE extract(MINUTE FROM ts) = 0 OR extract(HOUR FROM ts) IN (0, 4, 8, 12, 16, 20) AND extract(MINUTE FROM ts) < 5",
    "b06_outcome_mask": "SELECT o_orderkey, CASE WHEN o_totalprice <= -900 THEN NULL WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END AS target FROM orders",
    "b07_drop_missing": "SELECT event_id, value FROM events WHERE value IS NOT NULL AND props IS NOT NULL",
    "b08_try_number": "SELECT event_id, coalesce(try_cast(substr(event_type, 1, 1) AS DOUBLE), 0.0) AS x, coalesce(try_cast(cast(value AS VARCHAR(40)) AS DOUBLE), 0.0) AS y FROM events",
    "b09_forward_fill": "SELECT event_id, last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events",
    "b11_month_embargo": "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY extract(YEAR FROM o_orderdate), extract(MONTH FROM o_orderdate)) AS last_day FROM orders) x WHERE o_orderdate <= last_day - INTERVAL '1' DAY",
    "b12_fold_split": "SELECT o_orderkey, CASE WHEN extract(YEAR FROM o_orderdate) >= 1997 THEN 'oos' WHEN extract(MONTH FROM o_orderdate) % 2 = 0 THEN 'even' ELSE 'odd' END AS fold FROM orders",
    "b13_temporal_split": "SELECT event_id, rn <= floor(n * 0.8) AS is_train FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) x",
    "b14_unprocessed_keys": "SELECT c.c_custkey FROM customer c LEFT ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') o ON c.c_custkey = o.o_custkey",
    # Joins
    "j01_inner_chain": "SELECT l.l_orderkey, l.l_linenumber, c.c_mktsegment, n.n_name, r.r_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE l.l_quantity > 45",
    "j02_left_chain": "SELECT c.c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(o.total, 0.0) AS total FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey",
    "j03_key_intersection": "SELECT a.uid, a.h FROM (SELECT DISTINCT user_id AS uid, CAST(extract(HOUR FROM ts) AS BIGINT) AS h FROM events WHERE event_type = (SELECT min(event_type) FROM events)) a JOIN (SELECT DISTINCT user_id AS uid, CAST(extract(HOUR FROM ts) AS BIGINT) AS h FROM events WHERE event_type = (SELECT max(event_type) FROM events)) b ON a.uid = b.uid AND a.h = b.h",
    "j04_full_outer_zero": "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.s, 0.0) AS first_sum, coalesce(b.s, 0.0) AS last_sum FROM (SELECT user_id, round(sum(value), 4) AS s FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id) a FULL OUTER JOIN (SELECT user_id, round(sum(value), 4) AS s FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY user_id) b ON a.user_id = b.user_id",
    "j05_shifted_key": "SELECT a.event_type, a.h, a.n, b.n AS next_n FROM (SELECT event_type, date_trunc('HOUR', ts) AS t, CAST(extract(DAY FROM ts) * 24 + extract(HOUR FROM ts) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1, 2, 3) a JOIN (SELECT event_type, CAST(extract(DAY FROM ts) * 24 + extract(HOUR FROM ts) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1, 2) b ON a.event_type = b.event_type AND b.h = a.h + 1",
    "j11_dimension_join": "SELECT l.l_orderkey, l.l_linenumber, coalesce(d.w, 1e0) AS weight FROM lineitem l LEFT JOIN (SELECT p_partkey, CASE lower(substr(p_brand, 1, 7)) WHEN 'brand#1' THEN 5e-1 ELSE 2e0 END AS w FROM part WHERE p_size > 20) d ON l.l_partkey = d.p_partkey WHERE l.l_linenumber = 1",
    "j13_unmatched_count": "SELECT c.c_mktsegment, count(*) AS n, CAST(sum(CASE WHEN o.o_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000) o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment",
    "j14_best_of_two": "SELECT a.o_custkey, greatest(a.x, b.y) AS best FROM (SELECT o_custkey, max(o_totalprice) AS x FROM orders GROUP BY o_custkey) a JOIN (SELECT o_custkey, avg(o_totalprice) * 1.5 AS y FROM orders GROUP BY o_custkey) b ON a.o_custkey = b.o_custkey ORDER BY best DESC, a.o_custkey LIMIT 1",
    "j15_complete_latest": "SELECT n.n_nationkey, x.c_custkey FROM nation n LEFT JOIN (SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) y WHERE rn = 1) x ON n.n_nationkey = x.c_nationkey",
    "j16_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)",
    "j17_exists": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity >= 49)",
    "j18_backfill": "SELECT o.o_orderkey, coalesce(CASE WHEN o.o_totalprice > 100000 THEN o.o_totalprice END, round(x.p, 2)) AS filled FROM orders o LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey) x ON o.o_orderkey = x.l_orderkey",
    "j19_uniqueness": "SELECT event_id, round(1e0 / count(*) OVER (PARTITION BY event_type, user_id, extract(DAY FROM ts)), 6) AS w FROM events",
    # Aggregations
    "g01_group_by": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price, min(l_tax) AS min_tax, max(l_tax) AS max_tax FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "g02_conditional_sums": "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY o_orderpriority",
    "g03_having_distinct": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 3",
    "g04_guarded_ratio": "SELECT c_nationkey, round(sum(CASE WHEN c_acctbal > 0 THEN 1e0 ELSE 0e0 END) / nullif(count(*), 0), 6) AS share FROM customer GROUP BY c_nationkey",
    "g05_percent_of_total": "SELECT event_type, count(*) AS n, round(1e2 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY event_type",
    "g06_conditional_pivot": "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o FROM orders GROUP BY o_custkey HAVING max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) IS NOT NULL AND max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) IS NOT NULL ORDER BY abs(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) - max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END)) DESC, o_custkey LIMIT 30",
    "g07_distinct_list": "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY c_nationkey",
    "g08_spread": "SELECT event_type, round(stddev(value), 6) AS sd, round(stddev_pop(value), 6) AS sd_pop, round(median(value), 6) AS med FROM events GROUP BY event_type",
    "g09_first_per_key": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1",
    "g11_zero_rows": "SELECT f.flag, coalesce(x.n, 0) AS n FROM (SELECT 'A' AS flag UNION ALL SELECT 'N' UNION ALL SELECT 'R' UNION ALL SELECT 'X') f LEFT JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag) x ON f.flag = x.l_returnflag",
    "g17_weighted_moments": "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS wmean, round(sqrt(sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity) - power(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2)), 2) AS wsd FROM lineitem GROUP BY l_returnflag",
    "g18_weighted_histogram": "SELECT CAST(least(greatest(floor(l_discount / 0.02), 0), 5) AS INTEGER) AS bin, round(sum(l_quantity), 2) AS w FROM lineitem GROUP BY 1",
    "g19_effective_size": "SELECT l_returnflag, round(power(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 4) AS n_eff, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "g20_stuck_states": "SELECT event_type, n, share, share > 0.9 AS stuck FROM (SELECT event_type, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type) x",
    "g21_confusion": "SELECT o_orderstatus AS predicted, CASE WHEN o_totalprice > 120000 THEN 'F' ELSE 'O' END AS actual, count(*) AS n FROM orders GROUP BY 1, 2",
    "g23_binned": "SELECT CASE WHEN l_quantity < 10 THEN 'a' WHEN l_quantity < 25 THEN 'b' ELSE 'c' END AS bin, count(*) AS n, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY 1",
    "g26_scope_union": "SELECT scope, k, count(*) AS n FROM (SELECT 'supplier' AS scope, s_nationkey AS k FROM supplier UNION ALL SELECT 'customer', c_nationkey FROM customer) x GROUP BY scope, k",
    "g27_coverage": "SELECT o_orderpriority, count(*) AS eligible, count(CASE WHEN o_totalprice > 50000 THEN 1 END) AS filled, count(*) - count(CASE WHEN o_totalprice > 50000 THEN 1 END) AS missing FROM orders GROUP BY o_orderpriority",
    "g29_duplicates": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1",
    # Windows
    "w01_running_total": "SELECT d, round(sum(v) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS equity FROM (SELECT CAST(extract(DAY FROM ts) AS BIGINT) AS d, sum(value) AS v FROM events GROUP BY 1) x",
    "w02_abs_diff": "SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 6) AS d FROM events",
    "w03_positive_diff": "SELECT event_id, round(greatest(value - lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id), 0.0), 6) AS d FROM events",
    "w04_normalized": "SELECT event_id, round(value / nullif(sum(value) OVER (PARTITION BY user_id), 0), 9) AS w FROM events",
    "w05_group_number": "SELECT user_id, event_type, g FROM (SELECT DISTINCT user_id, event_type, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS BIGINT) AS g FROM events) x",
    "w06_first_in_group": "SELECT event_id, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS delta FROM events",
    "w08_rolling_mean": "SELECT event_id, CASE WHEN count(*) OVER w = 20 THEN round(avg(value) OVER w, 6) END AS sma FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "w09_outlier_ratio": "SELECT event_type, round(avg(CASE WHEN abs(z) > 3 THEN 1e0 ELSE 0e0 END), 6) AS ratio FROM (SELECT event_type, (value - avg(value) OVER (PARTITION BY event_type)) / nullif(stddev_pop(value) OVER (PARTITION BY event_type), 0) AS z FROM events) x GROUP BY event_type",
    "w10_drawdown": "SELECT d, round(max(e) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - e, 4) AS drawdown FROM (SELECT d, sum(v) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM (SELECT CAST(extract(DAY FROM ts) AS BIGINT) AS d, sum(value - 15) AS v FROM events GROUP BY 1) y) x",
    # Sort, limit, sets
    "o01_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "o02_top_k_computed": "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal - 5000) DESC, c_custkey LIMIT 30",
    "s01_union_all": "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region",
    "s02_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "s03_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier",
    "s04_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "s05_symmetric_keys": "SELECT coalesce(a.k, b.k) AS k, coalesce(a.p, 1e-10) AS p, coalesce(b.p, 1e-10) AS q FROM (SELECT c_nationkey AS k, round(count(*) / 100.0, 6) AS p FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, round(count(*) / 10.0, 6) AS p FROM supplier GROUP BY 1) b ON a.k = b.k",
    # Scalar functions
    "f01_strings": "SELECT p_partkey, p_name LIKE '%e%' AS has_e, lower(p_brand) AS brand, regexp_replace(p_type, '(_d|_240|_60| [A-Z]+)$', '') AS stem, concat_ws('|', p_brand, p_type) AS k, lpad(CAST(p_size AS VARCHAR(8)), 3, '0') AS lvl FROM part",
    "f04_key_parts": "SELECT p_partkey, split_part(concat_ws('|', p_brand, CAST(p_size AS VARCHAR(8))), '|', 2) AS size_part FROM part",
    "f06_case_chain": "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0.0), -1.0) AS d, greatest(l_tax, l_discount) AS hi, least(l_tax, l_discount) AS lo FROM lineitem",
    "f12_date_parts": "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(o_orderdate AS DATE) AS d FROM orders",
    "f20_math": "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, round(log2(abs(c_acctbal) + 1), 6) AS l2, round(exp(c_acctbal / 10000.0), 6) AS e, CAST(sign(c_acctbal) AS DOUBLE) AS sg FROM customer",
    "f28_base5": "SELECT code, code % 5 AS c0, CAST(floor(code / 5) AS BIGINT) % 5 AS c1, CAST(floor(code / 25) AS BIGINT) % 5 AS c2 FROM (SELECT DISTINCT l_partkey % 125 AS code FROM lineitem) x",
    "a25_daily_partitions": "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1",
    "a27_run_retention": "SELECT o_orderkey FROM (SELECT o_orderkey, dense_rank() OVER (ORDER BY d DESC) AS r FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) y) x WHERE r <= 5",
}

#: Spark's text where a function has another name there.
SPARK_ONLY = {
    "b09_forward_fill": "SELECT event_id, last_value(CASE WHEN value > 20 THEN value END) IGNORE NULLS OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events",
    "g07_distinct_list": "SELECT c_nationkey, array_join(array_sort(collect_set(c_mktsegment)), ',') AS segments FROM customer GROUP BY c_nationkey",
}
ORACLE_ONLY = {
    "b14_unprocessed_keys": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "w05_group_number": "SELECT DISTINCT user_id, event_type, g FROM (SELECT user_id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS g FROM events) x",
}


def _query(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql})

    return run


def _bind(sql: str) -> str:
    """Table names after FROM and JOIN become parameters, so that no view is left in the session."""
    import re

    return re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b", r"\1 {\2}", sql)


QUERIES = {name: _query(_bind(SPARK_ONLY.get(name, sql))) for name, sql in SQL.items()}
ORACLES = {name: ORACLE_ONLY.get(name, sql) for name, sql in SQL.items()}
