"""The relational pack over the star schema and the events."""

from __future__ import annotations

from millrace.plans.base import both

REV = "l_extendedprice * (1 - l_discount)"
both("rel_pricing_summary", "lineitem", f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({REV}), 2) AS sum_disc, round(sum({REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
both("rel_shipping_priority", "customer orders lineitem", f"SELECT l_orderkey, round(sum({REV}), 2) AS revenue, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10")
both("rel_order_priority", "orders lineitem", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority")
both("rel_local_supplier", "customer orders lineitem supplier nation region", f"SELECT n_name, round(sum({REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
both("rel_forecast_revenue", "lineitem", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
both("rel_volume_by_year", "orders lineitem customer nation", f"SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS y, round(sum({REV}), 2) AS volume FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, year(o_orderdate)")
both("rel_returned_items", "customer orders lineitem", f"SELECT c_custkey, round(sum({REV}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_custkey ORDER BY revenue DESC, c_custkey LIMIT 20")
both("rel_customers_without_orders", "customer orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
both("rel_order_distribution", "customer orders", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count")
both("rel_promo_share", "lineitem part", f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REV} ELSE 0 END) / sum({REV}), 4) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey")
both("rel_small_quantity", "lineitem part", "SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity < (SELECT 0.2 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey) GROUP BY p_brand")
both("rel_large_orders", "orders lineitem", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)")
both("rel_discounted_or", "lineitem part", f"SELECT round(sum({REV}), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_size BETWEEN 1 AND 5 AND l_quantity < 11) OR (p_size BETWEEN 6 AND 15 AND l_quantity BETWEEN 10 AND 20)")
both("rel_rollup", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("rel_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("rel_grouping_sets", "customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
both("rel_rank_window", "orders", "SELECT o_orderkey, CAST(r AS INT) AS r, CAST(dr AS INT) AS dr FROM (SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS dr FROM orders) t WHERE r <= 100")
both("rel_running_sum", "orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders")
both("rel_lag_lead", "orders", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders")
both("rel_ntile", "customer", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INT) AS quartile, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 6) AS cd FROM customer")
both("rel_first_last", "orders", "SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order FROM orders")
both("rel_union_distinct", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("rel_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("rel_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
both("rel_pivot", "lineitem", "SELECT l_returnflag, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS o, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS f FROM lineitem GROUP BY l_returnflag")
both("rel_quantiles", "orders", "SELECT o_orderpriority, round(percentile(o_totalprice, 0.5), 4) AS p50, round(percentile(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority",
     "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority")
both("rel_stddev", "lineitem", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS var_, round(corr(l_quantity, l_extendedprice), 6) AS corr_ FROM lineitem GROUP BY l_returnflag")
both("rel_json_props", "events", "SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type",
     "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
both("rel_date_parts", "events", "SELECT CAST(dayofweek(ts) - 1 AS BIGINT) AS dow, CAST(hour(ts) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY dayofweek(ts), hour(ts)",
     "SELECT CAST(dayofweek(ts) AS BIGINT) AS dow, CAST(hour(ts) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY ALL")
both("rel_string_funcs", "nation", "SELECT n_nationkey, upper(n_name) AS u, length(n_name) AS n, substr(n_name, 1, 3) AS head, reverse(n_name) AS r, lpad(n_name, 12, '*') AS padded, concat(n_name, '/', n_regionkey) AS c FROM nation",
     "SELECT n_nationkey, upper(n_name) AS u, CAST(length(n_name) AS INTEGER) AS n, substr(n_name, 1, 3) AS head, reverse(n_name) AS r, left(lpad(n_name, 12, '*'), 12) AS padded, concat(n_name, '/', n_regionkey) AS c FROM nation")
both("rel_asof", "events orders", "SELECT event_id, max(o_orderkey) AS latest FROM events JOIN orders ON o_custkey = user_id AND o_orderdate <= ts GROUP BY event_id")
both("rel_funnel", "events", "SELECT count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewed, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clicked, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS bought FROM events")
both("rel_recursive", "nation", "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT n, total FROM t")
both("rel_cte_reuse", "orders", "WITH m AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT count(*) AS above FROM m WHERE t > (SELECT avg(t) FROM m)")
both("rel_mode_argmax", "orders", "SELECT o_orderpriority, max_by(o_orderkey, o_totalprice) AS best, min_by(o_orderkey, o_totalprice) AS least FROM orders GROUP BY o_orderpriority")
both("rel_full_outer", "customer supplier", "SELECT coalesce(c.k, s.k) AS k, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON c.k = s.k")
