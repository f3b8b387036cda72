"""Free SQL over an open dataset, by family. Where dialects differ, the Spark spelling is ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapledger.sources.dataset import open_dataset
from snapledger.workloads import WORKLOADS, Workload


def _register(name: str, spark_sql: str, check_sql: str | None = None) -> None:
    """Register a query text, with a second spelling where the checking engine needs one."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return open_dataset(spark, sf_dir).sql(spark_sql)

    WORKLOADS[name] = Workload(name, run, check_sql or spark_sql)


_register("sql_join_inner", """
    SELECT n_name, c_mktsegment, count(*) AS n_lines,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name, c_mktsegment""")

_register("sql_join_outer", """
    SELECT coalesce(c.nationkey, s.nationkey) AS nationkey, c.n AS n_customers, s.n AS n_suppliers
    FROM (SELECT c_nationkey AS nationkey, count(*) AS n FROM customer
          WHERE c_acctbal < 0 GROUP BY c_nationkey) c
    FULL OUTER JOIN (SELECT s_nationkey AS nationkey, count(*) AS n FROM supplier
                     WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.nationkey = s.nationkey""")

_register("sql_join_left", """
    SELECT c_custkey, c_name, coalesce(o.n, 0) AS n_orders
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders
                             WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) o
    ON c_custkey = o.o_custkey""")

_register("sql_join_semi_anti", """
    SELECT 'with' AS label, o_orderpriority, count(*) AS n FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    GROUP BY o_orderpriority
    UNION ALL
    SELECT 'without', o_orderpriority, count(*) FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    GROUP BY o_orderpriority""", """
    SELECT CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
                THEN 'with' ELSE 'without' END AS label, o_orderpriority, count(*) AS n
    FROM orders GROUP BY ALL""")

# Each customer's campaign runs from a first purchase for three days. The interval is cut into the
# days it touches, so the join is on (type, day) and the exact bounds are checked within the day.
_register("sql_join_range", """
    WITH campaigns AS (
        SELECT event_type, date_trunc('MONTH', ts) AS month, min(ts) AS starts,
               min(ts) + INTERVAL '3' DAY AS ends
        FROM events WHERE value > 100 GROUP BY event_type, date_trunc('MONTH', ts)),
    campaign_days AS (
        SELECT event_type, starts, ends,
               explode(sequence(CAST(starts AS DATE), CAST(ends AS DATE))) AS day FROM campaigns)
    SELECT e.event_type, c.starts, count(*) AS n_events, count(DISTINCT e.user_id) AS n_users
    FROM events e JOIN campaign_days c
    ON e.event_type = c.event_type AND CAST(e.ts AS DATE) = c.day AND e.ts >= c.starts AND e.ts < c.ends
    GROUP BY e.event_type, c.starts""", """
    WITH campaigns AS (
        SELECT event_type, date_trunc('month', ts) AS month, min(ts) AS starts,
               min(ts) + INTERVAL 3 DAY AS ends
        FROM events WHERE value > 100 GROUP BY ALL)
    SELECT e.event_type, c.starts, count(*) AS n_events, count(DISTINCT e.user_id) AS n_users
    FROM events e JOIN campaigns c
    ON e.event_type = c.event_type AND e.ts >= c.starts AND e.ts < c.ends
    GROUP BY e.event_type, c.starts""")

# Last view of the user at or before each purchase. The events of a user are reduced to distinct
# times first. A window then runs within one second, and what lies further back comes from one row
# per second of the same hour, or one per earlier hour: no window group grows with the number of
# events a user has.
_register("sql_join_asof", """
    WITH times AS (
        SELECT user_id, ts, date_trunc('SECOND', ts) AS second, date_trunc('HOUR', ts) AS hour,
               max(CASE WHEN event_type = 'view' THEN ts END) AS view_ts
        FROM events WHERE event_type IN ('view', 'purchase') GROUP BY user_id, ts),
    in_second AS (
        SELECT *, max(view_ts) OVER (PARTITION BY user_id, second ORDER BY ts) AS view_in_second
        FROM times),
    seconds AS (
        SELECT user_id, hour, second, max(view_ts) AS last_view FROM times
        GROUP BY user_id, hour, second),
    in_hour AS (
        SELECT user_id, second, max(last_view) OVER (PARTITION BY user_id, hour ORDER BY second
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_in_hour FROM seconds),
    hours AS (
        SELECT user_id, hour, max(last_view) AS last_view FROM seconds GROUP BY user_id, hour),
    earlier AS (
        SELECT user_id, hour, max(last_view) OVER (PARTITION BY user_id ORDER BY hour
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS view_earlier FROM hours),
    points AS (
        SELECT t.user_id, t.ts, coalesce(view_in_second, view_in_hour, view_earlier) AS view_ts
        FROM in_second t JOIN in_hour s ON t.user_id = s.user_id AND t.second = s.second
        JOIN earlier h ON t.user_id = h.user_id AND t.hour = h.hour)
    SELECT e.event_id, e.user_id, e.ts, p.view_ts
    FROM events e JOIN points p ON e.user_id = p.user_id AND e.ts = p.ts
    WHERE e.event_type = 'purchase'""", """
    SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
    ON p.user_id = v.user_id AND p.ts >= v.ts""")

_register("sql_group_agg", """
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines,
           CAST(sum(l_quantity) AS BIGINT) AS sum_qty,
           count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
           min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")

_register("sql_agg_distinct", """
    SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers,
           count(DISTINCT l_orderkey) AS n_orders
    FROM lineitem GROUP BY l_returnflag""")

_register("sql_cube", """
    SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS all_status,
           CAST(grouping(o_orderpriority) AS INT) AS all_priority, count(*) AS n
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")

_register("sql_rollup", """
    SELECT p_brand, p_type, count(*) AS n, max(p_size) AS max_size
    FROM part GROUP BY ROLLUP (p_brand, p_type)""")

_register("sql_grouping_sets", """
    SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n
    FROM events GROUP BY GROUPING SETS ((event_type), (CAST(ts AS DATE)), ())""", """
    WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events)
    SELECT event_type, day, count(*) AS n FROM e GROUP BY GROUPING SETS ((event_type), (day), ())""")

# The estimate itself is the engine's own; what must hold is that it is near the exact number.
_register("sql_approx_distinct", """
    WITH estimate AS (SELECT l_returnflag, approx_count_distinct(l_orderkey, 0.01) AS n_near
                      FROM lineitem GROUP BY l_returnflag),
    exact AS (SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_returnflag)
    SELECT e.l_returnflag, n_orders, abs(n_near - n_orders) <= 0.05 * n_orders AS is_near
    FROM exact e JOIN estimate n ON e.l_returnflag = n.l_returnflag""", """
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, true AS is_near
    FROM lineitem GROUP BY l_returnflag""")

_register("sql_window_rank", """
    WITH revenue AS (
        SELECT p_brand, p_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_partkey),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS place
        FROM revenue)
    SELECT p_brand, p_partkey, CAST(revenue AS DOUBLE) AS revenue, CAST(place AS INT) AS place
    FROM ranked WHERE place <= 3""")

_register("sql_window_frame", """
    WITH daily AS (
        SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events
        GROUP BY event_type, CAST(ts AS DATE))
    SELECT event_type, day, n, lag(n) OVER w AS n_before, lead(n, 2) OVER w AS n_in_two,
           CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day
                             ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_week,
           first_value(n) OVER w AS n_first,
           CAST(rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS INT) AS place
    FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day)""")

_register("sql_window_range", """
    WITH sized AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size)
    SELECT p_brand, p_size, n,
           CAST(sum(n) OVER (PARTITION BY p_brand ORDER BY p_size
                             RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS n_similar
    FROM sized""")

_register("sql_topk", """
    SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10""")

_register("sql_set_ops", """
    SELECT 'except' AS label, k FROM
        (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') a
    UNION ALL
    SELECT 'intersect', k FROM
        (SELECT p_partkey AS k FROM part INTERSECT
         SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') b
    UNION ALL
    SELECT 'union', k FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation
                            UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier) c""")

_register("sql_set_ops_all", """
    SELECT 'except' AS label, k, count(*) AS n FROM
        (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer) a GROUP BY k
    UNION ALL
    SELECT 'intersect', k, count(*) FROM
        (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) b GROUP BY k""")

_register("sql_subquery", """
    WITH busy AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT c_custkey, c_name, n FROM customer JOIN busy ON c_custkey = o_custkey
    WHERE n > (SELECT avg(n) FROM busy)
      AND c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = customer.c_nationkey)
      AND c_nationkey IN (SELECT s_nationkey FROM supplier)""")

_register("sql_scalar", """
    SELECT p_partkey, upper(p_name) AS name_up, CAST(length(p_name) AS INT) AS name_length, substr(p_name, 1, 3) AS head,
           replace(p_name, ' ', '-') AS dashed, concat(p_brand, '/', p_type) AS label,
           p_size * 2 + 1 AS odd_size, floor(p_retailprice / 10) AS tens, abs(p_size - 25) AS distance,
           CASE WHEN p_size BETWEEN 10 AND 20 THEN 'mid' ELSE nullif(p_type, 'ECONOMY') END AS class,
           greatest(p_size, 10) AS at_least_10, lpad(CAST(p_size AS STRING), 4, '0') AS padded
    FROM part""", """
    SELECT p_partkey, upper(p_name) AS name_up, CAST(length(p_name) AS INT) AS name_length, substr(p_name, 1, 3) AS head,
           replace(p_name, ' ', '-') AS dashed, concat(p_brand, '/', p_type) AS label,
           p_size * 2 + 1 AS odd_size, CAST(floor(p_retailprice / 10) AS BIGINT) AS tens, abs(p_size - 25) AS distance,
           CASE WHEN p_size BETWEEN 10 AND 20 THEN 'mid' ELSE nullif(p_type, 'ECONOMY') END AS class,
           greatest(p_size, 10) AS at_least_10, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded
    FROM part""")

_register("sql_scalar_dates", """
    SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS d,
           quarter(o_orderdate) AS q, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month_start,
           datediff(DATE '2002-01-01', o_orderdate) AS age_days,
           CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS due, date_format(o_orderdate, 'yyyy/MM') AS label
    FROM orders""", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
           CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INT) AS age_days,
           CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS due, strftime(o_orderdate, '%Y/%m') AS label
    FROM orders""")

_register("sql_json_array", """
    SELECT CAST(get_json_object(props, '$.k') AS INT) AS k, count(*) AS n,
           count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""", """
    SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n,
           count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""")

_register("sql_array_functions", """
    SELECT vec_id, size(embedding) AS n, size(filter(embedding, x -> x > 0)) AS n_positive,
           CAST(array_max(embedding) AS DOUBLE) AS top,
           CAST(element_at(transform(embedding, x -> abs(x)), 1) AS DOUBLE) AS first_abs
    FROM embeddings""", """
    SELECT vec_id, CAST(len(embedding) AS INT) AS n,
           CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS n_positive,
           CAST(list_max(embedding) AS DOUBLE) AS top,
           CAST(list_transform(embedding, lambda x: abs(x))[1] AS DOUBLE) AS first_abs
    FROM embeddings""")

_register("sql_explode", """
    SELECT source, word, count(*) AS n
    FROM (SELECT source, explode(split(text, ' ')) AS word FROM documents) words
    WHERE length(word) > 0 GROUP BY source, word""", """
    SELECT source, word, count(*) AS n
    FROM (SELECT source, unnest(string_split(text, ' ')) AS word FROM documents) words
    WHERE length(word) > 0 GROUP BY source, word""")

_register("sql_unpivot", """
    SELECT l_returnflag, measure, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM (SELECT l_returnflag, l_quantity, l_extendedprice, l_tax FROM lineitem)
    UNPIVOT (amount FOR measure IN (l_quantity, l_extendedprice, l_tax))
    GROUP BY l_returnflag, measure""")

_register("sql_pivot", """
    SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders)
    PIVOT (count(1) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))""", """
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f,
           count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p
    FROM orders GROUP BY o_orderpriority""")

_register("sql_time_bucket", """
    SELECT window.start AS bucket, event_type, count(*) AS n,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM events GROUP BY window(ts, '1 hour'), event_type""", """
    SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM events GROUP BY ALL""")
