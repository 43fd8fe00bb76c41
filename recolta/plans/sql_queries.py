"""General SQL over the registered tables: the same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recolta.sources.tables import register_views

SQL = {
    "sql_join_aggregate": "SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority",
    "sql_revenue": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "sql_cube": "SELECT coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_rollup": "SELECT coalesce(r_name, '-') AS region, coalesce(n_name, '-') AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "sql_window_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders",
    "sql_set_operations": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders UNION SELECT s_suppkey + 1000000 FROM supplier INTERSECT SELECT l_suppkey + 1000000 FROM lineitem WHERE l_quantity > 49",
    "sql_correlated": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "sql_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, round(stddev_samp(value), 6) AS spread FROM events GROUP BY event_type HAVING count(*) > 10",
    "sql_cte_top": "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, round(total, 2) AS total FROM spend ORDER BY total DESC, o_custkey LIMIT 25",
    "sql_semi_part": "SELECT p_brand, count(*) AS parts, round(avg(p_retailprice), 4) AS price FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45) GROUP BY p_brand",
}


def _run(text: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        register_views(spark, d)
        return spark.sql(text)

    return query


QUERIES = {name: _run(text) for name, text in SQL.items()}
