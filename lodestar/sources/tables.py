"""The driver's tables and the event view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.files import dealt


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: id, title, sport, year, season, event_name, competitors, nations, venue, event_date, gold.

    Lines shrink to one row for each nation of an order, then to the order's, in
    the tasks to which their keys deal them: these are as many as the lines ask for.
    """
    orders, customer, nation = (read_table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    own = dealt(lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey"), lines.count(), "l_orderkey")
    counted = own.groupBy("l_orderkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n")).groupBy("l_orderkey").agg(F.sum("n").alias("n"), F.count("s_nationkey").alias("nat"))
    orders = dealt(orders, orders.count(), "o_custkey")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(counted, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
            F.lower("c_mktsegment").alias("sport"),
            F.year("o_orderdate").cast("long").alias("year"),
            F.when(F.month("o_orderdate").between(4, 9), "Summer").otherwise("Winter").alias("season"),
            F.col("o_orderpriority").alias("event_name"),
            F.col("n").alias("competitors"),
            F.col("nat").alias("nations"),
            F.col("n_name").alias("venue"),
            F.to_date("o_orderdate").alias("event_date"),
            F.col("c_name").alias("gold"),
        )
    )


EVENT_SQL = """li AS (
  SELECT l_orderkey, count(*) AS n, count(DISTINCT s_nationkey) AS nat FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey
), ev AS (
  SELECT o_orderkey AS id, 'Order ' || o_orderkey::VARCHAR AS title, lower(c_mktsegment) AS sport, year(o_orderdate) AS year,
         CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 'Summer' ELSE 'Winter' END AS season, o_orderpriority AS event_name,
         n AS competitors, nat AS nations, n_name AS venue, o_orderdate::DATE AS event_date, c_name AS gold
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN li ON l_orderkey = o_orderkey
)"""
