"""The generic relational surface: joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .bridge import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def revenue_by_nation(spark, d):
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.where("r_name = 'ASIA'").groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_orders_per_customer(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(order)).where("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "orders").select("o_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").select("o_custkey")).distinct().join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_orders(spark, d):
    return table(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def union_counts(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"))
    return a.unionByName(table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n")))
