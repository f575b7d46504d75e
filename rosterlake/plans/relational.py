"""Plain relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.session import table


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def line_summary(spark: SparkSession, d: str) -> DataFrame:
    """Quantities and prices by flag and status."""
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(_revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by the customers' nation."""
    t = lambda name: table(spark, d, name)
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"), F.count_distinct("o_custkey").alias("customers"))


def large_orders(spark: SparkSession, d: str) -> DataFrame:
    """The ten orders of greatest value not yet shipped in mid-1995."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    sums = lines.groupBy("l_orderkey").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))
    return sums.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderdate", "o_orderpriority", "revenue").orderBy(F.col("revenue").desc(), "o_orderkey").limit(10)


def event_activity(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and hour."""
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {f.__name__: f for f in (line_summary, nation_revenue, large_orders, event_activity)}

_REV = "l_extendedprice * (1 - l_discount)"
SQL = {
    "line_summary": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_REV}), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "nation_revenue": f"SELECT r_name, n_name, round(sum({_REV}), 2) AS revenue, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "large_orders": f"WITH s AS (SELECT l_orderkey, round(sum({_REV}), 2) AS revenue FROM lineitem GROUP BY 1) SELECT o_orderkey, o_orderdate, o_orderpriority, revenue FROM s JOIN orders ON l_orderkey = o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "event_activity": "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
