"""General relational queries over the star schema.  They are not the subject of the engine; they show that its tables join as any others do."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.registry import query
from siltstone.sources.tables import table

MONEY = "decimal(18,2)"


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, folder):
    own = table(spark, folder, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    total = lambda c: F.sum(F.col(c).cast(MONEY)).cast("double")
    return own.groupBy("l_returnflag", "l_linestatus").agg(total("l_quantity").alias("sum_qty"), total("l_extendedprice").alias("sum_price"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def regional_revenue(spark, folder):
    t = lambda name: table(spark, folder, name)
    own = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = own.join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.groupBy("n_name").agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("revenue"), F.count(F.lit(1)).alias("orders"))


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def customers_without_orders(spark, folder):
    return table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top3_orders(spark, folder):
    from siltstone.operators.frontier import capped

    own = table(spark, folder, "orders").withColumn("_o", F.struct(-F.col("o_totalprice"), "o_orderkey"))
    return capped(own, "o_custkey", "_o", 3).select("o_custkey", "o_orderkey")


@query("SELECT coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark, folder):
    own = table(spark, folder, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.coalesce("l_returnflag", F.lit("-")).alias("flag"), F.coalesce("l_linestatus", F.lit("-")).alias("status"), "n")
