"""The standard tables in the roles of points, cells, pixels and vectors, and the same as SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import voxel
from gridloom.session import table

#: Cell sizes of the line items' quantity, price and discount.
SIZES = (5.0, 5000.0, 0.02)


def line_points(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("batch_id"), F.col("l_linestatus").alias("line_status"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("qty"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return voxel.keys(line_points(spark, d), SIZES)


def points(spark: SparkSession, d: str) -> DataFrame:
    """Orders as points with whole-number coordinates and a unique id."""
    o = table(spark, d, "orders")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return o.select(F.col("o_orderstatus").alias("batch_id"), F.col("o_orderkey").alias("pid"), F.col("o_custkey").cast("double").alias("x"), days.cast("double").alias("y"), F.round(F.col("o_totalprice") / 100).alias("z"), F.substring("o_orderpriority", 1, 1).cast("int").alias("mask_id"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as query points among the orders."""
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("pid"), (F.col("s_suppkey") * 15 % 1500).cast("double").alias("x"), (F.col("s_nationkey") * 100).cast("double").alias("y"), F.round(F.abs("s_acctbal") / 2).alias("z"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_linenumber").cast("long").alias("image_id"), F.col("l_suppkey").alias("mask_id"), F.col("l_quantity").cast("int").alias("row"), F.floor(F.col("l_extendedprice") / 5000.0).cast("int").alias("col")).distinct()


def dense(spark: SparkSession, d: str) -> DataFrame:
    """An image for each line number: pixel (quantity, price bucket) with a whole-number value."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_linenumber").alias("image_id"), F.col("l_quantity").cast("int").alias("row"), F.floor(F.col("l_extendedprice") / 5000.0).cast("int").alias("col")).agg(F.count("*").alias("value"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


LINES = "lines AS (SELECT l_returnflag AS batch_id, l_linestatus AS line_status, l_tax AS tax, l_quantity AS qty, floor(l_quantity/5::DOUBLE)::BIGINT AS i, floor(l_extendedprice/5000::DOUBLE)::BIGINT AS j, floor(l_discount/0.02::DOUBLE)::BIGINT AS k FROM lineitem)"
PTS = "pts AS (SELECT o_orderstatus AS batch_id, o_orderkey AS pid, o_custkey::DOUBLE AS x, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS y, round(o_totalprice/100::DOUBLE) AS z, substr(o_orderpriority,1,1)::INT AS mask_id FROM orders)"
PROBES = "probes AS (SELECT s_suppkey AS pid, (s_suppkey*15 % 1500)::DOUBLE AS x, (s_nationkey*100)::DOUBLE AS y, round(abs(s_acctbal)/2::DOUBLE) AS z FROM supplier)"
PIX = "pix AS (SELECT DISTINCT l_linenumber::BIGINT AS image_id, l_suppkey AS mask_id, l_quantity::INT AS row, floor(l_extendedprice/5000::DOUBLE)::INT AS col FROM lineitem)"
DENSE = "dense AS (SELECT l_linenumber AS image_id, l_quantity::INT AS row, floor(l_extendedprice/5000::DOUBLE)::INT AS col, count(*) AS value FROM lineitem GROUP BY ALL)"
DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
