"""Groups by direction and layers in the vector and line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import senses as S
from ..registry import query, table
from .text import r6


@query(214)
def vectors_by_direction(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.spherical_kmeans(v, 8, least=5).select(F.col("id").alias("vec_id"), "cluster", *r6("similarity"))


@query(237)
def layers_of_suppliers(spark, d):
    line = table(spark, d, "lineitem")
    returned = (F.col("l_returnflag") == "R").cast("double")
    units = line.groupBy(F.col("l_suppkey").alias("id")).agg(F.array(F.avg("l_quantity"), F.avg("l_discount"), F.avg("l_tax"), F.avg(returned)).alias("vector"))
    return S.layers(units, 3).select("units", "k", *r6("r2", "null_mean", "null_max", "p"))


@query(240, sql="SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS place FROM lineitem")
def lines_in_order_of_price(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return S.indexed(line, ["l_extendedprice", "l_orderkey", "l_linenumber"], "place").select("l_orderkey", "l_linenumber", "place")
