"""The map model over the driver's tables: parts stand for nodes, orders for ways, their lines for references, customers
for relations. Every operator then runs on data that a SQL engine can read too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapframe.functions.geo import deg_to_nano
from mapframe.schema import Box, Viewport

BOX = Box(10, 905, 20, 930)
WORLD = Viewport(Box(1, 900, 50, 1000))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.lit("parts").alias("path"), F.col("p_partkey").alias("file_ordinal"), F.col("p_partkey").alias("node_id"), deg_to_nano(F.col("p_size").cast("double")).alias("lat_nano"), deg_to_nano(F.col("p_retailprice")).alias("lon_nano"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without their references: the tag ``natural`` is the priority, ``landuse`` the status."""
    orders = table(spark, sf_dir, "orders")
    tags = F.create_map(F.lit("natural"), F.col("o_orderpriority"), F.lit("landuse"), F.col("o_orderstatus"))
    return orders.select(F.lit("parts").alias("path"), F.col("o_orderkey").alias("way_id"), F.col("o_orderkey").alias("file_ordinal"), tags.alias("tags"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with their places, from 0. Line numbers repeat, so the place is counted."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    lines = table(spark, sf_dir, "lineitem").select(F.lit("parts").alias("path"), F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("node_id"), place.alias("pos"))
    return lines


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders as members, and one member that is no way."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.lit(0).alias("pos"), F.lit("WAY").alias("type"), F.col("o_orderkey").alias("ref"))).alias("m"))
    node = F.array(F.struct(F.lit(0).alias("pos"), F.lit("NODE").alias("type"), F.col("c_custkey").alias("ref")))
    customers = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    tags = F.create_map(F.lit("natural"), F.col("c_mktsegment"), F.lit("owner"), F.col("c_name"))
    return customers.select(F.lit("parts").alias("path"), F.col("c_custkey").alias("file_ordinal"), F.col("c_custkey").alias("rel_id"), tags.alias("tags"), F.concat(node, "m").alias("members"))


def paths(spark: SparkSession, sf_dir: str, view: Viewport = WORLD) -> DataFrame:
    """``path, way_id, points`` in pixels of ``view``."""
    from mapframe.functions.geo import scale, translate
    from mapframe.operators.ways import assemble_paths

    built = assemble_paths(refs(spark, sf_dir), nodes(spark, sf_dir))
    return built.withColumn("points", scale(translate(F.col("points"), view), view))
