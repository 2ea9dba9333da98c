"""Networks, memberships and sequences derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..network import Network


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, q, layer): a row a line item, from the supplier's nation to the customer's."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("layer"))
    orders, customers = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers, nations = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    keys = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    few = keys.groupBy("s_nationkey", "c_nationkey", "layer").agg(F.sum("q").alias("q"))  # names join after the sum
    a, b = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src")), nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"))
    return few.join(a, "s_nationkey").join(b, "c_nationkey").select("src", "dst", "q", "layer")


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"))


def trade(spark: SparkSession, sf_dir: str) -> Network:
    """Directed and dense: nations, weights are quantities."""
    edges = _trade_rows(spark, sf_dir).groupBy("src", "dst").agg(F.sum("q").cast("double").alias("weight"))
    return Network(nation_nodes(spark, sf_dir), edges, True)


def trade_top(spark: SparkSession, sf_dir: str, keep: int = 3) -> Network:
    """Directed and sparse: each nation's heaviest edges to others."""
    net = trade(spark, sf_dir)
    best = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    edges = net.edges.filter("src <> dst").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep).drop("r")
    return Network(net.nodes, edges, True)


def trade_flat(spark: SparkSession, sf_dir: str) -> Network:
    """trade_top without directions; weights of mutual edges add."""
    from ..network import undirected

    return undirected(trade_top(spark, sf_dir))


def trade_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, src, dst, weight) by return flag: the cells above their layer's mean."""
    cells = _trade_rows(spark, sf_dir).groupBy("layer", "src", "dst").agg(F.sum("q").cast("double").alias("weight"))
    return cells.withColumn("m", F.avg("weight").over(Window.partitionBy("layer"))).filter("weight > m").drop("m")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, cluster): nations by region."""
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("cluster"))


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case, t, state): users' events in order, t from 1."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("case"), F.row_number().over(order).alias("t"), F.col("event_type").alias("state"))


def event_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actor, window, code): event types of a user's hours."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("actor"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("window"), F.col("event_type").alias("code")).distinct()


def _order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parts): the different parts of each order, ascending."""
    items = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null")
    return items.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts")).select("parts")


def co_purchases(spark: SparkSession, sf_dir: str) -> Network:
    """Undirected and large: parts that share an order."""
    at = _order_parts(spark, sf_dir).select("parts", F.posexplode("parts").alias("i", "src"))
    pairs = at.select("src", F.explode(F.slice("parts", F.col("i") + 2, F.size("parts"))).alias("dst"))
    edges = pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    return Network(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), edges, False)


def co_purchase_rings(spark: SparkSession, sf_dir: str) -> Network:
    """co_purchases with the parts of an order on a ring instead of all pairs; weights are 1.

    Whatever node is removed, the rest of a ring hangs together as the rest of all pairs
    does, and with three parts or more neither has a bridge: components, cut vertices and
    bridges are the same, from as many edges as there are line items.
    """
    ring = F.zip_with("parts", F.concat(F.slice("parts", 2, F.size("parts")), F.slice("parts", 1, 1)), lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")))
    edges = _order_parts(spark, sf_dir).filter(F.size("parts") > 1).select(F.explode(ring).alias("e")).select("e.src", "e.dst").distinct()
    return Network(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), edges.withColumn("weight", F.lit(1.0)), False)
