"""Graph tables: nodes(graph_id, node_id, node_type), edges(graph_id, src, dst), node_types(name, default_weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges count once; self-loops stay."""
    return edges.select("graph_id", "src", "dst").distinct()


def nodes_from_edges(edges: DataFrame) -> DataFrame:
    """The end points of all edges, of the type `basic`."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return ends.withColumn("node_type", F.lit("basic"))


def with_default_weights(nodes: DataFrame, node_types: DataFrame) -> DataFrame:
    """nodes plus weight0, the default weight of the type; null where the type is unknown."""
    typed = nodes.withColumn("node_type", F.coalesce("node_type", F.lit("basic")))
    types = node_types.select(F.col("name").alias("node_type"), F.col("default_weight").alias("weight0"))
    return typed.join(types, "node_type", "left").select("graph_id", "node_id", "node_type", "weight0")


def define_types(node_types: DataFrame, new: DataFrame) -> DataFrame:
    """Register types, or replace them by name."""
    return node_types.join(new, "name", "left_anti").unionByName(new)


def validate_graphs(nodes: DataFrame, edges: DataFrame, node_types: DataFrame) -> DataFrame:
    """(graph_id, status) for every graph: the first that fits of repeated_node (two rows of one key), dangling_edge, unknown_type, non_positive_weight,
    self_loop (any edge from a node to itself; loop nesting may still cut it, see schedule.reduction_status), ok."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    dangling = ends.join(nodes, ["graph_id", "node_id"], "left_anti").select("graph_id", F.lit(1).alias("bad"))
    repeated = nodes.groupBy("graph_id", "node_id").count().where("count > 1").select("graph_id", F.lit(0).alias("bad"))
    typed = with_default_weights(nodes, node_types)
    unknown = typed.where("weight0 is null").select("graph_id", F.lit(2).alias("bad"))
    light = typed.where("weight0 < 1").select("graph_id", F.lit(3).alias("bad"))
    loops = edges.where("src = dst").select("graph_id", F.lit(4).alias("bad"))
    graphs = nodes.select("graph_id", F.lit(5).alias("bad")).unionByName(edges.select("graph_id", F.lit(5).alias("bad")))
    worst = graphs.unionByName(repeated).unionByName(dangling).unionByName(unknown).unionByName(light).unionByName(loops).groupBy("graph_id").agg(F.min("bad").alias("bad"))
    names = F.array(*map(F.lit, ("repeated_node", "dangling_edge", "unknown_type", "non_positive_weight", "self_loop", "ok")))
    return worst.select("graph_id", F.element_at(names, F.col("bad") + 1).alias("status"))
