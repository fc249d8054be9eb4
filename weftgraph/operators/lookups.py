"""Look-ups and set operations on graph tables. Keys are (graph_id, node), so one large graph spreads as many do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = ["graph_id", "node_id"]


def _side(edges: DataFrame, near: str, far: str) -> DataFrame:
    return edges.select("graph_id", F.col(near).alias("node_id"), F.col(far).alias("other"))


def out_degree(nodes: DataFrame, edges: DataFrame, near: str = "src", name: str = "out_degree") -> DataFrame:
    counts = edges.groupBy("graph_id", F.col(near).alias("node_id")).agg(F.count("*").alias(name))
    return nodes.select(NODE).join(counts, NODE, "left").fillna(0, [name])


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return out_degree(nodes, edges, "dst", "in_degree")


def successors(nodes: DataFrame, edges: DataFrame, near: str = "src", far: str = "dst", name: str = "succs") -> DataFrame:
    """The sorted neighbours of each node; a node without has an empty array."""
    lists = _side(edges, near, far).groupBy(NODE).agg(F.array_sort(F.collect_set("other")).alias(name))
    return nodes.select(NODE).join(lists, NODE, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def predecessors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return successors(nodes, edges, "dst", "src", "preds")


def node_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select(NODE)


def has_node(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """keys plus `present`."""
    there = nodes.select(NODE).distinct().withColumn("present", F.lit(True))
    return keys.join(there, NODE, "left").fillna(False, ["present"])


def is_empty(graphs: DataFrame, live: DataFrame) -> DataFrame:
    """Graphs without a live node."""
    return graphs.select("graph_id").distinct().join(live, "graph_id", "left_anti")


def in_scope(nodes: DataFrame, scope: DataFrame) -> DataFrame:
    """Nodes of graphs whose scope (graph_id, active, focus) is inactive or missing, and nodes in the focus of the others."""
    seen = nodes.join(scope.select("graph_id", "active", "focus"), "graph_id", "left")
    return seen.where("not coalesce(active, false) or array_contains(focus, node_id)").select(nodes.columns)


def induced_subgraph(nodes: DataFrame, edges: DataFrame, focus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that focus (graph_id, node_id) holds, and the edges between them."""
    kept = nodes.join(focus.select(NODE), NODE, "left_semi")
    ends = kept.select(NODE)
    inner = edges.join(ends.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi")
    return kept, inner.join(ends.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst")


def terminals(nodes: DataFrame, edges: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Nodes without a successor, with scope (see :func:`in_scope`) those in it. Successors outside the scope count as well."""
    found = nodes.join(edges.select("graph_id", F.col("src").alias("node_id")), NODE, "left_anti")
    return found if scope is None else in_scope(found, scope)


def next_terminal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The terminal with the smallest (weight0, node_id) of each graph."""
    least = terminals(nodes, edges).groupBy("graph_id").agg(F.min(F.struct("weight0", "node_id")).alias("t"))
    return least.select("graph_id", F.col("t.node_id").alias("node_id"), F.col("t.weight0").alias("weight0"))


def remove_edges(edges: DataFrame, cut: DataFrame) -> DataFrame:
    return edges.join(cut.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti")


def restore_edges(edges: DataFrame, cut: DataFrame) -> DataFrame:
    return edges.unionByName(cut.select("graph_id", "src", "dst")).distinct()


def remove_nodes(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop terminals (targets) with their edges; each predecessor that stays gains the weight0 of each."""
    gone = targets.select(NODE)
    weight = nodes.join(gone, NODE, "left_semi").select("graph_id", F.col("node_id").alias("dst"), "weight0")
    gain = edges.join(weight, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sum("weight0").alias("gain"))
    kept = nodes.join(gone, NODE, "left_anti").join(gain, NODE, "left")
    kept = kept.withColumn("weight0", F.col("weight0") + F.coalesce("gain", F.lit(0))).select(nodes.columns)
    left = edges.join(gone.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_anti")
    return kept, left.join(gone.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_anti").select("graph_id", "src", "dst")


def restore_nodes(nodes: DataFrame, edges: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverse of remove_nodes by op rows of the kind remove_node."""
    ops = ops.where("kind = 'remove_node'").select("graph_id", "inverse.*")
    back = ops.select("graph_id", F.col("target").alias("node_id"), "node_type", F.col("weight").alias("weight0"))
    loss = ops.select("graph_id", F.explode("weight_deltas").alias("node_id", "delta")).groupBy(NODE).agg(F.sum("delta").alias("delta"))
    every = nodes.unionByName(back).join(loss, NODE, "left").withColumn("weight0", F.col("weight0") - F.coalesce("delta", F.lit(0)))
    new = ops.select("graph_id", F.explode("pred_edges").alias("src"), F.col("target").alias("dst"))
    new = new.unionByName(ops.select("graph_id", F.col("target").alias("src"), F.explode("succ_edges").alias("dst")))
    return every.select(nodes.columns), restore_edges(edges, new)
