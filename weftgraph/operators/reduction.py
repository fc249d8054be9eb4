"""The ordered reduction of acyclic graphs, its building blocks, and look-ups in its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.loops import node_weights
from weftgraph.operators.lookups import NODE, predecessors
from weftgraph.operators.ordering import CHUNK, before_each, large_graphs, numbered
from weftgraph.operators.schedule import scope_members, scope_of_ops


def op_log(nodes: DataFrame, residual: DataFrame) -> DataFrame:
    """The removals of graphs without loops: op_idx orders a graph's nodes by (weight, node_id).

    Without loops a priority queue of terminals by (weight, id) pops in sorted order, because a predecessor always
    weighs more: so the whole schedule is one sort. nodes: with weight0 of 1 or more.
    """
    weights = node_weights(nodes, residual)
    rows = nodes.join(weights, NODE).join(predecessors(nodes, residual), NODE)
    none = F.array().cast("array<string>")
    edges = F.lit(None).cast("array<struct<src:string,dst:string>>")
    deltas = F.map_from_arrays("preds", F.transform("preds", lambda p: F.col("weight")))
    return numbered(rows, ["weight", "node_id"], "op_idx").select(
        "graph_id", "op_idx", F.lit("remove_node").alias("kind"),
        F.struct(F.col("node_id").alias("target"), edges.alias("edges")).alias("forward"),
        F.struct(F.col("node_id").alias("target"), F.col("preds").alias("pred_edges"), none.alias("succ_edges"), "weight", "node_type", deltas.alias("weight_deltas"), edges.alias("edges")).alias("inverse"),
        F.struct(F.lit(None).cast("string").alias("header"), F.lit(None).cast("array<string>").alias("scc")).alias("meta"),
        F.lit(None).cast("string").alias("payload"),
    )


def motif_kinds(nodes: DataFrame, residual: DataFrame) -> DataFrame:
    """(graph_id, node_id, kind) by residual predecessors: none entry, one linear, more merge. Needs no order."""
    n = F.size("preds")
    return predecessors(nodes, residual).select("graph_id", "node_id", F.when(n == 0, "entry").when(n == 1, "linear").otherwise("merge").alias("kind"))


def motifs(log: DataFrame) -> DataFrame:
    """Top-level motifs of a log of removals in the order of reconstruction; ops of other kinds are opaque motifs."""
    n, node = F.size("inverse.pred_edges"), F.col("kind") == "remove_node"
    kind = F.when(~node, F.col("kind")).when(n == 0, "entry").when(n == 1, "linear").otherwise("merge")
    preds = F.when(node, F.array_sort("inverse.pred_edges")).otherwise(F.array().cast("array<string>"))
    return numbered(log.withColumn("back", -F.col("op_idx")), ["back"], "step").select("graph_id", "step", kind.alias("kind"), F.when(node, F.col("inverse.target")).alias("node"), preds.alias("preds"), "op_idx")


def node_steps(found: DataFrame) -> DataFrame:
    return found.where("node is not null").select("graph_id", "node", "step")


def metagraph_edges(found: DataFrame) -> DataFrame:
    """(graph_id, src_step, dst_step): from the motif that restores a predecessor to the motif that names it."""
    steps = node_steps(found).select("graph_id", F.col("node").alias("pred"), F.col("step").alias("src_step"))
    named = found.select("graph_id", F.explode("preds").alias("pred"), F.col("step").alias("dst_step"))
    return named.join(steps, ["graph_id", "pred"]).where("src_step <> dst_step").select("graph_id", "src_step", "dst_step").distinct()


def dag_violations(edges: DataFrame) -> DataFrame:
    """Metagraph edges that don't lead to a later step."""
    return edges.where("src_step >= dst_step")


def motif_profile(found: DataFrame) -> DataFrame:
    """How many motifs of each kind there are, with the total (kind: all)."""
    return found.rollup("kind").agg(F.count("*").alias("n")).select(F.coalesce("kind", F.lit("all")).alias("kind"), "n")


def motif_counts(found: DataFrame) -> DataFrame:
    """(graph_id, parent_step, kind, n): how many motifs of each kind each level of each graph has; the top level has no parent_step."""
    return found.groupBy("graph_id", "parent_step", "kind").agg(F.count("*").alias("n"))


def _binned(rows: DataFrame, large: DataFrame, column: str) -> DataFrame:
    """rows with their bin: a large graph's are dealt by column to one for each CHUNK of its rows, all others are 0."""
    n = F.col("n") + 1
    return rows.join(F.broadcast(large), "graph_id", "left").select(*rows.columns, F.coalesce(F.pmod(F.xxhash64(column), F.floor(n / CHUNK) + 1), F.lit(0).cast("bigint")).alias("bin"))


def graph_as_of(nodes: DataFrame, edges: DataFrame, log: DataFrame, cursor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph_id, k, node_id, weight) and (graph_id, k, src, dst): what is left after the first k ops, removals and loop breaks.

    cursor: graph_id, k; a graph may have any number of cursors, repeated ones count once. Nodes and edges live from the start to an op, so each is compared with
    its graph's cursors by the number of that op, and a weight adds up the changes before k. Large graphs lie in bins, and their cursors go to each, so that one large graph is many
    tasks' work; cursors of other graphs stay one row each. Nothing here is broadcast but the list of large graphs: a table's estimate by its files is far below what it fills."""
    nodes, edges, log = (t.hint("merge") for t in (nodes, edges, log))
    large = large_graphs(nodes.select("graph_id").unionByName(edges.select("graph_id")))
    at = cursor.select("graph_id", "k").distinct().join(F.broadcast(large), "graph_id", "left")
    at = at.select("graph_id", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.floor((F.col("n") + 1) / CHUNK), F.lit(0).cast("bigint")))).alias("bin")).hint("merge")
    gone = log.where("kind = 'remove_node'").select("graph_id", F.col("inverse.target").alias("node_id"), F.col("op_idx").alias("gone"), "inverse.weight_deltas")
    changes = _binned(gone.select("graph_id", F.explode("weight_deltas").alias("node_id", "d"), "gone"), large, "node_id")
    gain = changes.join(at, ["graph_id", "bin"]).where("gone < k").groupBy("graph_id", "k", "node_id").agg(F.sum("d").alias("d")).hint("merge")
    ends = gone.select(*NODE, "gone")
    live = _binned(nodes.join(ends, NODE, "left").select(*NODE, "weight0", "gone"), large, "node_id").join(at, ["graph_id", "bin"]).where("gone is null or gone >= k")
    live = live.join(gain, ["graph_id", "k", "node_id"], "left").select("graph_id", "k", "node_id", (F.col("weight0") + F.coalesce("d", F.lit(0))).alias("weight"))
    cut = log.where("kind = 'remove_edges'").select("graph_id", F.explode("forward.edges").alias("e"), "op_idx").groupBy("graph_id", "e.src", "e.dst").agg(F.min("op_idx").alias("cut"))
    left = edges.select("graph_id", "src", "dst").join(cut, ["graph_id", "src", "dst"], "left")
    for side in ("src", "dst"):
        left = left.join(ends.withColumnsRenamed({"node_id": side, "gone": f"{side}_gone"}), ["graph_id", side], "left")
    left = _binned(left.select("graph_id", "src", "dst", F.least("cut", "src_gone", "dst_gone").alias("gone")), large, "src").join(at, ["graph_id", "bin"])
    return live, left.where("gone is null or gone >= k").select("graph_id", "k", "src", "dst")


def frontier_as_of(nodes: DataFrame, edges: DataFrame, log: DataFrame, cursor: DataFrame, scoped: bool = False) -> DataFrame:
    """The terminals (graph_id, k, node_id, weight) after the first k ops, for all cursors; scoped: those in the scope at that time."""
    live, left = graph_as_of(nodes, edges, log, cursor)
    ends = live.join(left.select("graph_id", "k", F.col("src").alias("node_id")).hint("merge"), ["graph_id", "k", "node_id"], "left_anti")
    if not scoped:
        return ends
    members = scope_members(log)
    active = scope_of_ops(log, members).where("broke is not null").select("graph_id", (F.col("op_idx") + 1).alias("k"), "broke")
    zoomed = ends.join(active.join(cursor.select("graph_id", "k").distinct(), ["graph_id", "k"]), ["graph_id", "k"], "left")
    inside = zoomed.join(members.select("graph_id", "broke", "node_id", F.lit(True).alias("inside")), ["graph_id", "broke", "node_id"], "left")
    return inside.where("broke is null or inside").select(ends.columns)


def truncate_and_append(log: DataFrame, cursor: DataFrame, new_ops: DataFrame) -> DataFrame:
    """Ops from k on are replaced by new_ops, whose op_idx counts from 0."""
    kept = log.join(cursor, "graph_id").where("op_idx < k").select(log.columns)
    moved = new_ops.join(cursor, "graph_id").withColumn("op_idx", F.col("op_idx") + F.col("k")).select(log.columns)
    return kept.unionByName(moved)


def progress(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    """(graph_id, cursor, live, frontier, zoomed) after each op: live nodes, how many of them could be removed next (terminals in the scope),
    and whether a scope is active.

    A node is a terminal from when its last edge goes (with its successor or by a break) to its own removal. Starts and ends of these spans are summed
    up over the ops, once for all nodes and once for the members of scopes, from their break to the next one; the scope after an op says which counts."""
    removed = log.where("kind = 'remove_node'").select("graph_id", F.col("inverse.target").alias("node_id"), F.col("op_idx").alias("gone"))
    cut = log.where("kind = 'remove_edges'").select("graph_id", "op_idx", F.explode("forward.edges").alias("e")).select("graph_id", "e.src", "e.dst", F.col("op_idx").alias("at"))
    ways = edges.select("graph_id", "src", "dst").join(cut, ["graph_id", "src", "dst"], "left").join(removed.withColumnsRenamed({"node_id": "dst", "gone": "with_dst"}), ["graph_id", "dst"])
    free = ways.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.max(F.coalesce("at", "with_dst")).alias("free"))
    spans = removed.join(free, NODE, "left").fillna(-1, ["free"])
    members = scope_members(log)
    scope = scope_of_ops(log, members)
    # A break before a break: the scope of the first ends with the second.
    after = log.where("kind = 'remove_edges' and meta.scc is not null").select("graph_id", "op_idx").join(scope, ["graph_id", "op_idx"]).select("graph_id", F.col("last").alias("broke"), F.col("op_idx").alias("until"))
    inside = members.select(*NODE, "broke").join(spans, NODE).join(after, ["graph_id", "broke"], "left")
    inside = inside.select("graph_id", F.greatest("free", "broke").alias("a"), F.least("gone", "until").alias("b"), F.lit(0).alias("all"), F.lit(1).alias("in_scope"))
    counted = inside.unionByName(spans.select("graph_id", F.col("free").alias("a"), F.col("gone").alias("b"), F.lit(1).alias("all"), F.lit(0).alias("in_scope"))).where("a < b")
    steps = counted.select("graph_id", F.expr("inline(array(struct(greatest(a, 0L) as op_idx, all as n, in_scope as m), struct(b as op_idx, -all as n, -in_scope as m)))"))
    steps = steps.groupBy("graph_id", "op_idx").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    rows = log.select("graph_id", "op_idx", (F.col("kind") == "remove_node").cast("int").alias("one")).join(steps, ["graph_id", "op_idx"], "left").fillna(0, ["n", "m"])
    rows = before_each(rows, ["one", "n", "m"], []).join(scope.select("graph_id", "op_idx", F.col("broke").isNotNull().alias("zoomed")), ["graph_id", "op_idx"])
    rows = rows.join(nodes.groupBy("graph_id").agg(F.count("*").alias("total")), "graph_id")
    frontier = F.when(F.col("zoomed"), F.col("m") + F.col("m_before")).otherwise(F.col("n") + F.col("n_before"))
    return rows.select("graph_id", (F.col("op_idx") + 1).alias("cursor"), (F.col("total") - F.col("one") - F.col("one_before")).alias("live"), frontier.alias("frontier"), "zoomed")
