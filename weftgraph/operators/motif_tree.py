"""Building blocks of graphs with loops: which op belongs to which loop, nested motifs, and the metagraph of each level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ordering import numbered
from weftgraph.operators.schedule import op_log
from weftgraph.operators.shared import settled

OP = ["graph_id", "op_idx"]
LAST = (1 << 63) - 1


def loop_parents(log: DataFrame) -> DataFrame:
    """(graph_id, op_idx, parent_idx) of the ops that belong to a loop, by the order of the log.

    The loop broken last and not yet used up owns an op if all of the op's nodes (a removed node, a broken loop's members) are left in
    it; it gives them away. A loop is used up when its last node is removed. Ops that the last loop can't own stay on top: in
    nested loops that can hit nodes of an outer loop. A fold over each graph's log, which has to fit into a row;
    :func:`containing_loops` has no such bound.
    """
    item = F.struct("op_idx", (F.col("kind") == "remove_edges").alias("opens"), F.coalesce("meta.scc", F.array("forward.target")).alias("nodes"))
    ops = log.where("kind in ('remove_node', 'remove_edges')").groupBy("graph_id").agg(F.array_sort(F.collect_list(item)).alias("ops"))
    held = "array<struct<idx:bigint,nodes:array<string>>>"
    last = "try_element_at(s.held, -1)"
    # One more level of lambda names what an op needs of the state: t is the last loop, rest what the op leaves of it.
    look = f"transform(array({last}), t -> named_struct('t', t, 'fits', t is not null and size(array_except(o.nodes, t.nodes)) = 0, 'rest', array_except(t.nodes, o.nodes)))[0]"
    kept = "if(o.opens or size(x.rest) > 0, array(named_struct('idx', x.t.idx, 'nodes', x.rest)), cast(array() as {held}))".replace("{held}", held)
    lower = f"concat(slice(s.held, 1, greatest(size(s.held) - 1, 0)), {kept})"
    opened = f"if(o.opens, array(named_struct('idx', o.op_idx, 'nodes', o.nodes)), cast(array() as {held}))"
    owned = "if(x.fits, array(named_struct('op_idx', o.op_idx, 'parent_idx', x.t.idx)), cast(array() as array<struct<op_idx:bigint,parent_idx:bigint>>))"
    step = f"transform(array({look}), x -> named_struct('held', concat(if(x.fits, {lower}, s.held), {opened}), 'owned', concat(s.owned, {owned})))[0]"
    start = f"named_struct('held', cast(array() as {held}), 'owned', cast(array() as array<struct<op_idx:bigint,parent_idx:bigint>>))"
    found = ops.select("graph_id", F.expr(f"explode(aggregate(ops, {start}, (s, o) -> {step}, s -> s.owned))").alias("p"))
    return found.select("graph_id", "p.op_idx", "p.parent_idx")


def containing_loops(log: DataFrame) -> DataFrame:
    """(graph_id, op_idx, parent_idx): the smallest broken loop that holds the op's node, or the op's whole loop. By joins, for
    graphs of any size."""
    broken = log.where("kind = 'remove_edges'").select("graph_id", F.col("op_idx").alias("parent_idx"), F.size("meta.scc").alias("n"), F.explode("meta.scc").alias("node"))
    ops = log.select("graph_id", "op_idx", F.coalesce("forward.target", F.element_at("meta.scc", 1)).alias("node"), F.coalesce(F.size("meta.scc"), F.lit(0)).alias("own"))
    ops = ops.withColumn("own", F.greatest("own", F.lit(0)))
    held = ops.join(broken, ["graph_id", "node"]).where("n > own")
    return held.groupBy(OP).agg(F.min_by("parent_idx", "n").alias("parent_idx"))


def motifs(log: DataFrame, parents: DataFrame) -> DataFrame:
    """(graph_id, step, parent_step, kind, node, preds, succs, header, scc, op_idx) in the order of reconstruction.

    Steps count ops backwards, what a loop holds before the loop itself: a sort by the path of op numbers from the top, with a
    largest number behind a loop's own path. Ops of unknown kinds are opaque motifs.
    """
    # By its files and those of its columns that are read a table is estimated far below what it fills: no broadcast goes by that.
    log, parents = log.hint("merge"), parents.hint("merge")
    tree = settled(log.select(OP).join(parents, OP, "left")).hint("merge")
    level = tree.where("parent_idx is null").select(*OP, F.array(-F.col("op_idx")).alias("path"))
    every = level = settled(level)
    while True:
        over = level.select("graph_id", F.col("op_idx").alias("parent_idx"), "path")
        level = settled(tree.join(over, ["graph_id", "parent_idx"]).select(*OP, F.concat("path", F.array(-F.col("op_idx"))).alias("path")))
        if level.isEmpty():
            break
        every = every.unionByName(level)
    every = settled(every).hint("merge")
    loop, node = F.col("kind") == "remove_edges", F.col("kind") == "remove_node"
    key = F.when(loop, F.concat("path", F.array(F.lit(LAST)))).otherwise(F.col("path"))
    steps = numbered(log.select(*OP, "kind").join(every, OP).select(*OP, key.alias("path")), ["path"], "step").drop("path")
    rows = settled(log.join(steps.hint("merge"), OP).join(tree, OP)).hint("merge")

    broken = rows.where("kind = 'remove_edges'").select("graph_id", F.col("op_idx").alias("loop_idx"), F.explode("meta.scc").alias("member"))
    named = rows.where("kind = 'remove_node'").select("graph_id", F.col("forward.target").alias("target"), "parent_idx", F.explode("inverse.pred_edges").alias("pred"))
    of_child = named.where("parent_idx is not null").withColumnRenamed("parent_idx", "loop_idx")
    outer = of_child.join(broken.withColumnRenamed("member", "pred"), ["graph_id", "loop_idx", "pred"], "left_anti")
    before = outer.groupBy("graph_id", "loop_idx").agg(F.array_sort(F.collect_set("pred")).alias("outer_preds")).hint("merge")
    after = named.join(broken.withColumnRenamed("member", "pred"), ["graph_id", "pred"]).select("graph_id", "loop_idx", "target")
    after = after.join(broken.withColumnRenamed("member", "target"), ["graph_id", "loop_idx", "target"], "left_anti")
    after = after.groupBy("graph_id", "loop_idx").agg(F.array_sort(F.collect_set("target")).alias("outer_succs")).hint("merge")
    steps = rows.select("graph_id", F.col("op_idx").alias("parent_idx"), F.col("step").alias("parent_step"))
    faces = [t.withColumnRenamed("loop_idx", "op_idx") for t in (before, after)]
    out = rows.join(steps, ["graph_id", "parent_idx"], "left").join(faces[0], OP, "left").join(faces[1], OP, "left")
    none, n = F.array().cast("array<string>"), F.size("inverse.pred_edges")
    kind = F.when(loop, "loop").when(~node, F.col("kind")).when(n == 0, "entry").when(n == 1, "linear").otherwise("merge")
    return out.select(
        "graph_id", "step", "parent_step", kind.alias("kind"), F.when(node, F.col("forward.target")).alias("node"),
        F.when(node, F.array_sort("inverse.pred_edges")).otherwise(F.coalesce("outer_preds", none)).alias("preds"),
        F.coalesce("outer_succs", none).alias("succs"), F.col("meta.header").alias("header"), F.col("meta.scc").alias("scc"), "op_idx",
    )


def metagraph_edges(found: DataFrame) -> DataFrame:
    """(graph_id, parent_step, src_step, dst_step): within each level, from the motif that restores a predecessor to the motif that
    names it, and from a loop to the motif that restores its successor. A loop stands for all its members; of two owners of a
    node the later counts."""
    found = found.hint("merge").withColumn("level", F.coalesce("parent_step", F.lit(-1)))
    stands = F.when(F.col("kind") == "loop", F.col("scc")).when(F.col("node").isNotNull(), F.array("node"))
    owner = found.select("graph_id", "level", "step", F.explode(stands).alias("node")).groupBy("graph_id", "level", "node").agg(F.max("step").alias("owner"))
    into = found.select("graph_id", "level", F.explode("preds").alias("node"), "step").join(owner, ["graph_id", "level", "node"])
    out = found.select("graph_id", "level", F.explode("succs").alias("node"), "step").join(owner, ["graph_id", "level", "node"])
    ways = into.select("graph_id", "level", F.col("owner").alias("src_step"), F.col("step").alias("dst_step"))
    ways = ways.unionByName(out.select("graph_id", "level", F.col("step").alias("src_step"), F.col("owner").alias("dst_step")))
    return ways.where("src_step <> dst_step").distinct().select("graph_id", F.expr("nullif(level, -1)").alias("parent_step"), "src_step", "dst_step")


def subgraphs(found: DataFrame, ways: DataFrame) -> DataFrame:
    """(graph_id, loop_step, parent_step, n_motifs, n_edges) of the loops that hold motifs."""
    found, ways = found.hint("merge"), ways.hint("merge")
    inner = found.where("parent_step is not null").groupBy("graph_id", F.col("parent_step").alias("loop_step")).agg(F.count("*").alias("n_motifs"))
    lines = ways.where("parent_step is not null").groupBy("graph_id", F.col("parent_step").alias("loop_step")).agg(F.count("*").alias("n_edges"))
    own = found.where("kind = 'loop'").select("graph_id", F.col("step").alias("loop_step"), "parent_step")
    return own.join(inner, ["graph_id", "loop_step"]).join(lines, ["graph_id", "loop_step"], "left").fillna(0, ["n_edges"])


def node_steps(found: DataFrame) -> DataFrame:
    """(graph_id, parent_step, node, step) of the motifs that restore a node, by level."""
    return found.where("node is not null").select("graph_id", "parent_step", "node", "step")


def metagraph_violations(found: DataFrame, ways: DataFrame) -> DataFrame:
    """(graph_id, parent_step, src_step, dst_step, reason) of what a metagraph must not have: an edge that doesn't lead to a later step (order), one
    that names a step which is no motif of its level (unknown_step), a level whose parent is no loop (not_a_loop; without steps)."""
    found, ways = found.hint("merge"), ways.hint("merge")
    level = found.select("graph_id", F.coalesce("parent_step", F.lit(-1)).alias("level"), "step", F.lit(True).alias("there"))
    lines = ways.select("graph_id", F.coalesce("parent_step", F.lit(-1)).alias("level"), "src_step", "dst_step")
    for side in ("src_step", "dst_step"):
        lines = lines.join(level.withColumnsRenamed({"step": side, "there": f"has_{side}"}), ["graph_id", "level", side], "left")
    reason = F.expr("case when has_src_step is null or has_dst_step is null then 'unknown_step' when src_step >= dst_step then 'order' end")
    wrong = lines.select("graph_id", F.expr("nullif(level, -1)").alias("parent_step"), "src_step", "dst_step", reason.alias("reason")).where("reason is not null")
    loops = found.where("kind = 'loop'").select("graph_id", F.col("step").alias("parent_step"))
    held = found.where("parent_step is not null").select("graph_id", "parent_step").distinct().join(loops, ["graph_id", "parent_step"], "left_anti")
    none = F.lit(None).cast("bigint")
    return wrong.unionByName(held.select("graph_id", "parent_step", none.alias("src_step"), none.alias("dst_step"), F.lit("not_a_loop").alias("reason")))


def metagraph_of(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(motifs, edges, subgraphs) of graphs: reduced, taken apart into motifs and linked. nodes: with weight0."""
    log = settled(op_log(nodes, edges))
    found = settled(motifs(log, loop_parents(log)))
    ways = settled(metagraph_edges(found))
    return found, ways, subgraphs(found, ways)
