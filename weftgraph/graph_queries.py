"""The registered graph queries over two corpora that are derived from `events`, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.describe import describe_redo, describe_step, describe_undo, node_label
from weftgraph.operators import lookups, loops, motif_tree, reduction, schedule
from weftgraph.operators.shared import settled, shared_dir
from weftgraph.sources import ingest, op_log_io

#: One graph for each user and week, event types as nodes, an edge from an event to the next one.
CYCLIC = """with t as (select concat(cast(user_id as string), '-', lpad(cast(weekofyear(ts) as string), 2, '0')) as graph_id, event_type as src,
 lead(event_type) over (partition by user_id, weekofyear(ts) order by ts, event_id) as dst from {events})
select distinct graph_id, src, dst from t where dst is not null"""
#: One graph for each user and day, events as nodes, edges to the next event and the one after it.
ACYCLIC = """with t as (select concat(cast(user_id as string), '-', cast(cast(ts as date) as string)) as graph_id, lpad(cast(event_id as string), 8, '0') as src,
 lead(event_id, 1) over (partition by user_id, cast(ts as date) order by ts, event_id) as n1,
 lead(event_id, 2) over (partition by user_id, cast(ts as date) order by ts, event_id) as n2 from {events})
select graph_id, src, lpad(cast(n1 as string), 8, '0') as dst from t where n1 is not null
union all select graph_id, src, lpad(cast(n2 as string), 8, '0') from t where n2 is not null"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CYCLIC + " and src <> dst", events=_events(spark, sf_dir))


def acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ACYCLIC, events=_events(spark, sf_dir))


def _types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("basic", 1)], "name string, default_weight bigint")


def _weighted(spark: SparkSession, edges: DataFrame) -> DataFrame:
    return ingest.with_default_weights(ingest.nodes_from_edges(edges), _types(spark))


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = settled(acyclic(spark, sf_dir))
    nodes = settled(_weighted(spark, edges))
    return nodes, edges, settled(reduction.op_log(nodes, edges))


def _half(log: DataFrame) -> DataFrame:
    """A cursor in the middle of each graph's log."""
    return log.groupBy("graph_id").agg(F.expr("cast(count(*) div 2 as bigint)").alias("k"))


def _flat(log: DataFrame) -> DataFrame:
    return log.select("graph_id", "op_idx", "kind", F.col("inverse.target").alias("target"), F.array_join("inverse.pred_edges", ",").alias("preds"), F.col("inverse.weight").alias("weight"))


def graph_edges(spark, sf):  # noqa: ANN001, ANN201
    return ingest.dedup_edges(cyclic(spark, sf))


def graph_nodes(spark, sf):  # noqa: ANN001, ANN201
    return ingest.nodes_from_edges(cyclic(spark, sf))


def type_weights(spark, sf):  # noqa: ANN001, ANN201
    types = ingest.define_types(_types(spark), spark.createDataFrame([("purchase", 3)], "name string, default_weight bigint"))
    typed = ingest.nodes_from_edges(cyclic(spark, sf)).withColumn("node_type", F.when(F.col("node_id") == "purchase", "purchase").otherwise("basic"))
    return ingest.with_default_weights(typed, types)


def graph_status(spark, sf):  # noqa: ANN001, ANN201
    edges = spark.sql(CYCLIC, events=_events(spark, sf))
    return ingest.validate_graphs(ingest.nodes_from_edges(edges), edges, _types(spark))


def degrees(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    nodes = ingest.nodes_from_edges(edges)
    return lookups.out_degree(nodes, edges).join(lookups.in_degree(nodes, edges), lookups.NODE)


def neighbours(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    nodes = ingest.nodes_from_edges(edges)
    both = lookups.successors(nodes, edges).join(lookups.predecessors(nodes, edges), lookups.NODE)
    return both.select("graph_id", "node_id", F.array_join("succs", ",").alias("succs"), F.array_join("preds", ",").alias("preds"))


def terminals(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(acyclic(spark, sf))
    return lookups.terminals(lookups.node_ids(ingest.nodes_from_edges(edges)), edges)


def next_terminal(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(acyclic(spark, sf))
    return lookups.next_terminal(_weighted(spark, edges), edges)


def induced_subgraph(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    nodes = ingest.nodes_from_edges(edges)
    return lookups.induced_subgraph(nodes, edges, nodes.where("node_id < 'p'"))[1]


def removed_terminals(spark, sf):  # noqa: ANN001, ANN201
    """Weights after all terminals are removed at once."""
    edges = settled(acyclic(spark, sf))
    nodes = settled(_weighted(spark, edges))
    return lookups.remove_nodes(nodes, edges, lookups.terminals(nodes, edges))[0].select("graph_id", "node_id", F.col("weight0").alias("weight"))


def scc(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    return loops.strongly_connected_components(ingest.nodes_from_edges(edges), edges)


def terminal_sccs(spark, sf):  # noqa: ANN001, ANN201
    return loops.terminal_sccs(scc(spark, sf), cyclic(spark, sf))


def loop_headers(spark, sf):  # noqa: ANN001, ANN201
    found = loops.headers(scc(spark, sf), cyclic(spark, sf))
    return found.select("graph_id", "scc_id", "header", F.array_join("members", ",").alias("members"))


def back_edges(spark, sf):  # noqa: ANN001, ANN201
    edges, parts = cyclic(spark, sf), scc(spark, sf)
    return loops.back_edges(parts, loops.headers(parts, edges), edges)


def loop_nesting(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    found = loops.loop_nesting(ingest.nodes_from_edges(edges), edges)[0]
    return found.select("graph_id", "loop_id", "depth", "parent_loop_id", "header", F.array_join("members", ",").alias("members"))


def residual_edges(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    return loops.loop_nesting(ingest.nodes_from_edges(edges), edges)[1]


def residual_weights(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    nodes = settled(_weighted(spark, edges))
    return loops.node_weights(nodes, loops.loop_nesting(nodes, edges)[1])


def residual_motif_kinds(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    nodes = ingest.nodes_from_edges(edges)
    return reduction.motif_kinds(nodes, loops.loop_nesting(nodes, edges)[1])


def dag_weights(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(acyclic(spark, sf))
    return loops.node_weights(settled(_weighted(spark, edges)), edges)


def op_log_dag(spark, sf):  # noqa: ANN001, ANN201
    return _flat(_log(spark, sf)[2])


def op_log_roundtrip(spark, sf):  # noqa: ANN001, ANN201
    log = _log(spark, sf)[2]
    path = f"{shared_dir(spark)}/op-log-{uuid.uuid4().hex}"
    op_log_io.write_op_log(log, path)
    return _flat(op_log_io.read_op_log(spark, path))


def motifs_dag(spark, sf):  # noqa: ANN001, ANN201
    return reduction.motifs(_log(spark, sf)[2]).select("graph_id", "step", "kind", "node", F.array_join("preds", ",").alias("preds"))


def metagraph_edges_dag(spark, sf):  # noqa: ANN001, ANN201
    return reduction.metagraph_edges(reduction.motifs(_log(spark, sf)[2]))


def motif_profile_dag(spark, sf):  # noqa: ANN001, ANN201
    return reduction.motif_profile(reduction.motifs(_log(spark, sf)[2]))


def dag_violations(spark, sf):  # noqa: ANN001, ANN201
    return reduction.dag_violations(metagraph_edges_dag(spark, sf))


def graph_as_of(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges, log = _log(spark, sf)
    live = reduction.graph_as_of(nodes, edges, log, _half(log))[0]
    return live.select("graph_id", "node_id", "weight", node_label().alias("label"))


def frontier_as_of(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges, log = _log(spark, sf)
    return reduction.frontier_as_of(nodes, edges, log, _half(log)).select("graph_id", "node_id")


def truncate_append(spark, sf):  # noqa: ANN001, ANN201
    """The log cut in the middle, its first op appended again."""
    log = _log(spark, sf)[2]
    return _flat(reduction.truncate_and_append(log, _half(log), log.where("op_idx = 0")))


def reduction_progress(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges, log = _log(spark, sf)
    return reduction.progress(nodes, edges, log)


def describe_ops(spark, sf):  # noqa: ANN001, ANN201
    return _log(spark, sf)[2].select("graph_id", "op_idx", describe_step().alias("step"), describe_undo().alias("undo"))


def _loop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = settled(cyclic(spark, sf_dir))
    return settled(schedule.op_log(settled(_weighted(spark, edges)), edges))


def _loop_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _loop_log(spark, sf_dir)
    return settled(motif_tree.motifs(log, motif_tree.loop_parents(log)))


def op_log_loops(spark, sf):  # noqa: ANN001, ANN201
    log = _loop_log(spark, sf)
    cut = F.expr("array_join(transform(forward.edges, e -> concat(e.src, '>', e.dst)), ',')")
    rows = log.select("graph_id", "op_idx", "kind", F.col("inverse.target").alias("target"), F.array_join("inverse.pred_edges", ",").alias("preds"), F.col("inverse.weight").alias("weight"), F.col("meta.header").alias("header"), F.array_join("meta.scc", ",").alias("members"), cut.alias("cut"), describe_step().alias("step"))
    seen = schedule.scopes(log).select("graph_id", "op_idx", F.array_join("before", ",").alias("scope_before"), F.array_join("after", ",").alias("scope_after"))
    return rows.join(seen, ["graph_id", "op_idx"])


def motifs_loops(spark, sf):  # noqa: ANN001, ANN201
    found = _loop_motifs(spark, sf)
    lists = [F.array_join(c, ",").alias(c) for c in ("preds", "succs", "scc")]
    return found.select("graph_id", "step", "parent_step", "kind", "node", "header", *lists)


def metagraph_edges_loops(spark, sf):  # noqa: ANN001, ANN201
    return motif_tree.metagraph_edges(_loop_motifs(spark, sf))


def subgraphs_loops(spark, sf):  # noqa: ANN001, ANN201
    found = _loop_motifs(spark, sf)
    return motif_tree.subgraphs(found, motif_tree.metagraph_edges(found))


def has_node(spark, sf):  # noqa: ANN001, ANN201
    nodes = ingest.nodes_from_edges(settled(cyclic(spark, sf)))
    return lookups.has_node(nodes.select("graph_id", F.lit("purchase").alias("node_id")).distinct(), nodes)


def empty_graphs(spark, sf):  # noqa: ANN001, ANN201
    nodes = ingest.nodes_from_edges(settled(cyclic(spark, sf)))
    return lookups.is_empty(nodes, nodes.where("node_id > 'r'"))


def scoped_terminals(spark, sf):  # noqa: ANN001, ANN201
    """Terminals in a scope of the nodes with even numbers, in graphs of even length of id."""
    edges = settled(acyclic(spark, sf))
    nodes = lookups.node_ids(ingest.nodes_from_edges(edges))
    focus = nodes.groupBy("graph_id").agg(F.collect_list(F.when(F.col("node_id").cast("bigint") % 2 == 0, F.col("node_id"))).alias("focus"))
    return lookups.terminals(nodes, edges, focus.withColumn("active", F.length("graph_id") % 2 == 0))


def terminal_sccs_in_focus(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    nodes, inner = lookups.induced_subgraph(*(lambda n: (n, edges, n.where("node_id < 'r'")))(ingest.nodes_from_edges(edges)))
    return loops.terminal_sccs(loops.strongly_connected_components(nodes, inner), edges, nodes)


def removed_edges(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    return lookups.remove_edges(edges, edges.where("dst < 'p'"))


def restored_edges(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    cut = edges.where("dst < 'p'")
    return lookups.restore_edges(lookups.remove_edges(edges, cut), cut)


def restored_nodes(spark, sf):  # noqa: ANN001, ANN201
    """The first op of each graph done and undone."""
    nodes, edges, log = _log(spark, sf)
    first = settled(log.where("op_idx = 0"))
    left = lookups.remove_nodes(nodes, edges, first.select("graph_id", F.col("inverse.target").alias("node_id")))
    return lookups.restore_nodes(*left, first)[0].select("graph_id", "node_id", F.col("weight0").alias("weight"))


def opaque_motifs(spark, sf):  # noqa: ANN001, ANN201
    """Every third op has a kind that nothing knows."""
    log = _log(spark, sf)[2].withColumn("kind", F.when(F.col("op_idx") % 3 == 0, "annotate").otherwise(F.col("kind")))
    return reduction.motifs(log).select("graph_id", "step", "kind", "node", F.array_join("preds", ",").alias("preds"))


def describe_redos(spark, sf):  # noqa: ANN001, ANN201
    return _log(spark, sf)[2].select("graph_id", "op_idx", describe_redo().alias("redo"))


def motif_counts_dag(spark, sf):  # noqa: ANN001, ANN201
    found = reduction.motifs(_log(spark, sf)[2])
    return reduction.motif_counts(found.withColumn("parent_step", F.lit(None).cast("bigint")))


def turned_edges(spark, sf):  # noqa: ANN001, ANN201
    """Violations where every edge into an even step is turned round."""
    found = settled(reduction.motifs(_log(spark, sf)[2]).withColumn("parent_step", F.lit(None).cast("bigint")))
    even = F.col("dst_step") % 2 == 0
    ways = reduction.metagraph_edges(found).select("graph_id", F.lit(None).cast("bigint").alias("parent_step"), F.when(even, F.col("dst_step")).otherwise(F.col("src_step")).alias("src_step"), F.when(even, F.col("src_step")).otherwise(F.col("dst_step")).alias("dst_step"))
    return motif_tree.metagraph_violations(found, ways).select("graph_id", "src_step", "dst_step", "reason")


def node_steps_dag(spark, sf):  # noqa: ANN001, ANN201
    return reduction.node_steps(reduction.motifs(_log(spark, sf)[2]))


def metagraph_violations_loops(spark, sf):  # noqa: ANN001, ANN201
    found = _loop_motifs(spark, sf)
    return motif_tree.metagraph_violations(found, motif_tree.metagraph_edges(found))


def motif_counts_loops(spark, sf):  # noqa: ANN001, ANN201
    return reduction.motif_counts(_loop_motifs(spark, sf))


def reduction_progress_loops(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(cyclic(spark, sf))
    nodes = settled(_weighted(spark, edges))
    log = settled(schedule.op_log(nodes, edges))
    return reduction.progress(nodes, edges, log)


def _thrice(log: DataFrame) -> DataFrame:
    """Cursors behind the first op, in the middle and before the last op of each graph's log."""
    n = log.groupBy("graph_id").agg(F.count("*").alias("n"))
    return n.select("graph_id", F.explode(F.array_distinct(F.expr("array(1L, n div 2, n - 1)"))).alias("k"))


def graphs_as_of(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges, log = _log(spark, sf)
    return reduction.graph_as_of(nodes, edges, log, _thrice(log))[0]


def edges_as_of(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges, log = _log(spark, sf)
    return reduction.graph_as_of(nodes, edges, log, _thrice(log))[1]


def frontiers_as_of(spark, sf):  # noqa: ANN001, ANN201
    nodes, edges, log = _log(spark, sf)
    return reduction.frontier_as_of(nodes, edges, log, _thrice(log)).select("graph_id", "k", "node_id")


def _annotated(log: DataFrame) -> DataFrame:
    """Every third op replaced by one of a kind, and with fields, that nothing here knows."""
    note = F.to_json(F.struct(F.lit("annotate").alias("kind"), F.struct(F.concat(F.lit("seen "), F.col("inverse.target")).alias("note"), F.array(F.struct(F.col("op_idx").alias("at"))).alias("marks")).alias("forward")))
    third = F.col("op_idx") % 3 == 0
    return log.withColumns({"kind": F.when(third, "annotate").otherwise(F.col("kind")), "payload": F.when(third, note)})


def annotated_roundtrip(spark, sf):  # noqa: ANN001, ANN201
    """Ops of an unknown kind, written and read again, with a field of their own and the text of the op."""
    path = f"{shared_dir(spark)}/op-log-{uuid.uuid4().hex}"
    op_log_io.write_op_log(_annotated(_log(spark, sf)[2]), path)
    back = op_log_io.read_op_log(spark, path)
    mark = F.try_variant_get(F.try_parse_json("payload"), "$.forward.marks[0].at", "bigint")
    return back.select("graph_id", "op_idx", "kind", F.col("inverse.target").alias("target"), mark.alias("mark"), describe_step().alias("step"))


def annotated_motifs(spark, sf):  # noqa: ANN001, ANN201
    found = reduction.motifs(_annotated(_log(spark, sf)[2]))
    return found.select("graph_id", "step", "kind", "node", F.array_join("preds", ",").alias("preds"))


def op_files_roundtrip(spark, sf):  # noqa: ANN001, ANN201
    path = f"{shared_dir(spark)}/op-files-{uuid.uuid4().hex}"
    op_log_io.write_op_files(_log(spark, sf)[2], path)
    return _flat(op_log_io.read_op_files(spark, path))


def broken_files(spark, sf):  # noqa: ANN001, ANN201
    """The status of each graph's text, of which some are cut short, wrapped or without a kind."""
    rows = op_log_io.ops_to_json(_log(spark, sf)[2])
    n = F.length("graph_id") % 4
    value = F.when(n == 0, F.concat("value", F.lit("]"))).when(n == 1, F.concat(F.lit('{"ops":'), "value", F.lit("}"))).when(n == 2, F.lit('[{"forward": {}}]')).otherwise(F.col("value"))
    return op_log_io.json_status(rows.withColumn("value", value))


def heavy_status(spark, sf):  # noqa: ANN001, ANN201
    """Nodes of a weight of which four leave 64 bits."""
    edges = settled(acyclic(spark, sf))
    return schedule.reduction_status(settled(ingest.nodes_from_edges(edges)), edges, spark.createDataFrame([("basic", 1 << 61)], "name string, default_weight bigint"))


def metagraph_of_dag(spark, sf):  # noqa: ANN001, ANN201
    edges = settled(acyclic(spark, sf))
    return motif_tree.metagraph_of(settled(_weighted(spark, edges)), edges)[1]


def wrong_levels(spark, sf):  # noqa: ANN001, ANN201
    """Violations where every third motif is put below the one before it, which is no loop, and the edges stay as they are."""
    found = settled(reduction.motifs(_log(spark, sf)[2]))
    ways = reduction.metagraph_edges(found).withColumn("parent_step", F.lit(None).cast("bigint"))
    return motif_tree.metagraph_violations(found.withColumn("parent_step", F.when(F.col("step") % 3 == 2, F.col("step") - 1)), ways)


_NAMES = (
    graphs_as_of, edges_as_of, frontiers_as_of, annotated_roundtrip, annotated_motifs, op_files_roundtrip, broken_files, heavy_status, metagraph_of_dag, wrong_levels,
    metagraph_edges_dag, graph_edges, graph_nodes, type_weights, graph_status, degrees, neighbours, terminals, next_terminal, induced_subgraph, removed_terminals, scc, terminal_sccs, loop_headers,
    back_edges, loop_nesting, residual_edges, residual_weights, residual_motif_kinds, dag_weights, op_log_dag, op_log_roundtrip, motifs_dag, motif_profile_dag, dag_violations, graph_as_of, frontier_as_of, truncate_append, reduction_progress, describe_ops,
    op_log_loops, motifs_loops, metagraph_edges_loops, subgraphs_loops, has_node, empty_graphs, scoped_terminals, terminal_sccs_in_focus, removed_edges, restored_edges, restored_nodes, opaque_motifs,
    describe_redos, motif_counts_dag, turned_edges, node_steps_dag, metagraph_violations_loops, motif_counts_loops, reduction_progress_loops,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMES}

_C = f"with recursive every as ({CYCLIC.format(events='events')}), c as (select * from every where src <> dst), n as (select graph_id, src as node_id from c union select graph_id, dst from c)"
#: The edges between nodes below r.
FOCUS = "(select * from every where src <> dst and src < 'r' and dst < 'r')"
_REACH = _C + """, r as (select graph_id, src as a, dst as b from c union select r.graph_id, r.a, c.dst from r join c on r.graph_id = c.graph_id and r.b = c.src),
 mutual as (select x.graph_id, x.a, x.b from r x join r y on x.graph_id = y.graph_id and x.a = y.b and x.b = y.a),
 parts as (select n.graph_id, n.node_id, least(n.node_id, coalesce(min(m.b), n.node_id)) as scc_id from n left join mutual m on m.graph_id = n.graph_id and m.a = n.node_id group by 1, 2),
 s as (select *, count(*) over (partition by graph_id, scc_id) as scc_size from parts),
 w as (select c.*, x.scc_id as sa, y.scc_id as sb, y.scc_size as size_b from c join s x on x.graph_id = c.graph_id and x.node_id = c.src join s y on y.graph_id = c.graph_id and y.node_id = c.dst),
 h as (select s.graph_id, s.scc_id, coalesce(min(case when e.dst is not null then s.node_id end), min(s.node_id)) as header, string_agg(distinct s.node_id, ',' order by s.node_id) as members
   from s left join (select distinct graph_id, dst from w where sa <> sb) e on e.graph_id = s.graph_id and e.dst = s.node_id where s.scc_size > 1 group by 1, 2)"""
_D = f"with recursive d as ({ACYCLIC.format(events='events')}), n as (select graph_id, src as node_id from d union select graph_id, dst from d)"
_LOG = _D + """, p as (select graph_id, node_id as v, node_id as at from n union all select p.graph_id, p.v, d.dst from p join d on d.graph_id = p.graph_id and d.src = p.at),
 w as (select graph_id, v as node_id, count(*) as weight from p group by 1, 2),
 q as (select w.*, coalesce((select string_agg(d.src, ',' order by d.src) from d where d.graph_id = w.graph_id and d.dst = w.node_id), '') as preds,
   (select count(*) from d where d.graph_id = w.graph_id and d.dst = w.node_id) as n_preds from w),
 l as (select *, row_number() over (partition by graph_id order by weight, node_id) - 1 as op_idx, count(*) over (partition by graph_id) as total from q),
 m as (select *, total - 1 - op_idx as step, case when n_preds = 0 then 'entry' when n_preds = 1 then 'linear' else 'merge' end as kind from l),
 k as (select distinct graph_id, cast(total // 2 as bigint) as k from l)"""
_OPS = "select graph_id, op_idx, 'remove_node' as kind, node_id as target, preds, weight from l"
_META = "select distinct x.graph_id, y.step as src_step, x.step as dst_step from m x join d on d.graph_id = x.graph_id and d.dst = x.node_id join m y on y.graph_id = d.graph_id and y.node_id = d.src"
_THRICE = f"{_LOG}, c as (select distinct graph_id, cast(unnest([1, total // 2, total - 1]) as bigint) as k from l)"
ORACLES: dict[str, str] = {
    "graphs_as_of": f"{_THRICE}, a as (select l.graph_id, c.k, l.node_id, 1 + coalesce((select sum(g.weight) from d join l g on g.graph_id = d.graph_id and g.node_id = d.dst where d.graph_id = l.graph_id and d.src = l.node_id and g.op_idx < c.k), 0) as weight from l join c on c.graph_id = l.graph_id where l.op_idx >= c.k) select graph_id, k, node_id, cast(weight as bigint) as weight from a",
    "edges_as_of": f"{_THRICE} select d.graph_id, c.k, d.src, d.dst from d join c on c.graph_id = d.graph_id join l s on s.graph_id = d.graph_id and s.node_id = d.src join l t on t.graph_id = d.graph_id and t.node_id = d.dst where least(s.op_idx, t.op_idx) >= c.k",
    "frontiers_as_of": f"{_THRICE} select l.graph_id, c.k, l.node_id from l join c on c.graph_id = l.graph_id where l.op_idx >= c.k and not exists (select 1 from d join l g on g.graph_id = d.graph_id and g.node_id = d.dst where d.graph_id = l.graph_id and d.src = l.node_id and g.op_idx >= c.k)",
    "annotated_roundtrip": f"""{_LOG} select graph_id, op_idx, case when op_idx % 3 = 0 then 'annotate' else 'remove_node' end as kind, case when op_idx % 3 > 0 then node_id end as target, case when op_idx % 3 = 0 then op_idx end as mark,
        case when op_idx % 3 = 0 then 'annotate: {{"marks":[{{"at":' || cast(op_idx as varchar) || '}}],"note":"seen ' || node_id || '"}}' else 'Removed [' || node_id || ']  (weight=' || cast(weight as varchar) || ')' end as step from l""",
    "annotated_motifs": f"{_LOG} select graph_id, step, case when op_idx % 3 = 0 then 'annotate' else kind end as kind, case when op_idx % 3 = 0 then null else node_id end as node, case when op_idx % 3 = 0 then '' else preds end as preds from m",
    "op_files_roundtrip": f"{_LOG} {_OPS}",
    "broken_files": f"{_D} select distinct graph_id, case length(graph_id) % 4 when 0 then 'broken_json' when 1 then 'no_array' when 2 then 'op_without_kind' else 'ok' end as status from n",
    "heavy_status": f"{_LOG} select graph_id, case when max(weight) >= 4 then 'weight_overflow' else 'ok' end as status from w group by 1",
    "metagraph_of_dag": f"{_LOG}, e as ({_META}) select graph_id, cast(null as bigint) as parent_step, src_step, dst_step from e",
    "wrong_levels": f"{_LOG}, e as ({_META}) select graph_id, cast(null as bigint) as parent_step, src_step, dst_step, 'unknown_step' as reason from e where src_step % 3 = 2 or dst_step % 3 = 2 union all select graph_id, step - 1, null, null, 'not_a_loop' from m where step % 3 = 2",
    "graph_edges": f"{_C} select * from c",
    "graph_nodes": f"{_C} select *, 'basic' as node_type from n",
    "type_weights": f"{_C} select *, case when node_id = 'purchase' then 'purchase' else 'basic' end as node_type, cast(case when node_id = 'purchase' then 3 else 1 end as bigint) as weight0 from n",
    "graph_status": f"{_C} select graph_id, case when bool_or(src = dst) then 'self_loop' else 'ok' end as status from every group by 1",
    "degrees": f"{_C} select *, (select count(*) from c where c.graph_id = n.graph_id and src = node_id) as out_degree, (select count(*) from c where c.graph_id = n.graph_id and dst = node_id) as in_degree from n",
    "neighbours": f"{_C} select *, coalesce((select string_agg(dst, ',' order by dst) from c where c.graph_id = n.graph_id and src = node_id), '') as succs, coalesce((select string_agg(src, ',' order by src) from c where c.graph_id = n.graph_id and dst = node_id), '') as preds from n",
    "terminals": f"{_D} select n.* from n where not exists (select 1 from d where d.graph_id = n.graph_id and src = node_id)",
    "next_terminal": f"{_D} select graph_id, min(node_id) as node_id, cast(1 as bigint) as weight0 from n where not exists (select 1 from d where d.graph_id = n.graph_id and src = node_id) group by 1",
    "induced_subgraph": f"{_C} select * from c where src < 'p' and dst < 'p'",
    "removed_terminals": f"{_D}, t as (select n.* from n where not exists (select 1 from d where d.graph_id = n.graph_id and src = node_id)) select n.*, 1 + (select count(*) from d join t on t.graph_id = d.graph_id and t.node_id = d.dst where d.graph_id = n.graph_id and d.src = n.node_id) as weight from n anti join t using (graph_id, node_id)",
    "scc": f"{_REACH} select * from s",
    "terminal_sccs": f"{_REACH} select distinct graph_id, scc_id, scc_size from s where scc_size > 1 and not exists (select 1 from w where w.graph_id = s.graph_id and sa = s.scc_id and sb <> sa)",
    "loop_headers": f"{_REACH} select * from h",
    "back_edges": f"{_REACH} select w.graph_id, w.src, w.dst, w.sb as scc_id from w join h on h.graph_id = w.graph_id and h.scc_id = w.sb and h.header = w.dst where w.sa = w.sb",
    "dag_weights": f"{_LOG} select * from w",
    "op_log_dag": f"{_LOG} {_OPS}",
    "op_log_roundtrip": f"{_LOG} {_OPS}",
    "motifs_dag": f"{_LOG} select graph_id, step, kind, node_id as node, preds from m",
    "metagraph_edges_dag": f"{_LOG} {_META}",
    "motif_profile_dag": f"{_LOG} select coalesce(kind, 'all') as kind, count(*) as n from m group by rollup (kind)",
    "dag_violations": f"{_LOG}, e as ({_META}) select * from e where src_step >= dst_step",
    "graph_as_of": f"{_LOG}, a as (select l.graph_id, l.node_id, 1 + coalesce((select sum(g.weight) from d join l g on g.graph_id = d.graph_id and g.node_id = d.dst where d.graph_id = l.graph_id and d.src = l.node_id and g.op_idx < k.k), 0) as weight from l join k on k.graph_id = l.graph_id where l.op_idx >= k.k) select graph_id, node_id, cast(weight as bigint) as weight, case when weight > 1 then node_id || chr(10) || 'w=' || cast(cast(weight as bigint) as varchar) else node_id end as label from a",
    "frontier_as_of": f"{_LOG} select l.graph_id, l.node_id from l join k on k.graph_id = l.graph_id where l.op_idx >= k.k and not exists (select 1 from d join l g on g.graph_id = d.graph_id and g.node_id = d.dst where d.graph_id = l.graph_id and d.src = l.node_id and g.op_idx >= k.k)",
    "truncate_append": f"{_LOG}, o as ({_OPS}) select o.* from o join k on k.graph_id = o.graph_id where op_idx < k.k union all select o.graph_id, o.op_idx + k.k, kind, target, preds, weight from o join k on k.graph_id = o.graph_id where op_idx = 0",
    "reduction_progress": f"{_LOG} select l.graph_id, l.op_idx + 1 as cursor, total - l.op_idx - 1 as live, (select count(*) from l x where x.graph_id = l.graph_id and x.op_idx > l.op_idx and not exists (select 1 from d join l y on y.graph_id = d.graph_id and y.node_id = d.dst where d.graph_id = x.graph_id and d.src = x.node_id and y.op_idx > l.op_idx)) as frontier, false as zoomed from l",
    "has_node": f"{_C} select graph_id, 'purchase' as node_id, bool_or(node_id = 'purchase') as present from n group by 1",
    "empty_graphs": f"{_C} select graph_id from n group by 1 having max(node_id) <= 'r'",
    "scoped_terminals": f"{_D} select n.* from n where not exists (select 1 from d where d.graph_id = n.graph_id and src = node_id) and (length(graph_id) % 2 = 1 or cast(node_id as bigint) % 2 = 0)",
    "terminal_sccs_in_focus": f"{_REACH.replace('(select * from every where src <> dst)', FOCUS)} select distinct graph_id, scc_id, scc_size from s where scc_size > 1 and not exists (select 1 from w where w.graph_id = s.graph_id and sa = s.scc_id and sb <> sa)",
    "removed_edges": f"{_C} select * from c where not dst < 'p'",
    "restored_edges": f"{_C} select * from c",
    "restored_nodes": f"{_D} select *, cast(1 as bigint) as weight from n",
    "opaque_motifs": f"{_LOG} select graph_id, step, case when op_idx % 3 = 0 then 'annotate' else kind end as kind, case when op_idx % 3 = 0 then null else node_id end as node, case when op_idx % 3 = 0 then '' else preds end as preds from m",
    "describe_redos": f"{_LOG} select graph_id, op_idx, 'Redo remove [' || node_id || ']' as redo from l",
    "motif_counts_dag": f"{_LOG} select graph_id, cast(null as bigint) as parent_step, kind, count(*) as n from m group by 1, 2, 3",
    "turned_edges": f"{_LOG}, e as ({_META}) select graph_id, dst_step as src_step, src_step as dst_step, 'order' as reason from e where dst_step % 2 = 0",
    "node_steps_dag": f"{_LOG} select graph_id, node_id as node, step from m",
    "describe_ops": f"{_LOG} select graph_id, op_idx, 'Removed [' || node_id || ']  (weight=' || cast(weight as varchar) || ')' as step, 'Undo remove [' || node_id || ']' as undo from l",
}
