"""Loops and weights on small graphs traced by hand."""

from weftgraph.operators import loops, lookups, reduction
from weftgraph.sources import ingest

GRAPHS = {
    "simple": "AB BC CB CD",
    "nested": "AB BC CD DC DB BE",
    "entries": "AB AC BC CB",
    "isolated": "AB BC CA",
    "lost": "AD BA BD CD DB DC EA EB",
    "chain": "AB BC CD",
    "diamond": "AB AC BD CD",
}
LOOPS = {
    "simple": [("BC", 0, "B")],
    "nested": [("BCD", 0, "B"), ("CD", 1, "C")],
    "entries": [("BC", 0, "B")],
    "isolated": [("ABC", 0, "A")],
    "lost": [("ABCD", 0, "A"), ("BCD", 1, "B"), ("CD", 2, "D")],
}
WEIGHTS = {"simple": "A4 B3 C2 D1", "nested": "A5 B4 C2 D1 E1", "entries": "A4 B2 C1", "isolated": "A3 B2 C1", "lost": "A3 B3 C1 D2 E7", "chain": "A4 B3 C2 D1", "diamond": "A5 B2 C2 D1"}


def tables(spark):
    edges = spark.createDataFrame([(g, e[0], e[1]) for g, es in GRAPHS.items() for e in es.split()], "graph_id string, src string, dst string")
    types = spark.createDataFrame([("basic", 1)], "name string, default_weight bigint")
    return ingest.with_default_weights(ingest.nodes_from_edges(edges), types), edges


def test_loops_and_weights(spark):
    nodes, edges = tables(spark)
    found, residual = loops.loop_nesting(nodes, edges)
    got = {}
    for r in found.collect():
        got.setdefault(r.graph_id, []).append(("".join(r.members), r.depth, r.header))
    assert {g: sorted(v, key=lambda x: x[1]) for g, v in got.items()} == LOOPS
    weights = {}
    for r in loops.node_weights(nodes, residual).collect():
        weights.setdefault(r.graph_id, []).append(f"{r.node_id}{r.weight}")
    assert {g: " ".join(sorted(v)) for g, v in weights.items()} == WEIGHTS


def test_removal_and_restore_are_inverse(spark):
    nodes, edges = tables(spark)
    nodes, edges = (t.where("graph_id in ('chain', 'diamond')") for t in (nodes, edges))
    log = reduction.op_log(nodes, edges)
    first = log.where("op_idx = 0")
    n, e = lookups.remove_nodes(nodes, edges, first.selectExpr("graph_id", "inverse.target as node_id"))
    n, e = lookups.restore_nodes(n, e, first)
    key = lambda t: sorted(map(tuple, t.collect()))
    assert key(n) == key(nodes) and key(e) == key(edges)
    assert [r.target for r in log.where("graph_id = 'diamond'").orderBy("op_idx").selectExpr("inverse.target as target").collect()] == ["D", "B", "C", "A"]


def test_weights_overflow_to_null(spark):
    edges = [(f"{i}", f"{i}{s}") for i in range(3) for s in "ab"] + [(f"{i}{s}", f"{i + 1}") for i in range(3) for s in "ab"]
    edges = spark.createDataFrame([("g", a, b) for a, b in edges], "graph_id string, src string, dst string")
    nodes = ingest.with_default_weights(ingest.nodes_from_edges(edges), spark.createDataFrame([("basic", 1 << 61)], "name string, default_weight bigint"))
    got = {r.node_id: r.weight for r in loops.node_weights(nodes, edges).collect()}
    assert got == {"3": 1 << 61, "2a": 1 << 62, "2b": 1 << 62, "2": None, "1a": None, "1b": None, "1": None, "0a": None, "0b": None, "0": None}


def test_status(spark):
    edges = spark.createDataFrame([("a", "A", "A"), ("b", "A", "B"), ("c", "A", "B")], "graph_id string, src string, dst string")
    nodes = spark.createDataFrame([("a", "A", "basic"), ("b", "A", "basic"), ("c", "A", "odd"), ("c", "B", None), ("d", "X", "none")], "graph_id string, node_id string, node_type string")
    types = spark.createDataFrame([("basic", 1), ("none", 0)], "name string, default_weight bigint")
    got = {r.graph_id: r.status for r in ingest.validate_graphs(nodes, edges, types).collect()}
    assert got == {"a": "self_loop", "b": "dangling_edge", "c": "unknown_type", "d": "non_positive_weight"}
