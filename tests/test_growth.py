"""Small and large graphs take different ways to the same results, and what reaches the driver doesn't grow with the tables."""

import gzip
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import loops, motif_tree, ordering, reduction, schedule
from weftgraph.sources import op_log_io


def tables(spark, graphs, loose=False):
    edges = [(g, s, d) for g, es in graphs.items() for s, d in es]
    nodes = sorted({(g, n) for g, s, d in edges for n in (s, d) if not (loose and n == "z")})
    return spark.createDataFrame(nodes, "graph_id string, node_id string").withColumns({"node_type": F.lit("basic"), "weight0": F.lit(1).cast("bigint")}), spark.createDataFrame(edges, "graph_id string, src string, dst string")


def some(seed, ordered):
    rng, out = random.Random(seed), {}
    for g in range(60):
        names = "abcdefghij"[: rng.randint(2, 10)] + "z" * (g % 3 == 0)
        pairs = [(s, d) for s in names for d in names if (s < d if ordered else s != d or rng.random() < 0.1) and rng.random() < 0.35]
        out[f"g{g}"] = pairs or [("a", "b")]
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def broadcasts(df):
    """The keys of the broadcast joins of a plan that was run."""
    df.collect()
    return re.findall(r"BroadcastHashJoin \[([^]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        run().collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("loose", [False, True])
def test_nesting_of_small_and_large_graphs(spark, loose):
    nodes, edges = tables(spark, some(1, False), loose)
    for small, large in zip(loops.small_nesting(nodes, edges), loops.large_nesting(nodes, edges), strict=True):
        assert found(small.select(sorted(small.columns))) == found(large.select(sorted(small.columns)))


def test_weights_of_small_and_large_graphs(spark):
    for ordered in (True, False):
        nodes, edges = tables(spark, some(2, ordered))
        heavy = nodes.withColumn("weight0", F.when(F.col("graph_id") == "g1", 1 << 61).when((F.col("graph_id") == "g2") & (F.col("node_id") == "b"), None).otherwise(F.col("weight0")))
        small, large = (found(f(heavy, edges)) for f in (loops.small_weights, loops.large_weights))
        assert small == large


def test_weights_of_a_deep_graph_take_few_jobs(spark):
    nodes, edges = tables(spark, {"g": [(f"{i:02}", f"{i + 1:02}") for i in range(30)]})
    assert jobs(spark, lambda: loops.node_weights(nodes, edges)) < 15


def test_nesting_of_deep_loops_takes_few_jobs(spark):
    nodes, edges = tables(spark, {"g": [(a, b) for a in "abcdef" for b in "abcdef" if a != b]})
    assert jobs(spark, lambda: loops.loop_nesting(nodes, edges)[0]) < 30


def test_numbers_of_small_and_large_graphs(spark, monkeypatch):
    rows = spark.range(200).select(F.concat(F.lit("g"), (F.col("id") % 7 * F.col("id") % 5).cast("string")).alias("graph_id"), (F.col("id") * 37 % 211).alias("x"))
    small = found(ordering.numbered(rows, ["x"], "n"))
    monkeypatch.setattr(ordering, "WINDOW", 30)
    assert found(ordering.numbered(rows, ["x"], "n")) == small


def test_history_of_small_and_large_graphs_without_broadcast_cursors(spark, monkeypatch):
    nodes, edges = tables(spark, some(3, True))
    log = reduction.op_log(nodes, edges)
    at = log.select("graph_id", F.col("op_idx").alias("k"))
    small = reduction.graph_as_of(nodes, edges, log, at)
    assert not [k for df in small for k in broadcasts(df) if "," in k]
    small = [found(df) for df in small]
    for module in (ordering, reduction):
        monkeypatch.setattr(module, "CHUNK", 3)
    assert [found(df) for df in reduction.graph_as_of(nodes, edges, log, at)] == small


def test_motifs_without_broadcasts_by_estimates(spark):
    log = schedule.op_log(*tables(spark, some(4, False)))
    out = motif_tree.motifs(log, motif_tree.loop_parents(log))
    assert not broadcasts(out) and not broadcasts(motif_tree.metagraph_edges(out))


def test_text_of_ops_is_parsed_once(spark, tmp_path):
    spark.createDataFrame([("a", "[]"), ("b", '[{"kind": "note", "n": 1}, {"kind": "remove_node", "forward": {"target": "x"}}]')], "graph_id string, value string").write.json(f"file://{tmp_path}/log")
    ops = op_log_io.read_op_log(spark, f"file://{tmp_path}/log")
    assert [(r.graph_id, r.op_idx, r.kind) for r in ops.orderBy("op_idx").collect()] == [("b", 0, "note"), ("b", 1, "remove_node")]
    plan = ops._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('concat({"a":') == 1


def test_many_op_files_are_written_by_tasks_and_listed_by_few(spark, tmp_path):
    """Folders have Spark's names; one that is there already is an error, and what a broken task left behind isn't read."""
    odd = ["", " ", "é%41", "a\"b#c%d'e*f", "a/b:c=d?e", "\\{[]}^\x7f\t", "a+b c.txt", "_x", "null"]
    log = schedule.op_log(*tables(spark, {"g": [("a", "b"), ("b", "c")]})).drop("graph_id").crossJoin(spark.createDataFrame([(g,) for g in [*odd, *map(str, range(100))]], "graph_id string"))
    # A quote and a line break in an op's text.
    log = log.withColumns({"kind": F.lit("note"), "payload": F.to_json(F.struct(F.lit("note").alias("kind"), F.struct(F.concat(F.lit("é\n\""), "graph_id").alias("s"), "op_idx").alias("forward")))})
    path = tmp_path / "files"
    op_log_io.write_op_files(log, f"file://{path}")
    log.select("graph_id", "payload").write.partitionBy("graph_id").text(f"file://{tmp_path}/spark")
    folders = {p.name for p in path.glob("graph_id=*")}
    assert folders == {p.name for p in (tmp_path / "spark").glob("graph_id=*")} and len(folders) == 109
    assert (path / "_SUCCESS").exists() and sum(p.is_file() for p in path.glob("graph_id=*/*")) == 109
    with pytest.raises(Exception, match="(?i)already exists"):
        op_log_io.write_op_files(log, f"file://{path}")
    (path / "graph_id=7" / ".left").write_text("[")
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    back = op_log_io.read_op_files(spark, f"file://{path}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    track = spark.sparkContext.statusTracker()
    tasks = [track.getStageInfo(s).numTasks for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 16
    named, text = F.expr("if(graph_id = '', '__HIVE_DEFAULT_PARTITION__', graph_id)"), F.get_json_object("payload", "$.forward.s")
    assert found(back.select("graph_id", "op_idx", "kind", text)) == found(log.select(named, "op_idx", "kind", text))


@pytest.mark.parametrize("loose", [False, True])
def test_order_of_breaks_of_small_and_large_graphs(spark, monkeypatch, loose):
    """In a row each, round by round, and some of both: graphs of more than four nodes, and with more than four with the ends of their edges."""
    nodes, edges = tables(spark, some(6, False) | {"k": [(a, b) for a in "abcdef" for b in "abcdef" if a != b], "none": [("a", "b")]}, loose)
    nest, residual = loops.loop_nesting(nodes, edges)
    small = [found(df.select(sorted(df.columns))) for df in schedule.break_order(nodes, nest, residual)]
    reach = schedule.reachable_loops(nest, residual)
    breaks, epochs = schedule.break_epochs(nest, reach)
    want = found(schedule.node_epochs(nodes, nest, reach, breaks, epochs).where("epoch > 0").select("epoch", "graph_id", "node_id"))
    assert small[0] == found(breaks.select(sorted(breaks.columns)))
    there = {tuple(r) for r in nodes.select("graph_id", "node_id").collect()}
    assert [r for r in small[1] if r[0] and r[1:] in there] == want and len(small[0]) > 60
    monkeypatch.setattr(schedule, "SMALL", 4)
    mixed = [found(df.select(sorted(df.columns))) for df in schedule.break_order(nodes, nest, residual)]
    assert mixed[0] == small[0] and [r for r in mixed[1] if r[0] and r[1:] in there] == want


def test_order_of_deep_loops_takes_no_jobs_a_break(spark):
    few, many = ({"g": [(a, b) for a in names for b in names if a != b]} for names in ("abc", "abcdefg"))
    assert jobs(spark, lambda: schedule.op_log(*tables(spark, many))) < jobs(spark, lambda: schedule.op_log(*tables(spark, few))) + 10


def test_packed_and_plain_op_files_are_read_alike(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text('[{"kind": "é"}]', encoding="utf-8")
    (tmp_path / "a" / "two.json.gz").write_bytes(gzip.compress('[{"kind": "ü"}]'.encode()))
    for path in (tmp_path, tmp_path / "a"):
        assert found(op_log_io.read_op_files(spark, f"file://{path}").select("graph_id", "kind")) == [("one", "é"), ("two.json.gz", "ü")]
    ops = op_log_io.read_op_files(spark, f"file://{tmp_path}/a/two.json.gz")
    assert found(ops.select("kind")) == [("ü",)]
    assert "binaryFile" in op_log_io.read_op_files(spark, f"file://{tmp_path}/a/one.json")._jdf.queryExecution().toString()
