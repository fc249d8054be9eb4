"""Op logs as interchange JSON: for each graph one array of ops in order, edges as lists of two, scopes in meta.

Ops of the kinds remove_node and remove_edges have typed columns. An op of any other kind keeps its fields as JSON in `payload`, whatever they are."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.schedule import scopes

EDGES = "array<array<string>>"
SCOPE = "struct<active:boolean,focus:array<string>>"
OP = f"""struct<kind:string, forward:struct<target:string,edges:{EDGES}>,
    inverse:struct<target:string,pred_edges:array<string>,succ_edges:array<string>,weight:bigint,node_type:string,weight_deltas:map<string,bigint>,edges:{EDGES}>,
    meta:struct<header:string,scc:array<string>,scope_snapshot:{SCOPE},scope_after:{SCOPE}>>"""

#: Endings of the files that Hadoop unpacks.
PACKED = ("bz2", "deflate", "gz", "lz4", "snappy", "zst")


def _pairs(struct: str) -> str:
    return f"transform({struct}.edges, e -> array(e.src, e.dst))"


def _op_texts(op_log: DataFrame) -> DataFrame:
    """(graph_id, op_idx, text): each op as a JSON object with kind, forward, inverse and meta; what an op hasn't got is left out of these.
    meta holds the scope before and after the op; an op with a payload is that."""
    scope = "named_struct('active', size({0}) > 0, 'focus', {0})"
    op = F.struct(
        "kind",
        F.expr(f"named_struct('target', forward.target, 'edges', {_pairs('forward')})").alias("forward"),
        F.expr(f"""named_struct('target', inverse.target, 'pred_edges', inverse.pred_edges, 'succ_edges', inverse.succ_edges, 'weight', inverse.weight,
            'node_type', inverse.node_type, 'weight_deltas', inverse.weight_deltas, 'edges', {_pairs('inverse')})""").alias("inverse"),
        F.expr(f"named_struct('header', meta.header, 'scc', meta.scc, 'scope_snapshot', {scope.format('before')}, 'scope_after', {scope.format('after')})").alias("meta"),
    )
    # Graphs without a break have no scopes; the others' are looked up, not all ops'.
    broken = op_log.where("kind = 'remove_edges'").select("graph_id").distinct().hint("merge")
    seen, none = scopes(op_log.join(broken, "graph_id", "left_semi")), F.array().cast("array<string>")
    rows = op_log.hint("merge").join(seen, ["graph_id", "op_idx"], "left").withColumns({c: F.coalesce(c, none) for c in ("before", "after")})
    return rows.select("graph_id", "op_idx", F.coalesce("payload", F.to_json(op)).alias("text"))


def ops_to_json(op_log: DataFrame) -> DataFrame:
    """(graph_id, value): the JSON array of a graph's ops in a row; :func:`write_op_files` has no such row."""
    rows = _op_texts(op_log).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("op_idx", "text"))).alias("ops"))
    return rows.select("graph_id", F.concat(F.lit("["), F.array_join("ops.text", ","), F.lit("]")).alias("value"))


def _parsed(rows: DataFrame) -> DataFrame:
    """(graph_id, v, ops): v is null where value isn't one whole JSON text, ops where it is no array. A parser of JSON stops behind the first
    value, so the text is read as a field with another one behind it."""
    read = rows.select("graph_id", F.try_parse_json(F.concat(F.lit('{"a":'), "value", F.lit(',"b":1}'))).alias("v"))
    read = read.select("graph_id", F.when(F.try_variant_get("v", "$.b", "int") == 1, F.col("v")).alias("v"))
    return read.select("graph_id", "v", F.try_variant_get("v", "$.a", "array<variant>").alias("ops"))


def json_status(rows: DataFrame) -> DataFrame:
    """(graph_id, status) of (graph_id, value): `ok`, `broken_json`, `no_array` (JSON of another shape), or `op_without_kind`."""
    kinds = F.expr("forall(ops, o -> try_variant_get(o, '$.kind', 'string') is not null)")
    return _parsed(rows).select("graph_id", F.when(F.col("v").isNull(), "broken_json").when(F.col("ops").isNull(), "no_array").when(~kinds, "op_without_kind").otherwise("ok").alias("status"))


def ops_from_json(rows: DataFrame) -> DataFrame:
    """(graph_id, op_idx, kind, forward, inverse, meta, payload) of (graph_id, value); the position in the array is op_idx.

    forward, inverse and meta may be absent and are empty then. meta has scope_snapshot and scope_after besides. Text that isn't a JSON array, and an op
    without a kind, are errors that name the graph; filter by :func:`json_status` first to leave such rows out. payload is null for the two typed
    kinds; else it is the op with these four fields, each with all that it holds."""
    broken = F.raise_error(F.concat(F.lit("no JSON array of ops in "), "graph_id")).cast("array<variant>")
    read = _parsed(rows).select("graph_id", F.coalesce("ops", broken).alias("ops"))
    # The outer form: for the other one a filter on the array is inferred, which parses the text again for each condition.
    ops = read.select("graph_id", F.posexplode_outer("ops").alias("op_idx", "v")).where("op_idx is not null")
    kind = F.coalesce(F.try_variant_get("v", "$.kind", "string"), F.raise_error(F.concat(F.lit("an op without a kind in "), "graph_id")).cast("string"))
    part = "coalesce(try_variant_get(v, '$.{0}', 'variant'), parse_json('{{}}'))"
    whole = F.expr(f"to_json(named_struct('kind', kind, {', '.join(f"'{p}', {part.format(p)}" for p in ('forward', 'inverse', 'meta'))}))")
    ops = ops.select("graph_id", "op_idx", "v", kind.alias("kind")).withColumn("op", F.from_json(F.to_json("v"), OP))
    edges = "transform(op.{0}.edges, e -> named_struct('src', e[0], 'dst', e[1]))"
    forward = F.expr(f"named_struct('target', op.forward.target, 'edges', {edges.format('forward')})")
    inverse = F.expr(f"""named_struct('target', op.inverse.target, 'pred_edges', op.inverse.pred_edges, 'succ_edges', op.inverse.succ_edges, 'weight', op.inverse.weight,
        'node_type', op.inverse.node_type, 'weight_deltas', op.inverse.weight_deltas, 'edges', {edges.format('inverse')})""")
    meta = F.expr("named_struct('header', op.meta.header, 'scc', op.meta.scc, 'scope_snapshot', op.meta.scope_snapshot, 'scope_after', op.meta.scope_after)")
    payload = F.when(~F.col("kind").isin("remove_node", "remove_edges"), whole)
    return ops.select("graph_id", F.col("op_idx").cast("bigint").alias("op_idx"), "kind", forward.alias("forward"), inverse.alias("inverse"), meta.alias("meta"), payload.alias("payload"))


def write_op_log(op_log: DataFrame, path: str) -> None:
    """A line for each graph: its id and its ops as text of the interchange format."""
    ops_to_json(op_log).write.json(path)


def read_op_log(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_op_log` wrote, as :func:`ops_from_json` gives it."""
    return ops_from_json(spark.read.schema("graph_id string, value string").json(path))


def _write_lines(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes lines (graph_id, value), sorted by graph, to a file for each graph, and says how many files these are. A file gets its name when it is whole, so a
    task that runs again, or twice at a time, writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, out, n = None, None, 0
        # The folder's name is the one that Spark gives it.
        escaped = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")

        def end() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, f"{os.path.dirname(out.name)}/part-0.txt")

        for batch in batches:
            for graph_id, value in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if graph_id != graph:
                    end()
                    folder = f"{root}/graph_id=" + (escaped.sub(lambda m: f"%{ord(m[0]):02X}", graph_id) or "__HIVE_DEFAULT_PARTITION__")
                    os.makedirs(folder, exist_ok=True)
                    graph, out, n = graph_id, open(f"{folder}/.{uuid.uuid4().hex}", "w", encoding="utf-8", newline="\n"), n + 1
                out.write(value)
                out.write("\n")
        end()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def write_op_files(op_log: DataFrame, path: str) -> None:
    """A file for each graph, with one JSON array, in a folder `graph_id=...` of its own; an op in a line.

    A graph's ops come to one task, sorted, and are written one by one, so a long log is never a row; brackets and commas are added to the lines. In a shared local
    folder the tasks write the files themselves: Hadoop's local files cost a process or two each for their permissions, and a move by the driver. `_SUCCESS` comes last."""
    last = op_log.groupBy("graph_id").agg(F.max("op_idx").alias("last"))
    begin, end = F.when(F.col("op_idx") == 0, "[").otherwise(""), F.when(F.col("op_idx") == F.col("last"), "]").otherwise(",")
    lines = _op_texts(op_log).join(last, "graph_id").select("graph_id", "op_idx", F.concat(begin, "text", end).alias("value"))
    # By id, so that no file is begun twice.
    lines = lines.repartition("graph_id").sortWithinPartitions("graph_id", "op_idx").select("graph_id", "value")
    spark, files = op_log.sparkSession, lambda df: df.write.partitionBy("graph_id").option("maxRecordsPerFile", 0)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    if uri.getScheme() != "file":
        return files(lines).text(path)
    # The folder, which must be a new one, and in the end its mark.
    none = spark.createDataFrame([], lines.schema)
    files(none).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(path)
    lines.mapInArrow(_write_lines(uri.getPath()), "n bigint").agg(F.sum("n")).collect()
    files(none).mode("append").text(path)


def read_op_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one JSON array of ops each, as one-graph tools and :func:`write_op_files` write them. graph_id is that of the folder, else the
    file's name without its ending."""
    folder = F.regexp_extract("_metadata.file_path", "/graph_id=([^/]*)/[^/]*$", 1)
    # The path is an encoded one, and so is the folder's name in it.
    decoded = lambda c: F.url_decode(F.regexp_replace(c, "[+]", "%2B"))
    name = F.when(folder != "", decoded(decoded(folder))).otherwise(F.regexp_replace("_metadata.file_name", "[.]json$", ""))
    # Folders are listed by as many tasks as elsewhere; Spark takes up to 10,000, which take longer to start than to list a few folders each.
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    try:
        # Spark's reader of whole texts takes several times as long for a small file as that of bytes, but unpacks files.
        read = spark.read.option("recursiveFileLookup", "true")
        plain = read.format("binaryFile").load(path).where(~F.col("path").rlike(f"[.]({'|'.join(PACKED)})$"))
        packed = read.option("pathGlobFilter", f"*.{{{','.join(PACKED)}}}").text(path, wholetext=True)
    finally:
        spark.conf.set(key, before)
    files = plain.select(name.alias("graph_id"), F.col("content").cast("string").alias("value")).unionByName(packed.select(name.alias("graph_id"), "value"))
    return ops_from_json(files)
