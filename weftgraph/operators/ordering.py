"""Numbering the rows of graphs in an order, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.shared import settled


#: Ops of a graph that lie in one window; a graph has a row for each such chunk beyond that.
CHUNK = 1 << 16


def large_graphs(rows: DataFrame) -> DataFrame:
    """(graph_id, n) of the graphs with more than CHUNK rows; there is one for each CHUNK rows at most, so a join may broadcast them."""
    return settled(rows.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK))


#: Rows of a graph that are numbered by one window.
WINDOW = 1 << 12


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with the column `name`: their number from 0 in the ascending order of columns within their graph_id, nulls first.

    Where no graph has more than WINDOW rows each is a window, else all are dealt by ranges. The order has to tell all rows of a graph apart."""
    rows = settled(rows)
    if not rows.groupBy("graph_id").count().where(F.col("count") > WINDOW).isEmpty():
        return _by_ranges(rows, order, name)
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy("graph_id").orderBy(*order)) - 1).cast("bigint"))


def _by_ranges(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """:func:`numbered` where a graph is large.

    Rows are dealt by ranges of (graph_id, order) and sorted within, so a large graph lies in as many ranges as it fills. A row's number is its
    place in its range, less where its graph begins there, plus the graph's rows in the ranges before. What is gathered of a graph is a
    number for each range that holds some of it.
    """
    dealt = rows.repartitionByRange("graph_id", *order).sortWithinPartitions("graph_id", *order)
    # The upper bits are the range, the others count its rows in order.
    dealt = settled(dealt.withColumn("_place", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_place", 33))
    held = dealt.groupBy("graph_id", "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    spans = held.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("_range", "_first", "_n"))).alias("_spans"))
    begin = "x._first - aggregate(slice(_spans, 1, i), 0L, (n, y) -> n + y._n)"
    begins = spans.select("graph_id", F.expr(f"inline(transform(_spans, (x, i) -> named_struct('_range', x._range, '_begin', {begin})))"))
    return dealt.join(begins, ["graph_id", "_range"]).withColumn(name, F.col("_place") - F.col("_begin")).select(*rows.columns, name)


def before_each(rows: DataFrame, sums: list[str], tops: list[str]) -> DataFrame:
    """rows with the sums (0 at first) and greatest values (null at first) of columns over their graph's rows of smaller op_idx, as `<column>_before`.

    Rows lie in chunks by op_idx, whose own totals are added up in turn, so one large graph is many tasks' work. Nulls count for nothing; rows
    of one op_idx would count for each other in no defined order."""
    rows = rows.withColumn("_chunk", F.floor(F.col("op_idx") / CHUNK))
    totals = rows.groupBy("graph_id", "_chunk").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in tops))
    earlier = Window.partitionBy("graph_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("graph_id", "_chunk", *(F.sum(c).over(earlier).alias(f"_{c}") for c in sums), *(F.max(c).over(earlier).alias(f"_{c}") for c in tops))
    within = Window.partitionBy("graph_id", "_chunk").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, -1)
    here = {c: F.sum(c).over(within) for c in sums} | {c: F.max(c).over(within) for c in tops}
    rows = rows.withColumns({f"{c}_before": x for c, x in here.items()}).join(totals, ["graph_id", "_chunk"])
    found = {f"{c}_before": F.coalesce(f"{c}_before", F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)) for c in sums} | {f"{c}_before": F.greatest(f"{c}_before", f"_{c}") for c in tops}
    return rows.withColumns(found).drop("_chunk", *(f"_{c}" for c in [*sums, *tops]))
