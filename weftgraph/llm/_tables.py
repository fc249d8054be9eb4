"""Spark helpers that the operators share: tables in the shared folder, bitmaps of a fixed size, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.shared import scratch, shared_dir
from weftgraph.operators.shared import written as stored

__all__ = ["bitmap", "components", "in_bitmap", "scratch", "shared_dir", "small_batches", "stored"]


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most, for jobs that run inside: rows with long arrays else add up in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bitmap(keys: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """A bitmap of the low log2_bits bits of long keys (ids or hashes).

    It has 2**log2_bits bits whatever the input's size, so it may be broadcast; the driver gets at most
    2**(log2_bits - 6) words. Keys that share a place look present too: callers must only use it where such a
    false "present" costs time, not rows.
    """
    mask = (1 << log2_bits) - 1
    words = (
        keys.where(F.col(column).isNotNull())
        .select(F.expr(f"`{column}` & {mask}L").alias("place"))
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63L as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the places of keys are set in a :func:`bitmap`."""
    place = keys.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of links the smallest node that it reaches. Links with a null end and of a node with itself
    count for nothing; repeated links count once; no links give no rows.

    Alternating large-star and small-star steps; each groups by node with a map-side min and joins the minimum
    back, so a hub with very many links is a skewed join that AQE splits, never a list in one task.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    return found.unionByName(roots)
