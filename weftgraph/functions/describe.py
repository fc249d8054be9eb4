"""Texts for ops and nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def describe_step() -> Column:
    """Over columns of an op log. An op of another kind shows the whole `forward` of its payload."""
    other = F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json("payload"), "$.forward", "variant")), F.to_json("forward"))
    names = F.concat(F.lit("['"), F.array_join("meta.scc", "', '"), F.lit("']"))
    removed = F.format_string("Removed [%s]  (weight=%s)", F.col("forward.target"), F.col("inverse.weight").cast("string"))
    broken = F.format_string("Loop %s → header [%s], back-edges cut", names, F.coalesce("meta.header", F.lit("?")))
    return F.when(F.col("kind") == "remove_node", removed).when(F.col("kind") == "remove_edges", broken).otherwise(F.concat("kind", F.lit(": "), other))


def describe_undo(word: str = "Undo") -> Column:
    loop = F.format_string(f"{word} break-edges (header [%s])", F.coalesce("meta.header", F.lit("?")))
    return F.when(F.col("kind") == "remove_node", F.format_string(f"{word} remove [%s]", F.col("forward.target"))).when(F.col("kind") == "remove_edges", loop).otherwise(F.concat(F.lit(f"{word} "), "kind"))


def describe_redo() -> Column:
    return describe_undo("Redo")


def node_label() -> Column:
    """Over columns node_id and weight."""
    return F.when(F.col("weight") > 1, F.concat("node_id", F.lit("\nw="), F.col("weight").cast("string"))).otherwise(F.col("node_id"))
