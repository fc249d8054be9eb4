"""How filters act together: five document filters, applied in every order, and what each adds to the others.

A document's failures are a mask of five bits. Four of them are its own affair. The fifth, an exact copy of a text with a smaller id,
comes from radix tries: texts are dealt to ranges by prefixes that are as long as it takes for no prefix to have too many
texts, each range inserts its whole texts into a compressed trie whose terminals hold the least id, and a walk over the rows flags those
above it. What is left for the orders is a count for each part and mask, so 120 orders cost as much as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._tables import stored
from weftgraph.llm._text import released

#: Bytes of a prefix, level by level; beyond the last one the whole text deals.
PREFIXES = tuple(8 * 4**i for i in range(7))
#: At most so many prefixes of a level are too frequent and go on to the next one, whatever the input's size.
FREQUENT = 1 << 16
#: Bytes of text that a task compares by itself before they are dealt.
CHUNK = 1 << 25
FILTERS = "ABCDE"
CAPITALS, SIGNS, INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


class Trie:
    """A radix trie: an edge's label is as long as no text branches off in it. A terminal holds the least id that is not null."""

    def __init__(self) -> None:
        self.labels, self.children, self.least = [b""], [{}], [None]

    def _node(self, label: bytes, least: object = None) -> int:
        self.labels.append(label)
        self.children.append({})
        self.least.append(least)
        return len(self.labels) - 1

    def insert(self, text: bytes, key: object) -> int:
        """The terminal of text, which takes key if that is less than its own."""
        node, at = 0, 0
        while at < len(text):
            child = self.children[node].get(text[at])
            if child is None:
                child = self.children[node][text[at]] = self._node(text[at:])
                node, at = child, len(text)
                break
            label = self.labels[child]
            if not text.startswith(label, at):
                n = min(len(label), len(text) - at)
                differ = np.frombuffer(label, np.uint8, n) != np.frombuffer(text, np.uint8, n, at)
                n = int(differ.argmax()) if differ.any() else n
                upper = self._node(label[:n])
                self.labels[child] = label[n:]
                self.children[upper][label[n]] = child
                self.children[node][text[at]] = child = upper
            node, at = child, at + len(self.labels[child])
        if key is not None and (self.least[node] is None or key < self.least[node]):
            self.least[node] = key
        return node


def own_mask(text: bytes) -> int:
    """The bits of filters A to D that a text fails."""
    words = text.split()
    points = len(text.translate(None, INNER))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * points, len(text.translate(None, SIGNS)) < len(text))
    return sum(bit << i for i, bit in enumerate(fails))


def _prefix_hashes(text: bytes) -> list[int]:
    """A hash for each level; a text that is no longer than a level ends there, as that one is the whole text."""
    out = []
    for n in PREFIXES:
        out.append(int.from_bytes(hashlib.blake2b(text[:n], digest_size=8).digest(), "little", signed=True))
        if n >= len(text):
            break
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, mask, text, prefixes). Rows that a row of the same chunk makes copies have their mask whole and no text."""

    def judged(chunk: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ends = Trie(), []
        texts = [[b or b"" for b in batch.column(2).cast(pa.binary()).to_pylist()] for batch in chunk]
        ids = [batch.column(0).to_pylist() for batch in chunk]
        for some, keys in zip(texts, ids, strict=True):
            ends.append([trie.insert(t, k) for t, k in zip(some, keys, strict=True)])
        for batch, some, keys, nodes in zip(chunk, texts, ids, ends, strict=True):
            copies = [k is not None and k > trie.least[n] for k, n in zip(keys, nodes, strict=True)]
            masks = [own_mask(t) | c << 4 for t, c in zip(some, copies, strict=True)]
            rest = [None if c else t for t, c in zip(some, copies, strict=True)]
            prefixes = [None if c else _prefix_hashes(t) for t, c in zip(some, copies, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(rest, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["id", "part", "mask", "text", "prefixes"])

    chunk, size = [], 0
    for batch in batches:
        chunk.append(batch)
        size += batch.column(2).nbytes
        if size >= CHUNK:
            yield from judged(chunk)
            chunk, size = [], 0
    if chunk:
        yield from judged(chunk)


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, mask) of a range: all its texts go into one trie, then each row is held against the least id of its terminal."""
    trie, seen = Trie(), []
    for batch in batches:
        nodes = [trie.insert(t, k) for t, k in zip(batch.column(3).to_pylist(), batch.column(0).to_pylist(), strict=True)]
        seen.append((batch.select([0, 1, 2]), nodes))
    for rows, nodes in seen:
        masks = [m | (k is not None and k > trie.least[n]) << 4 for m, k, n in zip(rows.column(2).to_pylist(), rows.column(0).to_pylist(), nodes, strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(masks, pa.int32())], ["id", "part", "mask"])


def dealing_keys(open_rows: DataFrame, range_texts: int) -> DataFrame:
    """open_rows (text, prefixes) with the column `key`: the shortest prefix of the text with at most range_texts rows (or a share of 1 / FREQUENT of all), else the text."""
    rows, length = open_rows, F.lit(None).cast("int")
    counted = open_rows.select("prefixes")
    limit = max(range_texts, open_rows.count() // FREQUENT)
    heavy_before = None
    for level, n in enumerate(PREFIXES):
        place = F.get("prefixes", F.lit(level))
        if heavy_before is not None:
            counted = counted.join(F.broadcast(heavy_before), F.get("prefixes", F.lit(level - 1)) == F.col("often"), "left_semi")
        # FREQUENT rows of 8 bytes at most, as each stands for more than limit rows.
        heavy = stored(counted.where(place.isNotNull()).groupBy(place.alias("often")).count().where(F.col("count") > limit).select("often"), "prefixes")
        rows = rows.join(F.broadcast(heavy.withColumnRenamed("often", f"often{level}")), place == F.col(f"often{level}"), "left")
        length = F.coalesce(length, F.when(F.col(f"often{level}").isNull(), n))
        heavy_before = heavy
        if heavy.isEmpty():
            break
    return rows.withColumn("key", F.when(length.isNull(), F.col("text")).otherwise(F.substring("text", F.lit(1), length))).select(*open_rows.columns, "key")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", range_texts: int = 100) -> DataFrame:
    """(id, part, mask) for every row: the bit of each filter of ABCDE, from 1 to 16, that the row fails.

    A: fewer than 200 words; B: fewer than half of the words are different; C: more than 2 % of the code points are A-Z; D: any of
    ``#$%&*|``; E: a row with a smaller id has the same whole text. A null text counts as empty, a null part as ''. A row with a
    null id is no copy and makes none; rows that share id and text make no copies of each other. An empty table gives no rows. Other
    columns of docs may have any names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    judged = stored(rows.mapInArrow(released(_judge), f"id {kind}, part string, mask int, text binary, prefixes array<bigint>"), "judged")
    dealt = dealing_keys(judged.where("text is not null"), range_texts).select("id", "part", "mask", "text", "key").repartitionByRange("key")
    flagged = dealt.select("id", "part", "mask", "text").mapInArrow(released(_flag), f"id {kind}, part string, mask int")
    return flagged.unionByName(judged.where("text is null").select("id", "part", "mask"))


def mask_counts(found: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic) of :func:`masks`: rows, those of quality 1 and those of toxic 1. An id with several labels has
    each that one of them states; ids without have none."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows of one id are one row of the join.
    each = found.groupBy("id", "part", "mask").agg(F.count("*").alias("n")).join(known, "id", "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("n"))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("good").alias("good"), total("toxic").alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of (part, mask, n, good, toxic).

    What a set of filters leaves doesn't depend on their order: each row counts for the sets whose filters it passes, 32 sets for a
    part. A step is the difference of two of them; shapley weighs those differences by how many orders have them.
    """
    left = counts.withColumn("s", F.explode(F.expr("filter(sequence(0, 31), s -> s & mask = 0)")))
    left = left.groupBy("part", "s").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    # At most 32 entries for a part.
    sets = left.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("n", "good", "toxic")))).alias("left"))
    # A part all of whose rows fail has no row for some sets.
    sets = sets.select("part", F.expr("transform(sequence(0, 31), s -> coalesce(left[s], named_struct('n', 0L, 'good', 0L, 'toxic', 0L)))").alias("left"))
    orders = " ".join("".join(p) for p in permutations(FILTERS))
    steps = sets.select("part", "left", F.explode(F.split(F.lit(orders), " ")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = "shiftleft(1, ascii(substring(filter_order, {0}, 1)) - 65)"
    steps = steps.withColumn("before", F.expr(f"aggregate(filter(sequence(1, 5), i -> i < step), 0, (s, i) -> s | {bit.format('i')})")).withColumn("bit", F.expr(bit.format("step")))
    orders_with = "element_at(array(24L, 6L, 4L, 6L, 24L), cast(bit_count(s) as int) + 1)"
    share = f"aggregate(filter(sequence(0, 31), s -> s & bit = 0), 0L, (t, s) -> t + {orders_with} * (left[s].n - left[s | bit].n))"
    lost = lambda c: f"left[before].{c} - left[before | bit].{c}"
    return steps.selectExpr(
        "part", "filter_order", "step", "left[before | bit].n as kept", f"{lost('n')} as removed", f"left[0].n - left[bit].n - ({lost('n')}) as redundant",
        "left[31 - bit].n - left[31].n as unique_fails", f"{lost('good')} as good_lost", f"{lost('toxic')} as toxic_lost", f"{share} as shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """:func:`interactions` of all rows of docs, by part."""
    return interactions(mask_counts(masks(docs, **options), labels, options.get("id_col", "doc_id")))
