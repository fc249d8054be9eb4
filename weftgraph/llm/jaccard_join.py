"""Exact Jaccard self-join of word-shingle sets by prefixes with token combinations.

Theory. Order all tokens in any fixed way. Two sets with Jaccard similarity of at least t share at least
ceil(t * n) tokens, n the larger size, so their prefixes of n - ceil(t * n) + 1 tokens share a token, and prefixes
longer by k - 1 share k tokens (or all of them). Here the order puts frequent tokens last. If the first shared
token is a rare one, both prefixes hold it: rare tokens are indexed singly. If it is a frequent one, all shared
tokens are frequent, and the extended prefixes share k frequent ones: those are indexed as k-token combinations,
which are far rarer than the tokens. So no pair is lost, whatever the class of frequent tokens is; the class only
saves work. Near copies share very many combinations, and each would bring the pair
again; so a key counts only if both sets have room behind its last token for what they must share, given that
it is the k-th shared one. A long set would have too many combinations: above a size all frequent tokens are indexed singly, and by sets that are
a little smaller in both ways, so two sets that can be linked always share a way. The class lives in a bitmap of a fixed size, the same in each task. Of two sets the smaller one needs only the
prefix for partners that are no smaller, n - ceil(2t / (1 + t) * n) + 1 tokens (indexed), the larger one the full one.

Copies. Sets that are equal are joined once, through their smallest id. Near copies are first linked as stars
around the smallest id that shares one of a few minimum hashes with them, each star's link verified. A group whose
smallest ids lie apart from it is left in many components that share minimum hashes; further stars around other nodes join these. Then only
tokens that occur in two components are joined, on pairs of different components. So a group of n near copies costs some n verifications a
round. Sets that are nearly similar enough are all compared: no link may be lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._tables import bitmap, components, in_bitmap, scratch, small_batches, stored
from weftgraph.llm._text import BASE, LOWER, gather_ranges, mix, released, sorted_distinct, text_chunks, word_hashes, word_spans

#: Tokens below this share of the hash space are counted to find the frequent ones: prefixes consist of the
#: smallest hashes, so the others hardly ever get into one.
COUNTED_SHARE = 0.3
#: Texts with up to so many shingles, and those that share a minimum hash with many others, count all their
#: tokens: they may consist of shared passages.
COUNTED_WHOLE = 128


def _sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, buf, offsets in text_chunks(texts):
        low = LOWER[buf]
        starts, ends, before = word_spans(low, offsets)
        word = word_hashes(low, starts, ends)
        if len(word) >= words:
            shingle = np.zeros(len(word) - words + 1, np.uint64)
            for i in range(words):
                shingle = mix(shingle * BASE ^ word[i : len(word) - words + 1 + i]) if i else word[: len(shingle)].copy()
        else:
            shingle = np.zeros(0, np.uint64)
        for a, b in zip(before.tolist(), before[1:].tolist(), strict=False):
            if b - a >= words:
                yield sorted_distinct(shingle[a : b - words + 1])
            elif b > a:
                one = word[a : a + 1].copy()
                for i in range(a + 1, b):
                    one = mix(one * BASE ^ word[i])
                yield mix(one + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _profile(words: int, keys: int):  # noqa: ANN202
    """For each text: set size, two sums that identify its set, and its smallest hashes under several mixings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, low = [], [], [], []
            for s in _sets(batch.column(1), words):
                n.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mix(s ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64).view(np.int64)))
                low.append([int(mix(s + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min().view(np.int64)) for j in range(keys)] if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(low, pa.list_(pa.int64()))], ["id", "n", "h1", "h2", "low"])

    return run


def _full_sets(words: int, wanted):  # noqa: ANN001, ANN202
    """(id, set as bytes) of texts whose id may be wanted; wanted: a broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column(0).to_numpy())))
            if batch.num_rows:
                sets = [s.tobytes() for s in _sets(batch.column(1), words)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "tokens"])

    return run


def _compare(percent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _counted(words: int, skip, whole):  # noqa: ANN001, ANN202
    """Tokens that count for the class of frequent ones, of texts that aren't skipped; all tokens of the texts in
    whole (both broadcast bitmaps of ids)."""
    edge = np.uint64(int(COUNTED_SHARE * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(~in_bitmap(skip.value, batch.column(0).to_numpy())))
            every = in_bitmap(whole.value, batch.column(0).to_numpy())
            held = [s if e or len(s) <= COUNTED_WHOLE else s[: np.searchsorted(s, edge)] for s, e in zip(_sets(batch.column(1), words), every, strict=True)]
            for i in range(0, len(held), 512):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held[i : i + 512]).view(np.int64))], ["token"])

    return run


def _combined(rest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the last token) of all combinations of k tokens."""
    at = np.arange(len(rest))[:, None]
    for _ in range(k - 1):  # each combination with all later places
        more = len(rest) - 1 - at[:, -1]
        at = np.hstack([np.repeat(at, more, axis=0), gather_ranges(at[:, -1] + 1, more)[:, None]])
    mixed = rest[at[:, 0]]
    for j in range(1, k):
        mixed = mix(mixed * BASE ^ rest[at[:, j]])
    return mixed, at[:, -1]


def _prefixes(words: int, percent: int, k: int, frequent, long: int):  # noqa: ANN001, ANN202
    """(id, n, keys, marks): single rare tokens and combinations of k frequent ones of each text's prefix. A mark is twice the place of a
    single token, or that of a combination's last token less k - 1, plus 1 if the key also lies in the shorter prefix that suffices
    against sets that are no smaller: from that place on a set has as many tokens as it can share, if the combination is that of the first k shared
    tokens. Sets of more than `long` tokens have their frequent tokens singly, and so do, besides the
    combinations, those that are large enough to be linked with such a set, and those so small that k - 1 shared tokens can link them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks, sizes = [], [], []
            for s in _sets(batch.column(1), words):
                n = len(s)
                sizes.append(n)
                p = n + (-percent * n) // 100 + 1 if n else 0
                short = n + (-2 * percent * n) // (100 + percent) + 1
                often = in_bitmap(frequent.value, s)
                found = [s[~often][:p]]
                r = len(found[0])
                places = [np.arange(r)]
                rest = s[often][: p + k - 1 - r] if r < p else s[:0]
                if len(rest) and (100 * n > percent * long or percent * n <= 100 * (k - 1)):
                    found.append(mix(rest[: p - r] ^ np.uint64(0xA5A5)))
                    places.append(r + np.arange(len(found[-1])))
                if n <= long:
                    mixed, last = _combined(rest, k)
                    found.append(mixed)
                    places.append(r + last - k + 1)
                place = np.concatenate(places)
                keys.append(np.concatenate(found).tobytes())
                marks.append((2 * place + (place < short)).astype(np.int32).tobytes())
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip([sizes, keys, marks], kinds, strict=True))], ["id", "n", "keys", "marks"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, marks = ([np.frombuffer(x.as_buffer(), t) for x in batch.column(c)] for c, t in (("keys", np.int64), ("marks", np.int32)))
        for i in range(0, len(keys), 512):
            sizes = [len(x) for x in keys[i : i + 512]]
            index = pa.array(np.repeat(np.arange(i, i + len(sizes)), sizes))
            rows = [pa.array(np.concatenate(x[i : i + 512])) for x in (keys, marks)]
            yield pa.RecordBatch.from_arrays([*rows, *(batch.column(c).take(index) for c in ("id", "n", "component"))], ["key", "mark", "id", "n", "component"])


def _maybe(bits):  # noqa: ANN001, ANN202
    """Rows whose key may be in a broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, batch.column("key").to_numpy())))

    return run


def verified(rows: DataFrame, pairs: DataFrame, words: int, percent: int, log2_bits: int = 25) -> DataFrame:
    """Those of the pairs (a, b) of ids whose sets are similar enough, by comparing whole sets."""
    spark = rows.sparkSession
    with small_batches(spark, 500), scratch(spark) as keep:
        pairs = stored(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
        wanted = spark.sparkContext.broadcast(bitmap(ids, "id", log2_bits))
        sets = stored(rows.mapInArrow(released(_full_sets(words, wanted)), "id bigint, tokens binary"), "sets")
        both = pairs.join(sets.withColumnsRenamed({"id": "a", "tokens": "ta"}), "a").join(sets.withColumnsRenamed({"id": "b", "tokens": "tb"}), "b")
        return keep(both.mapInArrow(released(_compare(percent)), "a bigint, b bigint").distinct(), "verified")


def linked_further(rows: DataFrame, keyed: DataFrame, links: DataFrame, words: int, percent: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """links with those that further stars find, and their components (node, component).

    keyed: (rep, n, low), a row for each minimum hash of a node. Where `parts` components or more share a minimum hash, one node of each, another in each
    round, is compared with that of one of them. A round has no more pairs than (minimum hash, component); it joins the components of near copies
    whose first hub lies apart from all of them. Rounds go on while one pair in eight is a link, and each link leaves a component less.
    """
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    # A rep that repeats with several sets is one node.
    keyed = stored(keyed.groupBy("rep", "low").agg(F.max("n").alias("n")), "keyed")
    for step in itertools.count():
        found = stored(components(links, "a", "b"), "found")
        labelled = keyed.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        drawn = F.xxhash64("rep", F.lit(step))
        one = labelled.groupBy("low", "component").agg(F.min(F.struct(drawn.alias("at"), "rep", "n")).alias("one"))
        hubs = one.groupBy("low").agg(F.count("*").alias("size"), F.min("one").alias("hub")).where(F.col("size") >= parts)
        hubs = hubs.select("low", F.col("hub.rep").alias("a"), F.col("hub.n").alias("m"))
        pairs = one.select("low", F.col("one.rep").alias("b"), F.col("one.n").alias("n")).join(hubs, "low").where(f"a <> b and {fits}")
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
        tried = pairs.count()
        if not tried:
            return links, found
        more = verified(rows, pairs, words, percent)
        linked = more.count()
        if linked:
            links = links.unionByName(more)
        if 8 * linked < tried:
            return links, stored(components(links, "a", "b"), "found") if linked else found


def jaccard_components(
    docs: DataFrame, words: int = 4, percent: int = 85, k: int = 2, frequent_from: int = 12, minhashes: int = 8, long: int = 400, id_col: str = "doc_id", text_col: str = "text", log2_bits: int = 26
) -> DataFrame:
    """(id, n_shingles, component_id) for every row: components of the graph in which two documents are linked if
    100 * |A & B| >= percent * |A | B|, A and B being their sets of `words`-word shingles.

    A-Z count as a-z; words are runs of other than ASCII white space. A text with fewer words has one shingle, all
    its words. An empty or null text has no shingle and no link. component_id is the smallest id that is reachable.
    Rows that repeat an id are one node with the links of each; n_shingles is that of the row. Rows with a null id keep their size and get
    a null component. An empty table gives no rows. frequent_from: how many components make a token frequent;
    minhashes: how many star keys; long: from which set size on frequent tokens aren't combined; none changes the result. Tokens are 64-bit hashes of shingles.
    """
    with small_batches(docs.sparkSession, 1000), scratch(docs.sparkSession) as keep:
        return keep(_joined(docs, words, percent, k, frequent_from, minhashes, long, id_col, text_col, log2_bits), "components")


def _joined(docs: DataFrame, words: int, percent: int, k: int, frequent_from: int, minhashes: int, long: int, id_col: str, text_col: str, log2_bits: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = stored(rows.mapInArrow(released(_profile(words, minhashes)), "id bigint, n bigint, h1 bigint, h2 bigint, low array<bigint>"), "sets")
    rows = rows.where("id is not null")
    # Equal sets: one node, the smallest id. An id that repeats with several sets has several nodes.
    nodes = sizes.where("id is not null and n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.first("low").alias("low"))
    nodes = stored(nodes, "nodes")
    equal = sizes.where("n > 0").join(nodes.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).where("id <> rep").select(F.col("id").alias("b"), F.col("rep").alias("a"))
    # Stars: each node is compared with the smallest id of each of its minimum hashes.
    keyed = nodes.select("rep", "n", F.explode("low").alias("low"))
    stars = keyed.groupBy("low").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    stars = stored(stars.select("low", "size", F.col("hub.rep").alias("a"), F.col("hub.n").alias("m")), "stars")
    whole = spark.sparkContext.broadcast(bitmap(keyed.join(stars.where(F.col("size") >= frequent_from), "low").select("rep"), "rep", log2_bits))
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    pairs = keyed.join(stars, "low").where(f"a <> rep and {fits}").select("a", F.col("rep").alias("b")).distinct()
    links = verified(rows, pairs, words, percent)
    links, found = linked_further(rows, keyed, links, words, percent, frequent_from)
    # The class of frequent tokens: in many components, counted over one text of each.
    others = spark.sparkContext.broadcast(bitmap(found.where("node <> component").select("node").unionByName(equal.select(F.col("b").alias("node"))), "node", log2_bits))
    counts = rows.mapInArrow(released(_counted(words, others, whole)), "token bigint").groupBy("token").count()
    frequent = spark.sparkContext.broadcast(bitmap(counts.where(F.col("count") >= frequent_from), "token", log2_bits))
    # Prefix keys that two components share.
    labels = nodes.select(F.col("rep").alias("id")).distinct().join(found.withColumnRenamed("node", "id"), "id", "left")
    labels = labels.select("id", F.coalesce("component", "id").alias("component"))
    keys = rows.mapInArrow(released(_prefixes(words, percent, k, frequent, long)), "id bigint, n bigint, keys binary, marks binary").join(labels, "id")
    keys = stored(keys.mapInArrow(_spread, "key bigint, mark int, id bigint, n bigint, component bigint"), "keys")
    shared = stored(keys.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "shared")
    kept = spark.sparkContext.broadcast(bitmap(shared, "key", log2_bits))
    keys = stored(keys.mapInArrow(_maybe(kept), keys.schema).join(shared, "key").select("key", "mark", "id", "n", "component"), "shared")
    left = keys.where("mark % 2 = 1").select("key", F.col("id").alias("a"), "n", F.expr("n - mark div 2").alias("rest_a"), F.col("component").alias("ca"))
    right = keys.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.expr("n - mark div 2").alias("rest_b"), F.col("component").alias("cb"))
    # Enough tokens are left from the place in the mark on, on both sides.
    room = f"({100 + percent}) * least(rest_a, rest_b) >= {percent} * (n + m)"
    pairs = left.join(right, "key").where(f"ca <> cb and (n < m or n = m and a < b) and {fits} and {room}")
    more = verified(rows, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), words, percent)
    every = links.unionByName(more).unionByName(equal.select("a", "b"))
    final = components(every, "a", "b")
    out = sizes.select("id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
