"""Removal of repeated byte strings by suffix arrays (Larsson and Sadakane, 2007; Kasai et al., 2001).

Strings of `length` bytes are dealt to shards by their anchors: the piece of ANCHOR bytes with the smallest hash,
the leftmost of several. Equal strings have equal anchors at equal places, so they meet in one shard, and shards
need no comparison of all with all. Runs of strings that share an anchor travel as one segment; an anchor that
occurs once in all documents sends nothing. In a shard equal segments collapse to their first occurrence; where an
anchor still has different segments, a suffix array over them, refined by doubling to `length` bytes, and the
common prefixes of its neighbours give the classes of equal strings.

Anchors with very many occurrences are dealt out by document instead, so no group grows with one passage. Each shard
keeps the first occurrence of each of their segments, and of equal segments of all shards again the first stays. What is
left are different segments with the same anchor. They are dealt out by document once more; each shard's suffix array
and common prefixes give its different strings in order, a sorted run. Shards are merged by binary search: runs are cut at
common borders, and in each range between two borders the runs are merged pairwise by looking up the strings of the one in
the other, whole strings compared. Of equal strings the first occurrence stays, the other ones are repeats. A string
stands in a run once at most, so even one in every document comes only as often as there are shards. A run has many times
the bytes of its segments and is never stored: it is made once for the borders, and again to be cut at them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._tables import bitmap, in_bitmap, stored
from weftgraph.llm._text import gather_ranges, mix, piece_hashes, prefix_sums, rolling_hashes, text_chunks

ANCHOR = 32
#: From so many occurrences on an anchor is dealt out by document.
HOT = 2000
ROW = "shard int, anchor bigint, segment bigint, id bigint, start int, n int, place int, bytes binary"
RANGE = "id bigint, first int, last int, anchor bigint, segment bigint, n int, place int, bytes binary"
#: A block of a sorted run (strings of it at even distances, and how many it has), or a range of repeats.
RUN = "id bigint, first int, last int, sample binary, size int"
PIECE = "range int, keys binary, ids binary, starts binary"
CUT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"
#: Rows of a shard in the first round, segments of one in the second.
SHARD_ROWS, SHARD_SEGMENTS = 60_000, 5_000
#: Bytes of segments, besides one anchor's, over which a suffix array is made in the first round: it takes some 100 times as much memory.
ARRAY_BYTES = 1 << 20
#: Strings of a block of a run, and of a range.
BLOCK, RANGE_STRINGS = 5_000, 100_000
#: Strings of each block, and of all, among which the borders of the ranges are chosen; where they lie changes no result.
BLOCK_SAMPLE, SAMPLE = 16, 20_000


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, anchor place, first start, last start) of the runs of strings that share an anchor."""
    empty = np.zeros(0, np.int64)
    if len(buf) < length:
        return empty, empty.view(np.uint64), empty, empty, empty
    hashes = rolling_hashes(buf, ANCHOR)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    reach, want = 1, length - ANCHOR + 1
    while 2 * reach <= want:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if want > reach:
        low = np.minimum(low[: len(low) - (want - reach)], low[want - reach :])
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = gather_ranges(offsets[:-1], sizes)
    if not len(starts):
        return empty, empty.view(np.uint64), empty, empty, empty
    place = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Within a text the anchors' places grow with the starts, so each anchor has one run.
    edges = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last = starts[edges], starts[np.append(edges[1:], len(starts)) - 1]
    return np.searchsorted(offsets, first, "right") - 1, hashes[place[edges]], place[edges], first, last


def _anchor_hashes(length: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offsets in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(buf, offsets, length)[1].view(np.int64))], ["anchor"])

    return run


def _segments(length: int, shards: int, repeated, hot):  # noqa: ANN001, ANN202
    """Occurrences of repeated anchors. A segment's bytes go with its first occurrence in a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, buf, offsets in text_chunks(batch.column(1)):
                text, anchor, place, first, last = anchors(buf, offsets, length)
                kept = in_bitmap(repeated.value, anchor)
                text, anchor, place, first, last = (x[kept] for x in (text, anchor, place, first, last))
                if not len(text):
                    continue
                segment = mix(piece_hashes(prefix_sums(buf), first, last + length) ^ (place - first).astype(np.uint64))
                owner = ids[row + text]
                often = in_bitmap(hot.value, anchor)
                shard = np.where(often, mix(anchor ^ owner.view(np.uint64)), anchor) % np.uint64(shards)
                order = np.lexsort((first, owner, segment, shard))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (segment[order][1:] != segment[order][:-1]) | (shard[order][1:] != shard[order][:-1])
                raw, mine = buf.tobytes(), np.zeros(len(order), bool)
                mine[order] = fresh
                data = [raw[a : b + length] if m else None for a, b, m in zip(first.tolist(), last.tolist(), mine.tolist(), strict=True)]
                cols = [shard.astype(np.int32), anchor.view(np.int64), segment.view(np.int64), owner, (first - offsets[text]).astype(np.int32), (last - first + 1).astype(np.int32), (place - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(data, pa.binary())], ["shard", "anchor", "segment", "id", "start", "n", "place", "bytes"])

    return run


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes (8 at least). Only groups that are still tied are sorted
    again: by the ranks of the suffixes h bytes further on, h doubling (Larsson and Sadakane)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : n + i]
    order = np.argsort(key)
    rank = np.zeros(n, np.uint32)
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = np.flatnonzero(~head | ~np.append(head[1:], True))
    h = 8
    while h < depth and len(tied):
        step = min(h, depth - h)
        at = order[tied]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + step, n - 1)]
        again = np.argsort(key)
        at, key = at[again], key[again]
        order[tied] = at
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = tied[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        tied = tied[~head | ~np.append(head[1:], True)]
        h += step
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it, within its segment and up to limit: Kasai's
    scan, one lane for each segment (starts and ends), from a suffix to the next with one byte less to begin with."""
    n = len(data)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    end_of = np.zeros(n, np.int64)
    end_of[gather_ranges(starts, ends - starts)] = np.repeat(ends, ends - starts)
    out = np.zeros(n, np.int64)
    by_size = np.argsort(starts - ends, kind="stable")
    starts, ends = starts[by_size], ends[by_size]
    have = np.zeros(len(starts), np.int64)
    lanes = len(starts)
    for j in range(int((ends - starts).max(initial=0))):
        lanes = int(np.searchsorted(starts - ends, -j, "left"))
        at, have = starts[:lanes] + j, np.maximum(have[:lanes] - 1, 0)
        other = before[at]
        most = np.minimum(np.minimum(end_of[at] - at, np.where(other >= 0, np.maximum(end_of[other] - other, 0), 0)), limit)
        have = np.minimum(have, most)
        live = np.flatnonzero(have < most)
        while len(live):
            live = live[data[at[live] + have[live]] == data[other[live] + have[live]]]
            have[live] += 1
            live = live[have[live] < most[live]]
        out[where[at]] = have
    return out


def _classes(held: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, segment, offset, class) of all strings of the segments, in the order of their suffixes; place in bytes: see
    :func:`_begins`. Equal strings have the same class, and classes grow with the strings."""
    # A separator of its own behind each segment makes all suffixes different: Kasai's bound needs their full order.
    sizes = np.array([len(x) for x in held], np.int64)
    flat = np.frombuffer(b"".join(y for i, x in enumerate(held) for y in (x, i.to_bytes(8, "big"))), np.uint8)
    begins = _begins(sizes)
    order = suffix_array(flat, int(sizes.max()) + 8)
    shared = common_prefixes(flat, order, begins, begins + sizes, length)
    kind = np.cumsum(shared < length)
    piece = np.repeat(np.arange(len(sizes)), sizes + 8)[order]
    offset = order - begins[piece]
    string = np.flatnonzero(offset <= sizes[piece] - length)
    return flat, piece[string], offset[string], kind[string]


def _begins(sizes: np.ndarray) -> np.ndarray:
    """Where segments of these sizes begin, each with a separator of eight bytes behind it."""
    return np.cumsum(sizes + 8) - sizes - 8


def _again(kind: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by class, id and start, and in it where classes begin and which strings are repeats. Equal ids and starts are one place."""
    by = np.lexsort((at, owner, kind))
    kind, owner, at = kind[by], owner[by], at[by]
    fresh = np.concatenate([[True], kind[1:] != kind[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(kind)), 0))
    return by, np.flatnonzero(fresh), np.flatnonzero((owner != owner[first]) | (at != at[first]))


def _blocks(anchor: np.ndarray, sizes: np.ndarray) -> list[slice]:
    """Stretches of segments in the order of their anchors, of some ARRAY_BYTES each. Equal strings have equal anchors, and no anchor is parted."""
    ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)) if len(anchor) else np.zeros(0, np.int64)
    number = (np.cumsum(sizes)[ends - 1] - 1) // ARRAY_BYTES
    cuts = ends[np.append(number[1:] != number[:-1], True)].tolist() if len(ends) else []
    return [slice(a, b) for a, b in zip([0, *cuts], cuts, strict=False)]


def _repeats(anchor, segment, ids, start, n, place, data, length):  # noqa: ANN001, ANN202
    """For rows in the order of (anchor, segment, id, start): whether a row is its segment's first occurrence, and the
    rows' ranges of repeated strings as (row, first, last). data: bytes by row, somewhere in each segment."""
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])
    head = np.flatnonzero(fresh)
    number = np.cumsum(fresh) - 1
    # Equal ids and starts are one place, from repeated rows.
    lead = (ids == ids[head][number]) & (start == start[head][number])
    later = np.flatnonzero(~lead)
    ranges = [np.stack([later, start[later], start[later] + n[later] - 1], axis=1)]
    same = np.zeros(len(head), bool)
    same[1:] = anchor[head][1:] == anchor[head][:-1]
    several = np.flatnonzero(same | np.append(same[1:], False))
    held = {k: d for k, d in zip(number.tolist(), data, strict=True) if d is not None} if len(several) else {}
    for block in _blocks(anchor[head][several], np.array([len(held[k]) for k in several.tolist()], np.int64)):
        block = several[block]
        _, piece, offset, kind = _classes([held[k] for k in block.tolist()], length)
        row = head[block][piece]
        owner, at = ids[row], start[row] + offset
        by, _, again = _again(kind, owner, at)
        row, at = row[by], at[by]
        row, at = row[again], at[again]
        by = np.lexsort((at, row))
        row, at = row[by], at[by]
        if len(row):
            edges = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
            ranges.append(np.stack([row[edges], at[edges], at[np.append(edges[1:], len(at)) - 1]], axis=1))
    return fresh, lead, np.concatenate(ranges)


def _shard(length: int, hot):  # noqa: ANN001, ANN202
    """The ranges of a shard; with hot (a broadcast bitmap), first occurrences of hot anchors' segments go on instead."""

    def run(table: pa.Table) -> pa.Table:
        get = lambda c: np.asarray(table.column(c))
        order = np.lexsort((get("start"), get("id"), get("segment"), get("anchor")))
        table = table.take(pa.array(order)) if len(order) else table
        anchor, segment, ids, start, n, place = (get(c) for c in ("anchor", "segment", "id", "start", "n", "place"))
        data = table.column("bytes").to_pylist()
        on = in_bitmap(hot.value, anchor.copy()) if hot is not None else np.zeros(len(anchor), bool)
        cold = np.flatnonzero(~on)
        parts = []
        if len(cold):
            _, _, found = _repeats(*(x[cold] for x in (anchor, segment, ids, start, n, place)), [data[i] for i in cold], length)
            parts.append((ids[cold][found[:, 0]], found[:, 1], found[:, 2], None))
        if on.any():
            rows = np.flatnonzero(on)
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (anchor[rows][1:] != anchor[rows][:-1]) | (segment[rows][1:] != segment[rows][:-1])
            head = rows[fresh][np.cumsum(fresh) - 1]
            later = rows[(ids[rows] != ids[head]) | (start[rows] != start[head])]
            parts.append((ids[later], start[later], start[later] + n[later] - 1, None))
            held = {}
            for i, h in zip(rows.tolist(), head.tolist(), strict=True):
                if data[i] is not None:
                    held[h] = data[i]
            go = rows[fresh]
            parts.append((ids[go], start[go], start[go], (anchor[go], segment[go], n[go], place[go], [held[i] for i in go.tolist()])))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["id", "first", "last", "anchor", "segment", "n", "place", "bytes"]
        tables = []
        for who, first, last, more in parts:
            cols = [pa.array(who, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
            cols += [pa.array(x, k) for x, k in zip(more, kinds[3:], strict=True)] if more else [pa.nulls(len(who), k) for k in kinds[3:]]
            tables.append(pa.Table.from_arrays(cols, names))
        return pa.concat_tables(tables) if tables else pa.Table.from_arrays([pa.nulls(0, k) for k in kinds], names)

    return run


def _run(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All strings of a shard by class, id and start, as (bytes, places in them, ids, starts); where its different strings begin, its sorted run;
    and which strings are repeats."""
    ids, start = np.asarray(table.column("id")), np.asarray(table.column("start"))
    held = table.column("bytes").to_pylist()
    flat, piece, offset, kind = _classes(held, length)
    place = _begins(np.array([len(x) for x in held], np.int64))[piece] + offset
    owner, at = ids[piece], start[piece] + offset
    by, fresh, again = _again(kind, owner, at)
    return flat, place[by], owner[by], at[by].astype(np.int32), fresh, again


def _samples(length: int):  # noqa: ANN202
    """What the borders need of a shard's sorted run, by blocks, and the ranges of its strings that repeat within it."""

    def run(table: pa.Table) -> pa.Table:
        flat, place, owner, at, fresh, again = _run(table, length)
        strings = np.lib.stride_tricks.sliding_window_view(flat, length)
        blocks = [fresh[i : i + BLOCK] for i in range(0, len(fresh), BLOCK)]
        samples = [strings[place[f[np.arange(BLOCK_SAMPLE) * len(f) // BLOCK_SAMPLE]]].tobytes() for f in blocks]
        by = np.lexsort((at[again], owner[again]))
        who, when = owner[again][by], at[again][by]
        edges = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (when[1:] != when[:-1] + 1)])) if len(who) else by
        last = when[np.append(edges[1:], len(who)) - 1] if len(who) else when
        cols = [pa.array([None] * len(blocks) + v, t) for v, t in zip([who[edges].tolist(), when[edges].tolist(), last.tolist()], [pa.int64(), pa.int32(), pa.int32()], strict=True)]
        cols += [pa.array(v + [None] * len(edges), t) for v, t in zip([samples, [len(f) for f in blocks]], [pa.binary(), pa.int32()], strict=True)]
        return pa.Table.from_arrays(cols, ["id", "first", "last", "sample", "size"])

    return run


def _pieces(length: int, borders):  # noqa: ANN001, ANN202
    """The sorted run of a shard's different strings, cut at the borders (broadcast, sorted) by binary search; a batch for each block."""
    schema = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        flat, place, owner, at, fresh, _ = _run(table, length)
        strings = np.lib.stride_tricks.sliding_window_view(flat, length)
        batches = []
        for i in range(0, len(fresh), BLOCK):
            f = fresh[i : i + BLOCK]
            raw = strings[place[f]].tobytes(), owner[f].tobytes(), at[f].tobytes()
            cuts = np.searchsorted(np.frombuffer(raw[0], f"S{length}"), borders.value).tolist()
            spans = [(k, a, b) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(f)], strict=True)) if a < b]
            cols = [[k for k, _, _ in spans], *([x[a * w : b * w] for _, a, b in spans] for x, w in zip(raw, (length, 8, 4), strict=True))]
            batches.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema))
        return pa.Table.from_batches(batches, schema)

    return run


Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def merge_runs(a: Run, b: Run) -> tuple[Run, tuple[np.ndarray, np.ndarray]]:
    """Two sorted runs of different strings (strings, ids, starts) as one, and the (ids, starts) of the later occurrences of strings
    in both. The strings of b are looked up in a by binary search."""
    (keys, ids, starts), (more, who, when) = a, b
    place = np.searchsorted(keys, more)
    both = place < len(keys)
    both[both] = keys[place[both]] == more[both]
    at, who_b, when_b = place[both], who[both], when[both]
    ahead = (who_b < ids[at]) | (who_b == ids[at]) & (when_b < starts[at])
    later = np.where(ahead, ids[at], who_b), np.where(ahead, starts[at], when_b)
    ids, starts = ids.copy(), starts.copy()
    ids[at], starts[at] = np.where(ahead, who_b, ids[at]), np.where(ahead, when_b, starts[at])
    new = ~both
    merged = tuple(np.insert(x, place[new], y[new]) for x, y in zip((keys, ids, starts), b, strict=True))
    return merged, later


def _merge(length: int):  # noqa: ANN202
    """The repeats of a range: all its runs merged, two at a time."""

    def run(table: pa.Table) -> pa.Table:
        kinds = (f"S{length}", np.int64, np.int32)
        runs = [tuple(np.frombuffer(x.as_buffer(), k) for x, k in zip(row, kinds, strict=True)) for row in zip(*(table.column(c) for c in ("keys", "ids", "starts")), strict=True)]
        later = []
        while len(runs) > 1:
            pairs = [merge_runs(x, y) for x, y in zip(runs[::2], runs[1::2], strict=False)]
            later += [gone for _, gone in pairs]
            runs = [m for m, _ in pairs] + (runs[-1:] if len(runs) % 2 else [])
        who = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in later)])
        when = np.concatenate([np.zeros(0, np.int32), *(s for _, s in later)])
        by = np.lexsort((when, who))
        who, when = who[by], when[by]
        edges = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (when[1:] != when[:-1] + 1)])) if len(who) else by
        last = when[np.append(edges[1:], len(who)) - 1] if len(who) else when
        return pa.Table.from_arrays([pa.array(x) for x in (who[edges], when[edges], last)], ["id", "first", "last"])

    return run


def _merged_shards(first: DataFrame, length: int, shards: int, log2_bits: int) -> DataFrame:
    """Ranges of the repeats among hot anchors' segments, the first ones of each shard of the first round."""
    spark = first.sparkSession
    # An anchor and segment stand in each shard of the first round once at most.
    equal = Window.partitionBy("anchor", "segment").orderBy("id", "start")
    first = stored(first.withColumn("lead", F.row_number().over(equal) == 1), "segments")
    ranges = first.where("not lead").selectExpr("id", "start as first", "start + n - 1 as last")
    lead = first.where("lead")
    several = lead.groupBy("anchor").count().where("count > 1")
    split = spark.sparkContext.broadcast(bitmap(several, "anchor", log2_bits))

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(split.value, batch.column("anchor").to_numpy())))

    total = several.agg(F.sum("count")).first()[0] or 0
    if not total:
        return ranges
    parts = max(shards // 4, total // SHARD_SEGMENTS)
    dealt = lead.select("anchor", "id", "start", "bytes").mapInArrow(differing, "anchor bigint, id bigint, start int, bytes binary")
    dealt = dealt.withColumn("part", F.expr(f"pmod(xxhash64(id), {parts})")).groupBy("part")
    runs = stored(dealt.applyInArrow(_samples(length), RUN), "runs")
    blocks = runs.where("sample is not null")
    wanted = max(shards // 4, (blocks.agg(F.sum("size")).first()[0] or 0) // RANGE_STRINGS)
    some = blocks.select("sample").orderBy(F.xxhash64("sample")).limit(SAMPLE // BLOCK_SAMPLE).collect()
    sample = np.sort(np.frombuffer(b"".join(r.sample for r in some), f"S{length}"))
    borders = spark.sparkContext.broadcast(np.unique(sample[np.arange(1, wanted) * len(sample) // wanted]))
    merged = dealt.applyInArrow(_pieces(length, borders), PIECE).groupBy("range").applyInArrow(_merge(length), "id bigint, first int, last int")
    return ranges.unionByName(runs.where("sample is null").select("id", "first", "last")).unionByName(merged)


def _cut(length: int):  # noqa: ANN202
    """What is left of each text: columns id, text, ranges (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ranges = batch.column("ranges")
            for row, buf, offsets in text_chunks(batch.column("text")):
                for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                    mark = np.zeros(b - a + 1, np.int32)
                    if ranges[row + i].is_valid:
                        mine = ranges[row + i].values
                        first, last = (np.asarray(mine.field(c)).astype(np.int64) for c in ("first", "last"))
                        np.add.at(mark, np.minimum(first, b - a), 1)
                        np.add.at(mark, np.minimum(last + length, b - a), -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    left = buf[a:b][~gone].tobytes()
                    spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                    for c, v in zip(out, (b - a, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", log2_bits: int = 26) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row.

    Texts are UTF-8 bytes; a null text is empty. Each byte is removed that a string of `length` bytes (32 at least)
    covers which also starts earlier: in a document with a smaller id, or before in the same one. Strings that
    overlap count, all are judged on the input, and none reaches over a text's end. n_spans counts the
    maximal removed runs; kept is what is left, decoded (broken characters replaced), kept_sha256 the hash of its
    bytes. Rows with a null id take no part and stay whole. Rows that repeat an id and its text are one document; if
    they repeat an id with different texts, the ranges of all are cut from each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    used = rows.where(f"id is not null and octet_length(text) >= {length}")
    share = spark.sparkContext.broadcast
    counts = stored(used.mapInArrow(_anchor_hashes(length), "anchor bigint").groupBy("anchor").count().where("count > 1"), "anchors")
    repeated, hot = share(bitmap(counts, "anchor", log2_bits)), share(bitmap(counts.where(F.col("count") >= HOT), "anchor", log2_bits - 3))
    occurrences = counts.agg(F.sum("count")).first()[0] or 0
    shards = max(4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), occurrences // SHARD_ROWS)
    found = used.mapInArrow(_segments(length, shards, repeated, hot), ROW).groupBy("shard").applyInArrow(_shard(length, hot), RANGE)
    found = stored(found, "ranges")
    merged = _merged_shards(found.where("bytes is not null").withColumnRenamed("first", "start"), length, shards, log2_bits - 3)
    ranges = stored(found.where("bytes is null").select("id", "first", "last").unionByName(merged), "ranges")
    cut = share(bitmap(ranges, "id", log2_bits - 1))

    def chosen(within: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.asarray(batch.column("id").fill_null(0))
                there = in_bitmap(cut.value, ids.copy()) & ~np.asarray(batch.column("id").is_null())
                yield batch.filter(pa.array(there == within))

        return run

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        yield from _cut(length)(b.append_column("ranges", pa.nulls(len(b), none)) for b in chosen(False)(batches))

    # Texts that no range can touch don't move. One function chooses and hashes them: with two, each task has two workers.
    whole = rows.mapInArrow(untouched, CUT)
    own = ranges.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    some = rows.mapInArrow(chosen(True), "id bigint, text string").join(own, "id", "left")
    return whole.unionByName(some.mapInArrow(_cut(length), CUT)).withColumnRenamed("id", id_col)
