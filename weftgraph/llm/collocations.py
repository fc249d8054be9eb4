"""Collocations of two to four words per language, from counts of the longest windows alone.

Each word of a piece opens one window: itself and the up to three words behind it, padded where the piece ends. Windows are counted, and
a ROLLUP over their columns sums them to all shorter phrases: what begins with a, b is the sum of the windows that begin with
a, b, whatever follows. So no n-grams of other lengths are ever made.

All parts of a phrase of `least` occurrences have as many (Agrawal and Srikant, 1994). Windows therefore end before the word that makes them rarer, which
changes no count that matters and leaves few different windows. What is frequent enough is found beforehand, from counts of hashes, length
by length, and kept in bitmaps that are sized by their number up to a fixed limit; what shares a hash or both its places with something frequent only
costs rows, which the counts of the windows' own words drop later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._tables import bitmap, in_bitmap, stored
from weftgraph.llm._text import BASE, LOWER, gather_ranges, mix, piece_hashes, prefix_sums, released, text_chunks

LONGEST = 4
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
#: [.,;:!?\x0A-\x0D] end a piece, [\x20\x09] a word.
ENDS_PIECE, ENDS_WORD = np.zeros(256, bool), np.zeros(256, bool)
ENDS_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
ENDS_WORD[[32, 9]] = True
#: Bytes of text whose windows are counted together, and different hashes that a task holds before it passes them on.
CHUNK, HELD = 1 << 20, 1 << 21
#: Bits of a bitmap at most, as a power of two: 32 MB; up to there, bits for each of its hashes at least.
MOST_BITS, BITS_EACH = 28, 64
#: Low bits of a hash that are its bucket, at least, and the greatest count of an entry.
BUCKET_BITS, MOST_TIMES = 10, 127
#: Bits of a hash by which its second place in a bitmap lies higher; MOST_BITS + SECOND bits are known of each, BUCKET_BITS + 32.
SECOND = 14
#: Parts of a language that are ranked by themselves first.
SALTS = 64


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, the text of each, and a number of its piece that differs from its neighbours'."""
    apart = ENDS_PIECE[buf]
    inside = ~(apart | ENDS_WORD[buf])
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    behind, ahead = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    behind[1:], ahead[:-1] = inside[:-1] & ~first[1:-1], inside[1:] & ~first[1:-1]
    starts, ends = np.flatnonzero(inside & ~behind), np.flatnonzero(inside & ~ahead) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, text, np.cumsum(apart)[starts] + text


def _language_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    own = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(own, np.uint64)[coded.indices.to_numpy()] if own else np.zeros(0, np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(words of _words, lower-case bytes, hash of each word with its language, languages of the texts)."""
    for batch in batches:
        for row, buf, offsets in text_chunks(batch.column(1), CHUNK):
            langs = batch.column(0).slice(row, len(offsets) - 1)
            low = LOWER[buf]
            spans = _words(low, offsets)
            hashes = mix(piece_hashes(prefix_sums(low), spans[0], spans[1]) ^ _language_hashes(langs)[spans[2]])
            yield spans, low, hashes, langs


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both places of hashes, by their low and by higher bits, are set."""
    out = in_bitmap(bits, hashes)
    out[out] = in_bitmap(bits, hashes[out] >> np.uint64(SECOND))
    return out


def _both_places(often: DataFrame) -> np.ndarray:
    """The bitmap of :func:`_known` of the hashes h in often."""
    size = min(MOST_BITS, max(16, (BITS_EACH * often.count()).bit_length()))
    return bitmap(often.select(F.explode(F.expr(f"array(h, shiftrightunsigned(h, {SECOND}))")).alias("h")), "h", size)


def _frequent(spans: tuple, hashes: np.ndarray, bitmaps: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For phrases of 1, 2, .. len(bitmaps) words, which words begin one that is frequent; then the words that begin a phrase of one word
    more whose parts are frequent, and hashes of these phrases."""
    together = np.zeros(len(hashes), bool)
    together[:-1] = spans[3][1:] == spans[3][:-1]
    begins, grown, may = [], hashes, np.ones(len(hashes), bool)
    for length, bits in enumerate(bitmaps, 1):
        at = np.flatnonzero(may)
        known = np.zeros(len(hashes), bool)
        known[at] = _known(bits.value, grown[at])
        begins.append(known)
        may = np.zeros(len(hashes), bool)
        may[:-1] = known[:-1] & known[1:] & together[:-1]
        at = np.flatnonzero(may)
        longer = np.zeros(len(hashes), np.uint64)
        longer[at] = mix(grown[at] * BASE ^ hashes[at + length])
        grown = longer
    return begins, np.flatnonzero(may), grown


def _count(bitmaps: list, bits: int):  # noqa: ANN202
    """(bucket, lows, ns): occurrences of phrases that are a word longer than the last of the bitmaps has, by language, summed over the task. Of
    a phrase's hash the low `bits` bits are its bucket, the next 32 stand in lows; counts of more than MOST_TIMES are dealt to several entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, parts = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, n = np.concatenate([keys, *(k for k, _ in parts)]), np.concatenate([counts, *(c for _, c in parts)])
            order = np.argsort(every, kind="stable")
            every, n = every[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            return every[at], np.add.reduceat(n, at) if len(at) else n

        def sent() -> pa.RecordBatch:
            times = -(-counts // MOST_TIMES)
            key, n = np.repeat(keys, times), np.full(int(times.sum()), MOST_TIMES)
            n[np.cumsum(times) - 1] = counts - (times - 1) * MOST_TIMES
            bucket = key >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.zeros(0, np.int64)
            offsets = pa.array(np.append(first, len(key)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (key.astype(np.uint32).view(np.int32), n.astype(np.int8))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), *lists], ["bucket", "lows", "ns"])

        for spans, _, hashes, _ in _chunks(batches):
            _, at, grown = _frequent(spans, hashes, bitmaps)
            grown = grown[at]
            # Sorted by bucket, so each bucket's are together.
            turned = (grown & np.uint64((1 << bits) - 1)) << np.uint64(32) | grown >> np.uint64(bits) & np.uint64(0xFFFFFFFF)
            parts.append(np.unique(turned, return_counts=True))
            if sum(len(k) for k, _ in parts) > HELD:
                keys, counts = merged()
                parts = []
                if len(keys) > HELD:
                    yield sent()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield sent()

    return run


def _often(rows: DataFrame, bitmaps: list, least: int) -> DataFrame:
    """(h): the hashes that :func:`_count` counts `least` times or more, by as many bits as a bitmap's two places take, or more. They travel
    as arrays, a row for each task and bucket, which takes half the room of a row for each."""
    bits = max(BUCKET_BITS, (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    packed = rows.mapInArrow(released(_count(list(bitmaps), bits)), "bucket int, lows array<int>, ns array<tinyint>").repartition("bucket")
    each = packed.select("bucket", F.inline(F.arrays_zip("lows", "ns"))).groupBy("bucket", "lows").agg(F.sum("ns").alias("n"))
    return each.where(F.col("n") >= least).select(F.expr(f"bucket + shiftleft(cast(lows as bigint) & 4294967295L, {bits})").alias("h"))


def _dense(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the pairs (high, low), and a place of each number."""
    pair = high.astype(np.int64) * (int(low.max(initial=0)) + 1) + low
    _, at, number = np.unique(pair, return_index=True, return_inverse=True)
    return number, at


def _windows(bitmaps: list):  # noqa: ANN202
    """(lang, w1 .. w4, n): the different windows of each chunk, all of whose parts are frequent; '' pads them, and stands for rare words in w1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spans, low, hashes, langs in _chunks(batches):
            starts, ends, text, _ = spans
            if not len(starts):
                continue
            begins = _frequent(spans, hashes, bitmaps)[0]
            known = begins[0]
            where, size = starts[known], ends[known] - starts[known]
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            strings = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(low[gather_ranges(where, size)]))
            # By bytes, so words whose hashes are equal stay apart.
            coded = strings.dictionary_encode()
            code = np.zeros(len(starts) + LONGEST, np.int64)
            code[: len(starts)][known] = coded.indices.to_numpy() + 1
            columns = [code[: len(starts)]]
            for i in range(1, LONGEST):
                columns.append(np.where(begins[i], code[i : len(starts) + i], 0))
            of = langs.dictionary_encode()
            number, first = of.indices.to_numpy()[text].astype(np.int64), None
            for column in columns:
                number, first = _dense(number, column)
            n = np.bincount(number, minlength=len(first))
            names = pa.concat_arrays([pa.array([""], pa.large_string()), coded.dictionary])
            out = [names.take(pa.array(c[first])).cast(pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([of.dictionary.take(pa.array(of.indices.to_numpy()[text[first]])), *out, pa.array(n)], ["lang", *WORDS, "n"])

    return run


def phrase_counts(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, words, f): phrases of one to four words that occur `least` times or more in a language, and for each language a row of
    size 0 with the number of all its words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bitmaps: list = []
    for _ in range(LONGEST):
        often = stored(_often(rows, bitmaps, least), "frequent")
        bitmaps.append(docs.sparkSession.sparkContext.broadcast(_both_places(often)))
    windows = rows.mapInArrow(released(_windows(bitmaps)), f"lang string, {', '.join(f'{w} string' for w in WORDS)}, n bigint")
    # Each window is summed over all tasks before the ROLLUP makes a row of it for each length.
    windows = windows.groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
    sums = windows.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # Level 2 ** m - 1 has lost m columns; a padded one is no phrase of its length.
    size = F.expr(f"{LONGEST} - cast(bit_count(level) as int)")
    whole = " and ".join(f"coalesce({w}, 'x') <> ''" for w in WORDS)
    kept = sums.withColumn("size", size).where(f"size = 0 or (size > 0 and f >= {least} and {whole})")
    words = F.expr(f"filter(array({', '.join(WORDS)}), w -> w is not null)")
    return kept.select("lang", "size", words.alias("words"), "f")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, contained: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` collocations.

    A-Z become a-z; ``.,;:!?`` and line ends part a text into pieces, blanks and tabs a piece into words. Phrases of two to four words that
    occur a >= `least` times within pieces are candidates. Cut after its first k words a candidate has l occurrences of the
    first part, r of the rest, and the score floor(2000000 a / (l + r)); the least score counts, of equal ones that with the smallest k. Candidates go whose
    words stand together in a longer one with 100 f(longer) >= `contained` a. The rest is ranked by score and a, descending, then by the bytes
    of the phrase. n is the number of all words of the language.

    A null text counts as empty, a null lang as `und`. Repeated rows count each time; ids play no part. An empty table gives no rows, and so does a
    language without candidates. Other columns of docs may have any names.
    """
    counts = stored(phrase_counts(docs, least, text_col, lang_col), "phrases").withColumn("phrase", F.array_join("words", " "))
    parts, totals = counts.where("size > 0").select("lang", "phrase", "f"), counts.where("size = 0").select("lang", F.col("f").alias("n"))
    found = counts.where("size > 1").select("lang", "phrase", "words", "size", F.col("f").alias("a"))
    joined = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cuts = found.select("lang", "phrase", "a", "words", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"]).join(parts.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"])
    exact = "cast({} as decimal(19, 0))"
    score = F.expr(f"cast({exact.format('a')} * 2000000 div ({exact.format('l')} + {exact.format('r')}) as bigint)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    inside = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(inside, ["lang", "phrase"], "left").where(f"longer is null or {exact.format('longer')} * 100 < {exact.format('a')} * {contained}")
    ranked = free.select("lang", "phrase", "a", "best.*").withColumn("salt", F.expr(f"pmod(xxhash64(phrase), {SALTS})"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for part in (["lang", "salt"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    # Languages are few; a row for each.
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
