"""Benchmark decontamination by latent semantic retrieval: TF-IDF passages, a distributed randomised SVD in one pass (Tropp,
Yurtsever, Udell and Cevher, 2017), candidates by cosine in the latent space, then longest common subsequences and an answer check.

Candidates are all windows of a text whose latent cosine with an item reaches a bound; they are as long as the item. An item's rarest words
bring further ones, so that whole copies are found at any rank: of n words that a copy may lack, one of any n + 1 is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._tables import scratch, stored
from weftgraph.llm._text import LOWER, gather_ranges, released, sorted_distinct, text_chunks, word_hashes

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Words of half a passage. Passages overlap by half; a last one may be shorter.
HALF = 16
#: Items that are searched for in one go end with so many, or so many words; more go in blocks, each with its own vocabulary and latent
#: space, so what is broadcast has a fixed bound (some 60 MB) but for an item that is longer itself.
ITEMS, ITEM_WORDS = 1_000, 200_000
#: Windows begin at multiples of so many words.
UNIT = 8
#: Words whose rows of the basis or the draw are taken at a time; also the words of texts that are looked at together, a text at least.
PIECE = 1 << 16
#: Rows of a sketch that travel together.
BUCKET = 64
#: An item's answer has so many words at least, a sentence that is judged by itself so many.
ANSWER, SENTENCE = 10, 4


def _word_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of words, words before each text): words are runs of letters and digits, A-Z and Latin-1 lower-cased."""
    for _, buf, offsets in text_chunks(texts):
        low = LOWER[buf]
        behind = np.zeros(len(low), bool)
        behind[1:] = low[:-1] == 0xC3
        low[behind & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 0x20
        word = WORD[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        start, last = word.copy(), word.copy()
        start[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        starts = np.flatnonzero(start)
        yield word_hashes(low, starts, np.flatnonzero(last) + 1), np.searchsorted(starts, offsets)


def _numbered(vocabulary):  # noqa: ANN001, ANN202
    """Texts as numbers of vocabulary words, 0 for all others; texts without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for batch in batches:
            rows = []
            for hashes, before in _word_hashes(batch.column(1)):
                place = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                ids = np.where(words[place] == hashes, place + 1, 0).astype("<u4")
                rows += [ids[a:b].tobytes() if ids[a:b].any() else None for a, b in zip(before.tolist(), before[1:].tolist(), strict=False)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "words"])
            yield out.filter(out.column("words").is_valid())

    return run


def _numbers(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in column]


def _groups(texts: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first, texts): runs of 128 texts or PIECE words at most, a text at least."""
    begin, words = 0, 0
    for i, x in enumerate(texts):
        if i > begin and (i - begin == 128 or words + len(x) > PIECE):
            yield begin, texts[begin:i]
            begin, words = i, 0
        words += len(x)
    if texts:
        yield begin, texts[begin:]


def _df(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for x in _numbers(batch.column("words")):
                counts[sorted_distinct(x)] += 1
        counts[0] = 0
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["word", "df"])

    return run


def sketch_texts(texts: list[np.ndarray], weights: np.ndarray, draw: np.ndarray, total: np.ndarray) -> None:
    """Add A'(A draw) to total, A being the length-normed TF-IDF rows of the passages of some texts: two halves of HALF words,
    each half shared with the next passage."""
    sizes = np.array([len(x) for x in texts], np.int64)
    flat, begin, halves = np.concatenate(texts), np.cumsum(sizes) - sizes, -(-sizes // HALF)
    base = np.cumsum(halves) - halves
    hit = np.flatnonzero(flat)
    if not len(hit):
        return
    owner = np.repeat(np.arange(len(texts)), sizes)[hit]
    words, half = flat[hit], base[owner] + (hit - begin[owner]) // HALF
    n, w = int(halves.sum()), weights[words]
    sums, squares = np.zeros((n + 1, draw.shape[1]), draw.dtype), np.bincount(half, w**2, n + 1)
    edges = np.flatnonzero(np.concatenate([[True], half[1:] != half[:-1]]))
    sums[half[edges]] = np.add.reduceat(draw[words] * w[:, None].astype(draw.dtype), edges, axis=0)
    text = np.repeat(np.arange(len(texts)), halves)
    # A half begins a passage unless it is the last one of several.
    whole = np.concatenate([text[1:] == text[:-1], [False]])
    begins = whole | (np.arange(n) == base[text])
    norm = squares[:n] + np.where(whole, squares[1:], 0)
    share = np.where(begins[:, None], sums[:n] + np.where(whole[:, None], sums[1:], 0), 0) / np.maximum(norm, 1e-9)[:, None].astype(draw.dtype)
    share[1:] += np.where(whole[:-1, None], share[:-1], 0).copy()
    order = np.argsort(words, kind="stable")
    words = words[order]
    edges = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    total[words[edges]] += weights[words[edges], None] * np.add.reduceat(share[half[order]], edges, axis=0)


def _sketch(weights, draw):  # noqa: ANN001, ANN202
    """A task's share of A'(A draw): rows of the words that it has, BUCKET words in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, d = weights.value, draw.value
        total = np.zeros(d.shape)
        for batch in batches:
            for _, texts in _groups(_numbers(batch.column("words"))):
                sketch_texts(texts, w, d, total)
        for b in range(0, len(total), BUCKET):
            if total[b : b + BUCKET].any():
                yield pa.RecordBatch.from_arrays([pa.array([b // BUCKET]), pa.array([total[b : b + BUCKET].tobytes()], pa.binary())], ["bucket", "rows"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum for each bucket. All rows of a bucket come to one task, which holds one sum for each, however many they are."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, x in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True):
            x = np.frombuffer(x.as_buffer())
            sums[b] = sums[b] + x if b in sums else x.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["bucket", "rows"])


def latent_basis(sketch: np.ndarray, draw: np.ndarray, rank: int) -> np.ndarray:
    """The leading `rank` right singular vectors of A, from sketch = A'A draw alone (Nystrom, with a small shift for stability), each
    divided by the root of its singular value: in full length the few directions of common words decide each cosine, at equal lengths noise does."""
    shift = 1e-9 * max(1e-30, float(np.linalg.norm(sketch)))
    shifted = sketch + shift * draw
    core = draw.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-10 * max(1e-30, float(values.max(initial=0)))
    left, sizes, _ = np.linalg.svd(shifted @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    sizes = np.maximum(sizes[:rank], 1e-3 * sizes[:1])
    return np.ascontiguousarray(left[:, :rank] / np.sqrt(sizes)).astype(np.float32)


def _width(size: int) -> int:
    """The length of the windows for items of so many words: 16, 24, 32, 48, 64, 96 and so on, that which holds it."""
    n = 2 * UNIT
    while n < size:
        n = n * 3 // 2 if n & (n - 1) == 0 else n * 4 // 3
    return n


def lcs(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence, in machine words of bits (Hyyro, 2004)."""
    masks: dict[int, int] = {}
    for i, word in enumerate(x):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for word in y:
        if word in masks:
            u = v & masks[word]
            v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


class Items:
    """The items of a block, made for the search.

    Of an item's words, `need` have to be in a stretch of text, so of its rarest size - need + least words `least` have to. Stretches
    are two steps long, a new one begins each step, and a step has room for twice the item.
    """

    def __init__(self, keys: list[int], parts: list[list[np.ndarray]], weights: np.ndarray, basis: np.ndarray, share: float) -> None:
        parts = [[s.tolist() for s in p] for p in parts]
        self.keys, self.words, self.sentences = keys, [sum(p, []) for p in parts], [_joined(p) for p in parts]
        self.answers = [_last(p) for p in parts]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.need = np.maximum(1, np.ceil(share * self.size - 1e-9).astype(np.int64))
        self.least = np.minimum(self.need, np.maximum(1, self.size // 5))
        self.step = 2 * self.size + 2 * HALF
        self.total = np.array([weights[x].sum() for x in self.words])
        word, item, times = [], [], []
        for i, x in enumerate(self.words):
            rare = np.array(sorted(x, key=lambda k: (-weights[k], k))[: len(x) - int(self.need[i]) + int(self.least[i])], np.int64)
            for k, n in zip(*np.unique(rare, return_counts=True), strict=True):
                word.append(k)
                item.append(i)
                times.append(n)
        order = np.argsort(np.array(word, np.int64), kind="stable")
        # The items in which word k is a rare one: entries first[k] to first[k + 1].
        self.first = np.searchsorted(np.array(word, np.int64)[order], np.arange(len(weights) + 1))
        self.item, self.times = np.array(item, np.int64)[order], np.array(times, np.int64)[order]
        self.rows, self.classes = [], {}
        for i, x in enumerate(self.words):
            if x:
                self.classes.setdefault(_width(len(x)), []).append(i)
            k, n = np.unique(np.array(x, np.int64), return_counts=True)
            v = weights[k] * n
            v = v / max(1e-12, float(np.sqrt(v @ v)))
            y = v @ basis[k] if len(k) else np.zeros(basis.shape[1])
            self.rows.append((k, v, (y / max(1e-12, float(np.sqrt(y @ y)))).astype(np.float32)))
        # For each window length: its items, and their latent rows as columns.
        self.classes = {n: (np.array(i), np.stack([self.rows[k][2] for k in i], axis=1)) for n, i in sorted(self.classes.items())}


def _joined(parts: list[list[int]]) -> list[list[int]]:
    """Sentences of SENTENCE words at least: shorter ones go with the one before."""
    out: list[list[int]] = []
    for p in parts:
        if out and (len(p) < SENTENCE or len(out[-1]) < SENTENCE):
            out[-1] = out[-1] + p
        else:
            out.append(p)
    return out


def _last(parts: list[list[int]]) -> list[int]:
    """The answer: the last sentences that have ANSWER words together."""
    out: list[int] = []
    for p in reversed(parts):
        out = p + out
        if len(out) >= ANSWER:
            break
    return out


def _stretches(texts: list[np.ndarray], items: Items) -> Iterator[tuple[int, int, int]]:
    """(text, item, stretch) of the stretches that hold enough of an item's rarest words."""
    sizes = np.array([len(x) for x in texts], np.int64)
    flat, ends = np.concatenate(texts), np.cumsum(sizes)
    n = items.first[flat + 1] - items.first[flat] if len(items.item) else np.zeros(len(flat), np.int64)
    n[flat == 0] = 0
    at = np.flatnonzero(n)
    if not len(at):
        return
    entry = gather_ranges(items.first[flat[at]], n[at])
    at = np.repeat(at, n[at])
    text = np.searchsorted(ends, at, "right")
    item = items.item[entry]
    stretch = (at - (ends - sizes)[text]) // items.step[item]
    most = int(stretch.max()) + 1
    group = (text * len(items.words) + item) * most + stretch
    # A stretch covers its own step and the next one.
    early = stretch > 0
    keys = sorted_distinct(np.concatenate([group, group[early] - 1]) * len(items.item) + np.concatenate([entry, entry[early]]))
    group, entry = keys // len(items.item), keys % len(items.item)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    held, group = np.add.reduceat(items.times[entry], edges), group[edges]
    item = group // most % len(items.words)
    group = group[held >= items.least[item]]
    yield from zip((group // most // len(items.words)).tolist(), (group // most % len(items.words)).tolist(), (group % most).tolist(), strict=True)


def latent_windows(texts: list[np.ndarray], scaled: np.ndarray, items: Items, near: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item, first word, words, cosine) of all windows whose latent cosine with an item is `near` or more.

    scaled: rows of the basis times the words' weights. A window is as long as the item, up to half more, or the whole of a shorter text; one
    begins each quarter of its length, at multiples of UNIT words."""
    units = np.array([-(-len(x) // UNIT) for x in texts], np.int64)
    begin = np.cumsum(units) - units
    padded = np.zeros(int(units.sum()) * UNIT, np.int64)
    for x, b in zip(texts, (begin * UNIT).tolist(), strict=True):
        padded[b : b + len(x)] = x
    sums, piece = np.zeros((len(padded) // UNIT + 1, scaled.shape[1])), PIECE // UNIT
    for i in range(0, len(sums) - 1, piece):
        part = scaled[padded[i * UNIT : (i + piece) * UNIT]].reshape(-1, UNIT, scaled.shape[1]).sum(axis=1)
        np.cumsum(part, axis=0, dtype=np.float64, out=sums[i + 1 : i + 1 + len(part)])
        sums[i + 1 : i + 1 + len(part)] += sums[i]
    for width, (which, rows) in items.classes.items():
        long, step = width // UNIT, max(1, width // UNIT // 4)
        n = np.maximum(0, -(-(units - long) // step)) + 1
        text = np.repeat(np.arange(len(texts)), n)
        first = begin[text] + gather_ranges(np.zeros(len(n), np.int64), n) * step
        last = np.minimum(first + long, begin[text] + units[text])
        # Blocks of windows and items, so that scores have a bound.
        for j in range(0, len(first), PIECE // 8):
            y = (sums[last[j : j + PIECE // 8]] - sums[first[j : j + PIECE // 8]]).astype(np.float32)
            y /= np.maximum(1e-9, np.sqrt(np.einsum("ij,ij->i", y, y)))[:, None]
            for i in range(0, len(which), 256):
                scores = y @ rows[:, i : i + 256]
                at, item = np.nonzero(scores >= near)
                cosines, at = np.minimum(1, scores[at, item]), at + j
                yield from zip(text[at].tolist(), which[i + item].tolist(), ((first[at] - begin[text[at]]) * UNIT).tolist(), [width] * len(at), cosines.tolist(), strict=True)


def _cosine(region: np.ndarray, row: tuple[np.ndarray, np.ndarray, np.ndarray], size: int, weights: np.ndarray, basis: np.ndarray) -> tuple[float, int]:
    """The largest cosine of a passage of the region with an item, in the latent space or of the TF-IDF rows themselves, which no rank
    bounds, and where that passage begins. Passages are as long as the item, two halves at least. A passage that repeats words
    counts as shorter than it is, so none falls short of its cosine."""
    words, shares, latent = row
    w = weights[region]
    place = np.minimum(np.searchsorted(words, region), len(words) - 1)
    dots = np.where(words[place] == region, shares[place], 0) * w
    step = max(HALF, size // 2)
    edges = np.arange(0, len(region), step)
    halves = np.add.reduceat(np.column_stack([dots, w * w, basis[region] * w[:, None]]), edges, axis=0)
    if len(halves) > 1:
        halves = halves[:-1] + halves[1:]
    y = halves[:, 2:]
    exact = halves[:, 0] / np.sqrt(np.maximum(1e-12, halves[:, 1]))
    near = (y @ latent) / np.sqrt(np.maximum(1e-12, (y * y).sum(axis=1)))
    best = np.minimum(1, np.maximum(exact, near))
    return float(best.max()), int(edges[best.argmax()])


def _agreement(region: np.ndarray, i: int, items: Items, weights: np.ndarray, share: float, answer_share: float, told: float) -> float:
    """The share of item i that the longest common subsequence with the region has, 0 where a check fails."""
    item = items.words[i]
    near_by = region[region > 0].tolist()
    there = set(near_by)
    held = [w for w in item if w in there]
    if len(held) < share * len(item) - 1e-9 or weights[held].sum() < told * items.total[i]:
        return 0.0
    ratio = max(lcs(item, near_by), sum(lcs(x, near_by) for x in items.sentences[i])) / len(item)
    good = ratio >= share - 1e-9 and lcs(items.answers[i], near_by) >= answer_share * len(items.answers[i])
    return ratio if good else 0.0


def _checked(texts: list[np.ndarray], weights: np.ndarray, basis: np.ndarray, scaled: np.ndarray, items: Items, near: float, reworded: float, share: float, answer_share: float, told: float) -> Iterator[tuple]:
    """(text, item key, cosine, share of the item, first word) of the candidates that pass."""
    for t, i, first, width, cosine in latent_windows(texts, scaled, items, near):
        ratio = _agreement(texts[t][max(0, first - width // 2) : first + width + width // 2], i, items, weights, reworded, answer_share, told)
        if ratio:
            yield t, items.keys[i], cosine, ratio, first
    for t, i, s in _stretches(texts, items):
        step = int(items.step[i])
        region = texts[t][s * step : (s + 2) * step]
        ratio = _agreement(region, i, items, weights, share, answer_share, told)
        if ratio:
            cosine, first = _cosine(region, items.rows[i], len(items.words[i]), weights, basis)
            yield t, items.keys[i], cosine, ratio, s * step + first


def _search(weights, basis, items, *bounds: float):  # noqa: ANN001, ANN202
    """Pairs (document, item) that pass all checks, with the best passage of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = weights.value, basis.value
        scaled = b * w[:, None].astype(np.float32)
        for batch in batches:
            ids, found = batch.column("id").to_pylist(), []
            for i, texts in _groups(_numbers(batch.column("words"))):
                found += [(ids[i + t], *rest) for t, *rest in _checked(texts, w, b, scaled, items.value, *bounds)]
            best: dict[tuple, tuple] = {}
            for row in sorted(found, key=lambda f: (-f[3], -f[2], f[4])):
                best.setdefault(row[:2], row)
            cols = list(zip(*best.values(), strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "cosine", "lcs", "first_word"])

    return run


def _sentences(texts: list[str]) -> list[list[np.ndarray]]:
    """The hashes of the words of each sentence of each text."""
    out = []
    for text in texts:
        parts = text.replace("\n", ". ").replace("? ", ". ").replace("! ", ". ").split(". ")
        hashes = [h[a:b] for h, at in _word_hashes(pa.array(parts, pa.string())) for a, b in zip(at, at[1:], strict=False)]
        out.append([h for h in hashes if len(h)])
    return out


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[list[np.ndarray]]]]:
    """Keys and sentences of the items, ITEMS at most or ITEM_WORDS words and one item more."""
    keys, parts, words = [], [], 0
    for row in items.toLocalIterator():
        keys.append(row.id)
        parts += _sentences([row.text])
        words += sum(map(len, parts[-1]))
        if len(keys) == ITEMS or words >= ITEM_WORDS:
            yield keys, parts
            keys, parts, words = [], [], 0
    yield keys, parts


def contaminated(
    docs: DataFrame, benchmark: DataFrame, near: float = 0.6, reworded: float = 0.45, share: float = 0.55, answer_share: float = 0.4, told: float = 0.45, rank: int = 64, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, first_word): the documents that hold a benchmark item, whole or paraphrased.

    The matrix has the documents' passages (32 words, a new one every 16) and the items as TF-IDF rows over the items' words (idf over all documents:
    log(1 + N / df), which a word in all of them has too, so no leak hides itself by its copies); items together weigh as much as all
    passages, so the `rank` singular directions tell items apart. Candidates are a text's windows of an item's length that have a
    latent cosine of `near` with it. The longest common subsequence with the window and half its length on either side, of the item or of its sentences one by one,
    which may then stand in another order, reaches `reworded` of the item; that of its answer (the last sentences with ten
    words together) answer_share of the answer; and the item's words that are there have `told` of the weight of all of them, so that common words
    alone don't make a match. Stretches of four times an item's length that hold enough of its rarest words are candidates too, whatever their cosine; there the subsequence
    reaches `share`. One row for a document and item, with its best passage. Items go in blocks of 1,000, each with a latent space and two passes of its own. Null or
    wordless texts and items match nothing; null ids take no part. Rows that repeat an id count as one document. Columns may have any
    names; an empty table on either side gives no rows. Texts and items may be of any length; the windows of an item longer than the text are that text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("id is not null and text <> ''")
    found = spark.createDataFrame([], FOUND)
    with scratch(spark) as keep:
        total = max(1, rows.count())
        for keys, parts in _blocks(items):
            if any(parts):
                with scratch(spark) as kept:
                    found = found.unionByName(kept(_found(rows, total, keys, parts, rank, near, reworded, share, answer_share, told), "block"))
        best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("cosine", "lcs", "first_word"), F.struct("lcs", "cosine", -F.col("first_word"))).alias("b"))
        best = best.select("doc_id", "item_id", "b.cosine", "b.lcs", "b.first_word")
        return keep(best, "contaminated").withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


FOUND = "doc_id bigint, item_id bigint, cosine double, lcs double, first_word int"


def _found(rows: DataFrame, total: int, keys: list[int], parts: list[list[np.ndarray]], rank: int, *bounds: float) -> DataFrame:
    """The rows for one block of items."""
    vocabulary = sorted_distinct(np.concatenate([h for p in parts for h in p]))
    share_out = rows.sparkSession.sparkContext.broadcast
    texts_table = stored(rows.mapInArrow(released(_numbered(share_out(vocabulary))), "id bigint, words binary"), "passages")
    counts = texts_table.mapInArrow(_df(len(vocabulary)), "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    df = np.ones(len(vocabulary) + 1)
    df[counts.column("word").to_numpy()] = np.maximum(1, counts.column("df").to_numpy())
    weights = np.log1p(total / df)
    weights[0] = 0
    parts = [[np.searchsorted(vocabulary, h) + 1 for h in p] for p in parts]
    w = share_out(weights)
    draw = np.random.default_rng(7).standard_normal((len(vocabulary) + 1, min(rank + 8, len(vocabulary)))).astype(np.float32)
    shares = texts_table.mapInArrow(released(_sketch(w, share_out(draw))), "bucket bigint, rows binary")
    sketch = np.zeros(draw.shape)
    for r in shares.repartition("bucket").mapInArrow(_summed, "bucket bigint, rows binary").toLocalIterator():
        sketch[r.bucket * BUCKET : (r.bucket + 1) * BUCKET] += np.frombuffer(r.rows).reshape(-1, draw.shape[1])
    # Items are rows of the matrix as well, repeated until they are as many as the passages.
    passages = texts_table.agg(F.sum(F.ceil(F.length("words") / (4 * HALF)))).first()[0] or 0
    times = max(1, passages / len(parts))
    for p in parts:
        x = np.concatenate(p) if p else np.zeros(0, np.int64)
        k, n = np.unique(x, return_counts=True)
        v = weights[k] * n
        sketch[k] += times * np.outer(v, v @ draw[k]) / max(1e-12, float(v @ v))
    basis = latent_basis(sketch, draw.astype(np.float64), rank)
    block = share_out(Items(keys, parts, weights, basis, bounds[2]))
    return texts_table.mapInArrow(released(_search(w, share_out(basis), block, *bounds)), FOUND)
