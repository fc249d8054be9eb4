"""Token ids as files: a static range asymmetric numeral system with interleaved lanes (Duda 2013; Giesen 2014).

A file row holds consecutive documents of about ROW_TOKENS ids: their ids and lengths, one frequency table that
all blocks of the row share, and the blocks. A block is encoded alone, with its own checksum and lane states, and
holds further states as checkpoints, so that blocks and the stretches between checkpoints decode in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._text import IS_SPACE, LOWER, gather_ranges, text_chunks, word_hashes

LANES = 1024
#: Steps of all lanes between two checkpoints, and in a block.
CHECKPOINT_STEPS = 256
BLOCK_TOKENS = LANES * 512
ROW_TOKENS = 1 << 22
SCALE = 20
LOW = np.uint64(1 << 31)

# --- the coder ---


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts of symbols as whole shares of 2**SCALE; each symbol that occurs gets one at least."""
    if not counts.sum():
        return np.zeros(len(counts), np.int64)
    share = np.where(counts > 0, np.maximum(1, counts * (1 << SCALE) // counts.sum()), 0)
    left = (1 << SCALE) - int(share.sum())
    for i in np.argsort(-share, kind="stable"):
        if left == 0:
            break
        step = left if left > 0 else max(left, 1 - int(share[i]))
        share[i] += step
        left -= step
    return share


def encode_block(symbols: np.ndarray, share: np.ndarray, first: np.ndarray) -> bytes:
    """One block: header, checkpoints (word position and lane states before the step), words."""
    n, steps = len(symbols), -(-len(symbols) // LANES)
    state = np.full(LANES, LOW, np.uint64)
    words, marks = [], []
    for step in range(steps - 1, -1, -1):
        s = symbols[step * LANES : (step + 1) * LANES]
        f, x = share[s].astype(np.uint64), state[: len(s)]
        full = x >= (f << np.uint64(63 - SCALE))
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(s)] = (q << np.uint64(SCALE)) + (x - q * f) + first[s].astype(np.uint64)
        if step % CHECKPOINT_STEPS == 0:
            marks.append((len(words), state.copy()))
    sizes = np.cumsum([0] + [len(w) for w in words])
    data = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = struct.pack("<IIII", n, len(data), len(marks), zlib.crc32(symbols.astype("<u4").tobytes()))
    return head + b"".join(struct.pack("<I", int(sizes[-1] - sizes[k])) + x.astype("<u8").tobytes() for k, x in marks[::-1]) + data.astype("<u4").tobytes()


def decode_block(block: bytes, share: np.ndarray, first: np.ndarray, symbol_at: np.ndarray, stretch: int | None = None) -> np.ndarray:
    """The symbols of a block, or those of one stretch between checkpoints alone. The checksum is verified."""
    n, n_words, n_marks, crc = struct.unpack_from("<IIII", block)
    size = 4 + 8 * LANES
    words = np.frombuffer(block, "<u4", n_words, 16 + n_marks * size).astype(np.uint64)
    out = np.zeros(n, np.int64)
    mask = np.uint64((1 << SCALE) - 1)
    for k in range(n_marks) if stretch is None else [stretch]:
        at = struct.unpack_from("<I", block, 16 + k * size)[0]
        state = np.frombuffer(block, "<u8", LANES, 20 + k * size).astype(np.uint64)
        for step in range(k * CHECKPOINT_STEPS, min((k + 1) * CHECKPOINT_STEPS, -(-n // LANES))):
            x = state[: min(LANES, n - step * LANES)]
            slot = x & mask
            s = symbol_at[slot.view(np.int64)]
            out[step * LANES : step * LANES + len(s)] = s
            x = share[s].astype(np.uint64) * (x >> np.uint64(SCALE)) + slot - first[s].astype(np.uint64)
            empty = np.flatnonzero(x < LOW)
            x[empty] = (x[empty] << np.uint64(32)) | words[at : at + len(empty)]
            at += len(empty)
            state[: len(x)] = x
    if stretch is not None:
        return out[stretch * CHECKPOINT_STEPS * LANES : (stretch + 1) * CHECKPOINT_STEPS * LANES]
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of token ids doesn't match its checksum")
    return out


def pack_table(share: np.ndarray) -> bytes:
    return zlib.compress(share.astype("<u4").tobytes(), 6)


def unpack_table(table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, their running sums, and the symbol of each of the 2**SCALE slots."""
    share = np.frombuffer(zlib.decompress(table), "<u4").astype(np.int64)
    return share, np.cumsum(share) - share, np.repeat(np.arange(len(share)), share)


# --- tokenising: each distinct piece is given to the library once in a worker ---


class PieceEncoder:
    """Ids of texts by the tokenizers library, with a cache of pieces.

    Valid for a tokenizer that lower-cases, drops white space, and splits into runs of letters, single digits and
    runs of other signs: no token crosses such a border, so a text's ids are those of its pieces. Only words of
    ASCII and Latin-1 letters without an apostrophe or `<` are split so; any other word goes to the library as
    it stands.
    """

    LIMIT = 1_500_000

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros((0, 2), np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def pieces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with plain words in lower case, piece starts, piece ends)."""
        n = len(buf)
        lead = buf == 0xC3
        behind = np.zeros(n, bool)
        behind[1:] = lead[:-1]
        odd = (buf >= 0x7F) & ~lead & (~behind | (buf == 0x97) | (buf == 0xB7)) | (buf < 0x20) & ~IS_SPACE[buf] | (buf == 0x27) | (buf == 0x3C)
        space = IS_SPACE[buf]
        begins = np.zeros(n + 1, bool)
        begins[1:n] = space[:-1]
        begins[offsets] = True
        begins = begins[:n] & ~space
        word = np.cumsum(begins) - 1
        plain = np.ones(n, bool)
        if odd.any():
            plain = np.bincount(word[odd & ~space], minlength=int(word[-1]) + 1)[word] == 0
        low = LOWER[buf]
        low[behind & (buf >= 0x80) & (buf <= 0x9E)] += 0x20
        low = np.where(plain, low, buf)
        letter = (low >= 97) & (low <= 122) | (low >= 0x80)
        digit = (low >= 48) & (low <= 57)
        cut = np.zeros(n, bool)
        cut[1:] = (letter[1:] != letter[:-1]) | digit[1:] | digit[:-1]
        begins |= cut & plain & ~space
        last = ~space
        last[:-1] &= begins[1:] | space[1:]
        return low, np.flatnonzero(begins), np.flatnonzero(last) + 1

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin (one entry more)."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        low, starts, ends = self.pieces(buf, offsets)
        hashes = word_hashes(low, starts, ends)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        if not known.all():
            new = where[~known]
            if len(self.hashes) + len(new) > self.LIMIT and len(self.hashes):
                self.clear()
                return self(buf, offsets)
            raw = low.tobytes()
            found = self.library.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new], ends[new], strict=True)], add_special_tokens=False)
            ids = [x.ids for x in found]
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.array([i for x in ids for i in x], np.int32)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            at = np.stack([self.used + np.cumsum(sizes) - sizes, sizes], axis=1)
            self.used += len(flat)
            self.hashes, self.at = np.insert(self.hashes, place[~known], distinct[~known]), np.insert(self.at, place[~known], at, axis=0)
            place = np.searchsorted(self.hashes, distinct)
        at = self.at[place[back]]
        before = np.concatenate([[0], np.cumsum(at[:, 1])])
        return self.pool[gather_ranges(at[:, 0], at[:, 1])], before[np.searchsorted(starts, offsets)]


_encoders: dict[str, PieceEncoder] = {}


def _tokenize(path: str, end_id: int, bounds: list[int]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = PieceEncoder(path)
        for batch in batches:
            keys = batch.column(0)
            part = np.searchsorted(np.array(bounds, np.int64), np.asarray(keys.fill_null(-(1 << 63))), "left")
            for row, buf, offsets in text_chunks(batch.column(1), 1 << 22):
                ids, at = _encoders[path](buf, offsets)
                at = at.tolist()
                data = [_narrow(np.append(ids[a:b], end_id)) for a, b in zip(at, at[1:], strict=False)]
                n = len(data)
                yield pa.RecordBatch.from_arrays([pa.array(part[row : row + n].astype(np.int32)), keys[row : row + n], pa.array(data, pa.binary())], ["part", "id", "ids"])

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where they suffice, else four; the last byte tells which."""
    return ids.astype("<u2").tobytes() + b"2" if ids.max(initial=0) < 1 << 16 else ids.astype("<u4").tobytes() + b"4"


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(memoryview(packed)[:-1], f"<u{packed[-1:].decode()}").astype(np.int64)


FILE_SCHEMA = "part int, part_start bigint, n_tokens bigint, ids array<bigint>, lengths array<bigint>, table binary, blocks array<binary>"


def _write_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, part, keys, docs, held = 0, None, [], [], 0

    def row() -> pa.RecordBatch:
        ids = np.concatenate(docs)
        share = frequencies(np.bincount(ids))
        first = np.cumsum(share) - share
        blocks = [encode_block(ids[i : i + BLOCK_TOKENS], share, first) for i in range(0, len(ids), BLOCK_TOKENS)]
        values = [[part], [done], [len(ids)], [keys], [[len(d) for d in docs]], [pack_table(share)], [blocks]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "part_start", "n_tokens", "ids", "lengths", "table", "blocks"])

    for batch in batches:
        for p, key, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if docs and (held >= ROW_TOKENS or p != part):
                yield row()
                done, keys, docs, held = (done + held if p == part else 0), [], [], 0
            elif p != part:
                done = 0
            part = p
            keys.append(key)
            docs.append(_wide(packed))
            held += len(docs[-1])
    if docs:
        yield row()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write the ids under path in ascending order of the integer id.

    tokenizer: the path of a tokenizers file that :class:`PieceEncoder` fits. Null texts count as empty; null ids
    come first; rows that repeat an id follow each other, ordered by their encoded ids. An empty table gives files without rows.
    Ids are dealt out by quantiles of the id column, so only encoded ids are shuffled, and once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.select("id").where("id is not null").agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0] or []
    bounds = sorted(set(cuts))
    encoded = rows.mapInArrow(_tokenize(tokenizer, end_id, bounds), "part int, id bigint, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("id").asc_nulls_first(), "ids")
    dealt.mapInArrow(_write_rows, FILE_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents under path, decoded row by row in parallel.

    start counts the ids of all documents before it. Only the sums of the parts (as many as write_tokens had
    partitions) reach the driver.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = dict(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).toArrow().to_pandas().itertuples(index=False, name=None))
    base, total = {}, 0
    for part in sorted(sums):
        base[part], total = total, total + sums[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, start, _, keys, lengths, table, blocks = (batch.column(i)[r].as_py() for i in range(7))
                share, first, symbol_at = unpack_table(table)
                ids = np.concatenate([decode_block(b, share, first, symbol_at) for b in blocks]).astype("<u4")
                ends = np.cumsum(np.array(lengths, np.int64))
                begins = ends - np.array(lengths, np.int64)
                raw = ids.view(np.uint8)
                cols = [pa.array(keys, pa.int64()), pa.array(begins + base[part] + start), pa.array(ends - begins), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return files.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
