"""SentencePiece encoding as a relational lattice, and decoding.

The distinct words of all texts are taken apart into all substrings of bounded length; an equi-join with the piece
table keeps those that are pieces; grouped by word they are the edges of its lattice, and a fold with Spark's
higher-order `aggregate` finds the best path (Viterbi). So each word is solved once, however often it occurs. The
texts are then encoded by a dictionary of words: the most frequent ones, up to a fixed number, are broadcast; the
others reach the texts that hold them by a join on the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm._tables import stored
from weftgraph.llm._text import gather_ranges, give_back, released, text_chunks, word_hashes

if TYPE_CHECKING:
    import pandas as pd

SPACE = "▁"
#: The score of a sign that no piece holds.
NO_PIECE = -1000.0
#: Places of a word that are folded together. Pieces have no more signs.
BLOCK = 64
#: Words of more ids aren't broadcast.
SHORT = 64
#: Words kept in a task before they are handed on.
TASK_WORDS = 400_000


def load_pieces(path: str, scores: str = "rank") -> pd.DataFrame:
    """(id, piece, score, byte) of a model file. byte: the byte of a fallback piece, else -1; control pieces are
    left out. scores: "model" takes the file's scores (unigram models); "rank" takes minus the logarithm of the
    piece's rank, a log probability by Zipf's law up to a constant: the scores of a BPE model are merge ranks, whose sum says nothing about a
    path's probability."""
    import pandas as pd
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows, rank = [], 0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        byte = int(piece[3:5], 16) if model.is_byte(i) else -1
        rank += byte < 0
        rows.append((i, piece, model.get_score(i) if scores == "model" else -float(np.log(rank + 1)), byte))
    return pd.DataFrame(rows, columns=["id", "piece", "score", "byte"])


def joints(pieces: pd.DataFrame) -> np.ndarray:
    """256 x 256: whether some piece holds a character that ends in the one byte before a character that begins with the other."""
    out = np.zeros((256, 256), bool)
    for piece in pieces.loc[pieces["byte"] < 0, "piece"]:
        raw = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
        inner = (raw[1:] & 0xC0) != 0x80
        out[raw[:-1][inner], raw[1:][inner]] = True
    return out


def _words(texts: pa.Array, joined: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, word starts, word ends, words before each text) of runs of texts, each text with a space in front.

    A word is a run of spaces with the run of other signs behind it, taken apart where no piece can reach across
    (joined: the table of :func:`joints`), so that the best paths of its parts make up its own.
    """
    for row, buf, offsets in text_chunks(texts):
        full = np.diff(offsets) > 0
        buf = np.insert(buf, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        n = len(buf)
        space = buf == 32
        start = np.zeros(n, bool)
        start[1:] = space[1:] & ~space[:-1] | ~joined[buf[:-1], buf[1:]] & ((buf[1:] & 0xC0) != 0x80)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start |= edge[:n]
        starts = np.flatnonzero(start)
        yield row, buf, starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, offsets)


def _distinct(joined):  # noqa: ANN001, ANN202
    """The distinct words of a task's texts; joined: a broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted_words(batches, joined.value)

    return run


def _counted_words(batches: Iterator[pa.RecordBatch], joined: np.ndarray) -> Iterator[pa.RecordBatch]:
    hashes, counts, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def rows() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(hashes), 20000):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + 20000].view(np.int64)), pa.array([w.decode("utf-8", "replace") for w in words[i : i + 20000]], pa.string()), pa.array(counts[i : i + 20000])], ["hash", "word", "n"])

    for batch in batches:
        for _, buf, starts, ends, _ in _words(batch.column(0), joined):
            found, where, n = np.unique(word_hashes(buf, starts, ends), return_index=True, return_counts=True)
            place = np.searchsorted(hashes, found)
            known = place < len(hashes)
            known[known] = hashes[place[known]] == found[known]
            counts[place[known]] += n[known]
            raw, new = buf.tobytes(), ~known
            fresh = np.empty(int(new.sum()), object)
            fresh[:] = [raw[a:b] for a, b in zip(starts[where[new]], ends[where[new]], strict=True)]
            hashes, counts, words = np.insert(hashes, place[new], found[new]), np.insert(counts, place[new], n[new]), np.insert(words, place[new], fresh)
            if len(hashes) > TASK_WORDS:
                yield from rows()
                hashes, counts, words = hashes[:0], counts[:0], words[:0]
    yield from rows()


def lattice(words: DataFrame, pieces: pd.DataFrame) -> tuple[DataFrame, DataFrame]:
    """(head, edges) of words of up to BLOCK signs, (head, chunks) of the longer ones: for each word the pieces that lie in it as (end, start,
    id, score), sorted; a chunk for each BLOCK ends; id -1 for a sign that is no piece. head: the word's columns. The piece table is
    broadcast: its size is that of the vocabulary."""
    import pandas as pd  # not in the workers, where it takes memory for nothing

    plain = pieces[pieces["byte"] < 0]
    longest = int(plain["piece"].str.len().max())
    if longest > BLOCK:
        raise ValueError(f"a piece has more than {BLOCK} signs")
    table = pd.DataFrame({"piece": plain["piece"].str.replace(SPACE, " "), "id": plain["id"], "score": plain["score"]})
    table = words.sparkSession.createDataFrame(table, "piece string, id int, score double")
    # What is grouped holds a word once, with its first sign, and not once for each edge: long words stay linear.
    parts = words.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))
    parts = parts.withColumn("tail", F.expr(f"substring(word, start + 1, {longest})"))
    parts = parts.withColumn("size", F.explode(F.expr("sequence(1, length(tail))"))).withColumn("piece", F.expr("substring(tail, 1, size)"))
    edges = parts.join(F.broadcast(table), "piece", "left").where("id is not null or size = 1")
    edge = F.struct((F.col("start") + F.col("size")).alias("end"), "start", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(NO_PIECE)).alias("score"))
    head = F.when(F.expr("start = 0 and size = 1"), F.struct(words.columns))
    edges = edges.select("hash", "key", "length", head.alias("head"), edge.alias("edge"))
    sorted_edges = F.sort_array(F.collect_list("edge"))
    short = edges.where(f"length <= {BLOCK}").groupBy("hash", "key").agg(F.max("head").alias("head"), sorted_edges.alias("edges"))
    long = edges.where(f"length > {BLOCK}").groupBy("hash", "key", F.expr(f"(edge.end - 1) div {BLOCK}").alias("chunk")).agg(F.max("head").alias("head"), sorted_edges.alias("edges"))
    long = long.groupBy("hash", "key").agg(F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("chunk", "edges"))).alias("chunks"))
    return short.select("head", "edges"), long.select("head", F.col("chunks.edges").alias("chunks"))


def short_viterbi_sql() -> tuple[str, str]:
    """SQL of the two folds for a short word: over `edges` to the best edge into each place (an array, by place), and over
    that, `best`, backwards to the path.

    The edges come by their ends. The best one into the end at hand is s.last; it joins the array when the next end begins. An
    edge has to be better to replace another, so of equal ones that with the smallest start stays, the longest piece."""
    kind = "struct<score:double,start:int,id:int>"
    node = "named_struct('score', {0} + e.score, 'start', e.start, 'id', e.id)"
    source = f"cast(named_struct('score', 0D, 'start', 0, 'id', -1) as {kind})"
    zero = f"named_struct('best', cast(array() as array<{kind}>), 'end', 0, 'last', {source})"
    seen = "s.best[e.start].score"
    first = node.format(f"if(e.start = s.end, s.last.score, {seen})")
    next_end = f"named_struct('best', concat(s.best, array(s.last)), 'end', e.end, 'last', {first})"
    better = f"named_struct('best', s.best, 'end', s.end, 'last', {node.format(seen)})"
    step = f"if(e.end > s.end, {next_end}, if({seen} + e.score > s.last.score, {better}, s))"
    forward = f"aggregate(edges, {zero}, (s, e) -> {step}, s -> concat(s.best, array(s.last)))"
    walk = "named_struct('at', best[s.at].start, 'path', concat(array(best[s.at]), s.path))"
    begin = f"named_struct('at', size(best) - 1, 'path', cast(array() as array<{kind}>))"
    return forward, f"aggregate(best, {begin}, (s, e) -> if(s.at = 0, s, {walk}), s -> s.path)"


def long_viterbi_sql() -> tuple[str, str]:
    """:func:`short_viterbi_sql` for a long word: over `chunks` to an array of nodes for each chunk, and over these, `best`, backwards
    to the path. A fold copies its state in each step, so each has an inner one over a chunk, whose state is small. No piece is longer
    than a chunk, so scores are looked up in this chunk (s.open) or the one before it."""
    kind = "struct<score:double,start:int,id:int>"
    none, lists = f"cast(array() as array<{kind}>)", f"cast(array() as array<array<{kind}>>)"
    source = f"cast(named_struct('score', 0D, 'start', 0, 'id', -1) as {kind})"
    base = f"size(t.done) * {BLOCK}"
    seen = f"if(e.start > {base}, s.open[cast(e.start - {base} - 1 as int)], t.before[cast(e.start - {base} + size(t.before) - 1 as int)]).score"
    node = "named_struct('score', {score} + e.score, 'start', e.start, 'id', e.id)"
    first = node.format(score=f"if(e.start = s.end and e.start > {base}, s.last.score, {seen})")
    # Nothing is pushed before the first end of a chunk.
    pushed = f"if(s.end > {base}, concat(s.open, array(s.last)), s.open)"
    next_end = f"named_struct('open', {pushed}, 'end', e.end, 'last', {first})"
    better = f"named_struct('open', s.open, 'end', s.end, 'last', {node.format(score=seen)})"
    step = f"if(e.end > s.end, {next_end}, if({seen} + e.score > s.last.score, {better}, s))"
    begin = f"named_struct('open', {none}, 'end', cast({base} as int), 'last', {source})"
    inner = f"aggregate(c, {begin}, (s, e) -> {step}, s -> concat(s.open, array(s.last)))"
    outer = f"named_struct('done', {lists}, 'before', array({source}))"
    forward = f"aggregate(chunks, {outer}, (t, c) -> transform(array({inner}), b -> named_struct('done', concat(t.done, array(b)), 'before', b))[0], t -> t.done)"

    here = f"best[k][cast(s.at - k * {BLOCK} - 1 as int)]"
    walk = f"if(s.at <= k * {BLOCK}, s, named_struct('at', {here}.start, 'path', concat(s.path, array({here}))))"
    part = f"aggregate(best[k], named_struct('at', t.at, 'path', {none}), (s, e) -> {walk})"
    steps = "reverse(sequence(0, size(best) - 1))"
    start = f"named_struct('at', (size(best) - 1) * {BLOCK} + size(element_at(best, -1)), 'paths', {lists})"
    back = f"aggregate({steps}, {start}, (t, k) -> transform(array({part}), p -> named_struct('at', p.at, 'paths', concat(t.paths, array(p.path))))[0], t -> reverse(flatten(t.paths)))"
    return forward, back


def solve_words(words: DataFrame, pieces: pd.DataFrame) -> DataFrame:
    """words plus `ids`: the piece ids of each word's best path. words: distinct by `word`, with two hashes `hash` and `key` and its `length`,
    a space standing for the space sign; it may have further columns. A character that no piece holds becomes its bytes' pieces. Of paths
    with the same score the one whose last pieces are longer wins. Words have no greatest length."""
    byte_ids = ",".join(map(str, pieces[pieces["byte"] >= 0].sort_values("byte")["id"].tolist())) or "-1"
    short, long = lattice(words, pieces)
    solved = [part.select("head", F.expr(a).alias("best")).select("head", F.expr(b).alias("path")) for part, (a, b) in ((short, short_viterbi_sql()), (long, long_viterbi_sql()))]
    number = "cast(conv(substring(hex(encode(sign, 'utf-8')), 2 * i + 1, 2), 16, 10) as int)"
    as_bytes = f"transform(sequence(0, octet_length(sign) - 1), i -> array({byte_ids})[{number}])"
    of_sign = f"transform(array(substring(head.word, p.start + 1, 1)), sign -> {as_bytes})[0]"
    ids = F.expr(f"flatten(transform(path, p -> if(p.id >= 0, array(p.id), {of_sign})))")
    return solved[0].unionByName(solved[1]).select("head.*", ids.alias("ids"))


def word_dictionary(docs: DataFrame, pieces: pd.DataFrame, text_col: str = "text") -> DataFrame:
    """(hash, word, n, ids) of the distinct words of all texts; n: how often it occurs."""
    joined = docs.sparkSession.sparkContext.broadcast(joints(pieces))
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    found = texts.mapInArrow(released(_distinct(joined)), "hash bigint, word string, n bigint")
    # The length is an aggregate, so that a condition on it isn't moved below the exchange, which short and long words share.
    # Dealt by the keys by which the edges of a word are grouped, so those aren't exchanged again. Each task's words are distinct already.
    dealt = found.repartition("hash").withColumn("key", F.xxhash64("word"))
    words = dealt.groupBy("hash", "key", "word").agg(F.sum("n").alias("n"), F.max(F.length("word")).alias("length"))
    return stored(solve_words(words, pieces).select("hash", "word", "n", "ids"), "words")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        rows = [np.asarray(batch.column("hash")).tobytes(), np.asarray(ids.value_lengths()).astype("<i4").tobytes(), np.asarray(ids.flatten()).astype("<i4").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in rows], ["hash", "size", "ids"])


def frequent_words(dictionary: DataFrame, max_words: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], bool]:
    """Sorted hashes, places and ids of at most max_words words of up to SHORT ids, the most frequent ones, and whether these are all.

    The cut is a power of two of the count, found from a histogram. Words that share a hash with another word of the
    dictionary are left out, so a hash in the result stands for one word of the texts."""
    bins = dictionary.where(F.size("ids") <= SHORT).groupBy(F.floor(F.log2("n")).alias("b")).count().orderBy(F.desc("b")).collect()
    least, total = None, 0
    for b, n in bins:
        if total + n > max_words:
            break
        least, total = 1 << int(b), total + n
    shared = dictionary.groupBy("hash").count().where("count > 1").select("hash")
    kept = dictionary.where("false" if least is None else f"n >= {least} and size(ids) <= {SHORT}").join(shared, "hash", "left_anti")
    rows = kept.select("hash", "ids").mapInArrow(_packed, "hash binary, size binary, ids binary").toArrow()

    def read(column: str, kind: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(r.as_buffer(), kind) for r in rows.column(column)] + [np.zeros(0, kind)])

    hashes, sizes, ids = read("hash", "<u8"), read("size", "<i4"), read("ids", "<i4")
    del rows
    ids = ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids
    order = np.argsort(hashes)
    at = np.stack([(np.cumsum(sizes, dtype=np.int32) - sizes)[order], sizes[order]], axis=1)
    hashes = hashes[order]
    give_back()
    return (hashes, at, ids), len(hashes) == dictionary.count()


def _spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray]):  # noqa: ANN202
    """For the distinct words among buf[start:end]: which one each is, where the first of each stands, its place and size in the ids
    of held, and whether it is there."""
    hashes, at, _ = held
    found, first, which = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    place = np.searchsorted(hashes, found)
    known = place < len(hashes)
    known[known] = hashes[place[known]] == found[known]
    span = np.zeros((len(found), 2), np.int64)
    span[known] = at[place[known]]
    return which, first, span, known


def _lacking(shared):  # noqa: ANN001, ANN202
    """(key, word): the distinct words of each text that aren't in shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = shared.value
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            for row, buf, starts, ends, before in _words(batch.column("text"), joined):
                which, first, _, known = _spans(buf, starts, ends, held)
                word = np.flatnonzero(~known[which])
                text = np.searchsorted(before, word, "right") - 1
                pairs = np.unique(text * max(1, len(known)) + which[word])
                text, k = pairs // max(1, len(known)), pairs % max(1, len(known))
                raw = buf.tobytes()
                words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[k]].tolist(), ends[first[k]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[row + text]), pa.array(words, pa.string())], ["key", "word"])

    return run


def _apply(shared):  # noqa: ANN001, ANN202
    """Encode texts (the column text); own: (word, ids) of words that aren't in shared, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = shared.value
        for batch in batches:
            own = batch.column("own")
            for row, buf, starts, ends, before in _words(batch.column("text"), joined):
                which, first, span, known = _spans(buf, starts, ends, held)
                ids, raw, extra = held[2], buf.tobytes(), []
                if not known.all():
                    told = {w["word"]: w["ids"] for r in range(row, row + len(before) - 1) if own[r].is_valid for w in own[r].as_py()}
                    size = len(ids)
                    for k in np.flatnonzero(~known).tolist():
                        more = told[raw[starts[first[k]] : ends[first[k]]].decode("utf-8", "replace")]
                        span[k] = size, len(more)
                        extra.append(np.array(more, np.int32))
                        size += len(more)
                    ids = np.concatenate([ids.astype(np.int32), *extra])
                span = span[which]
                ends_at = np.concatenate([[0], np.cumsum(span[:, 1])])[before]
                out = pa.ListArray.from_arrays(pa.array(ends_at.astype(np.int32)), pa.array(ids[gather_ranges(span[:, 0], span[:, 1])].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, len(before) - 1), out], ["row", "ids"])

    return run


def encode(docs: DataFrame, pieces: pd.DataFrame, text_col: str = "text", max_words: int = 3_000_000, decode_to: str | None = None) -> DataFrame:
    """The rows of docs plus `ids`, the piece ids of the whole text with a space in front, as SentencePiece has it.

    A null or empty text has no pieces. Every other text decodes to itself: spaces are kept as they are, and a
    literal space sign (U+2581) is spelt in bytes. max_words bounds the broadcast (some 25 bytes a word); it doesn't change the result. Rows and ids may
    repeat, each row gets its ids; an empty table gives no rows.
    A column `ids` of docs is replaced; other columns may have any name. decode_to: a column for the decoded texts; the same task then encodes and
    decodes, with one worker instead of two.
    """
    spark = docs.sparkSession
    dictionary = word_dictionary(docs, pieces, text_col)
    words, whole = frequent_words(dictionary, max_words)
    shared = spark.sparkContext.broadcast((words, joints(pieces)))
    apply, spell = _apply(shared), _speller(spark, pieces, decode_to) if decode_to else None
    kept = docs.drop("ids", *([decode_to] if decode_to else []))
    # The own columns of docs travel in one struct, so their names can't clash with those of this operator.
    rows = docs.select(F.struct(kept.columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    own = "array<struct<word:string,ids:array<int>>>"
    if whole:
        rows = rows.withColumn("own", F.lit(None).cast(own))
    else:
        rows = rows.withColumn("key", F.xxhash64("text"))
        lacking = rows.select("key", "text").where("text <> ''").mapInArrow(released(_lacking(shared)), "key bigint, word string").distinct()
        told = lacking.join(dictionary.select("word", "ids"), "word").groupBy("key").agg(F.collect_list(F.struct("word", "ids")).alias("own"))
        rows = rows.join(told, "key", "left").select("row", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return spell(apply(batches)) if spell else apply(batches)

    schema = T.StructType().add("row", kept.schema).add("ids", T.ArrayType(T.IntegerType()))
    schema = schema.add(decode_to, T.StringType()) if decode_to else schema
    return rows.mapInArrow(released(run), schema).select("row.*", "ids", *([F.col(f"`{decode_to}`")] if decode_to else []))


def _speller(spark: SparkSession, pieces: pd.DataFrame, to: str):  # noqa: ANN202
    """Batches with a column `ids` get the column `to`, the texts."""
    size = int(pieces["id"].max()) + 1
    spelt = [b""] * size
    for r in pieces.itertuples():
        spelt[r.id] = bytes([r.byte]) if r.byte >= 0 else r.piece.replace(SPACE, " ").encode()
    sizes = np.array([len(s) for s in spelt] + [0], np.int64)
    shared = spark.sparkContext.broadcast((np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(sizes) - sizes, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, sizes = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                ids = part.column("ids")
                lengths = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
                flat = np.asarray(ids.flatten()).astype(np.int64)
                flat = np.where((flat >= 0) & (flat < len(sizes) - 1), flat, len(sizes) - 1)
                raw = data[gather_ranges(starts[flat], sizes[flat])].tobytes()
                ends = np.concatenate([[0], np.cumsum(sizes[flat])])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
                texts = [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, to])

    return run


def decode(encoded: DataFrame, pieces: pd.DataFrame, to: str = "decoded") -> DataFrame:
    """The rows of encoded plus the text of `ids` in the column `to`. Null ids give null; unknown ids nothing."""
    schema = T.StructType([*encoded.schema.fields]).add(to, T.StringType())
    return encoded.mapInArrow(released(_speller(encoded.sparkSession, pieces, to)), schema)
