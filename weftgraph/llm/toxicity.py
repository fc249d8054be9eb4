"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, votes weighted by distance.

Terms are words and the first 4 to 7 bytes of longer words, as insults come inflected. Of these only the terms that labelled rows mark
as toxic count by themselves; all others would drown them, so any other word is one and the same term. Examples that hold marked terms are indexed: postings by term, examples in
blocks of 64 with the largest weight of each term in each block (block-max indexes: Ding and Suel, 2011). A query adds up, for each block, what its terms could
give at most, reads the best blocks in that order, a few first and then more at once, and ends when no other block can reach its k-th best example; so the neighbours are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._tables import stored
from weftgraph.llm._text import LOWER, gather_ranges, give_back, mix, piece_hashes, prefix_sums, released, text_chunks

STEMS = (4, 5, 6, 7)
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
BLOCK = 64
#: A term counts if its likelihood ratio reaches this and its share of toxic rows is so many times that of clean ones; so many count at most.
LEAST_RATIO, LEAST_LIFT, MOST_TERMS = 16.0, 4, 1024
#: Neighbours that vote, the power of their cosine that weighs them, and the weight of the share of toxic rows beside them.
NEIGHBOURS, POWER, PRIOR_WEIGHT = 20, 4, 0.2
#: Query vectors whose results a task remembers.
REMEMBERED = 20_000


def _terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term): hashes of all occurrences of terms in each text; and how many words each text has."""
    low, letter = LOWER[buf], IS_LETTER[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    behind, ahead = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    behind[1:], ahead[:-1] = letter[:-1] & ~first[1:-1], letter[1:] & ~first[1:-1]
    starts, ends = np.flatnonzero(letter & ~behind), np.flatnonzero(letter & ~ahead) + 1
    text, sums = np.searchsorted(offsets, starts, "right") - 1, prefix_sums(low)
    texts, terms = [text], [piece_hashes(sums, starts, ends)]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        texts.append(text[long])
        terms.append(mix(piece_hashes(sums, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(texts), np.concatenate(terms), np.bincount(text, minlength=len(offsets) - 1)


class Vocabulary:
    """Sorted hashes of terms with their weights; a small bitmap in front turns most other terms away. The last number stands for all words."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms, self.idf = terms, np.ones(len(terms) + 1)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[terms & np.uint64((1 << 20) - 1)] = True

    def vectors(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its terms by number and how often each occurs, all words last; nothing for a text without a marked term."""
        for _, buf, offsets in text_chunks(texts, 1 << 20):
            text, term, words = _terms(buf, offsets)
            there = np.flatnonzero(self.seen[term & np.uint64((1 << 20) - 1)])
            text, term = text[there], term[there]
            at = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
            hit = np.flatnonzero(self.terms[at] == term) if len(self.terms) else np.zeros(0, np.int64)
            pair, n = np.unique(text[hit].astype(np.int64) * max(1, len(self.terms)) + at[hit], return_counts=True)
            edges = np.searchsorted(pair, np.arange(len(offsets)) * max(1, len(self.terms)))
            for i, j, w in zip(edges[:-1].tolist(), edges[1:].tolist(), words.tolist(), strict=True):
                yield (np.append(pair[i:j] % len(self.terms), len(self.terms)), np.append(n[i:j], w)) if j > i else (pair[:0], n[:0])

    def weighed(self, terms: np.ndarray, n: np.ndarray) -> np.ndarray:
        """TF-IDF weights of length 1."""
        w = (1 + np.log(n)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())


class BlockMaxIndex:
    """Postings of unit vectors (terms, weights) by term, with the largest weight of each term in each block of 64 vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        row = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        order = np.lexsort((row, term))
        term, self.weight, self.row = term[order], weight[order], row[order]
        # Where the postings of a term in a block begin.
        self.begins = np.searchsorted(term * self.blocks + self.row // BLOCK, np.arange(n_terms * self.blocks + 1))
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, term * self.blocks + self.row // BLOCK, self.weight)
        self.most = self.most.reshape(n_terms, self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k rows of the largest products with the query, larger ones first, then smaller rows; their products; blocks read."""
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        rows, scores, read, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while read < len(order):
            some = order[read : read + step]
            # A block whose bound only ties may hold a smaller row.
            some = some[bound[some] >= (scores[-1] - 1e-9 if len(rows) == k else 1e-12)]
            if not len(some):
                break
            read, step = read + len(some), 8 * step
            places = terms[:, None] * self.blocks + some
            begin, size = self.begins[places], self.begins[places + 1] - self.begins[places]
            at = gather_ranges(begin.ravel(), size.ravel())
            slot = np.zeros(self.blocks, np.int64)
            slot[some] = np.arange(len(some))
            found = np.bincount(slot[self.row[at] // BLOCK] * BLOCK + self.row[at] % BLOCK, self.weight[at] * np.repeat(weights, size.sum(axis=1)), len(some) * BLOCK)
            own = np.flatnonzero(found > 0)
            rows, scores = np.concatenate([rows, some[own // BLOCK] * BLOCK + own % BLOCK]), np.concatenate([scores, found[own]])
            if len(rows) > k:
                near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                best = near[np.lexsort((rows[near], -scores[near]))][:k]
            else:
                best = np.lexsort((rows, -scores))
            rows, scores = rows[best], scores[best]
        return rows, scores, read


def _examples(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict]:
    """(id, text, y, first) of at most max_rows texts of each label, those with the smallest hash of their ids; first is one of the rows with equal texts and labels. Also how many ids of each label there are."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y", F.xxhash64("id").alias("h"))
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = known.where("y = 1").orderBy("h", "id").limit(max_rows).unionByName(known.where("y = 0").orderBy("h", "id").limit(max_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    rows = stored(rows.join(F.broadcast(chosen), "id").select("id", "text", "y", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("n")), "examples")
    first = rows.groupBy("t", "y").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("first"))
    return rows.join(first, "n", "left").select("id", "text", "y", F.coalesce("first", F.lit(False)).alias("first")), total


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """A model from labelled rows of docs: vocabulary, index of examples, and what each example's vote weighs.

    max_rows is the documented bound of what is fitted: at most so many labelled ids of each label, those with the smallest hash. Votes make
    up for that, so that both labels weigh what their shares are among all labelled ids. The weights of terms are counted over all rows of
    docs. An id with different labels, a null id and a null text teach nothing; equal vectors of one label count each time. Without labels of both
    kinds every text gets the share of toxic ones, or one half.
    """
    rows, total = _examples(docs, labels, max_rows, id_col, text_col, label_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, rows with label 1, rows with label 0) of each batch."""
        for batch in batches:
            y = batch.column(1).to_numpy()
            for row, buf, offsets in text_chunks(batch.column(0), 1 << 20):
                text, term, _ = _terms(buf, offsets)
                order = np.lexsort((text, term))
                text, term = text[order], term[order]
                new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])])) if len(term) else np.zeros(0, np.int64)
                text, term = text[new], term[new]
                at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
                one = np.add.reduceat(y[row + text].astype(np.int64), at) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(term[at].view(np.int64)), pa.array(one), pa.array(np.diff(np.append(at, len(term))) - one)], ["term", "a", "b"])

    # Equal texts of one label are one row here, or their every word would look like a mark.
    once = rows.where("first")
    size = {r.y: r.n for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / sum(total.values()) if total else 0.5
    if not size.get(0) or not size.get(1):
        return {"vocabulary": Vocabulary(np.zeros(0, np.uint64)), "index": None, "base": share}
    marks = once.select("text", "y").mapInArrow(released(hashed), "term bigint, a bigint, b bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 2")
    marks = marks.where(f"a * {size[0]} > {LEAST_LIFT} * b * {size[1]}")
    # Dunning's likelihood ratio (1993) of the four cells: term or not, toxic or clean.
    n, t = float(size[0] + size[1]), float(size[1])
    cells = (("a", f"{t}D * (a + b)"), ("b", f"{n - t}D * (a + b)"), (f"({t}D - a)", f"{t}D * ({n}D - a - b)"), (f"({n - t}D - b)", f"{n - t}D * ({n}D - a - b)"))
    g = " + ".join(f"if({k} > 0, {k} * ln({k} * {n}D / ({e})), 0D)" for k, e in cells)
    best = marks.select("term", F.expr(f"2 * ({g})").alias("g")).where(F.col("g") >= LEAST_RATIO).orderBy(F.desc("g"), "term").limit(MOST_TERMS).toArrow()
    words = Vocabulary(np.sort(best.column("term").to_numpy().astype(np.int64).view(np.uint64)))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(shared.value.terms) + 1, np.int64), 0
        for batch in batches:
            for terms, _ in shared.value.vectors(batch.column(0)):
                counts[terms[:-1]] += 1
                n += 1
        counts[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], ["term", "n"])

    # A row for each term.
    seen = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(released(frequencies), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).orderBy("term").toArrow()
    counts = seen.column("n").to_numpy()
    words.idf = np.log(1 + counts[-1] / np.maximum(1, counts))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.vectors(batch.column(2)))
            lists = [pa.array([x.tolist() for x in part], pa.list_(pa.int32())) for part in zip(*found, strict=True)] if found else [pa.array([], pa.list_(pa.int32()))] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "y", "terms", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    # 2 * max_rows vectors of MOST_TERMS terms at most.
    examples = rows.select("id", "y", "text").mapInArrow(released(sparse), f"id {kind}, y int, terms array<int>, n array<int>").toArrow().to_pylist()
    votes = {y: total[y] / max(1, sum(e["y"] == y for e in examples)) for y in (0, 1)}
    blank = [e for e in examples if not e["terms"]]
    held = [(e, np.array(e["terms"], np.int64)) for e in examples if e["terms"]]
    vectors = [(e, t, words.weighed(t, np.array(e["n"]))) for e, t in held]
    # Alike examples stand together, so that few blocks have a term.
    vectors.sort(key=lambda x: (int(x[1][x[2][:-1].argmax()]), -float(x[2][:-1].max()), str(x[0]["id"]), x[0]["y"]))
    weight = {y: sum(votes[y] for e in blank if e["y"] == y) for y in (0, 1)}
    model = {
        "vocabulary": words, "index": BlockMaxIndex([(t, w) for _, t, w in vectors], len(words.idf)), "ids": [x[0]["id"] for x in vectors],
        "y": np.array([x[0]["y"] for x in vectors], np.int64), "votes": np.array([votes[x[0]["y"]] for x in vectors]), "share": share,
        "base": (weight[1] + share) / (weight[0] + weight[1] + 1),
    }
    give_back()
    return model


def vote(model: dict, terms: np.ndarray, n: np.ndarray) -> tuple[float, list]:
    """The score of a vector and its three nearest examples."""
    if not len(terms) or model["index"] is None:
        return model["base"], []
    words: Vocabulary = model["vocabulary"]
    rows, cosine, _ = model["index"].nearest(terms, words.weighed(terms, n), NEIGHBOURS)
    weight = np.minimum(cosine, 1.0) ** POWER * model["votes"][rows] / model["votes"].max(initial=1.0)
    score = (float(weight @ model["y"][rows]) + PRIOR_WEIGHT * model["share"]) / (float(weight.sum()) + PRIOR_WEIGHT)
    return min(1.0, score), [model["ids"][i] for i in rows[:3].tolist()]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, nearest) for every row and its whole text: a score between 0 and 1, and the ids of up to three nearest examples as evidence.

    Null and empty texts, and texts without any term of the vocabulary, get the share of toxic rows among such examples and have no
    evidence. Ids may be null or repeat; an empty table gives no rows; other columns of docs may have any names. Terms are told apart by 64-bit hashes: a text
    built to share one with a marked term gets that term's votes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            out = []
            for terms, n in model["vocabulary"].vectors(batch.column(1)):
                key = terms.tobytes() + n.tobytes()
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = vote(model, terms, n)
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(batch.schema.field(0).type))], ["id", "score", "nearest"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), f"id {kind}, score double, nearest array<{kind}>").withColumnRenamed("id", id_col)
