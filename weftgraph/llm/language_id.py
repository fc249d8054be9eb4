"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._text import released, text_chunks

#: A place outside a word; code points start at 2 here.
EDGE = 1
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter plus 2, or EDGE where it is no letter."""
    if not _tables:
        table = np.full(0x110000, EDGE, np.int64)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = (ord(low) if len(low) == 1 else c) + 2
        _tables.append(table)
    return _tables[0]


def _codes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts, an EDGE before and after each; offsets into them."""
    starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != starts[-1]:  # broken UTF-8: decode text by text
        each = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        points = np.frombuffer("".join(each).encode("utf-32-le", "replace"), np.uint32)
    codes = np.full(len(points) + len(starts), EDGE, np.int64)
    at = np.arange(len(points)) + np.repeat(np.arange(1, len(starts)), np.diff(starts))
    codes[at] = _letters()[points]
    return codes, starts + np.arange(len(starts))


def _grams(codes: np.ndarray) -> np.ndarray:
    """Keys of the 1-, 2- and 3-grams of words of one text, with the words' edges. 21 bits for each character."""
    letter = codes != EDGE
    two = (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    return np.concatenate([codes[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, np.concatenate([c for _, c in parts]))
        return keys, counts

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for row, buf, offsets in text_chunks(batch.column(1)):
            codes, at = _codes(buf, offsets)
            rows = langs[row : row + len(at) - 1]
            for lang in set(rows):
                mine = np.concatenate([codes[at[i] : at[i + 1] + 1] for i in np.flatnonzero(rows == lang)])
                parts = kept.setdefault(lang, [])
                parts.append(np.unique(_grams(mine), return_counts=True))
                if len(parts) > 32:
                    kept[lang] = [merged(parts)]
    for lang, parts in kept.items():
        keys, counts = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = 400) -> DataFrame:
    """(lang, gram, rank): the `size` most frequent n-grams of each language over all rows of docs, ties to the
    smaller gram. Rows with a null language or text teach nothing. Counts are summed in each task first."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(released(_count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The limit stands on row_number itself, so each task keeps `size` of a language before anything is exchanged.
    first = counts.select("lang", "gram", F.row_number().over(order).alias("place")).where(F.col("place") <= size)
    return first.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def identify(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """(id, lang_pred, score) for every row of docs by the smallest out-of-place distance to a profile.

    model: of :func:`profiles`; it holds at most `size` rows a language, and is collected for that reason.
    Whole texts are read. A text that is null or has no letter gets 'und' with score 0; so does every text where
    the model is empty. Equal distances: the language first in alphabetical order. score: 1 minus the distance
    as a share of the greatest possible one. Ids may be null or repeat; each row gets its own answer.
    """
    ranks = model.select("lang", "gram", "rank").toArrow()
    names = sorted(set(ranks.column("lang").to_pylist()))
    keys, at = np.unique(ranks.column("gram").to_numpy(), return_inverse=True)
    places = np.full((len(keys) + 1, max(1, len(names))), size, np.int32)
    places[at, [names.index(x) for x in ranks.column("lang").to_pylist()]] = ranks.column("rank").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((names, keys, places))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, places = shared.value
        for batch in batches:
            best, scores = [], []
            for _, buf, offsets in text_chunks(batch.column(1)):
                codes, at = _codes(buf, offsets)
                for a, b in zip(at, at[1:], strict=False):
                    grams, counts = np.unique(_grams(codes[a : b + 1]), return_counts=True)
                    if not len(grams) or not names:
                        best.append("und")
                        scores.append(0.0)
                        continue
                    if len(grams) > size:  # only those that may be among the first, all ties of the last included
                        least = np.partition(counts, -size)[-size]
                        grams, counts = grams[counts >= least], counts[counts >= least]
                    top = grams[np.lexsort((grams, -counts))[:size]]
                    found = np.searchsorted(keys, top)
                    found[(found == len(keys)) | (keys[np.minimum(found, len(keys) - 1)] != top)] = len(keys)
                    there = places[found]
                    far = np.where(there == size, size, np.abs(there - np.arange(len(top))[:, None])).sum(axis=0)
                    best.append(names[int(far.argmin())])
                    scores.append(1.0 - float(far.min()) / (size * len(top)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
