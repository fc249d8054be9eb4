"""Quality classifier by positive-unlabelled learning with the non-negative risk (Kiryo et al., 2017)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._text import give_back, text_chunks

#: Classes of bytes: letters in lower and upper case, digits, white space, line ends, sentence signs, bars, others.
CLASSES = 8
KIND = np.full(256, 7, np.int64)
KIND[97:123] = 0
KIND[128:] = 0
KIND[65:91] = 1
KIND[48:58] = 2
KIND[[32, 9]] = 3
KIND[[10, 11, 12, 13]] = 4
KIND[[ord(c) for c in ".,;:'\"?-()"]] = 5
KIND[[ord(c) for c in "|<>{}[]=_\\/"]] = 6
WIDTH = CLASSES**3


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the square roots of the shares of its trigrams of byte classes; it has Euclidean length 1."""
    for _, buf, offsets in text_chunks(texts):
        kind = KIND[buf]
        gram = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
            counts = np.bincount(gram[a : b - 2], minlength=WIDTH) if b - a > 2 else np.zeros(WIDTH)
            yield np.sqrt(counts / max(1, b - a - 2))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _adam(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = np.asarray(gradient(w), np.float64)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def nnpu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * R_p(+), R_u(-) - prior * R_p(-)) with the logistic loss: the parts of the unbiased risk, of which the second can't be negative."""
    loss, w = lambda z: np.logaddexp(0, -z), w.astype(p.dtype)
    return prior * float(loss(p @ w).mean()), float(loss(-(u @ w)).mean()) - prior * float(loss(-(p @ w)).mean())


def nnpu_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk; where its second part is negative that is ascended, as in the paper."""
    v = w.astype(p.dtype)  # else each product would copy the rows to the kind of w
    sp, su = _sigmoid(p @ v), _sigmoid(u @ v)
    plus = prior * (p.T @ (sp - 1)) / len(p)
    minus = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    return plus + minus if nnpu_risk(w, p, u, prior)[1] >= 0 else -minus


def _augmented(x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), x.shape[1] + 1), x.dtype)
    np.multiply(x, 4, out=out[:, :-1])
    return out


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.2, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last one a constant) that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), by Adam."""
    p, u = _augmented(positive), _augmented(unlabelled)
    return _adam(lambda w: nnpu_gradient(w, p, u, prior) + decay * w, p.shape[1], steps, rate)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300, rate: float = 0.2) -> float:
    """The share of positives among the unlabelled rows, from these and the positives alone (best bin estimation; Garg et al., 2021).

    A classifier tells positives from unlabelled rows on one half of both. On the other half, among the rows that it takes for positive
    from some score on nearly all unlabelled ones are: their share, by that of the positives, is the estimate. The score is that
    at which an upper bound of it is least."""
    p, u = _augmented(positive[::2]), _augmented(unlabelled[::2])

    def gradient(w: np.ndarray) -> np.ndarray:
        w = w.astype(p.dtype)
        return p.T @ (_sigmoid(p @ w) - 1) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + 1e-3 * w

    w = _adam(gradient, p.shape[1], steps, rate)
    sp, su = (np.sort(4 * (x[1::2] if len(x) > 1 else x) @ w[:-1].astype(x.dtype) + w[-1]) for x in (positive, unlabelled))
    of_p, of_u = 1 - np.arange(len(sp)) / len(sp), 1 - np.searchsorted(su, sp) / len(su)
    slack = np.sqrt(np.log(40) / (2 * len(su))) + np.sqrt(np.log(40) / (2 * len(sp)))
    best = int(((of_u + 2 * slack) / of_p).argmin())
    return float(np.clip(of_u[best] / of_p[best], 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """A model from the trusted positives and unlabelled text among docs: {"weights", "prior"}.

    max_rows is the documented bound of what is fitted. Trusted positives are the rows of label 1, of these at most max_rows with the smallest
    hash of the id. Unlabelled are rows of docs, whatever their labels, which aren't looked at: at most max_rows, those with the smallest hash of the
    id. The class prior is estimated from these two sets; labels of 0 take no part. Rows with a null id or text teach nothing; an id with
    different labels is no positive; an id that repeats counts once for each row. Without positives or unlabelled rows the model scores each text with one half.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    good = known.groupBy("id").agg(F.min("y").alias("y")).where("y = 1").select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(max_rows).select("id", F.lit(1).alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").withColumn("h", F.xxhash64("id"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.astype(np.float32).tobytes() for x in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.array([zlib.crc32(r) for r in rows], pa.int64())], ["h", "x", "c"])

    def sample(part: DataFrame) -> np.ndarray:
        first = part.select("h", "text").mapInArrow(featured, "h bigint, x binary, c bigint").orderBy("h", "c").limit(max_rows).toArrow()
        out = np.empty((first.num_rows, WIDTH), np.float32)
        for i, r in enumerate(first.column("x")):
            out[i] = np.frombuffer(r.as_buffer(), np.float32)
        return out

    # Of all hashes those below this edge hold the max_rows smallest; texts beyond aren't read into features.
    edge = min(1.0, 2 * max_rows / max(1, rows.count()))
    unlabelled = sample(rows.where(F.col("h") / float(1 << 63) <= 2 * edge - 1))
    trusted = sample(rows.join(F.broadcast(good), "id", "left_semi"))
    if not len(trusted) or not len(unlabelled):
        return {"weights": np.zeros(WIDTH + 1), "prior": 0.5}
    prior = class_prior(trusted, unlabelled)
    # With too high a prior the second part of the risk is negative for any good classifier, so the fit takes a little less.
    model = {"weights": fit_nnpu(trusted, unlabelled, 0.97 * prior), "prior": prior}
    del trusted, unlabelled
    give_back()
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row and its whole text, score between 0 and 1. Null and empty texts have the score of a
    text without features, which is that of the constant. Ids may be null or repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model["weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            logits = np.array([4 * float(x @ w[:-1]) + w[-1] for x in features(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(logits), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def kept(docs: DataFrame, model: dict, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score reaches `least`. Scored and filtered in one pass, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model["weights"])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            logits = np.array([4 * float(x @ w[:-1]) + w[-1] for x in features(texts)])
            yield batch.filter(pa.array(_sigmoid(logits) >= least))

    return docs.mapInArrow(run, docs.schema)
