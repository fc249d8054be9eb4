"""Exact nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors again in double precision."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd


def _pack(size: int, kind: str):  # noqa: ANN202
    """Blocks of up to size vectors of one dimension: ids; 8-bit components; scale, length of the rounding error and length of each vector;
    and the components as they are, in 32 bits where that loses nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int, rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            ids, x = np.array([i for i, _ in rows], np.int64), np.stack([v for _, v in rows])
            small, *sizes = _int8(x)
            short = x.astype(np.float32)
            exact = short if (short.astype(np.float64) == x).all() else x
            values = [[dim], [ids.tobytes()], [small.tobytes()], [np.stack(sizes).tobytes()], [exact.tobytes()]]
            kinds = [pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["dim", *(f"{kind}_{c}" for c in ("ids", "small", "sizes", "x"))])

        for batch in batches:
            flat, at = batch.column(1).flatten(), batch.column(1)
            lengths = np.asarray(at.value_lengths().fill_null(0))
            values = np.asarray(flat.fill_null(np.nan), np.float64)
            starts = np.cumsum(lengths) - lengths
            for i, key in enumerate(batch.column(0).to_pylist()):
                v = values[starts[i] : starts[i] + lengths[i]]
                if key is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    continue
                rows = held.setdefault(len(v), [])
                rows.append((key, v))
                if len(rows) == size:
                    yield block(len(v), held.pop(len(v)))
        for dim, rows in held.items():
            yield block(dim, rows)

    return run


def _int8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers of 8 bits, scale, length of the rounding error, length) of each row."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    whole = np.rint(x / scale[:, None])
    lost = np.sqrt(((x - whole * scale[:, None]) ** 2).sum(axis=1))
    return whole.astype(np.int8), scale, lost, np.sqrt((x**2).sum(axis=1))


def _unpacked(cell: dict, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, 8-bit components, sizes, components) of a block."""
    ids, raw = np.frombuffer(cell[f"{kind}_ids"], np.int64), cell[f"{kind}_x"]
    exact = np.frombuffer(raw, np.float64 if len(raw) == 8 * len(ids) * cell["dim"] else np.float32)
    small = np.frombuffer(cell[f"{kind}_small"], np.int8)
    return ids, small.reshape(len(ids), -1), np.frombuffer(cell[f"{kind}_sizes"]).reshape(3, -1), exact.reshape(len(ids), -1)


def _tile(queries: tuple, candidates: tuple, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best candidates of the tile, exactly: |q.c - q8.c8| <= |q - q8||c| + |q8||c - c8|."""
    q_ids, q8, (qs, q_lost, q_len), q = queries
    c_ids, c8, (cs, c_lost, c_len), c = candidates
    # Products of 8-bit numbers are below 2**14 and their sums exact in float32 up to 2**24: 1,000 dimensions.
    kind = np.float32 if q.shape[1] < 1000 else np.float64
    near = (q8.astype(kind) @ c8.astype(kind).T).astype(np.float64) * qs[:, None] * cs
    wide = q_lost[:, None] * c_len + (q_len + q_lost)[:, None] * c_lost
    wide += 1e-9 * (np.abs(near) + q_len[:, None] * c_len)
    for i in range(len(q_ids)):
        low, high = near[i] - wide[i], near[i] + wide[i]
        own = c_ids == q_ids[i]
        low[own] = high[own] = -np.inf
        n = len(c_ids) - int(own.sum())
        least = np.partition(low, -k)[-k] if n > k else -np.inf
        kept = np.flatnonzero((high >= least) & ~own)
        mine, others, exact = q[i].astype(np.float64), c[kept].astype(np.float64), np.zeros(len(kept))
        for d in range(q.shape[1]):
            exact += mine[d] * others[:, d]
        order = np.lexsort((c_ids[kept], -exact))[:k]
        yield int(q_ids[i]), c_ids[kept][order], exact[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 1024, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest inner product to each query, exactly.

    The queries are a stated set; they meet all candidates in tiles of query_block x block vectors, one task each. A tile's
    int8 products bound each true product; those that can be among its k best are computed again in double
    precision, dimension by dimension. Sorted lists of tiles are merged by a heap. A query isn't its own
    candidate: rows with its id are left out. Ties go to the smaller id. Ids that repeat are separate candidates.
    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, as do those with a null id; only
    vectors of the same dimension meet. Fewer than k candidates give fewer rows; none, no row.
    """
    def packed(df: DataFrame, size: int, kind: str) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
        return rows.mapInArrow(_pack(size, kind), "dim int, " + ", ".join(f"{kind}_{c} binary" for c in ("ids", "small", "sizes", "x")))

    # Blocks meet by an equi-join: each query block is sent once for every group of candidate blocks.
    groups = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = packed(queries.repartition(max(1, groups // 8)), query_block, "q").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = packed(vectors, block, "c").withColumn("g", F.pmod(F.xxhash64("c_ids"), F.lit(groups)).cast("int"))
    tiles = left.join(right, ["dim", "g"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                best = list(_tile(_unpacked(cell, "q"), _unpacked(cell, "c"), k))
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best], pa.int64()), pa.array([b[1].tolist() for b in best], pa.list_(pa.int64())), pa.array([b[2].tolist() for b in best], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        lists = [list(zip([-s for s in scores], ids, strict=True)) for ids, scores in zip(rows["ids"], rows["scores"], strict=True)]
        best = [x for x, _ in zip(heapq.merge(*lists), range(k), strict=False)]
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": np.array([i for _, i in best], np.int64), "score": np.array([-s for s, _ in best], np.float64)})

    found = tiles.drop("g").mapInArrow(multiply, "query_id bigint, ids array<bigint>, scores array<double>")
    return found.groupBy("query_id").applyInPandas(merge, "query_id bigint, rank int, vec_id bigint, score double")
